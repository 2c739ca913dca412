"""Personal information inside free text: a character-level bidirectional LSTM with a CRF on top, all in numpy.

Windows are cut around everything that could belong to a mention (capitals side by side, longer runs of digits,
at-signs, house numbers); each is tagged by the network, the best tag path is found by Viterbi, and the spans of
overlapping windows are reconciled over the whole text. An exact check then moves a span to the borders of its form and
drops those that have none. Weights come from ``pii_train``; they are a parameter of the operator.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import Columns, map_lists, transpose
from ..scratch import spread

KINDS = ["name", "email", "phone", "id_number", "address"]
TAGS = 1 + 2 * len(KINDS)
"""0 outside; 1 + 2k begins and 2 + 2k continues a mention of kind k."""
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
LEFT, RIGHT = 30, 26
"""Characters of context on either side of what could be a mention."""
ROWS = 256
"""Windows tagged at once. A shorter batch is filled up, so that a window's numbers never depend on its company."""
WINDOW, OVERLAP = 192, 64
"""Longer stretches are cut into windows of WINDOW characters that overlap by OVERLAP."""
CACHED = 200_000
"""Windows whose spans a worker remembers; a bound on memory, not on work."""

_CAP = "A-Z" + "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)]) if c.isupper())
"""Capitals of the Latin, Greek and Cyrillic scripts, as the inside of a character class."""
_PARTICLE = r"(?:van|von|vom|zu|du|des?|de la|del|de los|della|da|dos|di|der|den|ter|le|la|el|y|e)"
# Every form begins with one of a few characters, which the search skips to; the branches look back at it.
TRIGGER = re.compile(
    rf"[@\[(+,\d{_CAP}](?:"
    rf"(?<=@)[\w .\[\]()-]{{0,40}}|(?<=[\[(])\s?at\s?[\])][\w .\[\]()-]{{0,40}}"
    rf"|(?:(?<=[+(])[+(]?\d|(?<=\d))(?:[ .()/\-–]{{0,3}}[\dA-ZÑ]){{4,}}"
    rf"|(?<=[{_CAP}])[{_CAP}]{{0,2}}-?\d{{5,}}"
    rf"|(?<=[{_CAP}])[\w'’-]*[.,]?,? \d{{1,3}}(?!\d)"
    rf"|(?<=\d)(?<![\d.,:-].)\d{{0,2}} ?[a-zA-Z]?(?: bis| ter)?,? (?:[{_CAP}]|[a-z]+ (?:d[eu]s?|aux?|l[ae]s?) |[a-z]+ d')"
    rf"|(?<=\w,) \d{{1,3}}(?!\d)(?! [a-z])"
    rf"|(?<=[{_CAP}])(?:[\w'’-]+,?|\.,?)\s(?:[{_CAP}]\.,?\s|{_PARTICLE}\s){{0,4}}[{_CAP}])"
)
LEAST_DIGITS = 5
"""A phone or identity number has at least so many digits; fewer name nobody."""
_LINK = re.compile(r"\[\[[^\[\]\n]{1,200}\]\]")

_ALPHABET = "\n\t !\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~ßàâäáçéèêëíîïñóôöúùûüœ°º–—«»„“”’"
SYMBOLS = len(_ALPHABET) + 5
"""0 pads; then the alphabet; then any other capital, small letter, digit and character."""
_IDS = np.full(0x110000, SYMBOLS - 1, np.uint8)


def _fill_ids() -> None:
    for i in range(0x3000):
        c = chr(i)
        _IDS[i] = SYMBOLS - 4 if c.isupper() else SYMBOLS - 3 if c.isalpha() else SYMBOLS - 2 if c.isdigit() else SYMBOLS - 1
    for i, c in enumerate(_ALPHABET):
        _IDS[ord(c)] = i + 1


_fill_ids()


def encode(windows: list[str], rows: int = 0) -> np.ndarray:
    """[window, position] of symbols, padded with 0; at least so many rows."""
    longest = max(map(len, windows))
    out = np.zeros((max(len(windows), rows), longest), np.uint8)
    for i, w in enumerate(windows):
        out[i, : len(w)] = _IDS[np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return out


def _sigmoid_of_negated(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in place; where exp overflows the result is 0."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Tagger:
    """W: [2, symbols, 4H] input by symbol; U: [2, H, 4H]; O: [2H, tags], o; A: transitions; first, last."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}
        h = self.w["U"].shape[1]
        # tanh(x) = 2 sigmoid(2x) - 1: with the candidate's weights doubled one sigmoid serves all four gates.
        # The sign that the sigmoid needs is in the weights too.
        scale = -np.ones(4 * h, np.float32)
        scale[3 * h :] = -2
        self.W, self.U, self.h = self.w["W"] * scale, self.w["U"] * scale, h
        # A stretch of n other tags wins at most enter + leave + (n - 1) * inner against staying outside.
        a, first, last = self.w["A"] - self.w["A"][0, 0], self.w["first"], self.w["last"]
        enter, leave = max(a[0, 1:].max(), (first - first[0])[1:].max()), max(a[1:, 0].max(), (last - last[0])[1:].max())
        self.safe = float(max(a[1:, 1:].max(), enter + leave, 0.0))

    @np.errstate(over="ignore")
    def emissions(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """[tag, position, window]. Either direction begins at a window's own end: for the backward one the windows
        stand at the right side, so that padding comes after what is read and has no effect."""
        b, t = ids.shape
        h, outs = self.h, np.empty((2, t, b, self.h), np.float32)
        gap = t - lens
        at = np.arange(t)[:, None]
        left = np.ascontiguousarray(ids.T).astype(np.intp)
        right = np.take_along_axis(left, np.maximum(at - gap, 0), 0)
        for d in range(2):
            state, cell, table, u = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32), self.W[d], self.U[d]
            z, came, squashed = np.empty((b, 4 * h), np.float32), np.empty((b, 4 * h), np.float32), np.empty((b, h), np.float32)
            i, f, o, g = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            columns = right if d else left
            for s in range(t - 1, -1, -1) if d else range(t):
                np.matmul(state, u, out=z)
                np.take(table, columns[s], 0, out=came, mode="clip")
                z += came
                _sigmoid_of_negated(z)
                g *= 2
                g -= 1
                g *= i
                cell *= f
                cell += g
                np.multiply(cell, -2, out=squashed)
                _sigmoid_of_negated(squashed)
                squashed *= 2
                squashed -= 1
                state = outs[d, s]
                np.multiply(o, squashed, out=state)
        o = self.w["O"]
        e = (o[:h].T @ outs[0].reshape(-1, h).T).reshape(-1, t, b)
        back = (o[h:].T @ outs[1].reshape(-1, h).T).reshape(-1, t, b)
        e += np.take_along_axis(back, np.minimum(at + gap, t - 1)[None], 1) if gap.any() else back
        e += self.w["o"][:, None, None]
        return e

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The best tag path of each window, [window, position]; what stands after a window's end means nothing."""
        e = self.emissions(ids, lens)
        path = np.zeros(ids.shape, np.uint8)
        # Where "outside" leads at every character by more than any change of tags can win, its path is the best one.
        lead = e[0] - e[1:].max(0)
        lead[np.arange(len(lead))[:, None] >= lens] = np.inf
        unsure = np.flatnonzero(lead.min(0) <= self.safe)
        if len(unsure):
            path[unsure] = self._viterbi(np.ascontiguousarray(e[:, :, unsure]), lens[unsure])
        return path

    def _viterbi(self, e: np.ndarray, lens: np.ndarray) -> np.ndarray:
        k, t, b = e.shape
        scores, trans = np.empty((t, k, b), np.float32), self.w["A"][:, :, None]
        scores[0] = e[:, 0] + self.w["first"][:, None]
        ended = lens.min()
        for s in range(1, t):
            np.add((scores[s - 1][:, None, :] + trans).max(0), e[:, s], out=scores[s])
            if s >= ended:
                # A window that has ended keeps its last scores.
                over = s >= lens
                scores[s][:, over] = scores[s - 1][:, over]
        path, into = np.empty((b, t), np.uint8), np.ascontiguousarray(self.w["A"].T)
        path[:, -1] = (scores[-1] + self.w["last"][:, None]).argmax(0)
        for s in range(t - 1, 0, -1):
            path[:, s - 1] = (scores[s - 1].T + into[path[:, s]]).argmax(1)
            if s >= ended:
                over = s >= lens
                path[over, s - 1] = path[over, s]
        return path


@functools.lru_cache(4)
def load_tagger(path: str) -> Tagger:
    with np.load(path) as z:
        return Tagger(dict(z))


def tagged_spans(path: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(start, end, kind) of a tag path."""
    spans, start, kind = [], None, None
    p = path[:length]
    marked = np.flatnonzero(p)
    if not len(marked):
        return spans
    for i in range(int(marked[0]), int(marked[-1]) + 2):
        tag = int(p[i]) if i < length else 0
        k, begins = (tag - 1) // 2 if tag else None, tag % 2 == 1
        if start is not None and (k != kind or begins):
            spans.append((start, i, kind))
            start = None
        if start is None and tag:
            start, kind = i, k
    return spans


def stretches(text: str) -> Iterator[tuple[int, str]]:
    """(start, window): links on their own, so that a repeated link is one window; else the merged surroundings of all
    that could belong to a mention, cut into overlapping windows."""
    links = [(m.start(), m.end()) for m in _LINK.finditer(text)] if "[[" in text else []
    plain = text
    if links:
        buffer, last = [], 0
        for a, b in links:
            buffer += [text[last:a], "\x01" * (b - a)]
            last = b
            yield a, text[a:b]
        plain = "".join([*buffer, text[last:]])
    a = b = -1
    n = len(text)
    for m in TRIGGER.finditer(plain):
        s, e = max(0, m.start() - LEFT), min(n, m.end() + RIGHT)
        if s <= b:
            b = max(b, e)
            continue
        if b > a >= 0:
            yield from _windows(plain, a, b)
        a, b = s, e
    if b > a >= 0:
        yield from _windows(plain, a, b)


def _windows(text: str, a: int, b: int) -> Iterator[tuple[int, str]]:
    while b - a > WINDOW:
        yield a, text[a : a + WINDOW]
        a += WINDOW - OVERLAP
    yield a, text[a:b]


def reconcile(found: list[tuple[int, int, int, bool, bool]]) -> list[tuple[int, int, int]]:
    """Spans of all windows of one text as one list without overlaps. Spans cut by a window's border give way to whole
    ones, then shorter ones to longer ones; pieces of one kind that touch or overlap become one."""
    kept: list[tuple[int, int, int]] = []
    for s, e, k, *_ in sorted(found, key=lambda x: (x[3] + x[4], x[0] - x[1], x[0])):
        hit = [x for x in kept if s < x[1] and x[0] < e]
        if not hit:
            kept.append((s, e, k))
        elif all(x[2] == k for x in hit):
            kept = [x for x in kept if x not in hit]
            kept.append((min(s, *(x[0] for x in hit)), max(e, *(x[1] for x in hit)), k))
    return sorted(set(kept))


# The exact check: the forms that a mention of each kind can have.
_AT, _DOT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)", r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
_EMAIL = re.compile(rf"[^\W_][\w.+%-]*{_AT}[\w-]+(?:{_DOT}[^\W_][\w-]*)+")
_PHONE = re.compile(r"(?:\(?\+\d{1,3}\)?|\(\d{2,5}\)|\d)(?:[ .()/–-]{0,3}\d)+(?:\s?(?:ext|x|Durchwahl|poste)\.?\s?\d+)?")
_ID = re.compile(r"(?:[A-ZÑ]{1,3}[ -]?)?\d(?:[ .-]?[\dA-ZÑ]{1,9})*(?<=[\dA-ZÑ])|[A-ZÑ]{1,3}[A-Z0-9]{1,4}(?:[ -]?[\dA-ZÑ]{2,9})+")
_TITLE = re.compile(r"(?:Mrs?|Ms|Miss|Mme|Mlle|Dr|Prof|Professor|Herrn?|Frau|Fräulein|Hr|Fr|Sra?|Srta|Don|Doña|Dña|Sir|Lady|INFO|WARN|Contact(?:er)?|Avisar a|From)(?:\.\s*|\s+)(?=\S)")
# Words of letters and logs that stand before a name count as titles. One letter is one only before a whole name; before a family name it is an initial.
_SHORT_TITLE = re.compile(rf"[MD]\.ª?\s+(?=[{_CAP}][\w'’-]*[.,]?,?\s+\S)")
_WORD = rf"[{_CAP}][\w'’]+(?:-[{_CAP}][\w'’]*)*"
_NAME = re.compile(rf"(?:{_PARTICLE}\s)*(?:{_WORD}|[{_CAP}]\.(?:-?[{_CAP}]\.)*),?(?:\s(?:[{_CAP}]\.|{_PARTICLE}|{_WORD})(?=[\s,.;:|)<\]/—–-]|$))+")


def snap(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The borders of the mention that a span means, or null if it has not the form of one."""
    n = len(text)
    while start < end and not text[start].isalnum() and text[start] not in "+(":
        start += 1
    while start > 0 and start < n and text[start].isalnum() and (text[start - 1].isalnum() or kind == "email" and text[start - 1] in "._+-%"):
        start -= 1
    low, high = max(0, start - 24), min(n, end + 40)
    pattern = {"email": _EMAIL, "phone": _PHONE, "id_number": _ID}.get(kind)
    if pattern:
        best = None
        for m in pattern.finditer(text, low, high):
            common = min(m.end(), end) - max(m.start(), start)
            if common > 0 and (best is None or common > best[0]):
                best = (common, m.start(), m.end())
        if best is None:
            return None
        s, e = best[1:]
        digits = sum(c.isdigit() for c in text[s:e])
        return (s, e) if kind == "email" or digits >= LEAST_DIGITS else None
    while end < n and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    if kind == "name":
        for m in _TITLE.finditer(text, start, end):
            if m.start() == start or text[m.start() - 1].isspace():
                start = m.end()
        if m := _SHORT_TITLE.match(text, start, end):
            start = m.end()
        m = _NAME.match(text, start, min(n, end + 1))
        if not m:
            return None
        return start, min(m.end(), end)
    body = text[start:end].rstrip(" \n,;.|/—–-")
    if not (any(c.isdigit() for c in body) and sum(c.isalpha() for c in body) >= 4):
        return None
    return start, start + len(body)


class Finder:
    """Finds mentions in texts; remembers the spans of windows it has seen. With gate=False windows cover the whole
    texts, not just the surroundings of what could be a mention."""

    def __init__(self, weights: str = WEIGHTS, gate: bool = True):
        self.tagger, self.gate, self.seen = load_tagger(weights), gate, {}

    def tag(self, windows: list[str]) -> dict[str, list[tuple[int, int, int]]]:
        fresh = sorted({w for w in windows if w not in self.seen}, key=len)
        if len(self.seen) + len(fresh) > CACHED:
            self.seen.clear()
            fresh = sorted(set(windows), key=len)
        for i in range(0, len(fresh), ROWS):
            part = fresh[i : i + ROWS]
            lens = np.ones(ROWS, np.intp)
            lens[: len(part)] = [len(w) for w in part]
            for w, path in zip(part, self.tagger.decode(encode(part, ROWS), lens), strict=False):
                self.seen[w] = tagged_spans(path, len(w))
        return self.seen

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the mentions of each text, in order, in characters."""
        cut = [list(stretches(t) if self.gate else _windows(t, 0, len(t))) if t else [] for t in texts]
        out: list[list[tuple[int, int, str]]] = []
        seen = self.tag([w for c in cut for _, w in c])
        for text, windows in zip(texts, cut, strict=True):
            raw = [
                (at + s, at + e, k, s == 0 and at > 0, e == len(w) and at + e < len(text))
                for at, w in windows
                for s, e, k in seen[w]
            ]
            spans, done = [], 0
            for s, e, k in reconcile(raw):
                placed = snap(text, s, e, KINDS[k])
                if placed and placed[0] >= done:
                    spans.append((*placed, KINDS[k]))
                    done = placed[1]
            out.append(spans)
        return out


def _rows(finder_of: list, weights: str, frame: Columns, chars: int = 1_600_000) -> Iterator[list[tuple]]:
    """(doc_id, text, spans) of a batch's rows, in parts of about so many characters."""
    if not finder_of:
        finder_of.append(Finder(weights))
    ids, texts = frame["doc_id"], frame["text"]
    i = 0
    while i < len(ids):
        j, size = i, 0
        while j < len(ids) and (j == i or size < chars):
            size += len(texts[j] or "")
            j += 1
        yield list(zip(ids[i:j], texts[i:j], finder_of[0].find(texts[i:j]), strict=True))
        i = j


def find_mentions(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos, mention). Null and empty texts have none. Repeated rows give repeated rows."""
    finder_of: list = []

    def run(frame: Columns) -> Iterator[Columns]:
        for rows in _rows(finder_of, weights, frame):
            flat = [(d, k, s, e, t[s:e]) for d, t, spans in rows for s, e, k in spans]
            yield transpose(flat, ["doc_id", "kind", "start_pos", "end_pos", "mention"])

    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return map_lists(spread(texts), run, "doc_id long, kind string, start_pos int, end_pos int, mention string")


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, text, n_mentions): each mention replaced by [NAME], [EMAIL], [PHONE], [ID_NUMBER] or [ADDRESS], all else
    unchanged; a null text stays null."""
    finder_of: list = []

    def run(frame: Columns) -> Iterator[Columns]:
        for rows in _rows(finder_of, weights, frame):
            out = []
            for d, t, spans in rows:
                parts, last = [], 0
                for s, e, k in spans:
                    parts += [t[last:s], f"[{k.upper()}]"]
                    last = e
                out.append((d, None if t is None else "".join([*parts, t[last:]]), len(spans)))
            yield transpose(out, ["doc_id", "text", "n_mentions"])

    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_lists(spread(texts), run, "doc_id long, text string, n_mentions int")
