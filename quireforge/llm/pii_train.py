"""Training of the mention tagger, in numpy: ``python -m quireforge.llm.pii_train DOCUMENTS KNOWN_NAMES WEIGHTS
[SECONDS [START]]``, where START are weights to go on from.

There are no labelled texts, so spans are labelled here by cues (what stands before and after a mention) and the list
of known names, on a bounded sample of documents; names and digits in labelled spans are then replaced at random, and
names and numbers of many forms and scripts are put into other sentences, so that the network has to go by form and
surroundings, not by the cues. Batches hold windows of one length, so nothing is padded. Only training reads the labels.
"""

from __future__ import annotations

import random
import re
import sys
import time
from collections import Counter

import numpy as np

from . import pii

SAMPLE_DOCUMENTS = 10_000
"""At most so many documents, those with the smallest ids, give the labelled sample."""
HIDDEN, BATCH, STEPS, SEED = 32, 128, 3600, 11
_HARD = re.compile(r"@|\d[\d .()/–-]{4,}\d|[A-Z]+\d+")

_C = pii._CAP
_W = rf"[{_C}][\w'’]+(?:-[{_C}][\w'’]+)*"
_P = r"(?:van|von|du|de la|de los|del|della|da|de)"
_CUES = r"(?!(?:Contact|Contacter|Avisar|Yours|Cordialement|Atentamente|From|Phone|Passport|Mobil|Korrekturen|Anschrift|Rappel|Recuerdo|Nachtrag|Abschrift|Mr|Mrs|Ms|Mme|Frau|Herr|Herrn|Dr|INFO|WARN)\b)"
FULL = re.compile(rf"(?<![\w-]){_CUES}(?:{_W}(?: [{_C}]\.)?(?: {_P})? {_W}|[{_C}]\. (?:[{_C}]\. )?(?:{_P} )?{_W}|(?:{_P} )?{_W}, (?:{_W}(?: [{_C}]\.)?|[{_C}]\.)(?!\w))")
BEFORE = re.compile(
    r"(?:keeper: |author: |From: |Yours, |Cordialement, |Atentamente, |Grüßen, |spoke with |and with |Contact |Contacter |Avisar a |bitte an |returned by |issued to (?:Dr\. )?|"
    r"ask for |belongs to |Mr |Mrs |Ms |Mme |M\. |Frau |Herr |Herrn |D\. |D\.ª |Dr\. )$"
)
AFTER = re.compile(r" wrote:| <|, wohnhaft| \(identity| \(Ausweis|, con documento|, pièce|, who now| on \+?[\d(]| au \+?[\d(]| en el |, Tel\.| / (?:C/|Calle|Plaza|Camino)| — \d")
PHONE_CUE = re.compile(r"(?:[Tt]el\.?:? |[Pp]hone[ =]|on |call |au |en el |Mobil: |; |\| | — | / |phone=|fon: )$")
PHONE = re.compile(r"(?<![\w.,])(?:\(\+\d{2,3}\) ?|\+\d{1,3}[ -]?|\(\d{3}\) ?|\(0\d+\) ?)?(?:\(0\))?\d(?:[ ./-]{0,3}\d){6,13}(?: ext\. \d+)?(?![\w])")
ID_CUE = re.compile(r"(?:Passport |identity no\. |reader card |ID on file: |Ausweis-Nr\. |documento |pièce n° |DNI |NIE )$")
ID = re.compile(r"[A-ZÑ]{0,3}-?[A-ZÑ\d](?:[ .-]?[A-ZÑ\d]){6,17}(?!\w)")
EMAIL = pii._EMAIL
CITY = rf"(?:, (?:\d{{5}} )?{_W}(?: \d{{5}})?)?"
STREET = r"(?:Road|Rd\.?|Street|St\.?|Lane|Ln\.?|Court|Ct\.?|Avenue|Ave\.?|Row|Hill|Ropewalk|Square|Sq\.?|Terrace|Place|Yard|Close|Way)"
ADDRESS = re.compile(
    rf"(?:Flat \d+[A-Z]?, )?(?<![\w.,:])\d{{1,4}}[A-Za-z]? (?:{_W} ){{1,2}}{STREET}{CITY}|(?:Flat \d+[A-Z]?, )?(?<![\w.,:])\d{{1,4}}[A-Za-z]? Old Ropewalk{CITY}|P\.O\. Box \d+{CITY}"
    rf"|(?:Am |An der |Im |Zum |Auf der )?{_W}(?:straße|str\.|gasse|weg|allee|platz|ufer|Speicher) \d{{1,3}}[a-z]?(?!\d){CITY}|Am {_W} {_W} \d{{1,3}}[a-z]?{CITY}|Postfach \d[\d ]*{CITY}"
    rf"|(?<![\w.,:])\d{{1,4}}(?: bis| ter)?, (?:rue|avenue|impasse|allée|quai|place|chemin|boulevard|cours|passage|ruelle) (?:de la |de l['’]|du |des |de |d['’]|aux? )?[\w'’-]+(?: {_W})?{CITY}|BP \d+{CITY}"
    rf"|(?:C/|Calle|Plaza|Camino|Avenida|Paseo|Avda\.|Cuesta|Ronda|Travesía) [^,/\n|]{{2,40}}, \d{{1,4}}(?:, \d+\.º [A-Z])?{CITY}|Apartado \d+{CITY}"
)


_PARTICLES = {"van", "von", "del", "los", "della"}
STRONG = re.compile(r"(?:author: |From: |Yours, |Cordialement, |Atentamente, |Grüßen, |spoke with |and with |Contact |Contacter |Avisar a |bitte an |returned by |ask for )$")


class Labeller:
    """Spans by cues and known names, never used by the operator itself."""

    def __init__(self, names: list[tuple[str, str]], texts: list[str] = ()):
        self.known = {n.casefold() for n, _ in names}
        # The list is incomplete: what often stands beside a known name in a full name becomes known too.
        for _ in range(2):
            beside: Counter = Counter()
            for text in texts:
                for m in FULL.finditer(text):
                    words = [w.casefold() for w in re.findall(r"[^\W\d_]{3,}", m[0])]
                    if any(w in self.known for w in words) and (BEFORE.search(text, max(0, m.start() - 24), m.start()) or AFTER.match(text, m.end())):
                        beside.update(w for w in words if w not in self.known)
            self.known |= {w for w, n in beside.items() if n >= 3 and w not in _PARTICLES}

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        taken: list[tuple[int, int, int]] = []

        def add(s: int, e: int, kind: str) -> None:
            if all(e <= a or b <= s for a, b, _ in taken):
                taken.append((s, e, pii.KINDS.index(kind)))

        for m in EMAIL.finditer(text):
            if re.search(r"\.|dot", m[0][1:]) and not m[0].startswith("weights"):
                add(m.start(), m.end(), "email")
        for m in ADDRESS.finditer(text):
            add(m.start(), m.end(), "address")
        for m in ID.finditer(text):
            if ID_CUE.search(text, max(0, m.start() - 20), m.start()) and sum(c.isdigit() for c in m[0]) >= 5:
                add(m.start(), m.end(), "id_number")
        for m in PHONE.finditer(text):
            if PHONE_CUE.search(text, max(0, m.start() - 20), m.start()) and 9 <= sum(c.isdigit() for c in m[0]) <= 17:
                add(m.start(), m.end(), "phone")
        at = 0
        while m := FULL.search(text, at):
            s, e = m.span()
            while t := pii._TITLE.match(text, s, e) or pii._SHORT_TITLE.match(text, s):
                s = t.end()
            words = re.findall(r"[^\W\d_]+", m[0])
            cue = bool(BEFORE.search(text, max(0, s - 24), s)) + bool(AFTER.match(text, e))
            hits = sum(w.casefold() in self.known for w in words)
            if (hits >= 1 and (cue or hits >= 2 or len(words) == 2 and "," not in m[0])) or cue >= 2 or STRONG.search(text, max(0, s - 24), s):
                if whole := FULL.match(text, s):
                    add(s, whole.end(), "name")
                    at = whole.end()
                    continue
            nxt = re.compile(r"\s").search(text, m.start(), e)
            at = nxt.end() if nxt else e
        return sorted(taken)


def _word(rng: random.Random, like: str) -> str:
    c, v = "bcdfghjklmnprstvwzß", "aeiouaeiouéöüáí"
    c = c.replace("ß", "")
    made = "".join(rng.choice(["", rng.choice(c)]) + rng.choice(v) + rng.choice(["", rng.choice("lnrstmkd")]) for _ in range(rng.choice([2, 2, 3, 3, 4])))
    made = made[:1].upper() + made[1:]
    return made.upper() if like.isupper() and len(like) > 2 else made.lower() if like.islower() else made


def vary(window: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The window with other names and digits in its spans."""
    out, fresh, last = [], [], 0
    size = 0
    for s, e, k in spans:
        body = window[s:e]
        if rng.random() < 0.6:
            kind = pii.KINDS[k]
            if kind == "name":
                body = re.sub(r"[^\W\d_]{3,}", lambda m: m[0] if re.fullmatch(_P, m[0]) else _word(rng, m[0]), body)
            elif kind == "email" and rng.random() < 0.5:
                body = re.sub(r"^[^\W\d_]{3,}", lambda m: _word(rng, m[0]).lower() if m[0].islower() else m[0], body)
            elif kind == "address" and rng.random() < 0.5:
                body = re.sub(r"(?<=[ -])[A-ZÀ-Þ][a-zà-ÿ]{4,}(?=[ ,'])", lambda m: _word(rng, m[0]), body)
            if kind in ("phone", "id_number", "address"):
                body = re.sub(r"(?<!\+)\d", lambda m: str(rng.randrange(10)), body) if rng.random() < 0.7 else body
        out += [window[last:s], body]
        size += s - last
        fresh.append((size, size + len(body), k))
        size += len(body)
        last = e
    return "".join([*out, window[last:]]), fresh


def labelled_windows(texts: list[str], labeller: Labeller) -> tuple[list, list]:
    """Windows with spans and without; spans that a window cuts are labelled as far as they reach."""
    with_spans, without, seen = [], [], set()
    for text in texts:
        spans = labeller.spans(text)
        for at, w in pii.stretches(text):
            if w in seen:
                continue
            seen.add(w)
            inside = [(max(s - at, 0), min(e - at, len(w)), k) for s, e, k in spans if s < at + len(w) and e > at]
            (with_spans if inside else without).append((w, inside))
    return with_spans, without


_GIVEN = ["Jon", "Carla", "Šimon", "Łukasz", "Žofie", "Ørjan", "Chloë", "Ewan", "Ánxela", "Jürgen", "Đorđe", "Élise", "Ivo", "Mia", "Çağla", "Ştefan", "Ольга", "Иван", "Νίκος"]
_FAMILY = ["Venn", "Smith", "Čapek", "Žižek", "Świątek", "Østby", "Nuñez", "O'Hara", "Müller-Kern", "Wu", "Li", "Kovář", "Ødegård", "Đurić", "Șerban", "Петров", "Παπάς", "Roy"]
_BEFORE_NAME = ["", "", "", "Mr ", "Mrs ", "Dr. ", "Frau ", "Herr ", "M. ", "Mme ", "D. ", "by ", "to ", "with ", "von ", "par ", "por ", "and ", "from ", "signed "]


def _any_name(rng: random.Random, known: list[tuple[str, str]]) -> str:
    parts = {"given": _GIVEN, "family": _FAMILY}

    def one(part: str) -> str:
        listed = [n for n, p in known if p == part]
        return rng.choice(listed) if listed and rng.random() < 0.3 else rng.choice(parts[part]) if rng.random() < 0.5 else _word(rng, "Xx")

    given, family, more = one("given"), one("family"), f"{rng.choice('ABCDEHJKLMPRSTŠŁŽ')}."
    link = rng.choice(["de la ", "von ", "van ", "de ", "di ", "du ", "del "])
    forms = [f"{given} {family}"] * 6 + [f"{given} {link}{family}"] * 2 + [f"{given} {more} {family}", f"{more} {family}", f"{more} {family}", f"{family}, {given}", f"{family}, {more}", f"{given} {family}".upper(), f"{given} {family.upper()}"]
    return rng.choice(forms)


def _any_phone(rng: random.Random) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)}-{d(3)}-{d(3)}-{d(3)}", f"0{d(3)} {d(6)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)}/{d(7)}"])


def insert(window: str, rng: random.Random, known: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """A window without mentions with a name or, now and then, a phone number put between two of its words."""
    gaps = [m.end() for m in re.finditer(r"(?<=[a-zà-ÿ,]) (?=[a-zà-ÿ])", window)]
    if not gaps:
        return window, []
    at = rng.choice(gaps)
    phone = rng.random() < 0.12
    lead, body = ("call " if rng.random() < 0.5 else "tel. ", _any_phone(rng)) if phone else (rng.choice(_BEFORE_NAME), _any_name(rng, known))
    start = at + len(lead)
    return f"{window[:at]}{lead}{body}{rng.choice([' ', ' ', ', '])}{window[at:]}", [(start, start + len(body), pii.KINDS.index("phone" if phone else "name"))]


def crop(batch: list[tuple[str, list]], rng: random.Random) -> list[tuple[str, list]]:
    """The windows cut to the length of the shortest, at random places."""
    n = min(len(w) for w, _ in batch)
    out = []
    for w, spans in batch:
        a = rng.choice([0, len(w) - n, rng.randint(0, len(w) - n)])
        out.append((w[a : a + n], [(max(s - a, 0), min(e - a, n), k) for s, e, k in spans if s < a + n and e > a]))
    return out


def tags_of(batch: list[tuple[str, list]], length: int) -> np.ndarray:
    y = np.zeros((len(batch), length), np.int64)
    for i, (_, spans) in enumerate(batch):
        for s, e, k in spans:
            y[i, s:e] = 2 + 2 * k
            if s < length:
                y[i, s] = 1 + 2 * k
    return y


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Model:
    """Parameters with Adam, loss and gradients of the bidirectional LSTM and the CRF."""

    def __init__(self, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        v, k = pii.SYMBOLS, pii.TAGS
        self.h = hidden
        self.p = {
            "W": r.normal(0, 0.15, (2, v, 4 * hidden)), "U": r.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)), "O": r.normal(0, 0.15, (2 * hidden, k)),
            "o": np.zeros(k), "A": np.zeros((k, k)), "first": np.zeros(k), "last": np.zeros(k),
        }
        self.p["W"][:, :, hidden : 2 * hidden] += 1.0
        self.p = {n: a.astype(np.float32) for n, a in self.p.items()}
        self.m = {n: np.zeros_like(a) for n, a in self.p.items()}
        self.v = {n: np.zeros_like(a) for n, a in self.p.items()}
        self.step = 0

    def loss(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, h = self.p, self.h
        b, t = ids.shape
        both = np.stack([ids, ids[:, ::-1]])
        z_in = np.stack([p["W"][d][both[d]] for d in range(2)])  # [2, B, T, 4H]
        hs, cs, gates = np.zeros((t + 1, 2, b, h), np.float32), np.zeros((t + 1, 2, b, h), np.float32), np.empty((t, 2, b, 4 * h), np.float32)
        tc = np.empty((t, 2, b, h), np.float32)
        for s in range(t):
            z = z_in[:, :, s] + hs[s] @ p["U"]
            z[..., : 3 * h] = 1 / (1 + np.exp(-z[..., : 3 * h]))
            z[..., 3 * h :] = np.tanh(z[..., 3 * h :])
            gates[s] = z
            cs[s + 1] = z[..., h : 2 * h] * cs[s] + z[..., :h] * z[..., 3 * h :]
            tc[s] = np.tanh(cs[s + 1])
            hs[s + 1] = z[..., 2 * h : 3 * h] * tc[s]
        feats = np.concatenate([hs[1:, 0], hs[1:, 1][::-1]], 2)  # [T, B, 2H]
        e = feats @ p["O"] + p["o"]
        value, de, da, df, dl = self._crf(e, y.T)
        n = float(b)
        g = {"O": np.tensordot(feats, de, ([0, 1], [0, 1])) / n, "o": de.sum((0, 1)) / n, "A": da / n, "first": df / n, "last": dl / n}
        dfeat = de @ p["O"].T
        dh_out = np.stack([dfeat[..., :h], dfeat[::-1, :, h:]], 1)  # [T, 2, B, H]
        dz_all = np.empty_like(gates)
        dh, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        ut = p["U"].transpose(0, 2, 1)
        for s in range(t - 1, -1, -1):
            dh = dh + dh_out[s]
            i, f, o, c = gates[s, ..., :h], gates[s, ..., h : 2 * h], gates[s, ..., 2 * h : 3 * h], gates[s, ..., 3 * h :]
            dc = dc + dh * o * (1 - tc[s] ** 2)
            dz = dz_all[s]
            dz[..., :h] = dc * c * i * (1 - i)
            dz[..., h : 2 * h] = dc * cs[s] * f * (1 - f)
            dz[..., 2 * h : 3 * h] = dh * tc[s] * o * (1 - o)
            dz[..., 3 * h :] = dc * i * (1 - c * c)
            dh = dz @ ut
            dc = dc * f
        g["U"] = np.stack([hs[:-1, d].reshape(-1, h).T @ dz_all[:, d].reshape(-1, 4 * h) for d in range(2)]) / n
        hot = np.zeros((2, t * b, pii.SYMBOLS), np.float32)
        for d in range(2):
            hot[d, np.arange(t * b), both[d].T.reshape(-1)] = 1
        g["W"] = np.stack([hot[d].T @ dz_all[:, d].reshape(-1, 4 * h) for d in range(2)]) / n
        return value / n, g

    def _crf(self, e: np.ndarray, y: np.ndarray):
        p = self.p
        t, b, k = e.shape
        rows = np.arange(b)
        alpha, beta = np.empty((t, b, k), np.float32), np.empty((t, b, k), np.float32)
        alpha[0] = p["first"] + e[0]
        for s in range(1, t):
            alpha[s] = _lse(alpha[s - 1][:, :, None] + p["A"][None], 1) + e[s]
        beta[-1] = p["last"]
        for s in range(t - 2, -1, -1):
            beta[s] = _lse(p["A"][None] + (e[s + 1] + beta[s + 1])[:, None, :], 2)
        z = _lse(alpha[-1] + p["last"], 1)
        gold = p["first"][y[0]] + p["last"][y[-1]] + e[0, rows, y[0]]
        for s in range(1, t):
            gold = gold + p["A"][y[s - 1], y[s]] + e[s, rows, y[s]]
        de = np.exp(alpha + beta - z[None, :, None])
        da = np.zeros((k, k), np.float32)
        for s in range(1, t):
            pair = np.exp(alpha[s - 1][:, :, None] + p["A"][None] + (e[s] + beta[s])[:, None, :] - z[:, None, None])
            da += pair.sum(0)
        np.add.at(da, (y[:-1].reshape(-1), y[1:].reshape(-1)), -1)
        df, dl = de[0].sum(0), de[-1].sum(0)
        np.add.at(df, y[0], -1)
        np.add.at(dl, y[-1], -1)
        de = de.copy()
        np.add.at(de.reshape(-1), np.arange(t * b) * k + y.reshape(-1), -1)
        return float((z - gold).sum()), de.astype(np.float32), da, df, dl

    def update(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((a.astype(np.float64) ** 2).sum()) for a in g.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        for n, a in g.items():
            a = a * scale
            self.m[n] = 0.9 * self.m[n] + 0.1 * a
            self.v[n] = 0.999 * self.v[n] + 0.001 * a * a
            mean, var = self.m[n] / (1 - 0.9**self.step), self.v[n] / (1 - 0.999**self.step)
            self.p[n] -= (rate * mean / (np.sqrt(var) + 1e-8)).astype(np.float32)


def train(texts: list[str], names: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = SEED, seconds: float = 1e9, log=print, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Weights from labelled windows of the texts; ends after steps or seconds. Goes on from ``start`` if it is given."""
    rng = random.Random(seed)
    positive, negative = labelled_windows(texts, Labeller(names, texts))
    log(f"{len(positive)} windows with mentions, {len(negative)} without")
    if not positive:
        raise ValueError("no labelled mention in the sample")
    negative = negative or positive
    # Numbers and signs that are no mention are rare among the windows, but the likeliest to be taken for one.
    hard = [x for x in negative if _HARD.search(x[0])] or negative
    prose = [x for x in negative if not _HARD.search(x[0])] or negative
    model, began, shown = Model(hidden, seed), time.time(), 0.0
    if start:
        model.p = {n: np.asarray(a, np.float32) for n, a in start.items()}
    for step in range(steps):
        part = max(step / steps, (time.time() - began) / seconds)
        if part >= 1:
            break
        half = batch // 2
        pool = [vary(w, sp, rng) for w, sp in rng.choices(positive, k=half * 4)] + rng.choices(negative, k=(batch - half) * 3) + rng.choices(hard, k=batch - half)
        pool += [insert(w, rng, names) for w, _ in rng.choices(prose, k=batch)]
        pool.sort(key=lambda x: len(x[0]) + rng.random() * 12)
        at = rng.randrange(len(pool) - batch + 1)
        chosen = crop(pool[at : at + batch], rng)
        ids = pii.encode([w for w, _ in chosen])
        value, g = model.loss(ids.astype(np.int64), tags_of(chosen, ids.shape[1]))
        model.update(g, (2e-3 if start else 6e-3) * (1 - part) ** 1.2 * min(1, (step + 1) / 50) + 1e-5)
        shown = 0.97 * shown + 0.03 * value if step else value
        if step % 100 == 0:
            log(f"step {step}: loss {shown:.3f}, {time.time() - began:.0f} s")
    return {k: v.astype(np.float16) for k, v in model.p.items()}


def main(args: list[str]) -> None:
    import pyarrow.parquet as pq

    documents = pq.read_table(args[0], columns=["doc_id", "text"]).to_pandas().dropna().sort_values("doc_id").head(SAMPLE_DOCUMENTS)
    names = list(pq.read_table(args[1]).to_pandas().itertuples(index=False, name=None))
    start = None
    if len(args) > 4:
        with np.load(args[4]) as z:
            start = dict(z)
    weights = train(documents["text"].tolist(), names, seconds=float(args[3]) if len(args) > 3 else 1e9, start=start)
    np.savez_compressed(args[2], **weights)


if __name__ == "__main__":
    main(sys.argv[1:])
