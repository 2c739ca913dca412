"""Noise in the text of scanned pages: running lines, page numbers, broken and misread words.

Three passes over the pages and small tables between them. Running lines are found by fuzzy repetition at the edges of
a document's pages, page numbers by their sequence, broken and misread words by the vocabulary of all pages. A word's
*stroke key* spells letters that scans confuse alike (rn and m, cl and d, li, u and h, 0 and o), so a misread word and
the true one meet in one equality join. No table of a document's pages is gathered in a task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..arrow import Columns, map_lists, transpose
from ..scratch import Scratch

COMMON_WORDS = 50_000
"""So many of the most frequent sound words are known to every worker; rarer ones are looked up by a shuffle."""
TAIL, HEAD = 4, 2
"""Lines with text at the foot and the head of a page that can be running lines."""

# Characters that scans confuse, spelt by a common form of their strokes.
STROKES = {
    "i": "i", "l": "i", "1": "i", "!": "i", "0": "o", "5": "s", "6": "b", "9": "g", "@": "a", "(": "e", "c": "e", "f": "t", "h": "ii", "u": "ii",
    "n": "ri", "m": "rri", "d": "ei", "w": "vv", "ﬁ": "ti", "ﬂ": "ti",
}
_NOISE = "|~·'’‘`´.,;:)[]{}\"„“”«»‹›?…_*^°¬\xad​‐"
_STROKES = {ord(k): v for k, v in STROKES.items()} | {ord(c): None for c in _NOISE}
_EDGE = " \t.,;:()[]{}\"„“”«»‹›?…–—"
_BREAK = "-‐\xad¬"
_MIXED = re.compile(r"[^\W\d_][0-9@!|~·(]|[0-9@!|~·(][^\W\d_]")
_GAP = re.compile(r"\s{2,}|\s+[—·|][.,]?\s+")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_PAGE_WORD = r"(?:p(?:a?g(?:e|ina|\.)?|[.,])?|seite|s\.|pág(?:ina)?\.?|folio|fol\.)"
_DIGITS = str.maketrans("lIi|!oOsSBb", "11111005566")
_OF = re.compile(rf"^\W*({_PAGE_WORD})?\W*([0-9lIi|!oOsSB]+)\s*(?:(/|of|von|de|sur|0f|ot)\s*([0-9lIi|!oOsSB]+))?(\W*)$", re.I)


def stroke_key(word: str) -> str:
    return word.lower().translate(_STROKES)


def strokes_of(word: Column) -> Column:
    """stroke_key in SQL: signs of one stroke at once, then those of several, whose strokes are none of these."""
    one = {k: v for k, v in STROKES.items() if len(v) == 1}
    out = F.translate(F.lower(word), "".join(one) + _NOISE, "".join(one.values()))
    for sign, strokes in STROKES.items():
        if len(strokes) > 1:
            out = F.replace(out, F.lit(sign), F.lit(strokes))
    return out


def line_key(line: str) -> str:
    return re.sub(r"[\W_]+", "", line.lower().translate(_STROKES))


def core(token: str) -> str:
    return token.strip(_EDGE).lower()


def _affixes(token: str) -> tuple[str, str]:
    """What core() strips before and behind."""
    return token[: len(token) - len(token.lstrip(_EDGE))], token[len(token.rstrip(_EDGE)) :]


def opened(token: str) -> str:
    """The core with the '(' beside it, which can be a c; empty if there is none or the token has a ')'."""
    w = core(token)
    if not w or "(" not in token or ")" in token:
        return ""
    lead, tail = _affixes(token)
    o = "(" * lead.endswith("(") + w + "(" * tail.startswith("(")
    return o if o != w else ""


def _roman(s: str) -> int | None:
    total = last = 0
    for c in reversed(s):
        n = _ROMAN.get(c)
        if n is None:
            return None
        total, last = (total - n, last) if n < last else (total + n, n)
    return total


def page_number(part: str) -> tuple[int, str] | None:
    """(number, form) of what can be a page number; the forms plain and roman need a sequence to be believed."""
    s = part.strip()
    if not s or len(s) > 24:
        return None
    m = _OF.match(s)
    if m and (m[1] or re.search(r"[0-9]", s)) and not s.endswith((".", ",", ";", ":")) or m and re.fullmatch(r"[lIO]{2,4}", s):
        n = m[2].translate(_DIGITS)
        if n.isdigit() and len(n) <= 6:
            bare = not m[1] and not m[3] and re.fullmatch(r"[0-9lIi|!oOsSB]+", s)
            return int(n), "plain" if bare else "marked"
    low = re.sub(r"[|!1]", "i", s.lower().strip("-–[]() "))
    if re.fullmatch(r"[ivxlc]{1,8}", low) and (n := _roman(low) if "l" not in low else _roman(low.replace("l", "i"))):
        return n, "roman" if low == s.lower() or s.islower() else "marked"
    return None


def unique_pages(pages: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """id, doc_id, page_no, text, own of pages with an id and a text, each id once.

    Of different rows with one id the one counts that was not scanned (its ocr_conf is null), else the one with the most
    confidence, at a tie the larger text. With blocks (page_id, col, ord, kind, text) a page that is nowhere stated with
    a text takes those of its blocks but running lines, in order; own is false for it, as it has no lines."""
    n = max(pages.sparkSession.sparkContext.defaultParallelism, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = pages.where("id is not null")
    if blocks is None:
        rows = rows.where("text is not null")
    # As many partitions as that, so that the costly work on them later has all cores.
    best = F.max(F.struct(F.col("text").isNotNull().alias("a"), F.coalesce("ocr_conf", F.lit(float("inf"))).alias("b"), "text", "doc_id", "page_no")).alias("p")
    one = rows.select("id", "doc_id", "page_no", "text", "ocr_conf").repartition(n, "id").groupBy("id").agg(best)
    one = one.select("id", "p.doc_id", "p.page_no", "p.text", F.lit(True).alias("own"))
    if blocks is None:
        return one
    held = blocks.where("page_id is not null and text is not null and coalesce(kind, 'body') <> 'chrome'").groupBy(F.col("page_id").alias("id"))
    held = held.agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("col", "ord", "text"))), lambda b: b["text"]), "\n\n").alias("blocks"))
    lost = one.where("text is null").join(held, "id").select("id", "doc_id", "page_no", F.col("blocks").alias("text"), F.lit(False).alias("own"))
    return one.where("text is not null").unionByName(lost)


def _count_words(frame: Columns) -> Iterator[Columns]:
    broken = re.compile(rf"(\S+)[{_BREAK}][ \t]*\n\s*(\S+)")
    raw, starts = Counter(), Counter()
    for text in frame["text"]:
        raw.update(text.split())
        for m in broken.finditer(text):
            raw[m[0].split()[0]] -= 1
            raw[m[2]] -= 1
        starts.update(line_key(" ".join(line.split()[:2])) for line in text.split("\n"))
    words = Counter()
    for token, n in raw.items():
        if n > 0 and (w := opened(token) or core(token)):
            words[w] += n
    starts.pop("", None)
    yield {"kind": ["w"] * len(words), "word": list(words), "n": list(words.values())}
    yield {"kind": ["s"] * len(starts), "word": list(starts), "n": list(starts.values())}


def _edges(frame: Columns) -> Iterator[Columns]:
    cols = ["id", "doc_id", "page_no", "line_no", "head", "foot", "size", "key", "parts", "number", "form", "first", "last", "alone", "second", "heading", "start"]
    rows = []
    for pid, doc, no, text in zip(frame["id"], frame["doc_id"], frame["page_no"], frame["text"], strict=True):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        for at, i in enumerate(full):
            head, foot, line = at + 1, len(full) - at, lines[i].strip()
            before = i == 0 or not lines[i - 1].strip()
            after = i + 1 >= len(lines) or not lines[i + 1].strip()
            heading = len(line) <= 60 and line[-1] not in ".,;:" + _BREAK and (before and after or head == 1) and bool(re.search(r"[^\W\d_]{2}", line))
            if head > HEAD and foot > TAIL and not heading:
                continue
            parts = [x for x in _GAP.split(line) if x.strip()]
            numbers = [x for x in map(page_number, parts) if x]
            number, form = numbers[0] if len(numbers) == 1 or len(parts) == 1 and numbers else (None, None)
            if form in ("plain", "roman") and len(parts) > 1:
                form = "beside"
            tokens = line.split()
            keys = [line_key(x) for x in parts if not page_number(x)]
            starts_big = line[0].isupper() and line[-1] not in ".,;:" + _BREAK
            rows.append((pid, doc, no, i + 1, head, foot, len(line), line_key(line), [k for k in keys if k], number, form, tokens[0], tokens[-1], starts_big, head == 2 and starts_big and after, heading, line_key(" ".join(tokens[:2]))))
    yield transpose(rows, cols)


_EDGE_SCHEMA = (
    "id long, doc_id long, page_no int, line_no int, head int, foot int, size int, key string, parts array<string>, number int, form string,"
    " first string, last string, alone boolean, second boolean, heading boolean, start string"
)


def _near(part: Column, title: Column) -> Column:
    """The same but for a few misread characters: at most one in ten, and three more or fewer."""
    longer = F.greatest(F.length(part), F.length(title))
    return (part == title) | ((F.abs(F.length(part) - F.length(title)) <= 3) & (F.levenshtein(part, title) * 10 <= longer))


def _line_key(line: Column) -> Column:
    return F.regexp_replace(strokes_of(line), r"[^\p{L}\p{N}]+", "")


def running_lines(edges: DataFrame, starts: DataFrame, titles: DataFrame) -> DataFrame:
    """The edges' places and end words with ``furniture``. starts: start, n (lines of all pages that begin so); titles: doc_id, title.

    A head line is furniture if it holds the document's title, a page number in sequence, or what stands at the head of
    another page; or, below the first page, the name of a section that has its heading elsewhere. A foot line is, if it
    is a page number in sequence, stands at the foot of three in ten pages, or begins as only foot lines do in all
    documents; the second line of a page before a blank one is, if it stands there on three in ten pages. Every table here has a few short rows a page."""
    at_edge = edges.where(f"head = 1 or foot <= {TAIL}")
    pages = edges.groupBy("doc_id").agg(F.count_distinct("page_no").alias("n_pages"), F.min("page_no").alias("first_page"))
    sequence = edges.where("number is not null").groupBy("doc_id", (F.col("number") - F.col("page_no")).alias("step")).agg(F.count_distinct("page_no").alias("in_step"))
    # A part of a longer head line and a line of its own are counted apart: the latter can be a heading at the page's top.
    own = F.explode(F.when(F.size("parts") > 0, F.array_distinct("parts")).otherwise(F.array("key"))).alias("part")
    alone = (F.size("parts") <= 1).alias("single")
    heads = at_edge.where("head = 1").select("doc_id", "page_no", alone, own)
    heads = heads.where("part <> ''").groupBy("doc_id", "single", "part").agg(F.count_distinct("page_no").alias("n"))
    at = lambda where: F.count_distinct(F.when(F.expr(where), F.col("page_no")))
    repeats = edges.where(f"alone and foot <= {TAIL} or second").groupBy("doc_id", "key").agg(at(f"alone and foot <= {TAIL}").alias("n_feet"), at("second").alias("n_second"))
    headings = edges.where("heading and key <> ''").select("doc_id", F.col("key").alias("part"), F.struct("page_no", "line_no").alias("place"))
    headings = headings.groupBy("doc_id", "part").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    known = at_edge.where("head = 1").select("id", "doc_id", "page_no", "line_no", alone, own)
    known = known.join(heads, ["doc_id", "single", "part"], "left").join(headings, ["doc_id", "part"], "left").groupBy("id", "line_no").agg(
        F.max("n").alias("n_heads"),
        F.max((F.col("low") != F.struct("page_no", "line_no")) | (F.col("high") != F.struct("page_no", "line_no"))).alias("has_heading"),
    )
    usual = at_edge.where("foot <= 2 and alone and number is null").groupBy("start", "doc_id").agg(F.count("*").alias("n"))
    usual = usual.groupBy("start").agg(F.sum("n").alias("at_foot"), F.count("doc_id").alias("docs"))
    usual = usual.join(starts, "start").where("docs >= 5 and at_foot >= 0.8 * n").select("start", F.lit(True).alias("usual"))
    keyed = titles.groupBy("doc_id").agg(F.min("title").alias("title")).select("doc_id", _line_key(F.col("title")).alias("title_key"))
    lines = (
        edges.withColumn("step", F.col("number") - F.col("page_no"))
        .join(pages, "doc_id").join(sequence, ["doc_id", "step"], "left").join(repeats, ["doc_id", "key"], "left")
        .join(known, ["id", "line_no"], "left").join(usual, "start", "left").join(keyed, "doc_id", "left")
    )
    at_head = F.col("head") == 1
    in_step = F.coalesce("in_step", F.lit(0)) >= 2
    later = F.col("page_no") > F.col("first_page")
    numbered = F.col("number").isNotNull() & (
        in_step | (F.col("form") == "marked") | ((F.col("form") == "plain") & (F.col("foot") == 1) & (F.col("n_pages") <= 2)) | ((F.col("form") == "roman") & (F.col("foot") == 1) & (F.col("n_pages") <= 2))
    )
    at_number = numbered & (at_head | (F.col("foot") <= 2))
    titled = at_head & later & (F.length("title_key") >= 4) & F.exists("parts", lambda p: _near(p, F.col("title_key")))
    twice = (F.coalesce("n_heads", F.lit(0)) >= 2) & (F.col("heading") | (F.size("parts") > 1))
    repeated = at_head & later & (twice | (F.coalesce("has_heading", F.lit(False)) & (F.col("size") <= 64)))
    beside = at_head & later & (F.col("form") == "beside") & (in_step | (F.size("parts") >= 1))
    footer = (F.col("foot") <= 3) & F.col("alone") & (
        (F.coalesce("n_feet", F.lit(0)) >= F.greatest(F.lit(2), F.ceil(0.3 * F.col("n_pages")))) | (F.coalesce("usual", F.lit(False)) & (F.col("foot") <= 2))
    )
    second = F.col("second") & later & (F.coalesce("n_second", F.lit(0)) >= F.greatest(F.lit(2), F.ceil(0.3 * F.col("n_pages"))))
    return lines.withColumn("furniture", F.coalesce(at_number | titled | repeated | beside | second | footer, F.lit(False))).select("id", "doc_id", "page_no", "line_no", "head", "foot", "first", "last", "furniture")


def _settle_opened(counts: DataFrame) -> DataFrame:
    """counts in which a word keeps a '(' at its edge only if that is a misread c.

    It is where words of the same strokes with a c in its place are 25 times as frequent as what the bracket leaves, and
    twice as frequent as the word with the bracket. Else the bracket is punctuation and the word counts without it."""
    edged = F.startswith("word", F.lit("(")) | F.endswith("word", F.lit("("))
    plain, rest = counts.where(~edged), F.regexp_replace("word", r"^\(|\($", "")
    edge = lambda x: F.struct(F.startswith(x, F.lit("c")).alias("c_first"), F.endswith(x, F.lit("c")).alias("c_last"))
    sound = plain.where(~F.col("word").rlike(_MIXED.pattern.replace("[^\\W\\d_]", "\\p{L}"))).withColumn("strokes", strokes_of(F.col("word")))
    first, last = F.startswith("word", F.lit("(")), F.endswith("word", F.lit("("))
    tops = sound.groupBy("strokes").agg(F.max("n").alias("rest_n"))
    meant = sound.groupBy("strokes", edge(F.col("word")).alias("edge")).agg(F.max("n").alias("c_n"))
    asked = counts.where(edged).select("word", "n", rest.alias("rest"), first.alias("first"), last.alias("last"))
    asked = asked.withColumn("strokes", strokes_of(F.col("word"))).withColumn("rest_strokes", strokes_of(F.col("rest")))
    found = asked.join(meant, "strokes").where("(edge.c_first or not first) and (edge.c_last or not last)").groupBy("word").agg(F.max("c_n").alias("c_n"))
    met = asked.join(found, "word", "left").join(tops.withColumnRenamed("strokes", "rest_strokes"), "rest_strokes", "left")
    misread = F.coalesce((F.col("c_n") >= 25 * F.coalesce("rest_n", F.lit(0))) & (F.col("c_n") >= 2 * F.col("n")) & (F.length("word") >= 3), F.lit(False))
    settled = met.select(F.when(misread, F.col("word")).otherwise(F.col("rest")).alias("word"), "n")
    return plain.select("word", "n").unionByName(settled).groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """word, n, best: the word that is meant; best = word where it is sound.

    A word is misread if one with the same strokes is far more frequent, or if digits or signs stand between its
    letters. Then best is the nearest in writing of the frequent words of its strokes, or null if there is none."""
    keyed = _settle_opened(counts).withColumn("strokes", strokes_of(F.col("word")))
    mixed = F.col("word").rlike(_MIXED.pattern.replace("[^\\W\\d_]", "\\p{L}"))
    keyed = keyed.withColumn("mixed", mixed)
    # Of words with the same strokes all that are not far rarer than the first can be meant; of these the one that is
    # nearest in writing.
    few = keyed.where("not mixed").withColumn("top_n", F.max("n").over(Window.partitionBy("strokes"))).where("n >= 0.02 * top_n")
    few = few.groupBy("strokes").agg(F.max("n").alias("top_n"), F.collect_list(F.struct("n", "word")).alias("few"))
    met = keyed.join(few, "strokes", "left")
    plain = F.translate(F.regexp_replace("word", r"[|~·'’]", ""), "(", "c")
    near = F.transform(F.filter("few", lambda x: (x["word"] != F.col("word")) & (x["n"] >= 2 * F.col("n"))), lambda x: F.struct((-F.levenshtein(x["word"], plain)).alias("d"), x["n"].alias("n"), x["word"].alias("word")))
    met = met.withColumn("top", F.array_max(near))
    # Of top_n true words at most one in 25 is expected to be misread alike. More are still noise if chance explains them:
    # the log likelihood of n at that mean (Poisson) is at most 5 below the best.
    mean = F.col("top_n") / 25
    rare = (F.col("n") <= mean) | (F.col("n") * F.log(F.col("n") / mean) - (F.col("n") - mean) <= 5)
    elided = F.col("word").rlike(r"^(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu)['’]\p{L}")
    other = F.col("top").isNotNull()
    number = F.col("word").rlike(r"^[0-9lIiOoSsBb|!]*[0-9][0-9lIiOoSsBb|!]*$")
    misread = F.when(F.col("mixed"), F.lit(True)).otherwise(F.coalesce(other & rare & ~elided & (F.length("word") >= 3) & ~F.col("word").rlike(r"^[0-9.,/]+$"), F.lit(False)))
    as_number = F.translate("word", "lIi|!oOsSBb", "11111005566")
    return met.select("word", "n", F.when(misread, F.when(number, as_number).otherwise(F.col("top.word"))).otherwise(F.col("word")).alias("best"), misread.alias("misread"))


def _odd_words(common: set[str]):
    broken = re.compile(rf"\S[{_BREAK}]\s*$")

    def run(frame: Columns) -> Iterator[Columns]:
        odd, hyphens = [], []
        for pid, text in zip(frame["id"], frame["text"], strict=True):
            lines = text.split("\n")
            full = [i for i, x in enumerate(lines) if x.strip()]
            held = False
            for at, i in enumerate(full):
                tokens = lines[i].split()
                cut = bool(broken.search(lines[i])) and len(tokens[-1]) > 1
                for token in tokens[1 if held else 0 : -1 if cut else None]:
                    w = core(token)
                    if w and w not in common:
                        odd.append((pid, i + 1, w))
                    if o := opened(token):
                        odd.append((pid, i + 1, o))
                held = cut
                if cut and len(full) - at > TAIL:
                    hyphens.append((pid, i + 1, tokens[-1], full[at + 1] + 1, lines[full[at + 1]].split()[0]))
        yield transpose(odd, ["id", "line_no", "word"])
        yield transpose(hyphens, ["id", "line_no", "word", "next_line", "next"])

    return run


def _edge_breaks(lines: DataFrame) -> DataFrame:
    """Breaks at the foot of a page: the text line that follows, on this page or at the head of the next."""
    text = lines.where("not furniture")
    order = Window.partitionBy("id").orderBy("line_no")
    feet = text.where(f"foot <= {TAIL}").select(
        "id", "doc_id", "page_no", "line_no", "last", F.lead(F.struct(F.col("id"), F.col("line_no"), F.col("first"))).over(order).alias("then")
    )
    heads = text.where(f"head <= {HEAD}").groupBy("doc_id", "page_no").agg(F.min(F.struct("line_no", "id", "first")).alias("over"))
    heads = heads.select("doc_id", (F.col("page_no") - 1).alias("page_no"), F.struct("over.id", "over.line_no", "over.first").alias("over"))
    cut = feet.where(F.col("last").rlike(rf"^.+[{_BREAK}]$")).join(heads, ["doc_id", "page_no"], "left")
    then = F.coalesce("then", "over")
    return cut.select("id", "line_no", F.col("last").alias("word"), then["id"].alias("next_id"), then["line_no"].alias("next_line"), then["first"].alias("next")).where("next is not null")


_PARTS = ("a", "b", "joined", "kept", "sign", "a_open", "b_open", "joined_open", "kept_open")


@F.pandas_udf(StructType([StructField(c, StringType()) for c in _PARTS]))
def _break_parts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b, strict=True):
        sign, front = x[-1], x[:-1]
        x, y, ys = front.lstrip(_EDGE).lower(), core(y), opened(y)
        xs = "(" + x if ")" not in front and _affixes(front)[0].endswith("(") else ""
        other = (xs or x, ys or y) if xs or ys else (None, None)
        keys = [(stroke_key(p + q), stroke_key(p) + "-" + stroke_key(q)) if p else (None, None) for p, q in ((x, y), other)]
        rows.append((x, y, *keys[0], sign, *other, *keys[1]))
    return pd.DataFrame(rows, columns=list(_PARTS), dtype=object)


def judge_breaks(breaks: DataFrame, words: DataFrame) -> DataFrame:
    """breaks with parts a and b, ``broken``, and best: the whole word by the vocabulary or just the parts joined.

    A hyphen belongs to the word if the vocabulary has the hyphenated word and not, or far less often, the joined one.
    Soft hyphens and not-signs are always breaks. A hyphen before a conjunction or a capital stays. A '(' at the edge of
    a part is kept as a misread c if only so the vocabulary has the word, or has it 25 times as often."""
    parts = breaks.withColumn("p", _break_parts("word", "next")).select(*breaks.columns, "p.*").where("a <> '' and b <> ''")
    by_key = words.where("not misread").select(strokes_of(F.col("word")).alias("k"), "word", "n").groupBy("k").agg(F.max(F.struct("n", "word")).alias("v"))
    keys = ("joined", "kept", "joined_open", "kept_open")
    asked = parts.select(F.explode(F.array(*keys)).alias("k")).where("k is not null").distinct().join(by_key, "k")
    met = parts
    for k in keys:
        met = met.join(asked.select(F.col("k").alias(k), F.col("v").alias(f"v_{k}")), k, "left")
    seen = lambda *ks: F.greatest(*[F.coalesce(F.col(f"v_{k}.n"), F.lit(0)) for k in ks])
    bracket = (seen("joined_open", "kept_open") > 0) & (seen("joined_open", "kept_open") >= 25 * seen("joined", "kept"))
    read = lambda c, o: F.when(bracket, F.col(o)).otherwise(F.col(c)).alias(c)
    met = met.select(*breaks.columns, "sign", read("a", "a_open"), read("b", "b_open"), read("v_joined", "v_joined_open").alias("one"), read("v_kept", "v_kept_open").alias("two"))
    n1, n2 = F.coalesce("one.n", F.lit(0)), F.coalesce("two.n", F.lit(0))
    soft = F.col("sign").isin("\xad", "¬")
    joins = F.col("b").isin("und", "oder", "and", "or", "et", "ou", "y", "o", "bzw")
    letters = F.col("a").rlike(r"\p{L}[^\s\p{L}]?$") & F.col("b").rlike(r"^[^\s\p{L}]?\p{L}")
    broken = letters & (soft | (~joins & ((n2 == 0) | (n1 > n2))))
    return met.withColumn("broken", F.coalesce(broken, F.lit(False))).withColumn("best", F.coalesce("one.word", F.concat("a", "b"))).withColumn("sure", n1 > 0).drop("one", "two")


class Scan:
    """What is known of the pages: pages, lines (edges with furniture), breaks, odd (id, line_no, word, best)."""

    def __init__(self, pages: DataFrame, titles: DataFrame, blocks: DataFrame | None = None):
        s = Scratch(pages.sparkSession, "scans")
        self.scratch, self.filled = s, blocks is not None
        self.pages = s.cut(unique_pages(pages, blocks))
        counted = s.cut(map_lists(self.pages.select("text"), _count_words, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")))
        self.words = s.cut(vocabulary(counted.where("kind = 'w'").select("word", "n")))
        edges = s.cut(map_lists(self.pages, _edges, _EDGE_SCHEMA))
        starts = counted.where("kind = 's'").select(F.col("word").alias("start"), "n")
        self.lines = s.cut(running_lines(edges, starts, titles.select("doc_id", "title")))
        s.drop(edges)
        common = {r[0] for r in self.words.where("not misread").orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word").collect()}
        odd = s.cut(map_lists(self.pages.select("id", "text"), _odd_words(common), "id long, line_no int, word string, next_line int, next string"))
        wrong = self.words.where("misread").select("word", "best")
        s.drop(counted)
        self.odd = s.cut(odd.where("next is null").select("id", "line_no", "word").join(wrong, "word"))
        inner = odd.where("next is not null").select("id", "line_no", "word", F.col("id").alias("next_id"), "next_line", "next")
        self.breaks = s.cut(judge_breaks(inner.unionByName(_edge_breaks(self.lines)), self.words))
        s.drop(odd)

    def found(self) -> DataFrame:
        """(page_id, line_no, kind): furniture, hyphen and misread lines, each once. Pages whose text comes from their
        blocks have no lines of their own and are left out."""
        row = lambda df, kind: df.select(F.col("id").alias("page_id"), "line_no", F.lit(kind).alias("kind"))
        furniture = self.lines.where("furniture").select("id", "line_no")
        broken = self.breaks.where("broken")
        # Of a broken word with a sure reading, the part that the reading does not hold was misread.
        sure = broken.where("sure")
        front = sure.where(~F.startswith(F.col("best"), F.col("a"))).select("id", "line_no")
        back = sure.where(~F.endswith(F.col("best"), F.col("b"))).select(F.col("next_id").alias("id"), F.col("next_line").alias("line_no"))
        mixed = _MIXED.pattern.replace("[^\\W\\d_]", "\\p{L}")
        odd_front = broken.where(F.col("a").rlike(mixed)).select("id", "line_no")
        odd_back = broken.where(F.col("b").rlike(mixed)).select(F.col("next_id").alias("id"), F.col("next_line").alias("line_no"))
        misread = self.odd.select("id", "line_no").union(front).union(back).union(odd_front).union(odd_back).distinct().join(furniture, ["id", "line_no"], "left_anti")
        found = row(furniture, "furniture").union(row(broken.select("id", "line_no").distinct(), "hyphen")).union(row(misread, "misread")).distinct()
        return found.join(self.pages.where("not own").select(F.col("id").alias("page_id")), "page_id", "left_anti") if self.filled else found

    def paragraphs(self) -> DataFrame:
        """(doc_id, paragraph, text): continuous paragraphs of each paged document, in order from 1."""
        drop = self.lines.where("furniture").groupBy("id").agg(F.collect_set("line_no").alias("drop"))
        fix = self.odd.where("best is not null").groupBy("id").agg(F.collect_set(F.struct("line_no", "word", "best")).alias("fix"))
        cut = self.breaks.groupBy("id").agg(F.collect_set(F.struct("line_no", "broken", F.when(F.col("sure"), F.col("best")).alias("best"))).alias("cut"))
        rows = self.pages.join(drop, "id", "left").join(fix, "id", "left").join(cut, "id", "left")
        parts = map_lists(rows.select("id", "doc_id", "page_no", "text", "drop", "fix", "cut"), _page_paragraphs, "doc_id long, page_no int, id long, part int, opens boolean, body string, cut boolean, best string, tail string")
        parts = self.scratch.cut(parts.where("doc_id is not null"))
        # A part that does not open a paragraph continues the one before, on an earlier page; running counts of opened
        # paragraphs are taken over blocks of pages first.
        per_block = parts.groupBy("doc_id", F.floor(F.col("page_no") / 64).alias("block")).agg(F.count_if("opens").alias("opened"))
        before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        per_block = per_block.select("doc_id", "block", F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("doc_id", "block").orderBy("page_no", "id", "part").rowsBetween(Window.unboundedPreceding, 0)
        numbered = parts.withColumn("block", F.floor(F.col("page_no") / 64)).join(per_block, ["doc_id", "block"]).withColumn("paragraph", F.col("base") + F.sum(F.col("opens").cast("int")).over(inside))
        whole = numbered.groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page_no", "id", "part", "body", "cut", "best", "tail"))).alias("s"))
        return whole.select("doc_id", F.greatest("paragraph", F.lit(1)).cast("int").alias("paragraph"), _stitch("s").alias("text"))


def _like(word: str, token: str) -> str:
    """word in the letter case of token, with its punctuation."""
    inner, (lead, tail) = token.strip(_EDGE), _affixes(token)
    if (o := opened(token)) and stroke_key(o) == stroke_key(word):
        # A bracket that was read as a letter is none of the punctuation.
        lead, tail = lead[: len(lead) - o.startswith("(")], tail[o.endswith("(") :]
    if len(inner) > 1 and inner.upper() == inner and re.search(r"[^\W\d_]{2}", inner):
        word = word.upper()
    elif inner[:1].isupper():
        word = word[:1].upper() + word[1:]
    return lead + word + tail


def _page_paragraphs(frame: Columns) -> Iterator[Columns]:
    rows_of = lambda x: [] if x is None else x
    rows = []
    for pid, doc, no, text, drop, fix, cut in zip(*(frame[c] for c in ("id", "doc_id", "page_no", "text", "drop", "fix", "cut")), strict=True):
        dropped = set(rows_of(drop))
        fixes = {(f["line_no"], f["word"]): f["best"] for f in rows_of(fix)}
        cuts = {c["line_no"]: c for c in rows_of(cut)}
        part, words, open_cut, blank, opens = 0, [], None, True, True
        page, first_text = [], True
        for i, line in enumerate(text.split("\n"), 1):
            if i in dropped:
                continue
            if not line.strip():
                blank = True
                continue
            tokens = [_like(b, t) if (b := fixes.get((i, opened(t))) or fixes.get((i, core(t)))) else t for t in line.split()]
            if blank and words and open_cut is None:
                page.append((opens, " ".join(words), False, None, None))
                words, opens = [], True
            if first_text:
                # A page that begins in small letters goes on with the paragraph of the page before.
                opens, first_text = not (line.strip()[0].islower()), False
            if open_cut is not None and words:
                head = words.pop()[:-1]
                if open_cut["broken"]:
                    joined = head + tokens[0]
                    tokens[0] = _like(open_cut["best"], joined) if open_cut["best"] else joined
                else:
                    tokens[0] = head + "-" + tokens[0]
            words += tokens
            open_cut, blank = cuts.get(i), False
        if words:
            page.append((opens, " ".join(words), bool(open_cut and open_cut["broken"]), open_cut["best"] if open_cut else None, "-" if open_cut else None))
        for opens_, body, is_cut, best, tail in page:
            rows.append((doc, no, pid, part, opens_, body, is_cut, best, tail))
            part += 1
    yield transpose(rows, ["doc_id", "page_no", "id", "part", "opens", "body", "cut", "best", "tail"])


@F.pandas_udf(StringType())
def _stitch(parts: pd.Series) -> pd.Series:
    def join(ps) -> str:
        out, last = "", None
        for p in ps:
            body = p["body"]
            if last is not None and last["tail"]:
                word, _, rest = body.partition(" ")
                head, _, tail = out.rpartition(" ")
                joined = tail[:-1] + ("" if last["cut"] else "-") + word
                out = (head + " " if head else "") + (_like(last["best"], joined) if last["cut"] and last["best"] else joined) + (" " + rest if rest else "")
            else:
                out = out + " " + body if out else body
            last = p
        return out

    return parts.map(join)
