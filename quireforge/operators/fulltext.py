"""Full-text search: tokens, Porter stems, postings with positions and BM25."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, spread

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SALTS = 32
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _marked_letters() -> tuple[str, str]:
    """Letters with one diacritic and what they are without it, by their decomposition."""
    marked, plain = [], []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(i))
        if len(parts) == 2 and unicodedata.combining(parts[1]):
            marked.append(chr(i))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _marked_letters()


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case without diacritics."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(F.translate(c, _MARKED, _PLAIN)), r"\p{Mn}", ""), F.lit(TOKEN), 0)


def porter(word: str) -> str:
    """The stem of a word by Porter's algorithm of 1980; words of one or two letters and others than a-z stay."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word

    def cons(i: int) -> bool:
        c = w[i]
        return c not in "aeiou" and not (c == "y" and (i > 0 and cons(i - 1)))

    def shape(stem: str) -> str:
        return "".join("c" if cons(i) else "v" for i in range(len(stem)))

    def measure(stem: str) -> int:
        return shape(stem).count("vc")

    def has_vowel(stem: str) -> bool:
        return "v" in shape(stem)

    def double(stem: str) -> bool:
        return len(stem) > 1 and stem[-1] == stem[-2] and cons(len(stem) - 1)

    def cvc(stem: str) -> bool:
        return len(stem) > 2 and shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for suffix, other in _STEP2:
        if w.endswith(suffix):
            w = w[: -len(suffix)] + other if measure(w[: -len(suffix)]) > 0 else w
            break
    for suffix, other in _STEP3:
        if w.endswith(suffix):
            w = w[: -len(suffix)] + other if measure(w[: -len(suffix)]) > 0 else w
            break
    for suffix in _STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if measure(stem) > 1 or measure(stem) == 1 and not cvc(stem):
            w = stem
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


# The suffixes of Porter's steps 2, 3 and 4.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


class _Stems(dict):
    """Stems of the words that a worker has met; cleared when it holds many."""

    def __missing__(self, word: str) -> str:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = stem = porter(word)
        return stem


_stems = _Stems()


_POSTING = "term string, chunk_id long, tf int, positions array<int>"


def _invert(stemmed: bool):
    """Postings of each text, and a row without term whose tf is the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, ids, places = [], [], []
            for chunk, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: dict[str, list[int]] = {}
                for at, w in enumerate(words):
                    held.setdefault(_stems[w] if stemmed else w, []).append(at)
                terms += [None, *held]
                ids += [chunk] * (len(held) + 1)
                places += [range(len(words)), *held.values()]
            tf = [len(p) for p in places]
            kept = [[] if t is None else p for t, p in zip(terms, places, strict=True)]
            columns = [pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.array(tf, pa.int32()), pa.array(kept, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "chunk_id", "tf", "positions"])

    return run


class Index:
    """postings: term, chunk_id, tf, positions; doclen: chunk_id, dl. Their corpus numbers are read once."""

    def __init__(self, postings: DataFrame, doclen: DataFrame, stemmed: bool):
        self.postings, self.doclen, self.stemmed = postings, doclen, stemmed
        self._stats: tuple[int, float] | None = None

    @property
    def stats(self) -> tuple[int, float]:
        if self._stats is None:
            n, avg = self.doclen.agg(F.count("*"), F.avg("dl")).first()
            self._stats = (n, avg or 1.0)
        return self._stats


def build_index(chunks: DataFrame, id_col: str = "id", text_col: str = "text", stemmed: bool = True) -> Index:
    """The inverted index of the texts, written to the shared folder in the order of terms, so that a search reads only
    the row groups that can hold its terms. A worker stems every distinct word once. Null texts count as empty ones; rows
    without id are left out; ids must be unique."""
    s = Scratch(chunks.sparkSession, "fulltext")
    texts = spread(chunks.select(F.col(id_col).cast("long").alias("chunk_id"), F.col(text_col).alias("text")).where("chunk_id is not null"))
    rows = texts.select("chunk_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    # A text is one row, so its words are grouped where it is; only finished postings are shuffled.
    inverted = rows.mapInArrow(_invert(stemmed), _POSTING)
    # The postings of a frequent term are dealt to SALTS places; inside a file terms are in order.
    held = s.cut(inverted.repartition("term", F.pmod("chunk_id", F.lit(SALTS))).sortWithinPartitions("term", "chunk_id"))
    return Index(held.where("term is not null"), held.where("term is null").select("chunk_id", F.col("tf").alias("dl")), stemmed)


def query_phrases(spark: SparkSession, query: str, stemmed: bool = True) -> list[list[str]]:
    """Each word of a query as a phrase of its tokens; quotes are dropped; words without tokens match nothing."""
    words = [w for w in (x.replace('"', "") for x in query.split()) if w]
    if not words:
        return []
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", tokens(F.col("w")).alias("t")).orderBy("i").collect()
    return [[porter(t) if stemmed else t for t in r["t"]] for r in rows]


def search(index: Index, query: str, limit: int | None = 100) -> DataFrame:
    """(chunk_id, bm25): rows that match any word, the best first; bm25 is negative, lower is better. Repeated words
    count again; a word of several tokens is a phrase of adjacent ones; ties go to the smaller chunk_id."""
    spark = index.postings.sparkSession
    phrases = [p for p in query_phrases(spark, query, index.stemmed) if p]
    empty = spark.createDataFrame([], "chunk_id long, bm25 double")
    if not phrases:
        return empty
    n, average = index.stats
    weights: dict[tuple[str, ...], int] = {}
    for p in phrases:
        weights[tuple(p)] = weights.get(tuple(p), 0) + 1
    hits = None
    for at, (phrase, times) in enumerate(weights.items()):
        one = index.postings.where(F.col("term") == phrase[0]).select("chunk_id", F.col("positions").alias("p"))
        for shift, term in enumerate(phrase[1:], 1):
            other = index.postings.where(F.col("term") == term).select("chunk_id", F.expr(f"transform(positions, x -> x - {shift})").alias("q"))
            one = one.join(other, "chunk_id").select("chunk_id", F.array_intersect("p", "q").alias("p")).where("size(p) > 0")
        row = one.select("chunk_id", F.size("p").alias("tf"), F.lit(at).alias("phrase"), F.lit(times).alias("times"))
        hits = row if hits is None else hits.unionByName(row)
    counted = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    # One row for each word of the query.
    scored = hits.join(F.broadcast(counted), "phrase").join(index.doclen, "chunk_id")
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average)) * F.col("times")
    out = scored.groupBy("chunk_id").agg((-F.sum(part)).alias("bm25")).orderBy("bm25", "chunk_id")
    return out.limit(limit) if limit is not None else out
