"""Words of a page to lines and blocks, and running lines of documents to chrome."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..arrow import whole_groups
from ..functions import text as tx
from ..scratch import Scratch

# The limits of the layout.
LEAST_WORDS, BINS, LOW_DENSITY, GUTTER_SHARE, SIDE_SHARE, SPAN_SHARE = 8, 200, 2, 0.02, 0.1, 0.3
LINE_REACH, BLOCK_GAP, TALLER = 0.6, 1.6, 1.05
LEAST_GAPS, LEAST_GAP, EQUAL_GAPS = 6, 0.05, 1.79
EDGE_SHARE, CHROME_PAGES, CHROME_LEAST, CHROME_SHARE = 0.12, 3, 4, 0.5
PAGE = "doc_id long, page_no int, width double, height double"
OUT = "col int, ord int, x0 double, y0 double, x1 double, y1 double, kind string, text string"
WORD = np.dtype([("text", object), ("x0", float), ("y0", float), ("x1", float), ("y1", float)])


def gutter(x0: np.ndarray, x1: np.ndarray, width: float) -> float | None:
    """Middle of the widest band of few words strictly inside the text, if it is wide enough; of equal ones the first."""
    step = width / BINS
    a = np.clip((x0 / step).astype(int), 0, BINS - 1)
    b = np.clip((x1 / step).astype(int), 0, BINS - 1)
    change = np.zeros(BINS + 1, int)
    ok = b >= a
    np.add.at(change, a[ok], 1)
    np.add.at(change, b[ok] + 1, -1)
    density = change.cumsum()[:BINS]
    used = np.flatnonzero(density)
    if len(used) < 2:
        return None
    low = np.zeros(BINS + 2, bool)
    low[used[0] + 2 : used[-1] + 1] = density[used[0] + 1 : used[-1]] <= LOW_DENSITY
    edge = np.flatnonzero(low[1:] != low[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return None
    best = int(np.argmax(ends - starts))
    if ends[best] - starts[best] < max(1, int(np.ceil(BINS * GUTTER_SHARE))):
        return None
    return (starts[best] + ends[best]) / 2 * step


def columns_of(w: np.ndarray, width: float) -> list[np.ndarray]:
    """The words as one or two columns, left first."""
    if len(w) < LEAST_WORDS or width <= 0 or (x := gutter(np.asarray(w["x0"]), np.asarray(w["x1"]), width)) is None:
        return [w]
    left, right = w[w["x0"] < x], w[w["x0"] >= x]
    span = lambda d: (np.fmax.reduce(d["y1"]) - np.fmin.reduce(d["y0"])) if len(d) else 0.0
    whole = max(span(w), 1.0)
    if min(len(left), len(right)) / len(w) < SIDE_SHARE or min(span(left), span(right)) / whole < SPAN_SHARE:
        return [w]
    return [left, right]


def lines_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words line by line from top to bottom, and the places where lines begin: a word belongs to a line if its
    middle is near that of the line's first word."""
    w = w[np.argsort(w["y0"], kind="stable")]
    middle, height = (w["y0"] + w["y1"]) / 2, np.maximum(np.maximum(w["y1"] - w["y0"], 0), 1.0)
    # A word at the height of the one before it is in that one's line.
    other = np.flatnonzero((middle[1:] != middle[:-1]) | (height[1:] != height[:-1])) + 1
    middle, height = middle.tolist(), height.tolist()
    starts, start = [0], 0
    for i in other.tolist():
        if abs(middle[i] - middle[start]) > max(height[start], height[i]) * LINE_REACH:
            starts.append(i)
            start = i
    line = np.zeros(len(w), int)
    line[starts[1:]] = 1
    return w[np.lexsort((w["x0"], line.cumsum()))], np.array(starts)


def fragmented(texts: list[str]) -> bool:
    """Many short pieces, as scans give that split words."""
    n = np.array([len(t) for t in texts])
    return len(n) >= 20 and n.mean() < 4.2 and (n <= 2).mean() > 0.30


def gaps_of(w: np.ndarray) -> np.ndarray:
    return np.maximum(w["x0"][1:] - w["x1"][:-1], 0.0)


def two_means(values: np.ndarray) -> tuple[float, float]:
    low, high = float(values.min()), float(values.max())
    for _ in range(10):
        before = low, high
        near = np.abs(values - low) <= np.abs(values - high)
        low = float(values[near].mean()) if near.any() else low
        high = float(values[~near].mean()) if (~near).any() else high
        if (low, high) == before:
            break
    return low, high


def merge_threshold(gaps: np.ndarray) -> float | None:
    """Where gaps inside words end and those between words begin; null if the gaps do not fall in two groups."""
    if len(gaps) < LEAST_GAPS:
        return None
    low, high = sorted(two_means(gaps))
    return None if high < 1e-6 or high / max(low, LEAST_GAP) < 1.8 else (low + high) / 2


def thresholds_of(w: np.ndarray, starts: np.ndarray) -> list[float | None]:
    """merge_threshold of each line. Means lie between the least and the largest gap, so that lines of about equal gaps,
    which are most, need none."""
    gaps, ends = gaps_of(w), np.append(starts[1:], len(w))
    before = np.concatenate([[0.0], gaps])
    before[starts] = 0.0
    high = np.maximum.reduceat(before, starts)
    before[starts] = np.inf
    low = np.minimum.reduceat(before, starts)
    out: list[float | None] = [None] * len(starts)
    for i in np.flatnonzero((ends - starts > LEAST_GAPS) & ~(high < EQUAL_GAPS * np.maximum(low, LEAST_GAP))).tolist():
        out[i] = merge_threshold(gaps[starts[i] : ends[i] - 1])
    return out


def merge_words(texts: list[str], gaps: np.ndarray, threshold: float | None) -> list[str]:
    if threshold is None or len(texts) < 2:
        return texts
    out = [texts[0]]
    for gap, text in zip(gaps.tolist(), texts[1:], strict=True):
        if gap <= threshold:
            out[-1] += text
        else:
            out.append(text)
    return out


def is_heading(text: str, height: float, median: float) -> bool:
    """At least 4 of: short (1), no stop at the end (1), capitals only or at the start of each word (2), tall (1). So
    there must be capitals; a text of capitals only has them at the start of each word."""
    s = text.strip()
    if not s or (len(s) < 60) + (s[-1] not in ".,;") + (height > median * TALLER) < 2:
        return False
    letters = False
    for w in s.split():
        first = next((c for c in w if c.isalpha()), None)
        if first is not None:
            if not first.isupper():
                return False
            letters = True
    return letters


def _median(v: list[float], empty: float) -> float:
    return max(sorted(v)[len(v) // 2], 1.0) if v else empty


def words_of(columns: Mapping) -> np.ndarray:
    """Words as an array with the fields of WORD, from columns by name."""
    w = np.empty(len(columns["x0"]), WORD)
    for c in WORD.names:
        w[c] = columns[c]
    return w


def layout_page(words: pd.DataFrame, width: float) -> list[tuple]:
    """(col, ord, x0, y0, x1, y1, kind, text) of the blocks of one page; ord runs on over the columns."""
    return layout_words(words_of(words), width)


def layout_words(words: np.ndarray, width: float) -> list[tuple]:
    """layout_page of an array of WORD."""
    cols = [lines_of(c) if len(c) else None for c in (columns_of(words, width) if len(words) else [])]
    thresholds = [thresholds_of(*c) if c else [] for c in cols]
    sure = sorted(t for c in thresholds for t in c if t is not None)
    fallback = sure[len(sure) // 2] if sure and fragmented(words["text"].tolist()) else None
    made = []
    for c, own in zip(cols, thresholds, strict=True):
        if not c:
            made.append([])
            continue
        w, starts = c
        all_texts, gaps, at = w["text"].tolist(), gaps_of(w), [*starts.tolist(), len(w)]
        texts = [" ".join(merge_words(all_texts[a:b], gaps[a : b - 1], t if t is not None else fallback)) for a, b, t in zip(at, at[1:], own, strict=False)]
        made.append(list(zip(*(f.reduceat(w[n], starts).tolist() for f, n in ((np.fmin, "x0"), (np.fmin, "y0"), (np.fmax, "x1"), (np.fmax, "y1"))), texts, strict=True)))
    median = _median([r[3] - r[1] for c in made for r in c], 10.0)
    out = []
    for col, rows in enumerate(made):
        heads = [is_heading(r[4], r[3] - r[1], median) for r in rows]
        reach = _median([r[3] - r[1] for r in rows], 1.0) * BLOCK_GAP
        groups: list[list[int]] = []
        for i, r in enumerate(rows):
            if groups and r[1] - rows[i - 1][3] <= reach and not heads[i] and not heads[i - 1]:
                groups[-1].append(i)
            else:
                groups.append([i])
        for g in groups:
            part = [rows[i] for i in g]
            kind = "heading" if len(g) == 1 and heads[g[0]] else "body"
            out.append((col, len(out), min(r[0] for r in part), min(r[1] for r in part), max(r[2] for r in part), max(r[3] for r in part), kind, " ".join(r[4] for r in part)))
    return out


def layout_pages(words: DataFrame) -> DataFrame:
    """Blocks of each page (doc_id, page_no, width, height and OUT) from its words (doc_id, page_no, width, height,
    text, x0, y0, x1, y1). A page is the group, so a group is as large as a page. Pages without words have no blocks.
    Words at one place stand in the order of their ends and texts."""
    schema = to_arrow_schema(StructType.fromDDL(f"{PAGE}, {OUT}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["doc_id", "page_no"]):
            w = words_of({c: t[c].to_numpy() for c in WORD.names})
            pages = zip(*(t[c].take(pa.array(starts)).to_pylist() for c in ("doc_id", "page_no", "width", "height")), strict=True)
            ends = np.append(starts[1:], len(w))
            out = [(*p, *b) for p, low, high in zip(pages, starts.tolist(), ends.tolist(), strict=True) for b in layout_words(w[low:high], math.nan if p[2] is None else p[2])]
            cells = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    good = words.where("text is not null and x0 is not null").select("doc_id", "page_no", "width", "height", *WORD.names)
    order = [F.col(c).asc_nulls_last() for c in ("y0", "x0", "x1", "y1", "text", "width", "height")]
    return good.repartition("doc_id", "page_no").sortWithinPartitions("doc_id", "page_no", *order).mapInArrow(run, f"{PAGE}, {OUT}")


def chrome_candidates(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, edge, ord, key): of each page the topmost block near its top and the lowest near its foot.

    blocks: doc_id, page_no, height, ord, y0, y1, text."""
    def edge(name: str, near: Column, order: Column) -> DataFrame:
        first = blocks.where(near).groupBy("doc_id", "page_no").agg(F.min(F.struct(order.alias("o"), "ord", "text")).alias("b"))
        return first.select("doc_id", "page_no", F.lit(name).alias("edge"), "b.ord", tx.chrome_key(F.col("b.text")).alias("key"))

    top = edge("top", F.col("y0") <= F.col("height") * EDGE_SHARE, F.col("y0"))
    return top.unionByName(edge("foot", F.col("y1") >= F.col("height") * (1 - EDGE_SHARE), -F.col("y1")))


def repeated_chrome(candidates: DataFrame) -> DataFrame:
    """Candidates whose key stands at that edge of four pages at least and of half of the pages that have one."""
    rows = candidates.where("key <> ''")
    pages = candidates.groupBy("doc_id").agg(F.count_distinct("page_no").alias("n_pages"))
    each = rows.groupBy("doc_id", "edge", "key").agg(F.count("*").alias("n"))
    whole = each.groupBy("doc_id", "edge").agg(F.sum("n").alias("whole"))
    good = each.join(whole, ["doc_id", "edge"]).join(pages, "doc_id").where((F.col("n") >= CHROME_LEAST) & (F.col("n") >= CHROME_SHARE * F.col("whole")) & (F.col("n_pages") >= CHROME_PAGES))
    return rows.join(good.select("doc_id", "edge", "key", "n"), ["doc_id", "edge", "key"])


def strip_chrome(blocks: DataFrame) -> DataFrame:
    """blocks with kind chrome where a running line was found. The blocks are made once, as they are read several times."""
    blocks = Scratch(blocks.sparkSession, "layout").cut(blocks)
    found = repeated_chrome(chrome_candidates(blocks)).select("doc_id", "page_no", "ord", F.lit(True).alias("running")).distinct()
    return blocks.join(found, ["doc_id", "page_no", "ord"], "left").withColumn("kind", F.when(F.col("running"), "chrome").otherwise(F.col("kind"))).drop("running")


def reading_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): the blocks of a page that are not chrome, joined by blank lines."""
    held = blocks.where("kind <> 'chrome'").groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("b"))
    return held.select("doc_id", "page_no", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))
