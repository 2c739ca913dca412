"""Oversized items cut at natural boundaries, by byte ranges.

The lengths of an item's blocks are summed up to their places in the joined text; blocks are cut into byte ranges with
a halo on either side, in which workers find boundaries; the best boundary of each window of an item is picked by a max
over the table of boundaries; pieces are then taken by offset out of cells, stretches of the joined text. No row holds
more than its own range, cell or piece: the text of an item above the limits is never put together.

Cut k of an item lies in the window (k*s - t, k*s] where s = max_bytes - overlap_bytes - t and t is a quarter of
max_bytes - overlap_bytes: so a piece with its overlap never exceeds max_bytes, every window is decided alone, and a
giant item is as parallel as many small ones. An item has a cut in each window that ends before the item does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

RANGE_BYTES = 1 << 16
HALO = 64
"""So many bytes around a place tell its kind; of a longer run of white space those nearest to the place count."""
GIANT_BYTES = 1 << 24
"""Ranges of items from this size on are dealt to all workers; those of smaller ones stay where they were read."""
GLUE = "\n\n"
# Natural places, the best first: paragraph, line, sentence, clause, word; a place lies after the match.
_PARAGRAPH = re.compile(rb"\n[ \t\r]*\n\s*")
PLACES = [
    (4, re.compile(rb"\n")),
    (3, re.compile(rb"(?:[.!?]|\xe2\x80\xa6)[\"')\]]{0,8}\s|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")),
    (2, re.compile(rb"[,;:]\s|\xe3\x80\x81")),
    (1, re.compile(rb"[ \t]")),
]
BLANK = r"(?U)^[\s\x{200B}\x{FEFF}]*$"


def item_blocks(df: DataFrame, id_col: str, title_col: str, blocks_col: str, text_field: str = "text") -> DataFrame:
    """(item, row, parts): the title and the blocks that are neither null nor blank, in order; row tells different rows
    of one item apart, exactly repeated ones have the same. Rows with a null id are items of their own by content."""
    parts = F.concat(F.array(F.col(title_col)), F.coalesce(F.transform(blocks_col, lambda b: b[text_field]), F.array().cast("array<string>")))
    rows = df.select(F.col(id_col).alias("item"), F.filter(parts, lambda x: x.isNotNull() & ~x.rlike(BLANK)).alias("parts"))
    return rows.where(F.size("parts") > 0).select("item", F.xxhash64("item", "parts").alias("row"), "parts")


def _profiles(profiles: DataFrame) -> list[tuple[str, int, int]]:
    """The limits, a small fixed table. An overlap of more than half the limit is refused, and so is a limit that leaves
    fewer than 12 bytes beside the overlap, as a window would then be shorter than a character."""
    found = [(r[0], int(r[1]), int(r[2] or 0)) for r in profiles.select("profile", "max_bytes", "overlap_bytes").where("profile is not null and max_bytes is not null").distinct().collect()]
    for name, most, overlap in found:
        if most - overlap < 12 or not 0 <= overlap <= most // 2:
            raise ValueError(f"profile {name}: {most} bytes with an overlap of {overlap} can't be cut")
    return sorted(found)


def stride(most: int, overlap: int) -> tuple[int, int]:
    slack = (most - overlap) // 4
    return most - overlap - slack, slack


def _with_total(blocks: DataFrame) -> DataFrame:
    """blocks with total, the bytes of the joined text."""
    summed = F.aggregate("parts", F.lit(-len(GLUE)).cast("long"), lambda a, p: a + F.octet_length(p) + len(GLUE))
    return blocks.withColumn("total", summed)


@F.pandas_udf(ArrayType(LongType()))
def _starts(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda x: np.concatenate([[0], np.cumsum(x)[:-1]]).astype(np.int64))


def _placed(sized: DataFrame) -> DataFrame:
    """(item, row, total, start, part): the blocks as bytes, each but the first led by the glue, with their places. Only
    lengths go to Python to be summed."""
    glued = F.expr(f"transform(parts, (p, i) -> octet_length(p) + if(i = 0, 0, {len(GLUE)}))")
    rows = sized.withColumn("starts", _starts(glued))
    each = rows.select("item", "row", "total", F.explode(F.arrays_zip("starts", "parts")).alias("z")).select("item", "row", "total", F.col("z.starts").alias("start"), F.col("z.parts").alias("p"))
    return each.select("item", "row", "total", "start", F.encode(F.when(F.col("start") > 0, F.concat(F.lit(GLUE), "p")).otherwise(F.col("p")), "UTF-8").alias("part"))


def _ranges(placed: DataFrame) -> DataFrame:
    """(item, row, total, at, before, length, body): byte ranges of the blocks; body has a halo on either side."""
    size = F.octet_length("part")
    cut = placed.select("item", "row", "total", "start", "part", F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(RANGE_BYTES))).alias("off"))
    first = F.greatest(F.col("off") - HALO, F.lit(0))
    return cut.select(
        "item", "row", "total", (F.col("start") + F.col("off")).alias("at"), (F.col("off") - first).alias("before"),
        F.least(F.lit(RANGE_BYTES), size - F.col("off")).alias("length"),
        F.expr(f"substring(part, greatest(off - {HALO}, 0) + 1, off - greatest(off - {HALO}, 0) + {RANGE_BYTES + HALO})").alias("body"),
    )


def _best_places(profiles: list[tuple[str, int, int]]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("item", "row", "total", "profile", "k", "strength", "cut")}
            for item, row, total, at, before, length, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                need = [(name, *stride(most, overlap)) for name, most, overlap in profiles if total > most]
                if not need:
                    continue
                # The joint of two blocks is a paragraph end that only the later block knows of.
                places: dict[int, int] = {at + len(GLUE): 5} if before == 0 and at and body[:2] == b"\n\n" else {}
                for m in _PARAGRAPH.finditer(body):
                    if before < m.end() <= before + length and _PARAGRAPH.search(body, max(m.start(), m.end() - HALO), m.end()):
                        places[at - before + m.end()] = 5
                for strength, pattern in PLACES:
                    for m in pattern.finditer(body):
                        where = m.end()
                        if before < where <= before + length:
                            places.setdefault(at - before + where, strength)
                for name, s, slack in need:
                    best: dict[int, tuple[int, int]] = {}
                    for where, strength in places.items():
                        k = -(-where // s)
                        if where > k * s - slack and k * s < total and (k not in best or (strength, where) > best[k]):
                            best[k] = (strength, where)
                    # Without a natural place: the last whole character that starts in the window's end.
                    for k in range(-(-(at + 1) // s), (at + length) // s + 1):
                        where = k * s
                        if k not in best and at < where <= at + length and where < total:
                            i = where - at + before
                            while 0 < i < len(body) and body[i] & 0xC0 == 0x80:
                                i -= 1
                            best[k] = (0, at - before + i)
                    for k, (strength, where) in best.items():
                        for name_, value in zip(out, (item, row, total, name, k, strength, where), strict=True):
                            out[name_].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), _CUT_TYPES, strict=True)})

    return find


_CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
_CUT_SCHEMA = "item long, row long, total long, profile string, k long, strength int, cut long"


def cuts(blocks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(item, row, total, profile, k, strength, cut) of every item above a profile's limit: where window k is cut.
    strength: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 word, 0 none of these, between two characters."""
    limits = _profiles(profiles)
    if not limits:
        return blocks.sparkSession.createDataFrame([], _CUT_SCHEMA)
    # Items under the smallest limit need no boundary and are left out by their length alone.
    sized = _with_total(blocks).where(F.col("total") > min(most for _, most, _ in limits))
    usual = _ranges(_placed(sized.where(F.col("total") < GIANT_BYTES)))
    giant = _ranges(_placed(sized.where(F.col("total") >= GIANT_BYTES))).repartition("row", "at")
    find = _best_places(limits)
    found = usual.mapInArrow(find, _CUT_SCHEMA).unionByName(giant.mapInArrow(find, _CUT_SCHEMA))
    best = found.groupBy("item", "row", "total", "profile", "k").agg(F.max(F.struct("strength", "cut")).alias("b"))
    return best.select("item", "row", "total", "profile", "k", "b.strength", "b.cut")


def _spans(table: DataFrame) -> DataFrame:
    """(item, row, profile, piece, from, end): every cut ends a piece and begins the next; no item's cuts are sorted."""
    sides = F.array(
        F.struct(F.col("k").alias("piece"), F.lit(None).cast("long").alias("from"), F.col("cut").alias("end")),
        F.struct((F.col("k") + 1).alias("piece"), F.col("cut").alias("from"), F.lit(None).cast("long").alias("end")),
    )
    each = table.select("item", "row", "total", "profile", F.explode(sides).alias("x"))
    met = each.groupBy("item", "row", "total", "profile", F.col("x.piece").alias("piece")).agg(F.max("x.from").alias("from"), F.max("x.end").alias("end"))
    return met.select("item", "row", "profile", F.col("piece").cast("int").alias("piece"), F.coalesce("from", F.lit(0).cast("long")).alias("from"), F.coalesce("end", "total").alias("end"))


def _joined(slices: Column) -> Column:
    """The bytes of an array of (at, bytes) in order."""
    return F.array_join(F.transform(F.array_sort(slices), lambda x: x["bytes"].cast("string")), "").cast("binary")


def pieces(blocks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(item, row, profile, piece, start, end, body): numbered from 1; start and end are bytes of the joined text.

    The piece's own part is preceded by overlap_bytes of the piece before, fewer by up to 3 where a character would be
    split. Items within the limit are one piece. Items without any text give no piece. All pieces of an item, their
    overlaps taken off, are its text."""
    limits = _profiles(profiles)
    spark = blocks.sparkSession
    if not limits:
        return spark.createDataFrame([], "item long, row long, profile string, piece int, start long, end long, body string")
    least, most = min(m for _, m, _ in limits), max(m for _, m, _ in limits)
    names = F.broadcast(spark.createDataFrame(limits, "profile string, max_bytes int, overlap_bytes int"))
    sized = _with_total(blocks)
    # A piece is taken out of the cell in which it starts; a cell also holds the first bytes of the next, as many as the
    # longest piece has. (key, row) stands for the item, which can be null.
    cell = max(RANGE_BYTES, 4 * most)
    key = F.coalesce("item", F.lit(0)).alias("key")
    spans = _spans(cuts(blocks, profiles)).join(names, "profile").select(
        "item", key, "row", "profile", "piece", F.when(F.col("piece") > 1, F.col("from") - F.col("overlap_bytes")).otherwise(F.col("from")).alias("start"), "end"
    )
    asked = spans.withColumn("start", F.greatest("start", F.lit(0))).withColumn("cell", F.floor(F.col("start") / cell))
    stop = F.col("start") + F.octet_length("part")
    parts = _placed(sized.where(F.col("total") > least)).withColumn("stop", stop).where("stop > start")
    held = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.greatest(F.col("start") - most, F.lit(0)) / cell), F.floor((F.col("stop") - 1) / cell))))
    low, high = f"greatest(start, cell * {cell})", f"least(stop, (cell + 1) * {cell} + {most})"
    held = held.select(key, "row", "cell", F.expr(low).alias("at"), F.expr(f"substring(part, int({low} - start) + 1, int({high} - {low}))").alias("bytes"))
    bodies = held.groupBy("key", "row", "cell").agg(_joined(F.collect_set(F.struct("at", "bytes"))).alias("bytes"))
    met = asked.join(bodies, ["key", "row", "cell"]).withColumn("bytes", F.expr(f"substring(bytes, int(start - cell * {cell}) + 1, int(end - start))"))
    # A start inside a character moves to the next one.
    lead = F.expr("length(regexp_extract(hex(substring(bytes, 1, 3)), '^((?:[89AB][0-9A-F])*)', 1)) div 2")
    long = met.withColumn("lead", lead.cast("int")).select(
        "item", "row", "profile", "piece", (F.col("start") + F.col("lead")).alias("start"), "end",
        F.decode(F.expr("substring(bytes, lead + 1, length(bytes))"), "UTF-8").alias("body"),
    )
    # Items that fit are joined only here, where their length is known to be within the largest limit.
    small = sized.where(F.col("total") <= most).select("item", "row", "total", F.array_join("parts", GLUE).alias("body")).dropDuplicates(["item", "row"])
    given = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(m).alias("max_bytes")) for p, m, _ in limits])
    fits = small.withColumn("p", F.explode(F.filter(given, lambda p: p["max_bytes"] >= F.col("total"))))
    fits = fits.select("item", "row", "p.profile", F.lit(1).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("total").alias("end"), "body")
    return long.unionByName(fits)
