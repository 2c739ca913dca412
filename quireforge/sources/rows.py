"""Rows of any table as blocks: a heading and a line for each other column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_text(c: Column, kind: str) -> Column:
    """A value as text: null is empty, a whole double has no decimals, bytes become their size."""
    if kind == "binary":
        out = F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>"))
    elif kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        out = F.when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def row_blocks(df: DataFrame, order_by: list[str], heading_column: str | None = None) -> DataFrame:
    """(row_key, ord, kind, text, heading_level): of each row the heading column (the first by default), then
    ``column: value`` lines. An empty heading stays as an empty text; row_key is the struct of ``order_by``."""
    kinds = dict(df.dtypes)
    head = heading_column or df.columns[0]
    if head not in kinds:
        raise ValueError(f"no column {head}")
    block = lambda n, kind, text, level: F.struct(F.lit(n).alias("ord"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(level).cast("int").alias("heading_level"))
    parts = [block(0, "heading", as_text(F.col(head), kinds[head]), 1)]
    for n, c in enumerate((c for c in df.columns if c != head), 1):
        parts.append(block(n, "body", F.concat(F.lit(f"{c}: "), as_text(F.col(f"`{c}`"), kinds[c])), None))
    keyed = df.select(F.struct(*order_by).alias("row_key"), F.explode(F.array(*parts)).alias("b"))
    return keyed.select("row_key", "b.ord", "b.kind", "b.text", "b.heading_level")
