"""Joins whose hot keys are split: found by pre-aggregated counts, told to all workers, salted on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 200
"""A key with at least 1/200 of all rows is heavy, so there are at most 200 heavy keys at any size."""
SALTS = 64


def heavy_keys(df: DataFrame, keys: list[str], share: int = HEAVY_SHARE) -> DataFrame | None:
    """The heavy keys as a table of at most ``share`` rows; None where there are none. Null keys are never heavy, as they
    join nothing."""
    counts = df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("__n"))
    least = max(1, -(-df.count() // share))
    rows = counts.where(F.col("__n") >= least).orderBy(F.desc("__n")).limit(share).select(*keys).collect()
    return df.sparkSession.createDataFrame(rows, df.select(*keys).schema) if rows else None


def salted_join(big: DataFrame, small: DataFrame, on: list[str], heavy: dict[str, DataFrame | None], by: list[str], how: str = "inner") -> DataFrame:
    """big joined to small, which has a row per key; rows of big with a heavy value in a column of ``on`` are dealt to
    SALTS places by a hash of ``by``, and small's rows of that value are sent to all of these. how: inner or left."""
    cols = [c for c in on if heavy.get(c) is not None]
    if not cols:
        return big.join(small, on, how)
    hot = F.lit(False)
    for c in cols:
        flag = F.broadcast(heavy[c].select(c, F.lit(True).alias(f"__hot_{c}")))
        big, small, hot = big.join(flag, c, "left"), small.join(flag, c, "left"), hot | F.coalesce(f"__hot_{c}", F.lit(False))
    flags = [f"__hot_{c}" for c in cols]
    big = big.withColumn("__salt", F.when(hot, F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0)).drop(*flags)
    small = small.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop(*flags)
    return big.join(small, [*on, "__salt"], how).drop("__salt")
