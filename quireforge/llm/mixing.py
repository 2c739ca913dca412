"""Mixing sources to target weights, by weighted fair queueing.

Each source's documents stand in a shuffled queue that may be passed max_repeats times. A copy's virtual finish time is
the source's tokens up to it, divided by the source's share; taking the copies by virtual time up to the budget gives
each source its share of it. Running sums are taken in two steps, over buckets of the shuffle hash and inside them, so
that no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch

BUCKETS = 1 << 14
"""Buckets of a queue: its rows in one window are about 1/16384 of it, and the sums of buckets have as many rows."""


def _running(df: DataFrame, group: str, bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over the rows of a group up to each row; bucket must agree with order."""
    rows = df.withColumn("__b", bucket)
    sums = rows.groupBy(group, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, [group, "__b"]).withColumn(out, F.col("__before") + F.sum(value).over(inside)).drop("__b", "__before")


def mix_shares(targets: DataFrame, totals: DataFrame, budget: int | None) -> DataFrame:
    """Per mix and source: target_share among all targets, fair_share among those with tokens, total, max_repeats, the
    mix's budget, and short: the tokens of its share that a source cannot give, repeated as often as it may be. The
    budget is the given one, else the most tokens for which every source with documents can give its share."""
    wanted = targets.where("mix_name is not null and source is not null and target_weight > 0").groupBy("mix_name", "source").agg(
        F.sum("target_weight").alias("weight"), F.when(F.min("max_repeats").isNotNull(), F.greatest(F.min("max_repeats"), F.lit(0))).alias("max_repeats")
    )
    met = wanted.join(totals, "source", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    has = (F.col("total") > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0)
    mix = Window.partitionBy("mix_name")
    met = met.withColumn("max_repeats", F.coalesce("max_repeats", F.lit(1)))
    met = met.withColumn("target_share", F.col("weight") / F.sum("weight").over(mix))
    met = met.withColumn("fair_share", F.when(has, F.col("weight") / F.sum(F.when(has, F.col("weight"))).over(mix)))
    most = F.min(F.col("total") * F.col("max_repeats") / F.col("fair_share")).over(mix)
    met = met.withColumn("budget", most if budget is None else F.lit(float(budget)))
    gap = F.floor(F.col("budget") * F.col("fair_share") * (1 + 1e-12)) - F.col("total") * F.col("max_repeats")
    return met.withColumn("short", F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)).cast("long")).drop("weight")


def mix_sources(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The selection and the report of shares.

    sized: doc_id, source, n_tokens, a row per document. Selection: mix_name, position (from 1, by virtual finish
    time), source, doc_id, repeat, n_tokens, of copies whose virtual finish time is within the budget. Documents
    without source, without tokens or of no target are not used; targets without documents reach nothing and the others
    share their part. With a budget of one's own small sources fall short of it, and the mix is smaller by what they
    lack; no other source is used above its share. Report: every target with its shares, tokens, repeats and what it is
    short of. A null max_repeats counts as 1.
    """
    s = Scratch(sized.sparkSession, "mix")
    usable = s.cut(
        sized.where("source is not null and n_tokens > 0").select("doc_id", "source", "n_tokens").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    )
    totals = usable.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    shares = s.cut(mix_shares(targets, totals, budget))
    queue = _running(usable, "source", F.shiftrightunsigned("h", 50).bitwiseXOR(F.lit(BUCKETS // 2)), ["h", "doc_id"], "n_tokens", "upto")
    room = shares.where("fair_share is not null").select("mix_name", "source", "fair_share", "total", "max_repeats", "budget")
    # The targets are a small fixed table; its size decides how it is joined.
    offered = queue.join(room, "source")
    tokens_left = F.col("budget") * F.col("fair_share") * (1 + 1e-12) - F.col("upto")
    passes = F.least(F.col("max_repeats").cast("long"), F.floor(tokens_left / F.col("total")) + 1)
    copies = offered.where(tokens_left >= 0).withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(passes, F.lit(1)))))
    timed = copies.withColumn("vft", (F.col("upto") + (F.col("repeat") - 1) * F.col("total")) / F.col("fair_share")).withColumn("one", F.lit(1).cast("long"))
    timed = timed.select("mix_name", "source", "doc_id", "repeat", "n_tokens", "vft", "one", F.least(F.floor(F.col("vft") / F.col("budget") * BUCKETS), F.lit(BUCKETS)).alias("slot"))
    chosen = _running(timed, "mix_name", F.col("slot"), ["vft", "source", "doc_id", "repeat"], "one", "position")
    chosen = s.cut(chosen.select("mix_name", "position", "source", "doc_id", F.col("repeat").cast("int").alias("repeat"), "n_tokens"))
    used = chosen.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("copies"), F.max("repeat").alias("most_repeats"))
    mix = Window.partitionBy("mix_name")
    zero = F.lit(0)
    report = shares.join(used, ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", "max_repeats", F.col("total").alias("source_tokens"),
        F.coalesce("tokens", zero).alias("tokens"), F.coalesce("copies", zero).alias("copies"), F.coalesce("most_repeats", zero).alias("most_repeats"),
        F.coalesce(F.coalesce("tokens", zero) / F.sum("tokens").over(mix), F.lit(0.0)).alias("actual_share"), "fair_share", "short",
    )
    return chosen, report
