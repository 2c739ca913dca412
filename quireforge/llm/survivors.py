"""One record for each group of records that state the same thing, by iterative truth discovery.

Sources (documents) and stated values vote for each other: a value's support is the sum of its sources' reliability, a
source's reliability the mean share that its values win, until neither moves. Every round pre-aggregates before it
shuffles; groups and sources with many claims are salted in the joins, so a group that a third of all rows state stays
spread.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import skew
from ..scratch import Scratch

# Ways to say that there is no value, folded as in _fold_empty.
EMPTY_WORDS = [
    "n/a", "na", "n.a.", "n.a", "k. a.", "k.a.", "keine angabe", "not stated", "not recorded", "not available", "not known", "(blank)", "blank", "tbd", "tba",
    "to be determined", "to be confirmed", "to do", "todo", "null", "nil", "none", "nan", "inconnu", "inconnue", "unbekannt", "desconocido", "desconocida",
    "sin datos", "s/d", "s. d.", "sans données", "ohne angabe", "o. a.", "[missing]", "missing", "see above", "see below", "siehe oben", "voir ci-dessus",
    "véase arriba", "unknown", "undefined", "empty", "(none)", "(unknown)", "[unknown]", "<unknown>", "<null>", "(null)", "?", "x", "xxx",
]
PRIOR_SHARE, PRIOR_WEIGHT = 0.5, 2.0
"""A source is held to have won half of two further claims, so that one claim alone does not make it sure."""
TOLERANCE = 1e-3


def fold_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)[\s\x{200B}\x{FEFF}]+", " "))


def usable(value: Column) -> Column:
    """Neither null nor blank, nor a word for no value, nor visibly cut off or unreadable."""
    folded = F.lower(fold_space(value))
    empty = folded.isin(EMPTY_WORDS) | folded.rlike(r"^[^\p{L}\p{N}]*$")
    damaged = value.rlike(r"\x{FFFD}|\[cut\]|\[…\]|\(…\)|\[\.\.\.\]|\(\.\.\.\)") | folded.rlike(r"(\.\.\.|…)$")
    return F.coalesce(~empty & ~damaged, F.lit(False))


def fold_value(value: Column) -> Column:
    """Values that differ only in case, white space or a full stop at the end vote as one."""
    return F.regexp_replace(F.lower(fold_space(value)), r"\s*\.$", "")


def fold_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]+", "")


def usable_rows(stated: DataFrame, labels: DataFrame) -> DataFrame:
    """entity_id, label, doc_id, value, at of each row with a usable value. Keys are brought to the label they mean; keys
    that mean none of them and rows without entity or document are left out."""
    names = labels.where("label is not null").groupBy(fold_key(F.col("label")).alias("k")).agg(F.min("label").alias("label"))
    rows = stated.where("entity_id is not null and doc_id is not null").where(usable(F.col("value")))
    rows = rows.select("entity_id", "doc_id", "value", F.col("ingested_at").alias("at"), fold_key(F.col("key")).alias("k"))
    # The labels are a fixed table; a long list is joined by shuffle as its size tells.
    return rows.join(names, "k").select("entity_id", "label", "doc_id", "value", "at")


def claims(stated: DataFrame, labels: DataFrame) -> DataFrame:
    """The usable rows with vote, the fold of value, and without exact repetitions."""
    return usable_rows(stated, labels).select("entity_id", "label", "doc_id", "value", fold_value(F.col("value")).alias("vote"), "at").distinct()


def newest() -> Column:
    """Greater for the later claim (a null time is earliest), at a tie for the smaller doc_id, then for the smaller text."""
    late = F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(1 << 62)))
    smaller = F.transform(F.split("value", ""), lambda c: -F.ascii(c))
    return F.struct(late.alias("o1"), (-F.col("doc_id")).alias("o2"), smaller.alias("o3"))


def discover(votes: DataFrame, scratch: Scratch, rounds: int = 200, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(group, vote, support, share) and (source, reliability) from distinct (group, vote, source).

    A value's support is the sum of its sources' reliability, its share its part of the group's support; a source's
    reliability is the mean share of its values, with a prior. Ends when no reliability moves by tolerance or more, and
    warns if that is not so after rounds. Groups with one value have that value's share of 1 in every round
    and take no part in the rounds; they count for their sources from the start."""
    votes = scratch.cut(votes)
    heavy = {k: skew.heavy_keys(votes, [k]) for k in ("group", "source")}
    spread = lambda big, small, on, by: skew.salted_join(big, small, on, heavy, by)

    def shares_of(rows: DataFrame, trust: DataFrame) -> DataFrame:
        backed = spread(rows, trust.select("source", "reliability"), ["source"], ["group", "vote"]).groupBy("group", "vote").agg(F.sum("reliability").alias("support"))
        whole = backed.groupBy("group").agg(F.sum("support").alias("whole"))
        part = F.when(F.col("whole") > 0, F.col("support") / F.col("whole")).otherwise(0.0)
        return spread(backed, whole, ["group"], ["vote"]).select("group", "vote", "support", part.alias("share"))

    spans = votes.groupBy("group").agg(F.min("vote").alias("a"), F.max("vote").alias("b"))
    marked = scratch.cut(spread(votes, spans, ["group"], ["source"]).select(*votes.columns, (F.col("a") != F.col("b")).alias("contested")))
    live = marked.where("contested").drop("contested")
    trust = scratch.cut(marked.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("contested")).alias("sure")).withColumn("reliability", F.lit(PRIOR_SHARE)))
    while True:
        won = spread(live, shares_of(live, trust).select("group", "vote", "share"), ["group", "vote"], ["source"]).groupBy("source").agg(F.sum("share").alias("won"))
        mean = (F.coalesce("won", F.lit(0.0)) + F.col("sure") + PRIOR_SHARE * PRIOR_WEIGHT) / (F.col("n") + PRIOR_WEIGHT)
        fresh = scratch.cut(trust.join(won, "source", "left").select("source", "n", "sure", mean.alias("reliability"), F.abs(mean - F.col("reliability")).alias("moved")))
        moved, rounds = fresh.agg(F.max("moved")).first()[0], rounds - 1
        scratch.drop(trust)
        trust = fresh
        if moved is None or moved < tolerance:
            break
        if rounds <= 0:
            warnings.warn(f"truth discovery ended before it settled: a reliability still moved by {moved:.4f}", stacklevel=2)
            break
    return scratch.cut(shares_of(votes, trust)), trust.select("source", "reliability")


def survivors(stated: DataFrame, labels: DataFrame, prefer: str = "support", rounds: int = 200) -> DataFrame:
    """One row per entity and label: value, doc_id (the source it is taken from), at, support, share, reliability.

    The value with the most support survives; of values with equal support the one with the more reliable source, then
    the later one, then that of the smaller doc_id, and it is taken from that source. Of several values in one document
    at one time the smaller text counts. prefer="latest": the rows of ``latest`` survive, and support and share say how
    far the sources back them. Fields without a usable value have no row.
    """
    s = Scratch(stated.sparkSession, "survivors")
    said = s.cut(claims(stated, labels).withColumn("group", F.struct("entity_id", "label")).withColumn("source", F.col("doc_id")))
    votes = said.select("group", "vote", "source").distinct()
    shares, trust = discover(votes, s, rounds)
    heavy = {k: skew.heavy_keys(said, [k]) for k in ("group", "source")}
    weighed = skew.salted_join(said, shares, ["group", "vote"], heavy, ["source"])
    weighed = skew.salted_join(weighed, trust, ["source"], heavy, ["group"])
    order = [newest()] if prefer == "latest" else [F.round("support", 9), F.round("reliability", 9), newest()]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = weighed.groupBy("group").agg(F.max(F.struct(rank.alias("rank"), "value", "doc_id", "at", "support", "share", "reliability")).alias("b"))
    return best.select("group.entity_id", "group.label", "b.value", "b.doc_id", "b.at", "b.support", "b.share", "b.reliability")


def latest(stated: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per entity and label: value, doc_id and at of the latest usable statement, as ``newest`` orders them. Time
    alone decides, so nothing is discovered; groups with many rows are aggregated before they are shuffled."""
    best = usable_rows(stated, labels).groupBy("entity_id", "label").agg(F.max(F.struct(newest().alias("rank"), "value", "doc_id", "at")).alias("b"))
    return best.select("entity_id", "label", "b.value", "b.doc_id", "b.at")


def stated_twice(stated: DataFrame) -> DataFrame:
    """Entities with rows from at least two documents, usable or not."""
    span = stated.groupBy("entity_id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return span.where("a < b and entity_id is not null").select("entity_id")
