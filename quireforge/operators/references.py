"""References to records that do not exist, counted per key and period and split by the weight of the referred key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .skew import HEAVY_SHARE, salted_join


def fold_title(value: Column) -> Column:
    """What is left of a name when letter case, spacing and punctuation don't count; null if nothing is."""
    kept = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}\p{M}]+", "")
    return F.when(F.length(kept) > 0, kept)


def strip_heading(value: Column) -> Column:
    """A link target without heading after the title and file ending."""
    return F.regexp_replace(F.regexp_replace(value, r"(?s)(?<=.)#.*$", ""), r"(?i)\.(md|markdown|adoc|asciidoc|txt|url|urls|pdf|html?)\s*$", "")


def strip_link(value: Column) -> Column:
    """A link target without leading folder, heading after the title and file ending."""
    return F.regexp_replace(strip_heading(value), r"(?s)^.*[/\\](?=.*[^\s/\\])", "")


def _present(value: Column) -> Column:
    return value.isNotNull() & F.regexp_replace(value, r"[\s  -​ 　﻿]+", "").__ne__("")


def references(df: DataFrame, fields: list[str], id_col: str, at_col: str) -> DataFrame:
    """One row per distinct reference: ref_id, field, seen_at, period (month of seen_at), key (the fold of the value
    without folder, heading and ending), others (what else the value can name: with its folder, or as a whole). Null and
    blank values refer to nothing."""
    rows = df.select(F.col(id_col).alias("ref_id"), F.col(at_col).alias("seen_at"), *fields).distinct()
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    long = rows.select("ref_id", "seen_at", F.explode(each).alias("r")).select("ref_id", "seen_at", "r.field", "r.value")
    fold = lambda c: F.coalesce(fold_title(c), F.lit(""))
    value = F.col("value")
    named = long.where(_present(value)).select("ref_id", "field", "seen_at", fold(strip_link(value)).alias("key"), fold(strip_heading(value)).alias("kept"), fold(value).alias("exact"))
    return named.select("ref_id", "field", "seen_at", F.date_format("seen_at", "yyyy-MM").alias("period"), "key", F.array_except(F.array("kept", "exact"), F.array("key")).alias("others"))


class Resolved:
    """References counted per key and period and looked up once per key, so that a hot key is one row wherever keys
    meet. refs: as of ``references``; live: key, at of the records that are there, at never null."""

    def __init__(self, refs: DataFrame, live: DataFrame, scratch: Scratch):
        self.refs = refs
        self.counts = scratch.cut(refs.groupBy("key", "others", "field", "period").agg(F.count("*").alias("n"), F.min("seen_at").alias("low"), F.max("seen_at").alias("high")))
        keys = self.counts.groupBy("key", "others").agg(F.sum("n").alias("n"))
        known = live.where("key is not null").groupBy("key").agg(F.min("at").alias("first_at"))
        by_key = keys.join(known, "key", "left")
        plain = by_key.where("first_at is not null or size(others) = 0")
        again = by_key.where("first_at is null and size(others) > 0").select("key", "others", "n", F.explode("others").alias("other"))
        again = again.join(known.withColumnRenamed("key", "other"), "other", "left").groupBy("key", "others", "n").agg(F.min("first_at").alias("first_at"))
        self.keys = scratch.cut(plain.select("key", "others", "n", "first_at").unionByName(again))
        least = max(1, -(-(self.keys.agg(F.sum("n")).first()[0] or 0) // HEAVY_SHARE))
        # At most HEAVY_SHARE rows, as each holds that part of all references.
        self.heavy = self.keys.where(F.col("n") >= least)

    def orphans(self) -> DataFrame:
        """(ref_id, field, seen_at) of the references without a live record: heavy keys by a broadcast of at most
        HEAVY_SHARE rows, the others by a shuffled anti-join with the keys that are there."""
        heavy = F.broadcast(self.heavy.select("key", "others", F.col("first_at").isNull().alias("gone")))
        marked = self.refs.join(heavy, ["key", "others"], "left")
        there = self.keys.where("first_at is not null").select("key", "others")
        rest = marked.where("gone is null").join(there, ["key", "others"], "left_anti")
        return marked.where("gone").unionByName(rest).select("ref_id", "field", "seen_at")

    def report(self) -> DataFrame:
        """Per field and period: all references (n_refs), those without a live record ever (n_missing), and those whose
        record came only after they were seen (n_late). Counts of heavy and other keys are summed; single references
        are looked at again only where a record came inside the period of the references to it."""
        met = self.counts.join(self.keys.select("key", "others", "first_at"), ["key", "others"])
        mixed = (F.col("first_at") > F.col("low")) & (F.col("first_at") <= F.col("high"))
        sums = met.groupBy("field", "period").agg(
            F.sum("n").alias("n_refs"), F.sum(F.when(F.col("first_at").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
            F.sum(F.when(F.col("first_at") > F.col("high"), F.col("n")).otherwise(0)).alias("n_late"),
        )
        hot = self.heavy.select("key").distinct()
        on = ["key", "others", "field", "period"]
        seen = salted_join(self.refs, met.where(mixed).select(*on, "first_at"), on, {"key": hot}, ["ref_id"]).where("first_at > seen_at")
        inside = seen.groupBy("field", "period").agg(F.count("*").alias("n_late"))
        parts = sums.unionByName(inside, allowMissingColumns=True).groupBy("field", F.col("period").alias("month"))
        return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_refs", "n_missing", "n_late")])


def link_references(wikilinks: DataFrame, documents: DataFrame) -> Resolved:
    """The references of wikilinks.target and source_document against the titles of live documents.

    A title is also tried as a whole where it holds a slash, a # or a file ending itself. Of a repeated link_id each
    different row counts. A null seen_at falls into the null month and is never late; a null ingested_at counts as
    always there."""
    s = Scratch(wikilinks.sparkSession, "references")
    refs = s.cut(references(wikilinks, ["target", "source_document"], "link_id", "seen_at"))
    live = documents.where("deleted_at is null").select(fold_title(F.col("title")).alias("key"), F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"))
    return Resolved(refs, live, s)
