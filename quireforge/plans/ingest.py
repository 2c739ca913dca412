"""Queries of incremental ingestion, in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import files
from ..streaming import incremental
from . import query


@query(
    "incremental_new_docs",
    "WITH cut AS (SELECT quantile_disc(ingested_at, 0.5) AS t FROM documents) SELECT doc_id, path FROM documents, cut WHERE ingested_at > t AND sha256 NOT IN (SELECT sha256 FROM documents, cut WHERE ingested_at <= t)",
)
def incremental_new_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "path", "sha256", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"))
    half = docs.agg(F.expr("percentile_disc(0.5) within group (order by at)").cast("long").alias("t")).first()["t"]
    return files.new_documents(docs.where(F.col("at") > F.lit(half)), docs.where(F.col("at") <= F.lit(half))).select("doc_id", "path")


@query(
    "upsert_by_path",
    """WITH fresh AS (SELECT path, title || ' (new)' AS title, bytes FROM documents WHERE kind = 'adoc' AND title IS NOT NULL)
SELECT path, title, bytes FROM documents WHERE path NOT IN (SELECT path FROM fresh) UNION ALL SELECT path, title, bytes FROM fresh""",
)
def upsert_by_path(spark, d):
    docs = table(spark, d, "documents").select("path", "title", "bytes")
    fresh = table(spark, d, "documents").where("kind = 'adoc' and title is not null").select("path", F.concat("title", F.lit(" (new)")).alias("title"), "bytes")
    return files.upsert(docs, fresh)


@query("stream_incremental_ingest", "SELECT sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def stream_incremental_ingest(spark, d):
    """All documents through the streaming path, one row for each content."""
    return incremental.distinct_contents(spark, d)


@query(
    "stream_event_windows",
    "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def stream_event_windows(spark, d):
    return incremental.event_windows(spark, d)
