"""Incremental ingestion as a stream: new files in, every content once, the same batch functions behind."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that has come, in micro-batches, and stop; a later call goes on from the checkpoint."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_stream(stream: DataFrame, known: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Rows with sha256 whose content is not known yet go to ``write`` in batches. ``known`` gives the hashes stored so
    far, so a batch that is run again after a loss writes nothing twice if ``write`` replaces by batch number."""

    def batch(df: DataFrame, number: int) -> None:
        stored = known()
        write(df if stored is None else df.join(stored.select("sha256"), "sha256", "left_anti"), number)

    run_available(stream, batch, checkpoint)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = os.path.join(d, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    # A table can be one file or a folder of files; a stream reads a folder.
    if os.path.isfile(path):
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return spark.readStream.schema(schema).parquet(path)


def _latest(spark: SparkSession, path: str, keys: list[str], values: list[str]) -> DataFrame:
    """Of what the batches wrote for a key the last."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def _updates(stream: DataFrame, base: str, name: str) -> str:
    """Every batch writes the groups that it changed, below its number, so that one run again writes nothing twice."""
    path = f"{base}/{name}"
    run_available(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), f"{base}/checkpoint", "update")
    return path


def distinct_contents(spark: SparkSession, d: str) -> DataFrame:
    """(sha256, doc_id, n): counts of every content, kept as the state of a stream and pre-aggregated in each batch."""
    s = Scratch(spark, "stream")
    docs = _read(spark, d, "documents").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return _latest(spark, _updates(docs, s.base, "contents"), ["sha256"], ["doc_id", "n"])


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """(window_start, event_type, n, total) in windows of an hour. State of windows older than a year before the newest
    event of the batches so far is dropped, and so are events that come later than that; none of one run's are."""
    s = Scratch(spark, "stream")
    events = _read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "365 days")
    counted = events.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = _latest(spark, _updates(counted, s.base, "windows"), ["window", "event_type"], ["n", "total"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
