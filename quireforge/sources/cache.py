"""What was extracted from a file, kept by the hash of its content, so that no file is extracted twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def _stored(files: DataFrame, path: str) -> DataFrame | None:
    spark = files.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path)


def extract_cached(files: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``extract`` for every file (sha256, ...), with sha256. Where these have an error they are given back but
    not stored, so a content that failed is tried again. Contents already stored at ``path`` are read from
    there; those of new hashes are extracted once each, however many files have them, and appended. An appended file
    becomes visible when its write is committed, so a lost task leaves nothing half done; a content that gave no rows
    is tried again."""
    stored = _stored(files, path)
    fresh = files.dropDuplicates(["sha256"]).where("sha256 is not null")
    if stored is not None:
        fresh = fresh.join(stored.select("sha256").distinct(), "sha256", "left_anti")
    made = extract(fresh)
    failed = None
    if "error" in made.columns:
        made = (scratch or Scratch(files.sparkSession, "extract")).cut(made)
        failed, made = made.where("error is not null"), made.where("error is null")
    made.write.mode("append").option("compression", "zstd").parquet(path)
    known = files.sparkSession.read.schema(made.schema).parquet(path).join(files.select("sha256").distinct(), "sha256", "left_semi")
    return known if failed is None else known.unionByName(failed)


def cached_share(files: DataFrame, path: str) -> DataFrame:
    """One row: n_files and n_cached."""
    stored = _stored(files, path)
    known = files.select("sha256").withColumn("hit", F.lit(False)) if stored is None else files.select("sha256").join(stored.select("sha256", F.lit(True).alias("hit")).distinct(), "sha256", "left")
    return known.agg(F.count("*").alias("n_files"), F.count_if("hit").alias("n_cached"))
