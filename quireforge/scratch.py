"""Tables that cut a lineage, kept in the folder that all executors share.

``cut`` writes a frame as Parquet below ``spark.checkpoint.dir`` and reads it back: the plan starts anew there, the
blocks outlive any executor, and the optimizer sees real sizes. Only where that setting is missing, as in a local
test session, a folder of this machine is taken.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="quireforge-")
        atexit.register(shutil.rmtree, _local[app], True)
    return "file://" + _local[app]


class Scratch:
    """Names tables of one run; ``drop`` deletes those that no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (back, path)
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``cut`` wrote, once every frame that reads it has been written itself."""
        _, path = self.paths.pop(id(df), (None, None))
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: an input of few files is dealt out before costly work on
    its rows; one of many partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
