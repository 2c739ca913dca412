"""Live SQL sources: a read-only SQLite file through the Python data source API, others through JDBC."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..config import Source, SourceQuery


def stringify(v) -> str:
    if v is None:
        return ""
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, bytes):
        return f"<{len(v)} bytes>"
    return str(v)


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.query = options["path"], options["query"]

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        con = _connect(self.path)
        try:
            for row in con.execute(self.query):
                yield tuple(stringify(v) for v in row)
        finally:
            con.close()


class ReadOnlySqlite(DataSource):
    """format("sqlite_readonly") with the options path and query; every value comes as text."""

    @classmethod
    def name(cls):
        return "sqlite_readonly"

    def schema(self):
        con = _connect(self.options["path"])
        try:
            names = [c[0] for c in con.execute(f"SELECT * FROM ({self.options['query'].rstrip().rstrip(';')}) LIMIT 0").description]
        finally:
            con.close()
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema):
        return _Reader(self.options)


def read_sqlite(spark: SparkSession, path: str, query: str) -> DataFrame:
    spark.dataSource.register(ReadOnlySqlite)
    return spark.read.format("sqlite_readonly").option("path", path).option("query", query).load()


def _jdbc(driver: str):
    def read(spark: SparkSession, dsn: str, query: str) -> DataFrame:
        return spark.read.format("jdbc").option("url", dsn).option("driver", driver).option("query", query).load()

    return read


READERS = {"sqlite": read_sqlite, "postgres": _jdbc("org.postgresql.Driver"), "mysql": _jdbc("com.mysql.cj.jdbc.Driver")}


def read_source(spark: SparkSession, source: Source, query: SourceQuery) -> DataFrame:
    """The rows of a query of a source; JDBC kinds need their driver on the class path."""
    if source.kind not in READERS:
        raise ValueError(f"unknown kind of data source: {source.kind}")
    return READERS[source.kind](spark, source.dsn, query.sql)
