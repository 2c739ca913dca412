"""Plain text as a page of words with made-up places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def text_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, place, word, x0, y0, x1, y1): line i stands at y = i, words one space apart, each character one
    wide. Blank lines only take a line. Null texts have no words."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "t"))
    words = lines.select("doc_id", "line", F.posexplode(F.split(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""), r"(?U)\s+")).alias("place", "word")).where("word <> ''")
    before = Window.partitionBy("doc_id", "line").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    x0 = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)).cast("double")
    placed = words.withColumn("x0", x0)
    return placed.select("doc_id", "line", "place", "word", "x0", F.col("line").cast("double").alias("y0"), (F.col("x0") + F.length("word")).alias("x1"), (F.col("line") + 1).cast("double").alias("y1"))


def plain_text(content: Column, path: Column) -> Column:
    """The text of a plain file; markup files lose their tags."""
    markup = F.lower(path).rlike(r"\.(html?|xml)$")
    return F.when(markup, tx.strip_markup(content)).otherwise(content)
