from pyspark.sql import functions as F

from quireforge import schema
from quireforge.functions import text as tx


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x"))
    return [r["x"] for r in df.orderBy("i").collect()]


def test_slugify(spark):
    got = one(spark, tx.slugify, "Storm King's Thunder", "  É x  ", "---", "", None, "word " * 40)
    assert got[:5] == ["storm-king-s-thunder", "x", "", "", None] and len(got[5]) <= 90 and got[5].startswith("word-word-")
    a, b = one(spark, tx.slugify, "y" * 100 + "1", "y" * 100 + "2")
    assert a != b


def test_display_name(spark):
    assert one(spark, tx.display_name, "URIDIMMU THE\tBOLD", " Mixed Case ", "12", None) == ["Uridimmu The Bold", "Mixed Case", "12", None]


def test_byte_prefix(spark):
    for n in range(1, 9):
        text = "aé日😀z"
        want = text.encode()[:n].decode("utf-8", "ignore")
        assert one(spark, lambda c, n=n: tx.byte_prefix(c, n), text) == [want]


def test_links_and_tags(spark):
    assert one(spark, tx.wikilink_targets, "a [[ X |y]] ![[Z]] [[bad\nlink]] [[]]") == [["X", "Z"]]
    assert one(spark, tx.tags, "#lead x #mid/sub no#url http://a#frag #1no é #été") == [["lead", "mid/sub", "été"]]


def test_markup_and_fingerprint(spark):
    assert one(spark, tx.strip_markup, "<p\nx>a&amp;lt;b</p>&nbsp;&#39;") == ["\na<b\n '"]
    import hashlib

    df = spark.createDataFrame([("T", ["a", "b"]), ("T", [])], "t string, b array<string>").select(tx.fingerprint(F.col("t"), F.col("b")).alias("x"))
    assert [r["x"] for r in df.collect()] == [hashlib.sha256(s.encode()).hexdigest() for s in ("T\x01a\x01b\x01", "T\x01")]


def test_frontmatter_accessors(spark):
    df = spark.createDataFrame([('{"tags": ["a", "b"], "title": "x"}',), ('{"tags": "one"}',), ("broken",), (None,)], "j string")
    rows = df.select(tx.frontmatter_list(F.col("j"), "tags").alias("t"), tx.frontmatter_scalar(F.col("j"), "title").alias("s")).collect()
    assert [(r["t"], r["s"]) for r in rows] == [(["a", "b"], "x"), (["one"], None), ([], None), ([], None)]


def test_heading_score(spark):
    got = one(spark, lambda c: tx.heading_score(c, F.lit(False)), "Two Words", "ALL CAPS", "2nd-level illusion", "A sentence that ends.", "", "x" * 70)
    assert got == [4, 4, 2, 1, 0, 1]


def test_kinds(spark):
    assert one(spark, schema.block_kind, "heading", "odd", None) == ["heading", "body", "body"]
    assert one(spark, schema.edge_kind, "links_to", "odd") == ["links_to", "mentions"]
    assert set(schema.DDL) >= {"documents", "chunks", "edges"} and all(schema.schema(n).fields for n in schema.DDL)
    import pytest

    with pytest.raises(Exception, match="not allowed"):
        schema.checked(spark.createDataFrame([("x",)], "kind string"), "kind", schema.EDGE_KINDS).collect()
