from datetime import datetime

from quireforge.operators import references as r

LINKS = "link_id long, source_document string, target string, seen_at timestamp_ntz, title string, key string"
DOCS = "doc_id long, title string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, key string, field string"
T = [datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)]


def tables(spark, links, docs):
    return (
        spark.createDataFrame([(i, s, t, at, "clash", "clash") for i, s, t, at in links], LINKS),
        spark.createDataFrame([(i, t, at, gone, "clash", "clash") for i, (t, at, gone) in enumerate(docs)], DOCS),
    )


def missing(spark, links, docs):
    found = r.link_references(*tables(spark, links, docs))
    return {(x["ref_id"], x["field"]) for x in found.orphans().collect()}


def test_ways_to_write_a_title(spark):
    docs = [("Kilo Tower: Part 2", T[0], None), ("A/B Test", T[0], None), ("Old One", T[0], T[1]), (None, T[0], None)]
    good = ["kilo tower part 2", "Kilo_Tower:_Part_2", "notes/Kilo Tower: Part 2", "../in/kilo-tower-part-2.md", "Kilo Tower: Part 2#Heading", "Kilo Tower: Part 2.adoc#x", " KILO  TOWER – PART 2 ", "A/B Test", "dir/ab test.PDF", "A/B Test#top"]
    bad = ["Kilo Tower", "???", "Old One", "B", "#Heading"]
    links = [(i, None, t, T[1]) for i, t in enumerate(good + bad)]
    assert missing(spark, links, docs) == {(i, "target") for i in range(len(good), len(good) + len(bad))}


def test_nulls_blanks_and_repeats(spark):
    docs = [("Here", T[0], None)]
    links = [(1, None, None, T[0]), (2, "", "  ", T[0]), (3, "  ", "Gone", None), (3, "  ", "Gone", None), (None, "Gone", "Here", T[0])]
    assert missing(spark, links, docs) == {(3, "target"), (None, "source_document")}
    report = {(x["field"], x["month"]): (x["n_refs"], x["n_missing"], x["n_late"]) for x in r.link_references(*tables(spark, links, docs)).report().collect()}
    assert report == {("target", None): (1, 1, 0), ("target", "2024-01"): (1, 0, 0), ("source_document", "2024-01"): (1, 1, 0)}


def test_late_documents_and_hot_key(spark):
    docs = [("Hot", T[1], None), ("Hot", T[2], None), ("Rare", T[2], None)]
    links = [(i, None, "hot", T[0] if i % 2 else T[2]) for i in range(400)] + [(1000 + i, "nowhere %d" % i, "Rare", T[0]) for i in range(20)]
    report = {(x["field"], x["month"]): (x["n_refs"], x["n_missing"], x["n_late"]) for x in r.link_references(*tables(spark, links, docs)).report().collect()}
    assert report[("target", "2024-01")] == (220, 0, 220) and report[("target", "2024-03")] == (200, 0, 0)
    assert report[("source_document", "2024-01")] == (20, 20, 0)


def test_record_that_came_inside_a_month(spark):
    day = lambda d: datetime(2024, 5, d)
    docs = [("Hot", day(10), None), ("A/B", day(4), None)]
    links = [(i, "A/B", "dir/hot.md", day(1 + i % 20)) for i in range(200)] + [(500 + i, None, "Gone", day(3)) for i in range(300)]
    found = r.link_references(*tables(spark, links, docs))
    report = {(x["field"], x["month"]): (x["n_refs"], x["n_missing"], x["n_late"]) for x in found.report().collect()}
    assert report == {("target", "2024-05"): (500, 300, 90), ("source_document", "2024-05"): (200, 0, 30)}
    assert found.orphans().count() == 300 and found.heavy.count() == 3


def test_empty(spark):
    assert missing(spark, [], []) == set()
    assert missing(spark, [(1, "A", "B", T[0])], []) == {(1, "target"), (1, "source_document")}


def test_very_long_value(spark):
    long = "x" * 200_000
    assert missing(spark, [(1, long, "f/" + long + ".md", T[0])], [(long.upper(), T[0], None)]) == set()
