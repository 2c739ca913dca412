from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireforge.llm import splitting as sp

SECTIONS = "section_id long, title string, body_blocks array<struct<page_no: int, text: string>>, item long, row long, profile string"
PROFILES = "profile string, max_bytes int, overlap_bytes int, total long"


def tables(spark, sections, profiles):
    rows = [(i, t, None if b is None else [(1, x) for x in b], 0, 0, "clash") for i, t, b in sections]
    return sp.item_blocks(spark.createDataFrame(rows, SECTIONS), "section_id", "title", "body_blocks"), spark.createDataFrame([(*p, 0) for p in profiles], PROFILES)


def check(spark, sections, profiles):
    blocks, limits = tables(spark, sections, profiles)
    texts = {(r["item"], r["row"]): "\n\n".join(r["parts"]) for r in blocks.collect()}
    by = defaultdict(list)
    for r in sp.pieces(blocks, limits).collect():
        by[r["item"], r["row"], r["profile"]].append(r)
    for (item, row, profile), rows in by.items():
        most, overlap = next((m, o) for p, m, o in profiles if p == profile)
        rows.sort(key=lambda r: r["piece"])
        whole = texts[item, row].encode()
        assert [r["piece"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0]["start"] == 0 and rows[-1]["end"] == len(whole)
        for a, b in zip([None, *rows], rows, strict=False):
            assert b["body"].encode() == whole[b["start"] : b["end"]] and len(b["body"].encode()) <= most
            assert a is None or 0 <= overlap - (a["end"] - b["start"]) <= 3
        assert (len(rows) > 1) == (len(whole) > most)
    assert len(by) == sum(bool(t) for t in texts.values()) * len(profiles)
    found = {(r["item"], r["profile"]) for r in sp.cuts(blocks, limits).collect()}
    assert found == {(i, p) for (i, _), t in texts.items() for p, m, _ in profiles if len(t.encode()) > m}
    return by, blocks, limits


def test_shapes(spark):
    long = "日本語の長い文章。" * 3000
    sections = [
        (1, "T", ["short"]), (1, "T", ["short"]), (2, "T", ["word " * 4000]), (3, None, ["x" * 50_000]), (4, "  ", [None, "", long, "a" * 100_000 + "😀" * 30_000]), (5, None, None), (6, "t" * 3000, []),
        (7, "T", ["para one. " * 20] * 40), (None, "n", ["y" * 2000]), (None, "n", ["z" * 2000]), (8, " ", [" "]),
    ]
    by, *_ = check(spark, sections, [("small", 300, 50), ("wide", 5000, 0), ("big", 100_000, 1000)])
    assert len(by[next(k for k in by if k[0] == 1 and k[2] == "small")]) == 1


def test_natural_places(spark):
    text = ["First sentence here. Second sentence is here too. " * 2, "Next paragraph " * 20]
    _, blocks, limits = check(spark, [(1, "Title", text)], [("p", 200, 0)])
    strengths = sorted(r["strength"] for r in sp.cuts(blocks, limits).collect())
    assert strengths[-1] == 5 and strengths[0] >= 1


def test_exact_limit_is_one_piece(spark):
    by, *_ = check(spark, [(1, "T", ["x" * 97]), (2, "T", ["x" * 98])], [("p", 100, 10)])
    assert sorted(len(v) for v in by.values()) == [1, 2]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n,é日😀", max_size=900), min_size=1, max_size=4))
def test_any_text(spark, parts):
    check(spark, [(1, "T", parts)], [("p", 64, 16), ("q", 33, 5)])


def test_borders_of_ranges_and_cells(spark, monkeypatch):
    monkeypatch.setattr(sp, "RANGE_BYTES", 100)
    text = ("Satz eins. Noch einer, länger 日本; " * 7 + "\n \t\n   ") * 6 + " " * 300 + "\n\n" + "😀" * 90
    sections = [(1, "T", [text, "tail"]), (2, "\n\n", ["a\n", "\nb" * 90])]
    by, blocks, limits = check(spark, sections, [("p", 64, 16), ("q", 200, 31)])
    small = sorted(map(tuple, sp.cuts(blocks, limits).collect()))
    for size, giant in ((7, 1 << 24), (1 << 16, 1 << 24), (333, 500)):
        monkeypatch.setattr(sp, "RANGE_BYTES", size)
        monkeypatch.setattr(sp, "GIANT_BYTES", giant)
        assert sorted(map(tuple, sp.cuts(blocks, limits).collect())) == small


def test_item_of_many_blocks(spark):
    """Work and memory follow the text, also for an item of very many small blocks."""
    n = 200_000
    df = spark.range(1).selectExpr("id as section_id", "'T' as title", f"transform(sequence(1, {n}), i -> named_struct('page_no', 1, 'text', concat('block of words ', i))) as body_blocks")
    blocks = sp.item_blocks(df, "section_id", "title", "body_blocks")
    limits = spark.createDataFrame([("p", 4800, 240)], "profile string, max_bytes int, overlap_bytes int")
    got = sp.pieces(blocks, limits).selectExpr("count(*) as n", "max(piece) as last", "max(octet_length(body)) as most", "max(end) as bytes", "count_if(octet_length(body) <> end - start) as off").first()
    total = 1 + sum(2 + len(f"block of words {i}") for i in range(1, n + 1))
    assert got["n"] == got["last"] and got["most"] <= 4800 and got["bytes"] == total and got["off"] == 0


def test_all_profiles_count(spark):
    _, limits = tables(spark, [], [(f"p{i}", 100 + i, 10) for i in range(1200)])
    assert len(sp._profiles(limits)) == 1200


def test_empty_and_refused(spark):
    blocks, limits = tables(spark, [], [("p", 100, 10)])
    assert sp.pieces(blocks, limits).count() == 0 and sp.cuts(blocks, limits).count() == 0
    blocks, none = tables(spark, [(1, "T", ["x"])], [])
    assert sp.cuts(blocks, none).count() == 0
    with pytest.raises(ValueError):
        sp.cuts(*tables(spark, [(1, "T", ["x"])], [("p", 100, 90)]))
