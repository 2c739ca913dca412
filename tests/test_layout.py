import numpy as np
import pandas as pd

from quireforge.operators import layout as lo


def words(rows):
    return pd.DataFrame([(t, x, y, x + w, y + h) for t, x, y, w, h in rows], columns=["text", "x0", "y0", "x1", "y1"])


def line(text, x, y, h=10.0):
    out, at = [], x
    for w in text.split():
        out.append((w, at, y, 5.0 * len(w), h))
        at += 5.0 * len(w) + 4
    return out


def test_two_columns_and_headings():
    rows = line("Big Title", 50, 20, 14)
    for i in range(12):
        rows += line("left column words here", 50, 60 + 12 * i) + line("right column words there", 330, 60 + 12 * i)
    blocks = lo.layout_page(words(rows), 600)
    assert [b[0] for b in blocks] == [0, 0, 1] and blocks[0][6] == "heading" and blocks[0][7] == "Big Title"
    assert blocks[2][7].startswith("right column words there right") and [b[1] for b in blocks] == [0, 1, 2]


def test_one_column_without_gutter():
    rows = [w for i in range(10) for w in line("some plain words that fill the whole width of this page", 50, 60 + 12 * i)]
    assert len(lo.columns_of(words(rows), 600)) == 1
    assert len(lo.columns_of(words(rows[:5]), 600)) == 1 and lo.columns_of(words(rows), 0.0)[0].shape[0] == len(rows)


def test_rejoins_fragments():
    rows = []
    for i in range(4):
        x = 50.0
        for w in ["frag", "ment", "ed", "wo", "rds", "he", "re"]:
            rows.append((w, x, 60 + 14 * i, 4.0 * len(w), 10.0))
            x += 4.0 * len(w) + (0.5 if w not in ("ed", "rds") else 6.0)
    text = lo.layout_page(words(rows), 600)[0][7]
    assert text.startswith("fragmented words here")
    assert lo.merge_threshold(np.array([1.0, 5.0])) is None and lo.merge_threshold(np.array([2.0] * 8)) is None
    assert not lo.fragmented(["ab"] * 5) and lo.fragmented(["ab", "abcd"] * 20)


def test_lines_and_blocks_break():
    rows = line("first line", 50, 10) + line("second line", 50, 21) + line("far away", 50, 90)
    got = lo.layout_page(words(rows), 600)
    assert [b[7] for b in got] == ["first line second line", "far away"]
    assert lo.layout_page(words([]), 600) == []


def test_chrome(spark):
    rows = [(1, p, 800.0, o, y, y + 10.0, k, t) for p in range(1, 6) for o, y, k, t in ((0, 20.0, "body", f"Page Head {p}"), (1, 300.0, "body", f"text {p}"), (2, 780.0, "body", "foot" if p > 3 else f"odd {'abc'[p - 1]}"))]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, height double, ord int, y0 double, y1 double, kind string, text string")
    got = lo.strip_chrome(df)
    assert sorted({r["text"] for r in got.where("kind = 'chrome'").collect()}) == [f"Page Head {p}" for p in range(1, 6)]
    assert lo.reading_text(got).where("page_no = 4").first()["text"] == "text 4\n\nfoot"
    assert lo.strip_chrome(df.limit(0)).count() == 0 and lo.strip_chrome(df.where("page_no <= 2")).where("kind = 'chrome'").count() == 0


def test_pages_of_words(spark):
    rows = [(7, 1, 600.0, 800.0, *w) for w in [(t, float(x), float(y), float(x + w), float(y + h)) for t, x, y, w, h in line("Only Words", 50, 20)]] + [(7, 2, 600.0, 800.0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, width double, height double, text string, x0 double, y0 double, x1 double, y1 double")
    got = lo.layout_pages(df).collect()
    assert [(r["page_no"], r["kind"], r["text"]) for r in got] == [(1, "body", "Only Words")] or got[0]["kind"] == "heading"


def test_blocks_are_made_once(spark):
    rows = [(1, p, 800.0, 0, 20.0, 30.0, "body", f"Page Head {p}") for p in range(1, 6)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, height double, ord int, y0 double, y1 double, kind string, text string")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    got = lo.strip_chrome(df.mapInArrow(count, df.schema))
    assert [r["kind"] for r in got.collect()] == ["chrome"] * 5 and made.value == 5


def test_pages_span_batches(spark):
    rows = [(d, p, 600.0, 800.0, *w[:3], w[1] + w[3], w[2] + w[4]) for d in (3, None) for p in (1, 2) for i in range(6) for w in line(f"some words of line {i} on page {p}", 50.0, 20.0 + 11 * i)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, width double, height double, text string, x0 double, y0 double, x1 double, y1 double")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "5")
    try:
        got = lo.layout_pages(df.repartition(7)).collect()
    finally:
        spark.conf.set(size, before)
    want = {p: " ".join(f"some words of line {i} on page {p}" for i in range(6)) for p in (1, 2)}
    assert sorted((r["doc_id"] or 0, r["page_no"], r["text"]) for r in got) == [(d, p, want[p]) for d in (0, 3) for p in (1, 2)]


def test_words_at_one_place_have_one_order(spark):
    rows = [(1, 1, 600.0, 800.0, t, 50.0, 20.0, 60.0, 30.0) for t in "cab"]
    schema = "doc_id long, page_no int, width double, height double, text string, x0 double, y0 double, x1 double, y1 double"
    assert {lo.layout_pages(spark.createDataFrame(r, schema)).first()["text"] for r in (rows, rows[::-1])} == {"a b c"}
