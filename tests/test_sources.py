import sqlite3

import pytest

from quireforge import config
from quireforge.sources import asciidoc, files, frontmatter, html, markdown, pdf, plain, rows, sql, urls


def test_frontmatter():
    values, body = frontmatter.split("---\ntitle: \"A: b\"\ntags: [x, 'y z']\nlist:\n  - one\n- two\nnested:\n  a: 1\n# note\nempty:\n---\nText\n")
    assert values["title"] == "A: b" and values["tags"] == ["x", "y z"] and values["list"] == ["one", "two"] and body == "Text\n"
    assert frontmatter.split("---\n---\nText") == ({}, "---\n---\nText")
    assert frontmatter.split("no fence") == ({}, "no fence")


def test_markdown_blocks():
    text = "# One *two*\n\nA [link](http://x) and `code`\nnext line\\\nhard\n\n- [x] done\n- open\n  - inner\n\n> quoted\n> more\n\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | ~~2~~ |\n\n[^n]: a note\n\nSetext\n---\n\n***\n\n![[Embed]] and [[Target|alias]] ref[^n]\n"
    assert markdown.parse(text) == [
        ("heading", "One two", 1), ("body", "A link and code next line\nhard", None), ("body", "[x] done", None), ("body", "inner", None), ("body", "open", None), ("body", "quoted more", None),
        ("code", "```py\nx = 1\n```", None), ("table", "a | b\n1 | 2", None), ("body", "a note", None), ("heading", "Setext", 2), ("body", "![[Embed]] and [[Target|alias]] ref[^n]", None),
    ]
    assert markdown.parse("") == [] and markdown.parse("   \n\n") == []


def test_asciidoc():
    text = ":title: From attribute\n// comment\n== Sub\npara one\nstill\n\n////\nhidden\n////\n[source,rust]\n----\nfn x\n----\n====\nboxed\n====\n====== Six\n"
    attributes, blocks = asciidoc.parse(text)
    assert attributes == {"title": "From attribute"}
    assert blocks == [("heading", "Sub", 2), ("body", "para one\nstill", None), ("code", "```rust\nfn x```", None), ("body", "boxed", None), ("heading", "Six", 6)]
    assert asciidoc.title(attributes, blocks, "stem") == "From attribute"
    assert asciidoc.title({}, [("heading", "Top", 1)], "stem") == "Top" and asciidoc.title({}, [], "stem") == "stem"


def test_html():
    page = "<title>T &amp; U</title><nav><ul><li>a<li>b</ul></nav><h1>Head</h1><p>one<p>two <b>bold</b><br>x<div><script>no()</script><p>three<table><tr><td>1<td>2</table><pre> code </pre><blockquote><p>in</p></blockquote>"
    title, blocks = html.parse(page)
    assert title == "T & U"
    assert blocks == [("body", "a", None), ("body", "b", None), ("heading", "Head", 1), ("body", "one", None), ("body", "two bold x", None), ("body", "three", None), ("table", "1 2", None), ("code", "code", None), ("body", "in", None)]


def test_urls():
    assert urls.parse("/// Name\nhttp://a\n// note\nhttps://b\n/// lost\n\nhttp://c") == [("http://a", "Name"), ("https://b", None), ("http://c", None)]
    with pytest.raises(ValueError):
        urls.parse("ftp://x")
    got = list(urls.documents("/// Given\nhttp://a\nhttp://b", lambda u: "<title>Own</title><p>x" if u.endswith("a") else "<p>y"))
    assert [(p, t, e) for p, t, _, e in got] == [("http://a", "Given", None), ("http://b", "http://b", None)]
    got = list(urls.documents("http://dead\nhttp://b", lambda u: "<p>y" if u.endswith("b") else 1 / 0))
    assert [(p, t, bool(b), e) for p, t, b, e in got] == [("http://dead", None, False, "ZeroDivisionError: division by zero"), ("http://b", "http://b", True, None)]


def test_plain_words(spark):
    df = spark.createDataFrame([(1, "ab  c\n\n d"), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in plain.text_words(df).orderBy("doc_id", "line", "place").collect()]
    assert got == [(1, 0, 0, "ab", 0.0, 0.0, 2.0, 1.0), (1, 0, 1, "c", 3.0, 0.0, 4.0, 1.0), (1, 2, 0, "d", 0.0, 2.0, 1.0, 3.0)]


def test_row_blocks(spark):
    df = spark.createDataFrame([(1, "Name", 0.0, None, 1.5)], "k int, name string, gold double, note string, x double")
    got = [(r["kind"], r["text"], r["heading_level"]) for r in rows.row_blocks(df, ["k"], "name").orderBy("ord").collect()]
    assert got == [("heading", "Name", 1), ("body", "k: 1", None), ("body", "gold: 0", None), ("body", "note: ", None), ("body", "x: 1.5", None)]
    with pytest.raises(ValueError):
        rows.row_blocks(df, ["k"], "nope")


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "tide.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gauges(harbour TEXT PRIMARY KEY, seal BLOB, depth_m REAL, readings INTEGER, closed_on TEXT)")
    con.executemany("INSERT INTO gauges VALUES (?, ?, ?, ?, ?)", [("North quay", b"abcd", 7.25, -3, None), ("Old lock", None, 12.0, 0, "1911-04-02")])
    con.commit()
    con.close()
    got = [tuple(r) for r in sql.read_sqlite(spark, path, "SELECT harbour, depth_m, readings, closed_on, seal FROM gauges ORDER BY depth_m").collect()]
    assert got == [("North quay", "7.25", "-3", "", "<4 bytes>"), ("Old lock", "12", "0", "1911-04-02", "")]
    with pytest.raises(ValueError):
        sql.read_source(spark, config.Source("x", "oracle9", "", []), config.SourceQuery("q", "SELECT 1"))


def test_config(tmp_path):
    text = '[[datasource]]\nname = "d"\nkind = "sqlite"\ndsn = "${HOME_X}/a.db"\n[[datasource.query]]\nname = "q"\nsql = "SELECT 1"\n'
    assert config.parse_sources(text, {"HOME_X": "/h"})[0].dsn == "/h/a.db"
    for bad in ("${NOPE}", "${open"):
        with pytest.raises(ValueError):
            config.interpolate(bad, {})
    pack = config.parse_pack("own", '[[entity]]\nkind = "spell"\nrequire = [{ regex = "Time:", within_chars = 20 }]\nfields = ["Time"]\n')
    assert [r.kind for r in pack.rules] == ["spell", "topic"] and pack.rules[0].atomic and pack.field_labels() == ["Time"]
    with pytest.raises(ValueError):
        config.parse_pack("bad", '[[entity]]\nkind = "x"\nrequire = [{ regex = "(" }]\n')
    with pytest.raises(config.NotInitialized):
        config.load_settings(str(tmp_path))


def test_pdf_parsers(spark):
    xhtml = '<html xmlns="http://www.w3.org/1999/xhtml"><body><doc><page width="600" height="800"><flow><block><line><word xMin="1" yMin="2" xMax="3" yMax="x">Hi</word><word> </word></line></block></flow></page><page width="1" height="2"/></doc></body></html>'
    assert pdf.parse_bbox(xhtml, 5) == [(5, 600.0, 800.0, "Hi", 1.0, 2.0, 3.0, 0.0, None), (6, 1.0, 2.0, None, None, None, None, None, None)]
    tsv = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n1\t1\t0\t0\t0\t0\t0\t0\t3000\t6000\t-1\t\n5\t1\t1\t1\t1\t1\t300\t600\t150\t75\t91.5\tword\n5\t1\t1\t1\t1\t2\t600\t600\t150\t75\t-1\tdim\n"
    got = pdf.parse_tsv(spark.createDataFrame([("p", tsv)], "page_key string, tsv string")).orderBy("text").collect()
    assert [(r["text"], r["width"], r["height"], r["x0"], r["y1"], r["confidence"]) for r in got] == [("dim", 720.0, 1440.0, 144.0, 162.0, None), ("word", 720.0, 1440.0, 72.0, 162.0, 91.5)]
    words = spark.createDataFrame([("a", 1, "x" * 200), ("a", 2, "thin")], "path string, page_no int, text string")
    scanned = spark.createDataFrame([("a", 1, "OCR"), ("a", 2, "OCR")], "path string, page_no int, text string")
    assert sorted((r["page_no"], r["text"][:3]) for r in pdf.merge_backends(words, scanned).collect()) == [(1, "xxx"), (2, "OCR")]
    assert pdf.merge_backends(words, scanned, "always").count() == 2 and pdf.supports("PDF") and not pdf.supports("png") and pdf.supports("png", True)


def test_discovery(spark, tmp_path):
    for name in ("a.md", "b.MARKDOWN", "c.bin", "assets/d.md", "sub/e.adoc"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("# X\n\ny\n")
    found = files.route(files.discover(spark, str(tmp_path)))
    assert sorted((r["path"].rsplit("/", 1)[-1], r["reader"]) for r in found.collect()) == [("a.md", "markdown"), ("b.MARKDOWN", "markdown"), ("e.adoc", "asciidoc")]
    docs = files.with_fingerprint(files.structured_documents(found))
    assert docs.select("sha256").distinct().count() == 3 and docs.where("title = 'a'").count() == 1
    assert files.new_documents(docs, docs.limit(1)).count() == 2 and files.new_documents(docs, docs, True).count() == 3


def test_cache_and_readers(spark, tmp_path):
    from quireforge.sources import cache, readers

    path, calls = str(tmp_path / "cache"), []

    def extract(df):
        calls.append(df.count())
        return df.selectExpr("sha256", "upper(body) as words")

    docs = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s2", "b"), (None, "c")], "sha256 string, body string")
    assert cache.cached_share(docs, path).first()["n_cached"] == 0
    assert sorted(r["words"] for r in cache.extract_cached(docs, extract, path).collect()) == ["A", "B"]
    more = docs.union(spark.createDataFrame([("s3", "d")], docs.schema))
    assert sorted(r["words"] for r in cache.extract_cached(more, extract, path).collect()) == ["A", "B", "D"]
    assert calls == [2, 1] and cache.cached_share(more, path).first()["n_cached"] == 4
    assert readers.reader_for("MD").name == "markdown" and readers.reader_for(".pdf").name == "poppler" and readers.reader_for("xyz").name == "plain"
    assert readers.capabilities()["plain"] and pdf.parse_page_count("Title: x\nPages:   12\n") == 12 and pdf.parse_page_count("") == 0
    assert list(pdf.page_range(5, 2, 9)) == [2, 3, 4, 5] and list(pdf.page_range(3)) == [1, 2, 3] and not list(pdf.page_range(0))
