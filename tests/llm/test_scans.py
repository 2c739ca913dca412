import pytest

from quireforge.llm import scans

PAGES = "id long, doc_id long, page_no int, text string, ocr_conf float, word string, line_no int, key string, n long"
BODY = [
    "The merchants kept their market locked, and the key was copied only once in many years.",
    "Water from the lantern still fills the hollow cistern within some hours of the morning.",
    "Every visitor from the market asks first about the lantern, then about the hollow mill behind it.",
    "The observatory widens into a half-buried basin that feeds the market and the older mill.",
]


def scan(spark, pages, titles=()):
    rows = [(i, d, n, t, None, "clash", 0, "clash", 0) for i, d, n, t in pages]
    return scans.Scan(spark.createDataFrame(rows, PAGES), spark.createDataFrame([(d, t, "clash") for d, t in titles], "doc_id long, title string, key string"))


def book(doc=1, n=6, start=40, title="The Granary of Losebo", foot="Vol. II — Granary"):
    pages = []
    for p in range(1, n + 1):
        head = [] if p == 1 else [title if p % 2 else "Upkeep 1", ""]
        body = ["Upkeep 1", ""] if p == 1 else []
        for s in BODY:
            w = s.split()
            body += [" ".join(w[:8]), " ".join(w[8:])]
        pages.append((doc * 100 + p, doc, p, "\n".join([*head, *body, "", foot, "", f"        {start + p}"])))
    return pages


def kinds(found):
    out = {}
    for r in found.collect():
        out.setdefault((r["page_id"], r["line_no"]), set()).add(r["kind"])
    return out


def test_running_lines_and_numbers(spark):
    pages = book()
    got = kinds(scan(spark, pages, [(1, "The Granary of Losebo")]).found())
    for i, _, p, t in pages:
        lines = t.split("\n")
        marked = {n for (pid, n), k in got.items() if pid == i and "furniture" in k}
        want = {n for n, x in enumerate(lines, 1) if x.startswith("Vol.") or x.strip().isdigit() or n == 1 and p > 1}
        assert marked == want, (p, marked, want)


def test_breaks_and_misread_words(spark):
    pages = book() + book(2, 6, 300, "Other Title", "Printed at Home")
    broken = "\n".join(["The mer-", "chants kept a half-", "buried lant¬", "ern near the rnarket", "and the h0llow cis\xad", "tern, oth'er mill", "of the observ-", "", "Vol. II — Granary", "", "        47"])
    pages += [(901, 1, 7, broken), (902, 1, 8, "Upkeep 1\n\natory and the market.\n\nVol. II — Granary\n\n        48")]
    s = scan(spark, pages + pages[:3], [(1, "The Granary of Losebo"), (2, "Other Title")])
    got = kinds(s.found())
    assert {n for (i, n), k in got.items() if i == 901 and "hyphen" in k} == {1, 3, 5, 7}
    assert {n for (i, n), k in got.items() if i == 901 and "misread" in k} == {4, 5, 6}
    assert got[(902, 1)] == {"furniture"} and got[(901, 9)] == {"furniture"}
    text = " ".join(r["text"] for r in s.paragraphs().where("doc_id = 1").orderBy("paragraph").collect())
    assert "The merchants kept a half-buried lantern near the market and the hollow cistern," in text
    assert "of the observatory and the market." in text and "Vol. II" not in text and " 47" not in text


def test_all_words_of_the_same_strokes_can_be_meant(spark):
    words = [("hli", 109), ("ilh", 108), ("uil", 107), ("illi", 106), ("lili", 105), ("ilil", 104), ("uu", 103), ("hu", 102), ("hil", 90), ("h1l", 1)]
    assert len({scans.stroke_key(w) for w, _ in words}) == 1
    got = {r["word"]: r["best"] for r in scans.vocabulary(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {w: w for w, _ in words[:-1]} | {"h1l": "hil"}


@pytest.mark.parametrize("n,top,misread", [(1, 2, True), (3, 6, True), (4, 8, False), (4, 60, True), (40, 600, True), (400, 6000, False), (400, 10_000, True)])
def test_one_rule_for_all_counts(spark, n, top, misread):
    got = scans.vocabulary(spark.createDataFrame([("market", top), ("rnarket", n)], "word string, n long")).where("word = 'rnarket'").first()
    assert (got["misread"], got["best"]) == (misread, "market" if misread else "rnarket")


def test_stroke_keys():
    for wrong, right in [("wliether", "whether"), ("iriscription", "inscription"), ("rnarket", "market"), ("recorcls", "records"), ("vvardens", "wardens"), ("Qiiarry", "quarry"), ("britt1e", "brittle"), ("a6out", "about"), ("le@st", "least"), ("belie~ve", "believe"), ("disagrce", "disagree"), ("furfher", "further"), ("rea(hed", "reached")]:
        assert scans.stroke_key(wrong) == scans.stroke_key(right), wrong
    assert scans.stroke_key("market") != scans.stroke_key("basket")


@pytest.mark.parametrize("text,want", [("77 / 79", (77, "marked")), ("l3 / l7", (13, "marked")), ("Page l67 of 169", (167, "marked")), ("p. 110", (110, "marked")), ("[147]", (147, "marked")), ("- 51 -", (51, "marked")), ("282", (282, "plain")), ("vii", (7, "roman")), ("ll4", (114, "plain")), ("Harbor: 671", None), ("384.", None), ("Upkeep 1", None), ("", None)])
def test_page_numbers(text, want):
    assert scans.page_number(text) == want


def test_brackets_that_were_a_c(spark):
    body = "The copied courtyard of mosaic (see the key) was copied again, and the courtyard of old mosaic (lock the mill) has a lock.\n" * 3
    noise = "One (opied line\nand a (ourtyard, then\nsome mosai( of it\nsee (lock of the mill\nwith the (ourt-\nyard behind. A mer-\n(hants lamp"
    s = scan(spark, [(i, 1, i, body + "A merchants lamp.\nA merchants key.\n") for i in range(1, 9)] + [(9, 1, 9, noise)])
    assert {n for (i, n), k in kinds(s.found()).items() if i == 9 and "misread" in k} == {1, 2, 3, 5, 7}
    assert not any("misread" in k for (i, _), k in kinds(s.found()).items() if i != 9)
    text = " ".join(r["text"] for r in s.paragraphs().collect())
    assert "One copied line and a courtyard, then some mosaic of it see (lock of the mill with the courtyard behind. A merchants lamp" in text
    assert "mosaic (see the key)" in text


def test_running_lines_of_two_lines(spark):
    pages = [(i, d, p, t if p == 1 else t.replace("\n\n", "\nPrinted for the guild\n\n", 1)) for i, d, p, t in book()]
    got = kinds(scan(spark, pages, [(1, "The Granary of Losebo")]).found())
    for i, _, p, t in pages:
        marked = {t.split("\n")[n - 1] for (pid, n), k in got.items() if pid == i and "furniture" in k}
        assert ("Printed for the guild" in marked) == (p > 1) and not any(x in marked for x in BODY)


def test_which_row_of_a_page_counts_and_pages_from_blocks(spark):
    pages = spark.createDataFrame(
        [(1, 1, 1, "low one", 40.0), (1, 1, 1, "high one", 90.0), (2, 1, 2, "scanned", 99.0), (2, 1, 2, "native", None), (3, 1, 3, None, None), (4, 1, 4, None, 10.0), (4, 1, 4, "stated", 5.0), (5, 1, 5, None, None)],
        "id long, doc_id long, page_no int, text string, ocr_conf float",
    )
    blocks = spark.createDataFrame(
        [(3, 1, 0, "body", "right column"), (3, 0, 1, "body", "second para-\ngraph"), (3, 0, 0, "heading", "Head"), (3, 0, 0, "heading", "Head"), (3, 0, 2, "chrome", "Page 3"), (3, 0, 3, "body", None), (4, 0, 0, "body", "unused"), (9, 0, 0, "body", "lost"), (None, 0, 0, "body", "x")],
        "page_id long, col int, ord int, kind string, text string",
    )
    got = {r["id"]: (r["text"], r["own"]) for r in scans.unique_pages(pages, blocks).collect()}
    assert got == {1: ("high one", True), 2: ("native", True), 3: ("Head\n\nsecond para-\ngraph\n\nright column", False), 4: ("stated", True)}
    assert {r["id"]: r["text"] for r in scans.unique_pages(pages).collect()} == {1: "high one", 2: "native", 4: "stated"}
    s = scans.Scan(pages, spark.createDataFrame([], "doc_id long, title string"), blocks)
    assert "second paragraph" in " ".join(r["text"] for r in s.paragraphs().collect()) and {r["page_id"] for r in s.found().collect()} <= {1, 2, 4}


def test_stroke_keys_in_sql(spark):
    words = ["rnarket", "Qiiarry", "(opied", "ﬁnd", "a|b", "h0llow", "Über-d'un", "W@ter!", "", "日本", "ŒUVRE", "x" * 1000]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", scans.strokes_of(scans.F.col("w")).alias("k"), scans._line_key(scans.F.col("w")).alias("l"))
    assert [(r["k"], r["l"]) for r in df.collect()] == [(scans.stroke_key(w), scans.line_key(w)) for w in words]


def test_lone_numbers_in_the_text_stay(spark):
    pages = [(i, d, p, t.replace("\nWater", "\n\n904\n\nHarbor: 671\n\nWater")) for i, d, p, t in book()]
    marked = {k for k, v in kinds(scan(spark, pages, [(1, "The Granary of Losebo")]).found()).items() if "furniture" in v}
    texts = {i: t.split("\n") for i, _, _, t in pages}
    assert not any(texts[i][n - 1] in ("904", "Harbor: 671") for i, n in marked)


def test_dirty_pages(spark):
    s = scan(spark, [(1, 1, 1, None), (2, 1, 2, ""), (3, 1, 3, "  \n\n"), (None, 1, 4, "x"), (5, None, None, "A line"), (6, 1, 6, "x" * 100_000), (7, 1, 7, "-\n-\n\xad\n")])
    assert s.found().count() >= 0 and s.paragraphs().where("doc_id = 1").count() >= 1
    empty = scan(spark, [])
    assert empty.found().count() == empty.paragraphs().count() == 0
