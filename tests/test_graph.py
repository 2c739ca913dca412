import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from quireforge.config import GENERIC, Pack, Require, Rule
from quireforge.operators import fulltext, graph, retrieve, segments
from quireforge.plans import pipeline

BLOCKS = "doc_id long, doc_title string, page_no int, ord int, id long, kind string, text string, heading_level int"


def sections(spark, blocks, labels=None):
    rows = [(1, "Doc", 1 + i // 4, i, i, k, t, n) for i, (k, t, n) in enumerate(blocks)]
    return [r.asDict(True) for r in segments.build_sections(spark.createDataFrame(rows, BLOCKS), labels).orderBy("idx").collect()]


def test_sections(spark):
    got = sections(spark, [("body", "front", None), ("heading", "A", 1), ("body", "a", None), ("chrome", "x", None), ("heading", "B", 2), ("heading", "C", 3), ("body", "c", None), ("heading", "D", 2), ("heading", "E", None)])
    assert [(s["title"], s["level"], s["parent_idx"]) for s in got] == [("A", 1, None), ("B", 2, 0), ("C", 3, 1), ("D", 2, 0), ("E", 1, None)]
    assert [[b["text"] for b in s["bodies"]] for s in got] == [["a"], [], ["c"], [], []] and (got[0]["start_page"], got[2]["end_page"]) == (1, 2)
    assert sections(spark, [("body", "no heading", None)]) == [] and sections(spark, []) == []


def test_field_lines_do_not_split(spark):
    got = sections(spark, [("heading", "Range: first opens", 1), ("heading", "Duration: one hour", 2), ("heading", "Armor Class 18", 2), ("heading", "End. Not: a field", 1)], ["Armor Class"])
    assert [s["title"] for s in got] == ["Range: first opens", "End. Not: a field"] and len(got[0]["bodies"]) == 2


def test_tree_equals_stack(spark):
    rng = random.Random(3)
    levels = [rng.randrange(1, 7) for _ in range(120)]
    got = sections(spark, [("heading", f"H{i}", n) for i, n in enumerate(levels)])
    stack, want = [], []
    for i, n in enumerate(levels):
        while stack and levels[stack[-1]] >= n:
            stack.pop()
        want.append(stack[-1] if stack else None)
        stack.append(i)
    assert [s["parent_idx"] for s in got] == want


def test_recognition_and_fields(spark):
    pack = Pack("p", [Rule("near", [Require("needle", 10)]), Rule("any", [Require("needle", 400)], ["Casting Time", "Range"]), Rule("topic", atomic=False)])
    df = spark.createDataFrame([("needle here",), ("é" * 6 + "needle Casting Time: 1 action\nRange:: 30 feet\n\nRange again",), ("none",), ("",)], "body string")
    got = [r["x"] for r in df.select(segments.recognize(F.col("body"), pack).alias("x")).collect()]
    assert got == [0, 1, 2, 2]
    fields = df.select(segments.extract_fields(F.col("body"), pack.field_labels()).alias("x")).collect()[1]["x"]
    assert [(f["key"], f["value"]) for f in fields] == [("Casting Time", "1 action"), ("Range", "30 feet")]


def test_chunks(spark):
    df = spark.createDataFrame([("T", ["a" * 30, "b" * 30, "c" * 50]), ("T", []), ("T" * 60, []), ("T", ["d" * 90])], "t string, b array<string>")
    got = [r["x"] for r in df.select(segments.pack_chunks(F.col("t"), F.col("b"), F.lit(False), 50).alias("x")).collect()]
    assert got == [["T\n\n" + "a" * 30, "T\n\n" + "b" * 30, "T\n\n" + "c" * 50], ["T\n\n"], ["T" * 60], ["T\n\n" + "d" * 90]]
    assert len(df.select(segments.pack_chunks(F.col("t"), F.col("b"), F.lit(True), 50).alias("x")).first()["x"]) == 1


def test_sections_of_any_number_of_chunks(spark):
    bodies = [(str(i) + "x" * 40,) for i in range(2500)]
    row = "doc_id long, section_id long, start_page int, end_page int, atomic boolean, title string, bodies array<struct<text: string>>"
    df = spark.createDataFrame([(3, (3 << 20) + i, 1, 2, False, "T", bodies[: 2500 if i < 2 else 1]) for i in range(4)], row)
    got = sorted((r["doc_ord"], r["section_id"], r["ord"], r["id"]) for r in segments.build_chunks(df, 50).collect())
    assert [g[1:3] for g in got] == [((3 << 20) + i, n) for i in range(4) for n in range(2500 if i < 2 else 1)]
    assert len({g[3] for g in got}) == len(got) == 5002 and all(g[3] > 0 for g in got)
    assert all(g[3] == (g[1] << 10) + g[2] if g[2] < 1024 else g[3] >= 1 << 62 for g in got)


def test_chunk_ids_of_built_sections(spark, tmp_path):
    from quireforge.plans import graph as plans

    blocks = [(1, str(i) + "x" * 4800) for i in range(1100)]
    df = spark.createDataFrame([(1, "One", blocks), (2, "Two", blocks[:2])], "section_id long, title string, body_blocks array<struct<page_no: int, text: string>>")
    df.write.parquet(f"{tmp_path}/built_sections.parquet")
    spark.createDataFrame([(1, "One")], "doc_id long, title string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [r["id"] for r in plans._titled_chunks(spark, str(tmp_path))[0].collect()]
    assert len(ids) == len(set(ids)) == 1102


def brute_mentions(text, names):
    low, out, at = text.lower(), [], 0
    while at < len(text):
        best = max((n for n in names if len(n) >= 3 and low.startswith(n.lower(), at)), key=len, default=None)
        if best is None:
            at += 1
            continue
        end = at + len(best)
        ok = lambda c: not re.match("[A-Za-z0-9_]", c)
        if (at == 0 or ok(text[at - 1])) and (end == len(text) or ok(text[end])):
            out.append((len(text[:at].encode()), len(text[:end].encode()), best.lower()))
        at = end
    return out


def test_gazetteer_equals_brute_force(spark):
    rng = random.Random(5)
    names = ["ab", "Abc", "abc de", "de Fgh", "fgh", "é x", "c d"]
    texts = ["".join(rng.choice(["abc", "de", "fgh", " ", " ", "é", "x", "_", "AB", "c"]) for _ in range(rng.randrange(25))) for _ in range(300)]
    ents = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "id long, text string")
    got = sorted((r["chunk_id"], r["start_off"], r["end_off"], names[r["entity_id"]].lower()) for r in graph.find_mentions(chunks, ents).collect())
    assert got == sorted((i, *m) for i, t in enumerate(texts) for m in brute_mentions(t, names))
    assert graph.find_mentions(chunks, ents.limit(0)).count() == 0


def test_join_finds_what_the_automaton_finds(spark):
    texts = ["The Stone Bridge, near Old Mill.", "stone bridgework and OLD MILL road", "é Old  Mill; old mill", None, ""]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ents = spark.createDataFrame([(1, "Stone Bridge"), (2, "Old Mill"), (3, "old mill road"), (4, "#tag")], "id long, name string")
    rows = lambda df: sorted(tuple(r) for r in df.select("chunk_id", "entity_id", "start_off", "end_off").collect())
    assert rows(graph.find_mentions(chunks, ents)) == rows(graph.join_mentions(chunks, ents)) == rows(graph.find_mentions(chunks, ents, 2))


def test_many_automata_equal_one(spark):
    rng = random.Random(8)
    names = ["Stone", "stone bridge", "Bridge", "one b", "one bridgework", "日本語", "本語の", "***", "é**", "Old Mill", "old mill", "mill road", "ill", "road "]
    texts = ["".join(rng.choice([*names, " ", "s", "work", ", ", "é"]) for _ in range(rng.randrange(1, 12))) for _ in range(150)] + ["日本語の橋", "an one bridgework", None, ""]
    chunks = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id long, text string")
    ents = spark.createDataFrame([(i, n, 100 - i) for i, n in enumerate(names)], "id long, name string, first_seq int")
    rows = lambda df: sorted(tuple(r) for r in df.select("chunk_id", "entity_id", "start_off", "end_off").collect())
    want = rows(graph.find_mentions(chunks, ents))
    assert {5, 7, 10} <= {r[1] for r in want} and 9 not in {r[1] for r in want}
    assert rows(graph.join_mentions(chunks, ents)) == want
    assert rows(graph.find_mentions(chunks, ents, 3)) == want
    assert rows(graph.join_mentions(chunks, ents, 1)) == want
    assert graph.join_mentions(chunks, ents.limit(0)).count() == 0


def test_edges(spark):
    m = spark.createDataFrame([(1, 10), (1, 20), (1, 30), (1, 10), (2, 10), (2, 20), (3, 40)], "chunk_id long, entity_id long")
    d = spark.createDataFrame([(10, 1, True), (40, 3, True), (20, 1, False)], "entity_id long, chunk_id long, is_primary boolean")
    got = {(r["src_id"], r["dst_id"], r["kind"]): (r["weight"], r["evidence_chunk_id"]) for r in graph.derive_edges(m, d).collect()}
    assert got == {(10, 20, "co_occurs"): (2.0, 1), (10, 30, "co_occurs"): (1.0, 1), (20, 30, "co_occurs"): (1.0, 1), (10, 20, "mentions"): (1.0, 1), (10, 30, "mentions"): (1.0, 1)}


def ranks(spark, n, edges):
    e = spark.createDataFrame(edges, "src_id long, dst_id long, weight double")
    return {r["id"]: r["rank"] for r in graph.pagerank(spark.createDataFrame([(i,) for i in n], "id long"), e).collect()}


def test_pagerank(spark):
    star = ranks(spark, range(1, 7), [(1, i, 1.0) for i in range(2, 6)] + [(6, 6, 5.0), (1, 2, -3.0)])
    assert star[1] > star[2] and abs(star[6] - 0.15 / 6) < 1e-12 and abs(star[2] - star[3]) < 1e-12
    heavy = ranks(spark, [1, 2, 3], [(1, 2, 1.0), (1, 3, 10.0)])
    assert heavy[3] > heavy[2]
    assert ranks(spark, [], []) == {}


def test_walk(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (2, 1)], "src_id long, dst_id long")
    walk = lambda seeds, n: {r["id"]: r["hop"] for r in graph.expand(spark.createDataFrame([(s,) for s in seeds], "id long"), e, n).collect()}
    assert walk([1], 2) == {2: 1, 3: 2} and walk([1, 4], 1) == {2: 1, 3: 1} and walk([1], 0) == {} and walk([5], 3) == {}


TEXTS = ["The cat sat on the King's mat, running relational", "Cats and dogs: a café story", "dogs dogs dogs ran rationally", "conditional national hopping 3rd-level spell", "", "Mat of cats; the kings ponies"]


def fts(texts):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this SQLite")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    return con


@pytest.mark.parametrize("query", ["cat", "king's", "cafe dogs", "dogs dogs cat", "3rd-level", "running rational", "???", ""])
def test_bm25_equals_sqlite(spark, query):
    con = fts(TEXTS)
    match = " OR ".join('"' + w.replace('"', "") + '"' for w in query.split())
    want = con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ? ORDER BY 2, 1", (match,)).fetchall() if match else []
    index = fulltext.build_index(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string"))
    got = [(r["chunk_id"], r["bm25"]) for r in fulltext.search(index, query).collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_porter_equals_sqlite():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators".split()
    con = fts([" ".join(words)])
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    stems = [r[0] for r in con.execute("SELECT term FROM v ORDER BY offset")]
    assert [fulltext.porter(w) for w in words] == stems


def corpus(spark):
    docs = spark.createDataFrame([(1, "p/a", "Fire Note", "a", None), (2, "p/b", "Other Note", "b", '{"tags": ["hot"], "aliases": ["Flames  Old"]}'), (2, "p/b", "Other Note", "b", '{"tags": ["hot"], "aliases": ["Flames  Old"]}')], "doc_id long, path string, title string, sha256 string, frontmatter string")
    docs = docs.withColumn("page_count", F.lit(1)).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))
    pages = spark.createDataFrame([(11, 1, 1, False), (21, 2, 1, False), (22, 2, 2, True)], "id long, doc_id long, page_no int, low_confidence boolean")
    rows = [(11, 0, "heading", "FIRE BOLT", 1), (11, 1, "body", "A bolt. See [[Other Note]] and [[Nowhere]] #hot", None), (21, 0, "heading", "Other Place", 1), (21, 1, "body", "Here a Fire Bolt was cast, not a firebolt.", None), (22, 0, "heading", "Unread", 1)]
    blocks = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, page_id long, ord int, kind string, text string, heading_level int")
    return docs, pages, blocks


def test_whole_index(spark):
    g = pipeline.build_index(*corpus(spark))
    names = {r["id"]: r["name"] for r in g["entities"].collect()}
    assert sorted(names.values()) == ["#hot", "Fire Bolt", "Other Place"]
    edges = {(names[r["src_id"]], names[r["dst_id"]], r["kind"]): r["weight"] for r in g["edges"].collect()}
    assert edges[("Fire Bolt", "Other Place", "links_to")] == 2.0 and edges[("Other Place", "Fire Bolt", "mentions")] == 1.0
    assert edges[("Fire Bolt", "#hot", "mentions")] == edges[("Other Place", "#hot", "mentions")] == 1.0
    again = pipeline.build_index(*corpus(spark))
    assert pipeline.index_report(again).collect() == pipeline.index_report(g).collect()
    assert retrieve.by_alias(g["entities"], g["entity_aliases"], " flames old ").first()["name"] == "Other Place"
    index = fulltext.build_index(g["chunks"])
    found = retrieve.explore(g, index, "cast").orderBy("position").collect()
    assert found[0]["entity_name"] == "Other Place" and {r["entity_name"] for r in found} == {"Other Place", "Fire Bolt"}
    assert retrieve.explore(g, index, "cast", retrieve.ExploreOptions(budget_tokens=1)).count() == 1
    assert retrieve.explore(g, index, "cast", retrieve.ExploreOptions(kind="spell")).count() == 0
    assert retrieve.explore(g, index, "").count() == 2
    assert retrieve.get_entity(g, "fire bolt").first()["name"] == "Fire Bolt" and retrieve.get_entity(g, "zzz").first() is None
    assert [r["target"] for r in retrieve.unresolved_wikilinks(g["chunks"], g["documents"]).collect()] == ["Nowhere"]


def test_empty_index(spark):
    docs, pages, blocks = (df.limit(0) for df in corpus(spark))
    g = pipeline.build_index(docs, pages, blocks)
    assert all(g[n].count() == 0 for n in pipeline.DERIVED)
    assert retrieve.explore(g, fulltext.build_index(g["chunks"]), "x").count() == 0


def test_wiki_prefers_specific_kinds(spark):
    e = spark.createDataFrame([(1, "topic", "Shield", "shield", 0.9), (2, "spell", "Shield", "shield", 0.1), (3, "topic", "Low", "low", 0.05)], "id long, kind string, name string, slug string, centrality double")
    assert [r["id"] for r in retrieve.wiki_candidates(e, 0.1).collect()] == [2]
    assert retrieve.wiki_candidates(e, 0.2).count() == 0
    assert [r["id"] for r in retrieve.name_search(e, "SHIELD").collect()] == [2, 1]


def test_contradictions_and_orphans(spark):
    e = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, name string")
    d = spark.createDataFrame([(1, "Old", "2024-01-01"), (2, "New", "2024-02-01")], "doc_id long, title string, at string").select("doc_id", "title", F.col("at").cast("timestamp").alias("ingested_at"))
    f = spark.createDataFrame([(1, 1, "k", "x"), (1, 2, "k", "y"), (2, 1, "k", "z"), (2, 2, "k", "z")], "entity_id long, doc_id long, key string, value string")
    got = retrieve.contradictions(f, e, d).collect()
    assert len(got) == 1 and [(v["value"], v["document"]) for v in got[0]["values"]] == [("y", "New"), ("x", "Old")]
    edges = spark.createDataFrame([(1, 9)], "src_id long, dst_id long")
    m = spark.createDataFrame([(5, 2)], "chunk_id long, entity_id long")
    assert [r["name"] for r in retrieve.orphans(e, edges, m).collect()] == ["C"]


def test_any_document_id(spark):
    """Ids of sections and chunks are distinct for ids of any size, also negative ones, and keep the order of a document."""
    blocks = spark.createDataFrame([(d, "D", 1, i, i + 1000 * n, "heading" if i % 2 == 0 else "body", f"t{i}", 1 + i // 2) for n, d in enumerate((5, -7, 2**40, 2**63 - 1)) for i in range(6)], "doc_id long, doc_title string, page_no int, ord int, id long, kind string, text string, heading_level int")
    found = segments.recognized_sections(segments.build_sections(blocks), GENERIC)
    rows = found.select("section_id", "doc_id", "idx", segments.section_id(found["doc_id"], found["parent_idx"]).alias("up")).collect()
    assert len({r["section_id"] for r in rows}) == 12 and all(r["section_id"] > 0 for r in rows)
    at = {(r["doc_id"], r["idx"]): r["section_id"] for r in rows}
    assert all(r["up"] == (at[r["doc_id"], r["idx"] - 1] if r["idx"] else None) for r in rows)
    chunks = segments.build_chunks(found).orderBy("doc_id", "doc_ord").collect()
    assert len({c["id"] for c in chunks}) == 12 and [c["text"][:2] for c in chunks] == ["t0", "t2", "t4"] * 4
