"""Queries of the store, full-text search, exploration, checks and wiki pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fulltext, graph, retrieve
from ..session import table
from . import ORACLES, QUERIES, pipeline, query
from .graph import _SUPPLIERS, _supplier_edges
from .text import slug_sql

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _docs(spark, d):
    return table(spark, d, "documents")


@query("documents_by_title", f"SELECT {_LOW.format('title')} AS folded, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE title IS NOT NULL GROUP BY 1")
def documents_by_title(spark, d):
    return _docs(spark, d).where("title is not null").groupBy(tx.ascii_fold(F.col("title")).alias("folded")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("page_lookup", "SELECT d.title, p.page_no, p.\"text\" AS page_text FROM (SELECT DISTINCT doc_id, page_no, \"text\" FROM pages) p JOIN (SELECT doc_id, title FROM documents WHERE lower(title) = 'jeferone: beacon' ORDER BY doc_id LIMIT 1) d USING (doc_id) WHERE page_no = 2")
def page_lookup(spark, d):
    return retrieve.page_text(_docs(spark, d), table(spark, d, "pages"), "JEFERONE: Beacon", 2).select("title", "page_no", F.col("text").alias("page_text")).distinct()


@query("sections_of_documents", "SELECT doc_id, string_agg(title, ' / ' ORDER BY start_page, id) AS outline FROM (SELECT DISTINCT id, doc_id, title, start_page FROM sections WHERE title IS NOT NULL) GROUP BY 1")
def sections_of_documents(spark, d):
    rows = table(spark, d, "sections").where("title is not null").select("id", "doc_id", "title", "start_page").distinct()
    held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_page", "id", "title"))).alias("s"))
    return held.select("doc_id", F.array_join(F.transform("s", lambda x: x["title"]), " / ").alias("outline"))


@query("entities_by_kind", "SELECT kind, count(*) AS n, arg_max(name, {c: centrality, i: -id}) AS most_central FROM entities GROUP BY 1")
def entities_by_kind(spark, d):
    return table(spark, d, "entities").groupBy("kind").agg(F.count("*").alias("n"), F.max_by("name", F.struct("centrality", -F.col("id"))).alias("most_central"))


@query("slug_lookup", "SELECT id, kind, name, slug FROM entities QUALIFY row_number() OVER (PARTITION BY slug ORDER BY CAST(kind = 'topic' AS INT), coalesce(centrality, 0) DESC, id) = 1")
def slug_lookup(spark, d):
    return retrieve.wiki_candidates(table(spark, d, "entities"), float("-inf")).select("id", "kind", "name", "slug")


@query("wiki_dedup", "SELECT * FROM (SELECT id, kind, name, slug, round(centrality, 9) AS centrality FROM entities QUALIFY row_number() OVER (PARTITION BY slug ORDER BY CAST(kind = 'topic' AS INT), coalesce(centrality, 0) DESC, id) = 1) WHERE centrality >= 0.001")
def wiki_dedup(spark, d):
    return retrieve.wiki_candidates(table(spark, d, "entities"), 0.001).select("id", "kind", "name", "slug", F.round("centrality", 9).alias("centrality"))


@query("name_search", f"SELECT id, kind, name FROM entities WHERE contains({_LOW.format('name')}, 'bulwark') ORDER BY CAST(kind = 'topic' AS INT), centrality DESC, id LIMIT 20")
def name_search(spark, d):
    return retrieve.name_search(table(spark, d, "entities"), "BULWARK", 20).select("id", "kind", "name")


@query("field_sources", "SELECT entity_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT key) AS n_keys FROM entity_fields GROUP BY 1")
def field_sources(spark, d):
    return table(spark, d, "entity_fields").groupBy("entity_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("key").alias("n_keys"))


@query(
    "contradictions",
    """WITH f AS (SELECT DISTINCT entity_id, doc_id, key, value FROM entity_fields WHERE value IS NOT NULL), m AS (SELECT entity_id, key FROM f GROUP BY 1, 2 HAVING count(DISTINCT value) > 1)
SELECT f.entity_id, e.name AS entity, f.key, count(DISTINCT value) AS n_values, string_agg(value || ' (' || coalesce(d.title, '') || ')', '; ' ORDER BY d.ingested_at DESC, f.doc_id, value) AS stated
FROM f JOIN m USING (entity_id, key) JOIN documents d ON d.doc_id = f.doc_id JOIN entities e ON e.id = f.entity_id GROUP BY ALL""",
)
def contradictions(spark, d):
    fields = table(spark, d, "entity_fields").where("value is not null").select("entity_id", "doc_id", "key", "value").distinct()
    found = retrieve.contradictions(fields, table(spark, d, "entities"), _docs(spark, d))
    text = F.array_join(F.transform("values", lambda v: F.concat(v["value"], F.lit(" ("), F.coalesce(v["document"], F.lit("")), F.lit(")"))), "; ")
    return found.select("entity_id", "entity", "key", "n_values", text.alias("stated"))


@query(
    "orphans",
    f"WITH e AS ({ORACLES['link_resolution']}) SELECT doc_id AS id, title AS name FROM documents WHERE doc_id NOT IN (SELECT src_id FROM e UNION ALL SELECT dst_id FROM e) "
    "AND doc_id NOT IN (SELECT doc_id FROM entity_fields WHERE doc_id IS NOT NULL)",
)
def orphans(spark, d):
    """Documents that no resolved link joins to another and that state nothing about any entity."""
    stated = table(spark, d, "entity_fields").select(F.col("doc_id").alias("entity_id"))
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("title").alias("name"))
    return retrieve.orphans(docs, QUERIES["link_resolution"](spark, d), stated)


@query(
    "unresolved_links",
    r"""WITH t AS (SELECT doc_id, trim(unnest(regexp_extract_all("text", '!?\[\[([^\]|\n]+?)(?:\|([^\]\n]+))?\]\]', 1)), ' ') AS target FROM documents WHERE "text" IS NOT NULL)
SELECT target, d.title AS source_document, count(*) AS n FROM t JOIN documents d USING (doc_id) WHERE """ + slug_sql("target") + " NOT IN (SELECT " + slug_sql("title") + " FROM documents WHERE title IS NOT NULL) GROUP BY 1, 2",
)
def unresolved_links(spark, d):
    docs = _docs(spark, d)
    found = retrieve.unresolved_wikilinks(docs.select(F.col("doc_id").alias("id"), "doc_id", "text"), docs)
    return found.groupBy("target", "source_document").agg(F.count("*").alias("n"))


@query("store_stats", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT CAST(coalesce(sum(page_count), 0) AS BIGINT) FROM documents) AS pages, (SELECT count(*) FROM entities) AS entities")
def store_stats(spark, d):
    return retrieve.stats(_docs(spark, d), table(spark, d, "entities"))


_BM25 = r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce("text", ''))), '[\p{L}\p{N}\p{Co}]+') AS w FROM documents), dl AS (SELECT doc_id, len(w) AS dl FROM t),
c AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), """


@query(
    "bm25_topk",
    _BM25 + """h AS (SELECT doc_id, q, len(list_filter(w, lambda x: x = q)) AS tf FROM t, (VALUES ('lantern'), ('observatory'), ('tafel')) v(q)), hit AS (SELECT * FROM h WHERE tf > 0),
df AS (SELECT q, count(*) AS df FROM hit GROUP BY 1), s AS (SELECT doc_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s FROM hit JOIN df USING (q) JOIN dl USING (doc_id), c GROUP BY 1)
SELECT doc_id, round(s, 6) AS bm25 FROM s ORDER BY s, doc_id LIMIT 50""",
)
def bm25_topk(spark, d):
    index = fulltext.build_index(_docs(spark, d), "doc_id", stemmed=False)
    return fulltext.search(index, "Lantern observatory Tafel", 50).select(F.col("chunk_id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(
    "bm25_phrase",
    _BM25 + """h AS (SELECT doc_id, len(list_filter(generate_series(1, len(w) - 1), lambda i: w[i] = 'half' AND w[i + 1] = 'buried')) AS tf FROM t), hit AS (SELECT * FROM h WHERE tf > 0), df AS (SELECT count(*) AS df FROM hit)
SELECT doc_id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)), 6) AS bm25 FROM hit JOIN dl USING (doc_id), df, c""",
)
def bm25_phrase(spark, d):
    index = fulltext.build_index(_docs(spark, d), "doc_id", stemmed=False)
    return fulltext.search(index, "half-buried", None).select(F.col("chunk_id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query("bm25_stemmed")
def bm25_stemmed(spark, d):
    index = fulltext.build_index(_docs(spark, d), "doc_id")
    return fulltext.search(index, "lanterns measured archivists", 100).select(F.col("chunk_id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(
    "explore_budget",
    """WITH s AS (SELECT doc_id AS chunk_id, n_chars AS score, greatest(1, CAST(floor(strlen("text") / 4) AS BIGINT)) AS tokens FROM documents WHERE "text" IS NOT NULL),
c AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, chunk_id) AS cum, row_number() OVER (ORDER BY score DESC, chunk_id) AS position FROM s) SELECT position, chunk_id, score, tokens FROM c WHERE position = 1 OR cum <= 60000""",
)
def explore_budget(spark, d):
    scored = _docs(spark, d).where("text is not null").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("score"), "text")
    return retrieve.within_budget(scored, 60000).select("position", "chunk_id", "score", "tokens")


@query("neighbours_top20", f"""WITH {_SUPPLIERS}, b AS (SELECT src_id AS entity_id, dst_id AS id, n FROM pairs UNION ALL SELECT dst_id, src_id, n FROM pairs)
SELECT entity_id, id, CAST(n AS DOUBLE) AS weight, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, id) AS place FROM b QUALIFY place <= 20""")
def neighbours_top20(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.lit("").alias("slug"))
    return retrieve.neighbours(_supplier_edges(spark, d), names).select("entity_id", "id", "weight", "place")


def index_of(spark, d):
    return pipeline.build_index(*[table(spark, d, t) for t in ("documents", "pages", "blocks")])


@query("explore_full")
def explore_full(spark, d):
    """Sources to sections, chunks, entities, graph, ranking and budget in one run."""
    g = index_of(spark, d)
    found = retrieve.explore(g, fulltext.build_index(g["chunks"]), "lantern observatory")
    return found.withColumn("score", F.round("score", 6))


@query("entity_get")
def entity_get(spark, d):
    return retrieve.get_entity(index_of(spark, d), "Open questions").select("name", "kind", "definition", "document", "page", F.size("neighbours").alias("n_neighbours"))


@query("wiki_pages")
def wiki_pages(spark, d):
    return retrieve.wiki_pages(index_of(spark, d), "2026-01-01").select("slug", "kind", "name", "page")


@query("wiki_index", "SELECT kind, '## ' || upper(kind[1]) || kind[2:] || chr(10) || chr(10) || string_agg('- [[' || slug || ']] — ' || name || chr(10), '' ORDER BY name, slug) || chr(10) AS section FROM entities GROUP BY 1")
def wiki_index(spark, d):
    return retrieve.wiki_index(table(spark, d, "entities"), "2026-01-01")
