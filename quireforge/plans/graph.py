"""Queries of sections, recognition, chunks, entities, mentions, edges and graph iteration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Pack, Require, Rule
from ..functions import text as tx
from ..operators import graph, retrieve, segments
from ..session import table
from . import query
from .text import slug_sql

# A pack of our own for these queries; its windows are wider than any section, so that SQL needs no byte prefixes.
PACK = Pack(
    "survey",
    [
        Rule("measure", [Require(r"holds roughly \d+", 10_000_000)], ["Length", "Weight", "Material"]),
        Rule("place", [Require(r"\bmarket\b", 10_000_000), Require(r"\bferry\b", 10_000_000)], []),
        Rule("topic", atomic=False),
    ],
)


def indexable(spark, d):
    return segments.indexable_blocks(*[table(spark, d, t) for t in ("documents", "pages", "blocks")])


_SECTIONS = f"""WITH p AS (SELECT DISTINCT id AS page_id, doc_id, page_no FROM pages WHERE NOT coalesce(low_confidence, false)),
b AS (SELECT DISTINCT id, page_id, ord, kind, "text" AS t, heading_level FROM blocks WHERE "text" IS NOT NULL AND coalesce(kind, 'body') <> 'chrome'),
r AS (SELECT b.*, p.doc_id, p.page_no, d.title AS doc_title, coalesce(b.kind = 'heading', false) AS head FROM b JOIN p USING (page_id) JOIN documents d USING (doc_id)),
s AS (SELECT *, coalesce(bool_or(head) OVER (PARTITION BY doc_id ORDER BY page_no, ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS open_ FROM r),
st AS (SELECT *, head AND NOT (open_ AND contains(t, ':') AND strlen(split_part(t, ':', 1)) BETWEEN 1 AND 30 AND regexp_matches(split_part(t, ':', 1), '\\p{{L}}') AND NOT contains(split_part(t, ':', 1), '.')) AS starts FROM s),
ix AS (SELECT *, CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY page_no, ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) - 1 AS idx FROM st),
sec AS (SELECT doc_id, min(doc_title) AS doc_title, idx, max(CASE WHEN starts THEN least(greatest(coalesce(heading_level, 1), 1), 6) END) AS level, max(CASE WHEN starts THEN t END) AS title,
 max(CASE WHEN starts THEN page_no END) AS start_page, max(page_no) AS end_page, string_agg(CASE WHEN NOT starts THEN t END, chr(10) || chr(10) ORDER BY page_no, ord, id) AS body,
 count(*) FILTER (NOT starts) AS n_blocks FROM ix WHERE idx >= 0 GROUP BY doc_id, idx),
tree AS (SELECT s.*, (SELECT max(q.idx) FROM sec q WHERE q.doc_id = s.doc_id AND q.idx < s.idx AND q.level < s.level) AS parent_idx, {slug_sql("title")} AS slug FROM sec s)
"""


@query("section_tree", _SECTIONS + "SELECT doc_id, idx, parent_idx, level, title, slug, start_page, end_page, n_blocks, md5(coalesce(body, '')) AS body_md5 FROM tree")
def section_tree(spark, d):
    s = segments.build_sections(indexable(spark, d))
    return s.select("doc_id", "idx", "parent_idx", "level", "title", "slug", "start_page", "end_page", F.size("bodies").cast("long").alias("n_blocks"), F.md5(segments.body_text(F.col("bodies"))).alias("body_md5"))


@query(
    "recognized_kinds",
    _SECTIONS + r"""SELECT doc_id, idx, CASE WHEN regexp_matches(coalesce(body, ''), 'holds roughly \d+') THEN 'measure'
WHEN regexp_matches(coalesce(body, ''), '\bmarket\b') AND regexp_matches(coalesce(body, ''), '\bferry\b') THEN 'place' ELSE 'topic' END AS kind FROM sec""",
)
def recognized_kinds(spark, d):
    return segments.recognized_sections(segments.build_sections(indexable(spark, d)), PACK).select("doc_id", "idx", "kind")


NARROW = Pack("near", [Rule("measure", [Require(r"holds roughly \d+")], []), Rule("place", [Require(r"\bmarket\b"), Require(r"\blantern\b", 200)], []), Rule("topic", atomic=False)])


@query(
    "recognized_in_window",
    _SECTIONS + r""", near AS (SELECT doc_id, idx, left(b, list_max(list_filter(range(0, 401), lambda n: strlen(left(b, n)) <= 400))) AS far, left(b, list_max(list_filter(range(0, 201), lambda n: strlen(left(b, n)) <= 200))) AS close_
 FROM (SELECT doc_id, idx, coalesce(body, '') AS b FROM sec))
SELECT doc_id, idx, CASE WHEN regexp_matches(far, 'holds roughly \d+') THEN 'measure' WHEN regexp_matches(far, '\bmarket\b') AND regexp_matches(close_, '\blantern\b') THEN 'place' ELSE 'topic' END AS kind FROM near""",
)
def recognized_in_window(spark, d):
    """Kinds by rules that look at the first 400 bytes, as rules do unless told otherwise, and at the first 200."""
    return segments.recognized_sections(segments.build_sections(indexable(spark, d)), NARROW).select("doc_id", "idx", "kind")


LABELS = ["Origin", "Weight", "Keeper", "First Recorded", "Condition", "Material", "Length", "Script", "Habitat", "Season", "Toll"]


def _fields_sql() -> str:
    """Labels that no letter or digit stands before get a mark; a value ends before the mark of another label."""
    pick = lambda x: r"'(?s)\x01" + x + r"\s*:*\s*(.*?)\s*(?:\n\s*\n|\z|\x01(?:" + "|".join(y for y in LABELS if y != x) + "))'"
    pairs = ", ".join(f"{{key: '{x}', value: replace(regexp_extract(marked, {pick(x)}, 1), chr(1), '')}}" for x in LABELS)
    return rf"""WITH b AS (SELECT DISTINCT section_id, regexp_replace(array_to_string(list_transform(body_blocks, lambda b: b."text"), chr(10) || chr(10)), '(^|[^A-Za-z0-9])({"|".join(LABELS)})', '\1' || chr(1) || '\2', 'g') AS marked
 FROM built_sections WHERE body_blocks IS NOT NULL), f AS (SELECT section_id, unnest([{pairs}]) AS f FROM b) SELECT section_id, f.key AS key, f.value AS value FROM f WHERE f.value <> ''"""


@query("extracted_fields", _fields_sql())
def extracted_fields(spark, d):
    """Fields of built_sections by the proper labels."""
    body = segments.body_text(F.col("body_blocks"))
    rows = table(spark, d, "built_sections").where("body_blocks is not null").dropDuplicates(["section_id"])
    each = rows.select("section_id", F.explode(segments.extract_fields(body, LABELS)).alias("f"))
    return each.select("section_id", "f.key", "f.value")


_CHUNKS = r"""WITH RECURSIVE s AS (SELECT DISTINCT section_id, coalesce(title, '') AS title, list_transform(list_filter(coalesce(body_blocks, []), lambda b: b."text" IS NOT NULL), lambda b: b."text") AS bodies FROM built_sections),
w AS (SELECT *, strlen(title || chr(10) || chr(10) || array_to_string(bodies, chr(10) || chr(10))) AS n FROM s),
f(section_id, title, bodies, i, done, cur) AS (SELECT section_id, title, bodies, 0, CAST([] AS VARCHAR[]), '' FROM w WHERE n > 4800
 UNION ALL SELECT section_id, title, bodies, i + 1, CASE WHEN cur <> '' AND strlen(cur) + strlen(bodies[i + 1]) + 2 > 4800 THEN list_append(done, cur) ELSE done END,
  CASE WHEN cur <> '' AND strlen(cur) + strlen(bodies[i + 1]) + 2 <= 4800 THEN cur || chr(10) || chr(10) || bodies[i + 1] ELSE bodies[i + 1] END FROM f WHERE i < len(bodies)),
pieces AS (SELECT section_id, title, unnest(CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END) AS p FROM f WHERE i = len(bodies))
"""


@query(
    "chunk_split",
    _CHUNKS + r"""SELECT section_id, count(*) AS n_chunks, CAST(sum(strlen(title) + 2 + strlen(p)) AS BIGINT) AS n_bytes, max(strlen(title) + 2 + strlen(p)) AS longest FROM pieces GROUP BY 1
UNION ALL SELECT section_id, 1, n, n FROM w WHERE n <= 4800""",
)
def chunk_split(spark, d):
    texts = F.transform(F.filter(F.coalesce("body_blocks", F.array().cast("array<struct<page_no:int,text:string>>")), lambda b: b["text"].isNotNull()), lambda b: b["text"])
    rows = table(spark, d, "built_sections").select("section_id", F.coalesce("title", F.lit("")).alias("title"), texts.alias("bodies")).distinct()
    each = rows.select("section_id", F.explode(segments.pack_chunks(F.col("title"), F.col("bodies"), F.lit(False))).alias("c"))
    return each.groupBy("section_id").agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("c").cast("long")).alias("n_bytes"), F.max(F.octet_length("c").cast("long")).alias("longest"))


_ENTITIES = _SECTIONS + f""", named AS (SELECT *, CASE WHEN regexp_matches(title, '\\p{{Lu}}') AND NOT regexp_matches(title, '\\p{{Ll}}')
 THEN array_to_string(list_transform(string_split(regexp_replace(lower(trim(title)), '\\s+', ' ', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE trim(title) END AS name FROM sec),
en AS (SELECT *, {slug_sql("name")} AS es FROM named WHERE length(name) >= 3 AND {slug_sql("name")} <> '')
"""


@query("entity_upsert", _ENTITIES + "SELECT 'topic' AS kind, es AS slug, arg_max(name, {t: doc_title, d: doc_id, i: idx}) AS name, count(*) AS n_sections FROM en GROUP BY es")
def entity_upsert(spark, d):
    from ..config import GENERIC

    named = graph.section_entities(segments.recognized_sections(segments.build_sections(indexable(spark, d)), GENERIC))
    n = named.groupBy("kind", F.col("entity_slug").alias("slug")).agg(F.count("*").alias("n_sections"))
    return graph.entities_of(named).join(n, ["kind", "slug"]).select("kind", "slug", "name", "n_sections")


@query("primary_definitions", _ENTITIES + "SELECT es AS slug, arg_min(doc_id, {t: doc_title, d: doc_id, i: idx}) AS doc_id, arg_min(idx, {t: doc_title, d: doc_id, i: idx}) AS idx, arg_min(start_page, {t: doc_title, d: doc_id, i: idx}) AS page_no FROM en GROUP BY es")
def primary_definitions(spark, d):
    from ..config import GENERIC

    named = graph.section_entities(segments.recognized_sections(segments.build_sections(indexable(spark, d)), GENERIC))
    defs = graph.definitions_of(named).where("is_primary")
    slugs = graph.entities_of(named).select(F.col("id").alias("entity_id"), "slug")
    idx = F.pmod(F.floor(F.col("chunk_id") / (1 << 10)), F.lit(1 << 20)).cast("int")
    return defs.join(slugs, "entity_id").select("slug", "doc_id", idx.alias("idx"), "page_no")


@query("fields_last_wins", "SELECT entity_id, doc_id, trim(key) AS key, arg_max(coalesce(value, ''), {a: coalesce(ingested_at, TIMESTAMP '1970-01-01'), v: coalesce(value, '')}) AS value FROM entity_fields WHERE key IS NOT NULL GROUP BY 1, 2, 3")
def fields_last_wins(spark, d):
    rows = table(spark, d, "entity_fields").where("key is not null")
    seq = F.struct(F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("a"), F.coalesce("value", F.lit("")).alias("v"))
    named = rows.select("entity_id", "doc_id", seq.alias("seq"), F.array(F.struct(F.trim("key").alias("key"), F.coalesce("value", F.lit("")).alias("value"))).alias("fields"))
    return graph.fields_of(named)


def _titled_chunks(spark, d):
    """Chunks of all sections, and the titles of all documents as names."""
    texts = F.transform(F.filter(F.coalesce("body_blocks", F.array().cast("array<struct<page_no:int,text:string>>")), lambda b: b["text"].isNotNull()), lambda b: b["text"])
    rows = table(spark, d, "built_sections").dropDuplicates(["section_id"]).select("section_id", F.coalesce("title", F.lit("")).alias("title"), texts.alias("bodies"))
    each = rows.select("section_id", F.posexplode(segments.pack_chunks(F.col("title"), F.col("bodies"), F.lit(False))).alias("ord", "text"))
    names = table(spark, d, "documents").where("title is not null").groupBy(F.col("title").alias("name")).agg(F.min("doc_id").alias("id"))
    return each.select(segments.chunk_id(F.col("section_id"), F.col("ord")).alias("id"), "text"), names


# Every occurrence of a name, of those at one place the longest, then from left to right those that do not overlap; at last
# those between word borders. Titles do not overlap themselves, so the parts between a title's occurrences tell its places.
_MENTIONS = _CHUNKS + r""",
ch AS (SELECT section_id * 1024 + i0 AS cid, title || chr(10) || chr(10) || l[i0 + 1] AS t FROM (SELECT section_id, title, l, unnest(range(len(l))) AS i0 FROM (SELECT section_id, title, CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END AS l FROM f WHERE i = len(bodies)))
 UNION ALL SELECT section_id * 1024, title || chr(10) || chr(10) || array_to_string(bodies, chr(10) || chr(10)) FROM w WHERE n <= 4800),
low AS (SELECT cid, t, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lt FROM ch),
names AS (SELECT translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS name, min(doc_id) AS id FROM documents WHERE length(title) >= 3 GROUP BY 1),
held AS (SELECT cid, t, id, length(name) AS n, list_transform(string_split(lt, name), lambda x: length(x)) AS gaps FROM low JOIN names ON contains(lt, name)),
occ AS (SELECT cid, t, id, n, unnest(list_transform(range(1, len(gaps)), lambda k: CAST(list_sum(gaps[1:k]) + (k - 1) * n AS BIGINT))) AS s FROM held),
best AS (SELECT cid, any_value(t) AS t, s, max(n) AS n, arg_max(id, n) AS id FROM occ GROUP BY cid, s),
walk(cid, s, e) AS (SELECT cid, s, s + n FROM best WHERE s = (SELECT min(b.s) FROM best b WHERE b.cid = best.cid)
 UNION ALL SELECT best.cid, best.s, best.s + best.n FROM walk JOIN best ON best.cid = walk.cid AND best.s >= walk.e QUALIFY row_number() OVER (PARTITION BY best.cid ORDER BY best.s) = 1)
SELECT cid AS chunk_id, id AS entity_id, strlen(left(t, s)) AS start_off, strlen(left(t, s + n)) AS end_off FROM walk JOIN best USING (cid, s)
WHERE NOT (s > 0 AND regexp_matches(substr(t, s, 1), '^[A-Za-z0-9_]')) AND NOT regexp_matches(substr(t, s + n + 1, 1), '^[A-Za-z0-9_]')"""


@query("gazetteer_mentions", _MENTIONS)
def gazetteer_mentions(spark, d):
    return graph.find_mentions(*_titled_chunks(spark, d))


@query(
    "field_label_mentions",
    r"""WITH t AS (SELECT DISTINCT doc_id, "text" AS t FROM documents WHERE "text" IS NOT NULL), w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-z0-9_]+')) AS word FROM t)
SELECT name, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM w JOIN (SELECT DISTINCT name FROM known_names WHERE name_part = 'given' AND regexp_full_match(name, '[A-Za-z]{3,}')) k
 ON translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') GROUP BY 1""",
)
def field_label_mentions(spark, d):
    """Known given names in all texts: for names of one word the automaton must agree with equality of words."""
    names = table(spark, d, "known_names").where("name_part = 'given' and name rlike '^[A-Za-z]{3,}$'").select("name").distinct().withColumn("id", F.xxhash64("name"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = graph.find_mentions(texts, names)
    return found.join(names.select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("n_docs"))


@query("gazetteer_by_join", _MENTIONS)
def gazetteer_by_join(spark, d):
    """The way for gazetteers too large for one automaton, on the same input as gazetteer_mentions."""
    return graph.join_mentions(*_titled_chunks(spark, d))


def _parts(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id")).distinct()


def _supplier_edges(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("entity_id")).distinct()
    pairs = graph.cooccurrences(m).select("src_id", "dst_id", F.lit("co_occurs").alias("kind"), F.lit(1.0).alias("weight"), F.col("chunk_id").alias("evidence_chunk_id"), F.col("chunk_id").alias("order"))
    return graph.accumulate(pairs)


_SUPPLIERS = """m AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS e FROM lineitem),
pairs AS (SELECT a.e AS src_id, b.e AS dst_id, count(*) AS n, min(a.c) AS first_chunk FROM m a JOIN m b ON a.c = b.c AND a.e < b.e GROUP BY 1, 2)"""


@query("cooccurrence_edges", "WITH m AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem) SELECT a.e AS src_id, b.e AS dst_id, CAST(count(*) AS DOUBLE) AS weight, min(a.c) AS evidence FROM m a JOIN m b ON a.c = b.c AND a.e < b.e GROUP BY 1, 2")
def cooccurrence_edges(spark, d):
    pairs = graph.cooccurrences(_parts(spark, d)).select("src_id", "dst_id", F.lit("co_occurs").alias("kind"), F.lit(1.0).alias("weight"), F.col("chunk_id").alias("evidence_chunk_id"), F.col("chunk_id").alias("order"))
    return graph.accumulate(pairs).select("src_id", "dst_id", "weight", F.col("evidence_chunk_id").alias("evidence"))


@query("mention_edges", "WITH m AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS e FROM lineitem), o AS (SELECT c, min(e) AS s FROM m GROUP BY 1) SELECT s AS src_id, e AS dst_id, CAST(count(*) AS DOUBLE) AS weight FROM m JOIN o USING (c) WHERE s <> e GROUP BY 1, 2")
def mention_edges(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("entity_id")).distinct()
    owner = m.groupBy("chunk_id").agg(F.min("entity_id").alias("entity_id")).withColumn("is_primary", F.lit(True))
    return graph.derive_edges(m, owner).where("kind = 'mentions'").select("src_id", "dst_id", "weight")


@query("supplier_edges", f"WITH {_SUPPLIERS} SELECT src_id, dst_id, CAST(n AS DOUBLE) AS weight, first_chunk AS evidence FROM pairs")
def supplier_edges(spark, d):
    return _supplier_edges(spark, d).select("src_id", "dst_id", "weight", F.col("evidence_chunk_id").alias("evidence"))


@query(
    "link_resolution",
    r"""WITH t AS (SELECT doc_id, trim(unnest(regexp_extract_all("text", '!?\[\[([^\]|\n]+?)(?:\|([^\]\n]+))?\]\]', 1)), ' ') AS target FROM documents WHERE "text" IS NOT NULL),
l AS (SELECT doc_id, """ + slug_sql("target") + """ AS slug, count(*) AS n FROM t GROUP BY 1, 2),
b AS (SELECT """ + slug_sql("title") + """ AS slug, arg_max(doc_id, {t: title, d: doc_id}) AS to_doc FROM documents GROUP BY 1)
SELECT l.doc_id AS src_id, to_doc AS dst_id, CAST(sum(n) * 2 AS DOUBLE) AS weight FROM l JOIN b USING (slug) WHERE slug <> '' AND l.doc_id <> to_doc GROUP BY 1, 2""",
)
def link_resolution(spark, d):
    docs = table(spark, d, "documents")
    own = docs.select("doc_id", F.col("doc_id").alias("entity_id"))
    links = graph.link_edges(docs.select(F.col("doc_id").alias("id"), "doc_id", "text"), docs, own)
    return graph.accumulate(links).select("src_id", "dst_id", "weight")


@query("document_tags", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all("text", '(?:^|[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}])#(\p{L}[\p{L}\p{M}\p{Nd}\p{Pc}/-]*)', 1)) AS tag, doc_id AS c FROM documents WHERE "text" IS NOT NULL
 UNION ALL SELECT doc_id, unnest(json_extract_string(frontmatter, '$.tags[*]')), NULL FROM documents WHERE frontmatter IS NOT NULL)
SELECT doc_id, tag, count(*) AS n, count(*) FILTER (c IS NULL) > 0 AS in_front FROM t GROUP BY 1, 2""")
def document_tags(spark, d):
    docs = table(spark, d, "documents")
    tags = graph.document_tags(docs.select(F.col("doc_id").alias("id"), "doc_id", "text"), docs)
    return tags.select("doc_id", "tag", "n", F.col("evidence_chunk_id").isNull().alias("in_front"))


@query("document_aliases", r"""WITH t AS (SELECT doc_id, title, unnest(json_extract_string(frontmatter, '$.aliases[*]')) AS alias FROM documents WHERE frontmatter IS NOT NULL)
SELECT doc_id AS entity_id, lower(regexp_replace(trim(alias), '\s+', ' ', 'g')) AS norm, min(alias) AS alias FROM t GROUP BY 1, 2""")
def document_aliases(spark, d):
    docs = table(spark, d, "documents")
    return graph.aliases_of(docs, docs.select("doc_id", F.col("doc_id").alias("entity_id"))).select("entity_id", "norm", "alias")


@query("alias_lookup", r"""WITH t AS (SELECT doc_id, title, bytes, lower(regexp_replace(trim(unnest(json_extract_string(frontmatter, '$.aliases[*]'))), '\s+', ' ', 'g')) AS norm FROM documents WHERE frontmatter IS NOT NULL)
SELECT DISTINCT doc_id AS id, title AS name, CAST(bytes AS DOUBLE) AS centrality FROM t WHERE norm = (SELECT min(norm) FROM t) ORDER BY centrality DESC NULLS LAST, id LIMIT 1""")
def alias_lookup(spark, d):
    """The largest of the documents that have the first of all aliases."""
    docs = table(spark, d, "documents")
    aliases = graph.aliases_of(docs, docs.select("doc_id", F.col("doc_id").alias("entity_id")))
    first = aliases.agg(F.min("norm")).first()[0]
    entities = docs.select(F.col("doc_id").alias("id"), F.col("title").alias("name"), F.col("bytes").cast("double").alias("centrality"))
    return retrieve.by_alias(entities, aliases, first or "").select("id", "name", "centrality")


def _rank_sql(pairs: str, nodes: str, digits: int, rounds: int = 20) -> str:
    steps = [f"WITH {pairs}, e AS (SELECT src_id AS a, dst_id AS b, n FROM pairs UNION ALL SELECT dst_id, src_id, n FROM pairs), s AS (SELECT a, sum(n) AS total FROM e GROUP BY 1), "]
    steps.append("f AS MATERIALIZED (SELECT e.a, e.b, e.n / s.total AS share FROM e JOIN s USING (a)), ids AS (" + nodes + "), r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM ids) AS rank FROM ids)")
    for i in range(rounds):
        steps.append(f", r{i + 1} AS MATERIALIZED (SELECT ids.id, 0.15 / (SELECT count(*) FROM ids) + 0.85 * coalesce(sum(f.share * r.rank), 0) AS rank FROM ids LEFT JOIN f ON f.b = ids.id LEFT JOIN r{i} r ON r.id = f.a GROUP BY 1)")
    return "".join(steps) + f" SELECT id, round(rank, {digits}) AS rank FROM r{rounds}"


@query("pagerank_suppliers", _rank_sql(_SUPPLIERS, "SELECT s_suppkey AS id FROM supplier", 6))
def pagerank_suppliers(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return graph.pagerank(nodes, _supplier_edges(spark, d)).select("id", F.round("rank", 6).alias("rank"))


@query("pagerank_parts", _rank_sql(_SUPPLIERS.replace("l_suppkey", "l_partkey"), "SELECT p_partkey AS id FROM part", 9))
def pagerank_parts(spark, d):
    pairs = graph.cooccurrences(_parts(spark, d)).select("src_id", "dst_id", F.lit(1.0).alias("weight"))
    return graph.pagerank(table(spark, d, "part").select(F.col("p_partkey").alias("id")), pairs).select("id", F.round("rank", 9).alias("rank"))


_WALK = """WITH m AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem), p AS (SELECT DISTINCT a.e AS a, b.e AS b FROM m a JOIN m b ON a.c = b.c AND a.e <> b.e),
h1 AS (SELECT DISTINCT b AS id FROM p WHERE a = 1 AND b <> 1), h2 AS (SELECT DISTINCT b AS id FROM p WHERE a IN (SELECT id FROM h1) AND b <> 1 AND b NOT IN (SELECT id FROM h1))"""


@query("bfs_two_hops", _WALK + " SELECT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM h2")
def bfs_two_hops(spark, d):
    seeds = table(spark, d, "part").where("p_partkey = 1").select(F.col("p_partkey").alias("id"))
    return graph.expand(seeds, graph.cooccurrences(_parts(spark, d)), 2)


@query("index_report")
def index_report(spark, d):
    from . import pipeline

    return pipeline.index_report(pipeline.build_index(*[table(spark, d, t) for t in ("documents", "pages", "blocks")]))
