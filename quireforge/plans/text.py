"""Queries of sources, text functions and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import layout
from ..scratch import spread
from ..session import table
from ..sources import plain, rows
from . import query

SLUG = "regexp_replace(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '-', 'g'), '^-', ''), '-$', '')"


def slug_sql(c: str) -> str:
    plain = "translate(" + SLUG.format(c) + ", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"(CASE WHEN length({plain}) > 80 THEN regexp_replace({plain}[1:80], '-$', '') || '-' || md5({c})[1:8] ELSE {plain} END)"


@query("slugify_titles", f"SELECT doc_id, {slug_sql('title')} AS slug FROM documents")
def slugify_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.slugify(F.col("title")).alias("slug"))


@query(
    "display_names",
    r"""SELECT DISTINCT id, CASE WHEN regexp_matches(title, '\p{Lu}') AND NOT regexp_matches(title, '\p{Ll}')
THEN array_to_string(list_transform(string_split(regexp_replace(lower(trim(title)), '\s+', ' ', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE trim(title) END AS display_name FROM sections""",
)
def display_names(spark, d):
    return table(spark, d, "sections").select("id", tx.display_name(F.col("title")).alias("display_name")).distinct()


@query("alias_norm", r"SELECT alias, lower(regexp_replace(trim(alias), '\s+', ' ', 'g')) AS norm, count(*) AS n FROM wikilinks WHERE alias IS NOT NULL GROUP BY 1, 2")
def alias_norm(spark, d):
    return table(spark, d, "wikilinks").where("alias is not null").groupBy("alias", tx.normalize_alias(F.col("alias")).alias("norm")).agg(F.count("*").alias("n"))


@query(
    "wikilinks_in_texts",
    r"""WITH t AS (SELECT doc_id, trim(unnest(regexp_extract_all("text", '!?\[\[([^\]|\n]+?)(?:\|([^\]\n]+))?\]\]', 1)), ' ') AS target FROM documents WHERE "text" IS NOT NULL)
SELECT doc_id, target, count(*) AS n FROM t GROUP BY 1, 2""",
)
def wikilinks_in_texts(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.explode(tx.wikilink_targets(F.col("text"))).alias("target"))
    return each.groupBy("doc_id", "target").agg(F.count("*").alias("n"))


@query(
    "inline_tags",
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all("text", '(?:^|[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}])#(\p{L}[\p{L}\p{M}\p{Nd}\p{Pc}/-]*)', 1)) AS tag FROM documents WHERE "text" IS NOT NULL)
SELECT tag, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY 1""",
)
def inline_tags(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.explode(tx.tags(F.col("text"))).alias("tag"))
    return each.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(
    "strip_markup_texts",
    """SELECT doc_id, replace(replace(replace(replace(replace(replace(regexp_replace("text", '<[^>]+>', chr(10), 'gs'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS plain FROM documents""",
)
def strip_markup_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.strip_markup(F.col("text")).alias("plain"))


@query("doc_sha_dedup", "SELECT sha256(coalesce(\"text\", '')) AS content_sha, count(*) AS n, min(doc_id) AS first_doc, bool_and(sha256 = sha256(coalesce(\"text\", ''))) AS as_stored FROM documents GROUP BY 1")
def doc_sha_dedup(spark, d):
    docs = table(spark, d, "documents").withColumn("content_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.groupBy("content_sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.every(F.col("sha256") == F.col("content_sha")).alias("as_stored"))


@query(
    "section_fingerprints",
    "SELECT DISTINCT section_id, sha256(array_to_string(list_concat([title], coalesce(list_transform(body_blocks, lambda b: coalesce(b.\"text\", '')), [])), chr(1)) || chr(1)) AS fingerprint FROM built_sections WHERE title IS NOT NULL",
)
def section_fingerprints(spark, d):
    texts = F.coalesce(F.transform("body_blocks", lambda b: F.coalesce(b["text"], F.lit(""))), F.array().cast("array<string>"))
    return table(spark, d, "built_sections").where("title is not null").select("section_id", tx.fingerprint(F.col("title"), texts).alias("fingerprint")).distinct()


@query("token_estimates", 'SELECT doc_id, CAST(floor(strlen("text") / 4) AS INTEGER) AS tokens FROM documents')
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("byte_prefixes", "SELECT doc_id, left(\"text\", list_max(list_filter(range(0, 401), lambda n: strlen(left(\"text\", n)) <= 400))) AS prefix FROM documents")
def byte_prefixes(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.byte_prefix(F.col("text"), 400).alias("prefix"))


@query(
    "heading_scores",
    r"""WITH b AS (SELECT DISTINCT id, regexp_replace("text", '^\s+|\s+$', '', 'g') AS t FROM blocks WHERE "text" IS NOT NULL)
SELECT id, CASE WHEN t = '' THEN 0 ELSE CAST(length(t) < 60 AS INT) + CAST(NOT regexp_matches(t, '[.,;]$') AS INT)
 + CASE WHEN regexp_matches(t, '\p{L}') AND (NOT regexp_matches(t, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') OR len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: regexp_matches(w, '^\P{L}*[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]'))) = 0) THEN 2 ELSE 0 END END AS score FROM b""",
)
def heading_scores(spark, d):
    return table(spark, d, "blocks").where("text is not null").select("id", tx.heading_score(F.col("text"), F.lit(False)).alias("score")).distinct()


@query(
    "low_confidence_pages",
    r"""SELECT DISTINCT id, CASE WHEN ocr_conf IS NOT NULL THEN ocr_conf < 45 ELSE length(regexp_replace(coalesce("text", ''), '[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\v]', '', 'g')) < 100 END AS low FROM pages""",
)
def low_confidence_pages(spark, d):
    return table(spark, d, "pages").select("id", tx.low_confidence(F.col("ocr_conf"), F.col("text")).alias("low")).distinct()


@query(
    "frontmatter_values",
    """SELECT doc_id, json_extract_string(frontmatter, '$.title') AS fm_title, array_to_string(coalesce(json_extract_string(frontmatter, '$.tags[*]'), []), ',') AS tags,
array_to_string(coalesce(json_extract_string(frontmatter, '$.aliases[*]'), []), ',') AS aliases FROM documents WHERE frontmatter IS NOT NULL""",
)
def frontmatter_values(spark, d):
    fm = F.col("frontmatter")
    return table(spark, d, "documents").where("frontmatter is not null").select(
        "doc_id", tx.frontmatter_scalar(fm, "title").alias("fm_title"), F.array_join(tx.frontmatter_list(fm, "tags"), ",").alias("tags"), F.array_join(tx.frontmatter_list(fm, "aliases"), ",").alias("aliases")
    )


@query("frontmatter_parsed")
def frontmatter_parsed(spark, d):
    from ..sources import frontmatter as fm

    def run(frames):
        for f in frames:
            f["parsed"] = [fm.to_json(fm.split(t)[0]) for t in f["text"]]
            yield f[["doc_id", "parsed"]]

    return table(spark, d, "documents").where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, parsed string")


def _blocks_of(spark, d, kind, parse):
    def run(frames):
        import pandas as pd

        for f in frames:
            out = [(i, n, *b) for i, t in zip(f["doc_id"], f["text"], strict=True) for n, b in enumerate(parse(t))]
            yield pd.DataFrame(out, columns=["doc_id", "ord", "kind", "block_text", "heading_level"])

    docs = table(spark, d, "documents").where((F.col("kind") == kind) & F.col("text").isNotNull())
    return spread(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, ord int, kind string, block_text string, heading_level int")


@query("markdown_blocks")
def markdown_blocks(spark, d):
    from ..sources import frontmatter, markdown

    return _blocks_of(spark, d, "md", lambda t: markdown.parse(frontmatter.split(t)[1]))


@query("asciidoc_blocks")
def asciidoc_blocks(spark, d):
    from ..sources import asciidoc

    return _blocks_of(spark, d, "adoc", lambda t: asciidoc.parse(t)[1])


@query("html_blocks")
def html_blocks(spark, d):
    """Sections written as pages of HTML with unclosed paragraphs, and read again."""
    from ..sources import html

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [(i, n, *b) for i, t in zip(f["section_id"], f["page"], strict=True) for n, b in enumerate(html.parse(t)[1])]
            yield pd.DataFrame(out, columns=["section_id", "ord", "kind", "block_text", "heading_level"])

    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform("body_blocks", lambda b: F.concat(F.lit("<p>"), safe(b["text"]))), "\n")
    sections = table(spark, d, "built_sections").dropDuplicates(["section_id"])
    pages = sections.select("section_id", F.concat(F.lit("<html><title>t</title><h1>"), safe(F.coalesce("title", F.lit(""))), F.lit("</h1>"), F.coalesce(body, F.lit("")), F.lit("</html>")).alias("page"))
    return pages.mapInPandas(run, "section_id long, ord int, kind string, block_text string, heading_level int")


@query("plain_words", r"""WITH lines AS (SELECT doc_id, unnest(string_split("text", chr(10))) AS t, generate_subscripts(string_split("text", chr(10)), 1) AS i FROM documents WHERE "text" IS NOT NULL),
w AS (SELECT doc_id, i, unnest(regexp_extract_all(t, '[^\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\v]+')) AS word FROM lines)
SELECT doc_id, count(*) AS n_words, count(DISTINCT i) AS n_lines, CAST(sum(length(word)) AS BIGINT) AS n_chars FROM w GROUP BY 1""")
def plain_words(spark, d):
    words = plain.text_words(table(spark, d, "documents"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_distinct("line").alias("n_lines"), F.sum(F.length("word")).alias("n_chars"))


@query(
    "fragmentation_stats",
    r"""WITH w AS (SELECT DISTINCT id, unnest(regexp_extract_all(coalesce("text", ''), '[^\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\v]+')) AS word, generate_subscripts(regexp_extract_all(coalesce("text", ''), '[^\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\v]+'), 1) AS i FROM pages)
SELECT id, count(*) AS n_words, round(avg(length(word)), 6) AS avg_len, round(avg(CAST(length(word) <= 2 AS DOUBLE)), 6) AS short_share FROM w GROUP BY 1""",
)
def fragmentation_stats(spark, d):
    words = plain.text_words(table(spark, d, "pages").dropDuplicates(["id"]), "id")
    size = F.length("word")
    return words.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_words"), F.round(F.avg(size), 6).alias("avg_len"), F.round(F.avg((size <= 2).cast("double")), 6).alias("short_share"))


def _placed(spark, d):
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "doc_id", "page_no", "height").distinct()
    blocks = table(spark, d, "blocks").where("text is not null").select("page_id", "ord", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"), "text", "kind").distinct()
    return blocks.join(pages, "page_id")


_PLACED = """WITH p AS (SELECT DISTINCT id AS page_id, doc_id, page_no, height FROM pages),
b AS (SELECT DISTINCT page_id, ord, bbox.y0 AS y0, bbox.y1 AS y1, "text" AS t, kind FROM blocks WHERE "text" IS NOT NULL),
pb AS (SELECT * FROM b JOIN p USING (page_id)),
c AS (SELECT doc_id, page_no, 'top' AS edge, arg_min({t: t, ord: ord}, {y: y0, ord: ord, t: t}) AS x FROM pb WHERE y0 <= height * 0.12 GROUP BY 1, 2
 UNION ALL SELECT doc_id, page_no, 'foot', arg_min({t: t, ord: ord}, {y: -y1, ord: ord, t: t}) FROM pb WHERE y1 >= height * 0.88 GROUP BY 1, 2),
k AS (SELECT doc_id, page_no, edge, x.ord AS ord, translate(regexp_replace(regexp_replace(x.t, '^\\s+|\\s+$', '', 'g'), '[0-9]+', '#', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM c)
"""


@query("chrome_candidates", _PLACED + "SELECT * FROM k")
def chrome_candidates(spark, d):
    return layout.chrome_candidates(_placed(spark, d))


@query(
    "chrome_lines",
    _PLACED + """, e AS (SELECT doc_id, edge, key, count(*) AS n FROM k WHERE key <> '' GROUP BY ALL), w AS (SELECT doc_id, edge, sum(n) AS whole FROM e GROUP BY ALL),
n AS (SELECT doc_id, count(DISTINCT page_no) AS n_pages FROM k GROUP BY 1)
SELECT k.doc_id, k.page_no, k.edge, k.ord, k.key, e.n FROM k JOIN e USING (doc_id, edge, key) JOIN w USING (doc_id, edge) JOIN n USING (doc_id) WHERE e.n >= 4 AND e.n >= 0.5 * whole AND n_pages >= 3""",
)
def chrome_lines(spark, d):
    return layout.repeated_chrome(layout.chrome_candidates(_placed(spark, d))).select("doc_id", "page_no", "edge", "ord", "key", "n")


@query(
    "reading_text",
    _PLACED + "SELECT doc_id, page_no, string_agg(t, chr(10) || chr(10) ORDER BY ord, t) AS page_text FROM pb WHERE kind <> 'chrome' GROUP BY ALL",
)
def reading_text(spark, d):
    return layout.reading_text(_placed(spark, d)).withColumnRenamed("text", "page_text")


@query("layout_blocks")
def layout_blocks(spark, d):
    """Scanned pages set as words at made-up places, and laid out again."""
    pages = table(spark, d, "pages").where("id is not null and text is not null").dropDuplicates(["id"])
    words = plain.text_words(pages, "id").withColumnRenamed("doc_id", "id").join(pages.select("id", "doc_id", "page_no"), "id")
    placed = words.select("doc_id", "page_no", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.col("word").alias("text"), (72 + 5 * F.col("x0")).alias("x0"), (60 + 13 * F.col("y0")).alias("y0"), (72 + 5 * F.col("x1")).alias("x1"), (70 + 13 * F.col("y0")).alias("y1"))
    return layout.strip_chrome(layout.layout_pages(placed))


@query(
    "row_blocks_supplier",
    """WITH r AS (SELECT s_suppkey, unnest([{ord: 0, kind: 'heading', t: s_name, level: 1}, {ord: 1, kind: 'body', t: 's_suppkey: ' || s_suppkey, level: NULL}, {ord: 2, kind: 'body', t: 's_nationkey: ' || s_nationkey, level: NULL}]) AS b FROM supplier)
SELECT s_suppkey, b.ord AS ord, b.kind AS kind, b.t AS block_text, b.level AS heading_level FROM r""",
)
def row_blocks_supplier(spark, d):
    out = rows.row_blocks(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name"), ["s_suppkey"], "s_name")
    return out.select("row_key.s_suppkey", "ord", "kind", F.col("text").alias("block_text"), "heading_level")
