"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy, references
from ..session import table
from . import query

_LINKS = """
WITH RECURSIVE one AS (SELECT id, min(parent_id) AS parent_id FROM sections WHERE id IS NOT NULL GROUP BY id),
nodes AS (SELECT a.id, b.id AS parent_id FROM one a LEFT JOIN one b ON a.parent_id = b.id),
"""
_UP = _LINKS + """
up(id, anc) AS (SELECT id, parent_id FROM nodes WHERE parent_id IS NOT NULL
  UNION SELECT up.id, nodes.parent_id FROM up JOIN nodes ON nodes.id = up.anc WHERE nodes.parent_id IS NOT NULL)
"""
_DOWN = _LINKS + """
tree(id, parent_id, root_id, depth, path, ids) AS (SELECT id, parent_id, id, 0, CAST(id AS VARCHAR), [id] FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, n.parent_id, t.root_id, t.depth + 1, t.path || '/' || n.id, list_append(t.ids, n.id) FROM tree t JOIN nodes n ON n.parent_id = t.id),
pairs(id, descendant_id, distance) AS (SELECT parent_id, id, 1 FROM tree WHERE parent_id IS NOT NULL
  UNION ALL SELECT t.parent_id, p.descendant_id, p.distance + 1 FROM pairs p JOIN tree t ON t.id = p.id WHERE t.parent_id IS NOT NULL)
"""


@query("p1_found", _UP + "SELECT id FROM up WHERE id = anc")
def p1_found(spark, d):
    return hierarchy.build_hierarchy(table(spark, d, "sections"), tree=False).circular


@query(
    "p1_hierarchy",
    _DOWN + ", sizes AS (SELECT id, count(*) AS n FROM pairs GROUP BY id) "
    "SELECT *, lft + subtree - 1 AS rgt FROM (SELECT t.id, t.parent_id, t.root_id, t.depth, t.path, 1 + coalesce(n, 0) AS subtree, "
    "row_number() OVER (PARTITION BY t.root_id ORDER BY t.ids) AS lft FROM tree t LEFT JOIN sizes s ON s.id = t.id)",
)
def p1_hierarchy(spark, d):
    tree = hierarchy.build_hierarchy(table(spark, d, "sections")).tree
    return tree.select("id", "parent_id", "root_id", "depth", F.array_join("path", "/").alias("path"), F.col("size").alias("subtree"), "lft", "rgt")


@query("p1_descendants", _DOWN + "SELECT id, descendant_id, distance FROM pairs")
def p1_descendants(spark, d):
    return hierarchy.descendants(hierarchy.build_hierarchy(table(spark, d, "sections")).tree)


@query(
    "p1_label_paths",
    _LINKS + """names AS (SELECT id, coalesce(min(title), '') AS title FROM sections GROUP BY id),
tree(id, depth, label_path) AS (SELECT n.id, 0, title FROM nodes n JOIN names USING (id) WHERE parent_id IS NULL
  UNION ALL SELECT n.id, t.depth + 1, t.label_path || ' > ' || names.title FROM tree t JOIN nodes n ON n.parent_id = t.id JOIN names ON names.id = n.id)
SELECT id, depth, label_path FROM tree""",
)
def p1_label_paths(spark, d):
    sections = table(spark, d, "sections")
    return hierarchy.labelled_paths(hierarchy.build_hierarchy(sections).tree, sections).select("id", "depth", "label_path")


@query(
    "p1_unfinished",
    _UP + """, circle AS (SELECT id FROM up WHERE id = anc)
SELECT id, 'circle' AS state FROM circle UNION ALL
SELECT DISTINCT id, 'below_circle' FROM up WHERE anc IN (SELECT id FROM circle) AND id NOT IN (SELECT id FROM circle)
UNION ALL SELECT o.id, 'dangling' FROM one o WHERE o.parent_id IS NOT NULL AND o.parent_id NOT IN (SELECT id FROM one)""",
)
def p1_unfinished(spark, d):
    h = hierarchy.build_hierarchy(table(spark, d, "sections"), tree=False)
    state = lambda df, s: df.select("id", F.lit(s).alias("state"))
    return state(h.circular, "circle").unionByName(state(h.below, "below_circle")).unionByName(state(h.nodes.where("dangling"), "dangling"))


_REFS = r"""
WITH links AS (SELECT DISTINCT link_id, target, source_document, seen_at FROM wikilinks),
long AS (SELECT link_id, seen_at, 'target' AS field, target AS value FROM links UNION ALL SELECT link_id, seen_at, 'source_document', source_document FROM links),
refs AS (SELECT *, regexp_replace(lower(value), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS exact,
  regexp_replace(regexp_replace(value, '(.)#(.|\n)*$', '\1'), '(?i)\.(md|markdown|adoc|asciidoc|txt|url|urls|pdf|html?)\s*$', '') AS named,
  regexp_replace(lower(named), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS kept, regexp_replace(lower(regexp_replace(named, '^.*[/\\](.*[^\s/\\])', '\1')), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS key
  FROM long WHERE value IS NOT NULL AND regexp_matches(value, '[^\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]')),
live AS (SELECT regexp_replace(lower(title), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS key, min(coalesce(ingested_at, TIMESTAMP '1970-01-01')) AS first_at FROM documents WHERE deleted_at IS NULL AND title IS NOT NULL GROUP BY 1),
found AS (SELECT r.link_id, r.field, r.seen_at, coalesce(a.key, b.key, c.key) IS NOT NULL AS live, coalesce(a.first_at, least(b.first_at, c.first_at)) AS first_at FROM refs r
  LEFT JOIN live a ON a.key = r.key AND r.key <> '' LEFT JOIN live b ON b.key = r.exact AND r.exact <> '' LEFT JOIN live c ON c.key = r.kept AND r.kept <> '')
"""


@query("p3_found", _REFS + "SELECT DISTINCT link_id, field FROM found WHERE NOT live")
def p3_found(spark, d):
    found = references.link_references(table(spark, d, "wikilinks"), table(spark, d, "documents"))
    return found.orphans().select(F.col("ref_id").alias("link_id"), "field").distinct()


@query(
    "p3_orphan_report",
    _REFS + """SELECT field, strftime(seen_at, '%Y-%m') AS month, count(*) AS n_refs, count(*) FILTER (NOT live) AS n_missing,
count(*) FILTER (live AND first_at > seen_at) AS n_late FROM found GROUP BY 1, 2""",
)
def p3_orphan_report(spark, d):
    return references.link_references(table(spark, d, "wikilinks"), table(spark, d, "documents")).report()
