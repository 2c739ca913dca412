"""Queries of this subpackage, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import mixing, pii, scans, splitting, survivors, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_EMPTY = ", ".join("'" + w.replace("'", "''") + "'" for w in survivors.EMPTY_WORDS)
_CLAIMS = rf"""
WITH folded AS (SELECT entity_id, doc_id, value, ingested_at, regexp_replace(lower(key), '[^\p{{L}}\p{{N}}]+', '', 'g') AS k,
  lower(trim(regexp_replace(value, '[\s\x{{00A0}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))) AS f FROM entity_fields),
claims AS (SELECT DISTINCT entity_id, l.label, doc_id, value, f, ingested_at AS stated_at FROM folded
  JOIN field_labels l ON regexp_replace(lower(l.label), '[^\p{{L}}\p{{N}}]+', '', 'g') = k
  WHERE f NOT IN ({_EMPTY}) AND regexp_matches(f, '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(f, '\x{{FFFD}}|\[cut\]|\[…\]|\(…\)|\[\.\.\.\]|\(\.\.\.\)|(\.\.\.|…)$')),
twice AS (SELECT entity_id FROM entity_fields GROUP BY entity_id HAVING count(DISTINCT doc_id) >= 2)
"""


@query(
    "p2_found",
    _CLAIMS + """SELECT entity_id, label, doc_id FROM claims SEMI JOIN twice USING (entity_id)
QUALIFY row_number() OVER (PARTITION BY entity_id, label ORDER BY coalesce(stated_at, TIMESTAMP '0001-01-01') DESC, doc_id) = 1""",
)
def p2_found(spark, d):
    stated = table(spark, d, "entity_fields")
    best = survivors.latest(stated, table(spark, d, "field_labels"))
    return best.join(survivors.stated_twice(stated), "entity_id", "left_semi").select("entity_id", "label", "doc_id")


@query(
    "p2_survivors",
    _CLAIMS.replace("WITH folded", "WITH RECURSIVE folded") + rf""", votes AS (SELECT DISTINCT entity_id, label, doc_id, regexp_replace(f, '\s*\.$', '') AS vote FROM claims),
trust(step, doc_id, reliability, moved) AS (SELECT 0, doc_id, CAST({survivors.PRIOR_SHARE} AS DOUBLE), CAST(1 AS DOUBLE) FROM votes GROUP BY doc_id UNION ALL
  SELECT step + 1, doc_id, now, max(abs(now - was)) OVER () FROM (SELECT any_value(step) AS step, doc_id, any_value(reliability) AS was,
      (sum(share) + {survivors.PRIOR_SHARE * survivors.PRIOR_WEIGHT}) / (count(*) + {survivors.PRIOR_WEIGHT}) AS now
    FROM (SELECT *, support / sum(support / n) OVER (PARTITION BY entity_id, label) AS share FROM (
      SELECT v.*, t.step, t.reliability, sum(t.reliability) OVER same AS support, count(*) OVER same AS n FROM votes v JOIN trust t USING (doc_id) WHERE t.moved >= {survivors.TOLERANCE}
      WINDOW same AS (PARTITION BY v.entity_id, v.label, v.vote))) GROUP BY doc_id)),
settled AS (SELECT doc_id, reliability FROM trust WHERE step = (SELECT max(step) FROM trust)),
backed AS (SELECT entity_id, label, vote, sum(reliability) AS support FROM votes JOIN settled USING (doc_id) GROUP BY ALL),
shares AS (SELECT *, support / sum(support) OVER (PARTITION BY entity_id, label) AS share FROM backed)
SELECT entity_id, label, value, doc_id, round(support, 6) AS support, round(share, 6) AS share
FROM (SELECT *, regexp_replace(f, '\s*\.$', '') AS vote FROM claims) JOIN shares USING (entity_id, label, vote) JOIN settled USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY entity_id, label ORDER BY round(support, 9) DESC, round(reliability, 9) DESC, coalesce(stated_at, TIMESTAMP '0001-01-01') DESC, doc_id, value) = 1""",
)
def p2_survivors(spark, d):
    best = survivors.survivors(table(spark, d, "entity_fields"), table(spark, d, "field_labels"))
    return best.select("entity_id", "label", "value", "doc_id", F.round("support", 6).alias("support"), F.round("share", 6).alias("share"))


_SPLIT_SQL = r"""
WITH parts AS (SELECT DISTINCT section_id, list_filter(list_concat([title], coalesce(list_transform(body_blocks, lambda b: b."text"), [])),
  lambda x: x IS NOT NULL AND regexp_matches(x, '[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]')) AS p FROM built_sections),
sized AS (SELECT section_id, strlen(array_to_string(p, chr(10) || chr(10))) AS n FROM parts)
"""
# Each text as a shape with one character a byte: a character of several bytes becomes a sign for its kind (1 any, 3 and 4 and
# 5 those that end sentences and clauses) and 2 for each further byte, so that bytes can be counted and matched.
_PIECES_SQL = _SPLIT_SQL.rstrip("\n") + r""",
items AS (SELECT *, row_number() OVER () AS item, array_to_string(p, chr(10) || chr(10)) AS t, strlen(array_to_string(p, chr(10) || chr(10))) AS total FROM parts WHERE len(p) > 0),
shaped AS (SELECT item, section_id, t, total, list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x) + 2)) AS BIGINT)) AS joints,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x01-\x05]', 'a', 'g'), '…', chr(3) || chr(2) || chr(2), 'g'), '[。！？]', chr(4) || chr(2) || chr(2), 'g'),
    '、', chr(5) || chr(2) || chr(2), 'g'), '[\x{80}-\x{7FF}]', chr(1) || chr(2), 'g'), '[\x{800}-\x{FFFF}]', chr(1) || chr(2) || chr(2), 'g'), '[\x{10000}-\x{10FFFF}]', chr(1) || chr(2) || chr(2) || chr(2), 'g') AS shape FROM items),
limits AS (SELECT DISTINCT profile, max_bytes, coalesce(overlap_bytes, 0) AS overlap, (max_bytes - coalesce(overlap_bytes, 0)) // 4 AS slack FROM split_profiles WHERE profile IS NOT NULL AND max_bytes IS NOT NULL),
windows AS (SELECT *, k * s AS high, k * s - slack AS low, greatest(k * s - slack - 64, 0) AS base FROM (
  SELECT item, joints, shape, profile, slack, s, unnest(range(1, CAST(ceil(total / s) AS BIGINT))) AS k FROM (SELECT *, max_bytes - overlap - slack AS s FROM shaped JOIN limits ON total > max_bytes))),
seen AS (SELECT item, profile, k, low, high, base, shape, coalesce(list_max(list_filter(joints, lambda j: j > low AND j <= high)), 0) AS joint, shape[base + 1:high] AS x, shape[base + 1:high + 1] AS x1 FROM windows),
places AS (SELECT item, profile, k, low, high, shape,
  greatest(joint, base + length(regexp_extract(x1, '(?s)^(.*\n[ \t\r]*\n[ \t\n\r\f\v]*)[^ \t\n\r\f\v]', 1))) AS p5, base + length(regexp_extract(x, '(?s)^(.*\n)', 1)) AS p4,
  base + length(regexp_extract(x, '(?s)^(.*(?:(?:[.!?]|\x03\x02\x02)["'')\]]{0,8}[ \t\n\r\f\v]|\x04\x02\x02))', 1)) AS p3, base + length(regexp_extract(x, '(?s)^(.*(?:[,;:][ \t\n\r\f\v]|\x05\x02\x02))', 1)) AS p2,
  base + length(regexp_extract(x, '(?s)^(.*[ \t])', 1)) AS p1 FROM seen),
cuts AS (SELECT item, profile, k, CASE WHEN p5 > low THEN p5 WHEN p4 > low THEN p4 WHEN p3 > low THEN p3 WHEN p2 > low THEN p2 WHEN p1 > low THEN p1
  ELSE high - CASE WHEN shape[high + 1] <> chr(2) THEN 0 WHEN shape[high] <> chr(2) THEN 1 WHEN shape[high - 1] <> chr(2) THEN 2 ELSE 3 END END AS cut FROM places),
spans AS (SELECT item, profile, CAST(k AS INT) AS piece, lag(cut, 1, 0) OVER (PARTITION BY item, profile ORDER BY k) AS from_, cut AS end_byte FROM cuts
  UNION ALL SELECT c.item, c.profile, CAST(max(k) + 1 AS INT), max(cut), any_value(total) FROM cuts c JOIN items USING (item) GROUP BY 1, 2),
starts AS (SELECT section_id, profile, piece, t, shape, greatest(from_ - CASE WHEN piece > 1 THEN overlap ELSE 0 END, 0) AS a, end_byte FROM spans JOIN shaped USING (item) JOIN limits USING (profile)),
moved AS (SELECT *, a + CASE WHEN shape[a + 1] <> chr(2) THEN 0 WHEN shape[a + 2] <> chr(2) THEN 1 WHEN shape[a + 3] <> chr(2) THEN 2 ELSE 3 END AS start_byte FROM starts)
SELECT section_id, profile, piece, start_byte, end_byte, substr(t, 1 + length(replace(shape[:start_byte], chr(2), '')), length(replace(shape[start_byte + 1:end_byte], chr(2), ''))) AS piece_text FROM moved
UNION ALL SELECT section_id, profile, 1, 0, total, t FROM items JOIN limits ON total <= max_bytes
"""


@query("p4_found", _SPLIT_SQL + "SELECT DISTINCT section_id, profile FROM sized, split_profiles WHERE n > max_bytes")
def p4_found(spark, d):
    blocks = splitting.item_blocks(table(spark, d, "built_sections"), "section_id", "title", "body_blocks")
    found = splitting.cuts(blocks, table(spark, d, "split_profiles"))
    return found.select(F.col("item").alias("section_id"), "profile").distinct()


@query("p4_pieces", _PIECES_SQL)
def p4_pieces(spark, d):
    blocks = splitting.item_blocks(table(spark, d, "built_sections"), "section_id", "title", "body_blocks")
    found = splitting.pieces(blocks, table(spark, d, "split_profiles"))
    return found.select(F.col("item").alias("section_id"), "profile", "piece", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.col("body").alias("piece_text"))


@query("p6_ids")
def p6_ids(spark, d):
    return tokens.encode_corpus(table(spark, d, "documents"))


@query("p6_round_trip", "SELECT doc_id, coalesce(\"text\", '') AS decoded FROM documents")
def p6_round_trip(spark, d):
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, d, "documents"))).select("doc_id", F.col("text").alias("decoded"))


def _mix(spark, d, budget=None):
    sized = tokens.count_tokens(table(spark, d, "documents"), keep=("source",))
    return mixing.mix_sources(sized, table(spark, d, "mix_targets"), budget)


def _rounded(report):
    return report.select(*[F.round(c, 6).alias(c) if c.endswith("_share") else c for c in report.columns])


@query("p7_selection")
def p7_selection(spark, d):
    return _mix(spark, d)[0]


@query("p7_shares")
def p7_shares(spark, d):
    return _rounded(_mix(spark, d)[1])


@query("p7_budget_shares")
def p7_budget_shares(spark, d):
    """Every mix with a budget of ten million tokens, whatever its sources hold."""
    return _rounded(_mix(spark, d, 10_000_000)[1])


@query("p5_found")
def p5_found(spark, d):
    return scans.Scan(table(spark, d, "pages"), table(spark, d, "documents")).found()


@query("p5_paragraphs")
def p5_paragraphs(spark, d):
    return scans.Scan(table(spark, d, "pages"), table(spark, d, "documents"), table(spark, d, "blocks")).paragraphs()


@query("p8_found")
def p8_found(spark, d):
    return pii.find_mentions(table(spark, d, "documents")).select("doc_id", "kind", "start_pos").distinct()


@query("p8_redacted")
def p8_redacted(spark, d):
    return pii.redact(table(spark, d, "documents"))
