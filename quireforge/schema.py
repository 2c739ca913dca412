"""Schemas of the graph's tables and the words that its columns may hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


BBOX = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
WORD = f"STRUCT<text: STRING, bbox: {BBOX}, confidence: FLOAT>"
DDL = {
    "documents": "doc_id LONG, path STRING, sha256 STRING, title STRING, kind STRING, page_count INT, bytes LONG, ingested_at TIMESTAMP, extractor STRING, ocr BOOLEAN, frontmatter STRING",
    "pages": "id LONG, doc_id LONG, page_no INT, width DOUBLE, height DOUBLE, text STRING, ocr_conf FLOAT, low_confidence BOOLEAN",
    "blocks": f"id LONG, page_id LONG, col INT, ord INT, bbox {BBOX}, kind STRING, text STRING, heading_level INT",
    "sections": "id LONG, doc_id LONG, parent_id LONG, level INT, title STRING, slug STRING, start_page INT, end_page INT",
    "chunks": "id LONG, doc_id LONG, section_id LONG, start_page INT, end_page INT, ord INT, doc_ord LONG, kind STRING, text STRING, token_est INT",
    "entities": "id LONG, kind STRING, name STRING, slug STRING, canonical_id LONG, centrality DOUBLE, confidence FLOAT",
    "entity_aliases": "entity_id LONG, alias STRING, norm STRING",
    "entity_defs": "entity_id LONG, chunk_id LONG, doc_id LONG, page_no INT, is_primary BOOLEAN",
    "entity_fields": "entity_id LONG, doc_id LONG, key STRING, value STRING",
    "mentions": "chunk_id LONG, entity_id LONG, start_off INT, end_off INT, weight DOUBLE",
    "edges": "src_id LONG, dst_id LONG, kind STRING, weight DOUBLE, evidence_chunk_id LONG",
}
# The words of the data model.
BLOCK_KINDS = ["heading", "body", "table", "statblock", "caption", "chrome", "code"]
CHUNK_KINDS = ["prose", "definition"]
EDGE_KINDS = ["defines", "mentions", "part_of", "references", "co_occurs", "same_as", "contradicts", "links_to"]
EXTRACTORS = ["poppler", "tesseract", "plain"]
OCR_MODES = ["auto", "never", "always"]


def schema(name: str) -> T.StructType:
    return _struct(DDL[name])


def block_kind(kind: Column) -> Column:
    """Unknown kinds are read as body."""
    return F.when(kind.isin(BLOCK_KINDS), kind).otherwise(F.lit("body"))


def edge_kind(kind: Column) -> Column:
    """Unknown kinds are read as mentions."""
    return F.when(kind.isin(EDGE_KINDS), kind).otherwise(F.lit("mentions"))


def checked(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """df that fails when it is written if the column holds another word."""
    ok = F.col(column).isin(allowed)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.format_string(f"{column}: not allowed: %s", F.col(column))).cast("string")))
