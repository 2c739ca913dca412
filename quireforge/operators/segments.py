"""Blocks to sections, recognised kinds, fields and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Pack
from ..functions import text as tx

CHUNK_BYTES = 4800
SECTIONS_PER_DOC, CHUNKS_PER_SECTION = 1 << 20, 1 << 10


def _java(regex: str) -> str:
    return "(?U)" + regex


def _quote(label: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " _" else c for c in label)


def indexable_blocks(documents: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of pages that are not of low confidence, with doc_id, title and page_no; repeated ids once."""
    p = pages.where("not coalesce(low_confidence, false)").select(F.col("id").alias("page_id"), "doc_id", "page_no").dropDuplicates(["page_id"])
    d = documents.select("doc_id", F.col("title").alias("doc_title"))
    b = blocks.select("id", "page_id", "ord", "kind", "text", "heading_level").dropDuplicates(["id"])
    return b.join(p, "page_id").join(d, "doc_id")


def field_continuation(text: Column, labels: list[str]) -> Column:
    """A heading that is a field line: a colon at byte 1 to 30 after letters without a full stop, or a known label."""
    head = F.substring_index(text, ":", 1)
    size = F.octet_length(head)
    colon = text.contains(":") & size.between(1, 30) & head.rlike(r"\p{L}") & ~head.contains(".")
    if labels:
        colon = colon | text.rlike(r"(?U)^(?:" + "|".join(map(_quote, sorted(labels, key=len, reverse=True))) + r")(?:$|\s)")
    return F.coalesce(colon, F.lit(False))


def build_sections(blocks: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(doc_id, doc_title, idx, parent_idx, level, title, slug, start_page, end_page, bodies) of each document.

    A heading opens a section unless one is open and it continues a field. Text before the first heading, chrome and
    null texts are dropped; documents without headings have no sections. The parent is the nearest earlier section of a
    smaller level; a missing level is 1. blocks: doc_id, doc_title, page_no, ord, kind, text, heading_level."""
    doc = Window.partitionBy("doc_id").orderBy("page_no", "ord", "id")
    rows = blocks.where("coalesce(kind, 'body') <> 'chrome' and text is not null")
    head = F.col("kind") == "heading"
    before = F.max(head.cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("starts", F.coalesce(head, F.lit(False)) & ~((F.coalesce(before, F.lit(0)) == 1) & field_continuation(F.col("text"), labels or [])))
    rows = rows.withColumn("idx", F.sum(F.col("starts").cast("int")).over(doc) - 1).where("idx >= 0")
    level = F.when(F.col("starts"), F.least(F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)), F.lit(6)))
    parts = F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("page_no", "ord", "id", "text"))))
    out = rows.groupBy("doc_id", "doc_title", "idx").agg(
        F.max(level).alias("level"), F.max(F.when(F.col("starts"), F.col("text"))).alias("title"),
        F.max(F.when(F.col("starts"), F.col("page_no"))).alias("start_page"), F.max("page_no").alias("end_page"), parts.alias("parts"),
    )
    seq = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("idx")), True).over(seq).alias(f"l{k}") for k in range(1, 6)]
    seen = out.select("*", *last)
    below = [F.when(F.col("level") > k, F.col(f"l{k}")) for k in range(1, 6)]
    bodies = F.transform("parts", lambda p: F.struct(p["page_no"].alias("page_no"), p["text"].alias("text")))
    return seen.select(
        "doc_id", "doc_title", F.col("idx").cast("int").alias("idx"), F.greatest(*below).cast("int").alias("parent_idx"), "level", "title", tx.slugify(F.col("title")).alias("slug"),
        "start_page", "end_page", bodies.alias("bodies"),
    )


def body_text(bodies: Column) -> Column:
    return F.array_join(F.transform(bodies, lambda b: b["text"]), "\n\n")


def recognize(body: Column, pack: Pack) -> Column:
    """Number of the first rule whose patterns all match within their byte windows; null if none does."""
    picks = []
    for i, rule in enumerate(pack.rules):
        ok = F.lit(True)
        for r in rule.require:
            ok = ok & tx.byte_prefix(body, r.within_chars).rlike(_java(r.regex))
        picks.append(F.when(ok, F.lit(i)))
    return F.coalesce(*picks) if picks else F.lit(None).cast("int")


def extract_fields(body: Column, labels: list[str]) -> Column:
    """Map of label to value: what stands after a label up to a blank line, another label or the end; empties out."""
    pairs = []
    for label in labels:
        others = [x for x in labels if x != label]
        stop = r"\n\s*\n|\z" + ("|(?<![A-Za-z0-9])(?:" + "|".join(map(_quote, sorted(others, key=len, reverse=True))) + ")" if others else "")
        pattern = rf"(?s)(?<![A-Za-z0-9]){_quote(label)}\s*:*\s*(.*?)\s*(?:{stop})"
        pairs.append(F.struct(F.lit(label).alias("key"), F.regexp_extract(body, pattern, 1).alias("value")))
    if not pairs:
        return F.array().cast("array<struct<key:string,value:string>>")
    return F.filter(F.array(*pairs), lambda p: F.length(p["value"]) > 0)


def pack_chunks(title: Column, bodies: Column, atomic: Column, most: int = CHUNK_BYTES) -> Column:
    """Texts of a section's chunks. One if atomic or within ``most`` bytes with its title; else bodies are packed in
    order, a chunk ending where the next body with its blank line would exceed ``most``, each led by the title."""
    whole = F.concat(title, F.lit("\n\n"), F.array_join(bodies, "\n\n"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, b: Column) -> Column:
        cur = acc["cur"]
        flush = (F.length(cur) > 0) & (F.octet_length(cur) + F.octet_length(b) + 2 > most)
        joined = F.when(F.length(cur) > 0, F.concat(cur, F.lit("\n\n"), b)).otherwise(b)
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"), F.when(flush, b).otherwise(joined).alias("cur")
        )

    folded = F.aggregate(bodies, start, step)
    pieces = F.when(F.length(folded["cur"]) > 0, F.concat(folded["done"], F.array(folded["cur"]))).otherwise(folded["done"])
    led = F.transform(pieces, lambda p: F.concat(title, F.lit("\n\n"), p))
    split = F.when(F.size(pieces) > 0, led).otherwise(F.array(title))
    return F.when(atomic | (F.octet_length(whole) <= most), F.array(whole)).otherwise(split)


def section_id(doc_id: Column, idx: Column) -> Column:
    """A positive id: by place for the first ``SECTIONS_PER_DOC`` sections of documents below 2^32; else, from 2^62 on, a
    hash of both, so that a document can have any id and any number of sections."""
    placed = (idx < SECTIONS_PER_DOC) & doc_id.between(0, (1 << 32) - 1)
    hashed = F.xxhash64(doc_id.cast("long"), idx.cast("long"), F.lit("section")).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.when(placed, doc_id * SECTIONS_PER_DOC + idx).when(idx.isNotNull() & doc_id.isNotNull(), hashed)


def chunk_id(section_id: Column, ord_: Column) -> Column:
    """A positive id of a section's chunk: by place below ``CHUNKS_PER_SECTION`` and 2^62; else, above 2^62, a hash of
    both, so that a section can have any number of chunks and those beyond come after all others."""
    placed = section_id.between(0, (1 << 52) - 1) & (ord_ < CHUNKS_PER_SECTION)
    hashed = F.xxhash64(section_id.cast("long"), ord_.cast("long")).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.when(placed, section_id * CHUNKS_PER_SECTION + ord_).when(section_id.isNotNull(), hashed)


def recognized_sections(sections: DataFrame, pack: Pack) -> DataFrame:
    """sections with section_id, kind, atomic, fields of the rule that fits."""
    body = body_text(F.col("bodies"))
    rows = sections.withColumn("body", body).withColumn("rule", recognize(F.col("body"), pack))
    pick = lambda f, kind: F.coalesce(*[F.when(F.col("rule") == i, f(r)) for i, r in enumerate(pack.rules)], F.lit(None).cast(kind))
    fields = pick(lambda r: extract_fields(F.col("body"), r.fields), "array<struct<key:string,value:string>>")
    return rows.select(
        "*", section_id(F.col("doc_id"), F.col("idx")).alias("section_id"), pick(lambda r: F.lit(r.kind), "string").alias("kind"),
        F.coalesce(pick(lambda r: F.lit(r.atomic), "boolean"), F.lit(False)).alias("atomic"), fields.alias("fields"),
    )


def build_chunks(sections: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """The chunks table of recognised sections: ord counts from 0 in each section, doc_ord orders within a document."""
    texts = pack_chunks(F.col("title"), F.transform("bodies", lambda b: b["text"]), F.col("atomic"), most)
    idx = F.col("idx") if "idx" in sections.columns else F.pmod("section_id", F.lit(SECTIONS_PER_DOC))
    each = sections.select("doc_id", "section_id", idx.alias("idx"), "start_page", "end_page", "atomic", F.posexplode(texts).alias("ord", "text"))
    # doc_ord counts in a document only, so it has room for 2^31 sections and 2^31 chunks of each.
    doc_ord = F.col("idx").cast("long") * F.lit(1 << 31) + F.col("ord")
    return each.select(
        chunk_id(F.col("section_id"), F.col("ord")).alias("id"), "doc_id", "section_id", "start_page", "end_page", "ord", doc_ord.alias("doc_ord"),
        F.when(F.col("atomic"), "definition").otherwise("prose").alias("kind"), "text", tx.token_estimate(F.col("text")).alias("token_est"),
    )
