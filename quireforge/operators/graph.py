"""Entities, definitions, mentions, edges and their centrality."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scratch import Scratch, spread
from .segments import chunk_id

LEAST_NAME = 3
AUTOMATON_NAMES = 500_000
"""So many names go to the workers as one automaton; more are dealt to several, whose matches are settled together."""
_MENTION = "chunk_id long, entity_id long, start_off int, end_off int"
DAMPING, ROUNDS = 0.85, 20
LINK_WEIGHT = 2.0
_FOLD = str.maketrans(tx.UPPER, tx.LOWER)
_WORD = set(tx.LOWER + tx.UPPER + "0123456789_")


def entity_id(kind: Column, slug: Column) -> Column:
    """A positive id from kind and slug, so that no global sort is needed to number entities."""
    return F.xxhash64(kind, slug).bitwiseAND(F.lit((1 << 62) - 1))


def section_entities(sections: DataFrame) -> DataFrame:
    """Recognised sections that name an entity, with entity_id and seq, their order of processing."""
    name = tx.display_name(F.col("title"))
    rows = sections.where("kind is not null").withColumn("name", name).withColumn("entity_slug", tx.slugify(name))
    rows = rows.where((F.length("name") >= LEAST_NAME) & (F.col("entity_slug") != ""))
    return rows.select(
        "*", entity_id(F.col("kind"), F.col("entity_slug")).alias("entity_id"), F.struct(F.coalesce("doc_title", F.lit("")).alias("t"), F.col("doc_id").alias("d"), F.col("idx").alias("i")).alias("seq")
    )


def entities_of(named: DataFrame) -> DataFrame:
    """The entities table without centrality: of a kind and slug the last name; canonical_id stays null."""
    return named.groupBy("kind", F.col("entity_slug").alias("slug")).agg(F.max_by("name", "seq").alias("name"), F.min("seq").alias("first_seq")).select(
        entity_id(F.col("kind"), F.col("slug")).alias("id"), "kind", "name", "slug", F.lit(None).cast("long").alias("canonical_id"), F.lit(1.0).cast("float").alias("confidence"), "first_seq"
    )


def definitions_of(named: DataFrame) -> DataFrame:
    """The first chunk of each section that names an entity; primary is the first of all documents."""
    first = named.groupBy("entity_id").agg(F.min("seq").alias("first_seq"))
    chunk = chunk_id(F.col("section_id"), F.lit(0))
    return named.join(first, "entity_id").select(
        "entity_id", chunk.alias("chunk_id"), "doc_id", F.col("start_page").alias("page_no"), (F.col("seq") == F.col("first_seq")).alias("is_primary")
    )


def fields_of(named: DataFrame) -> DataFrame:
    """Field values of an entity in a document, the last one of a key."""
    each = named.select("entity_id", "doc_id", "seq", F.explode("fields").alias("f"))
    return each.groupBy("entity_id", "doc_id", F.col("f.key").alias("key")).agg(F.max_by("f.value", "seq").alias("value"))


def longest_matches(text: str, automaton) -> list[tuple[int, int, int, bool]]:
    """(start, end, value, free) of the longest match at each place, in order; free ones stand between ASCII word borders."""
    low = text.translate(_FOLD)
    best: dict[int, tuple[int, int]] = {}
    for last, (size, value) in automaton.iter(low):
        start = last - size + 1
        if start not in best or size > best[start][0]:
            best[start] = (size, value)
    free = lambda s, e: (s == 0 or text[s - 1] not in _WORD) and (e == len(text) or text[e] not in _WORD)
    return [(s, s + size, value, free(s, s + size)) for s, (size, value) in sorted(best.items())]


def scan_texts(texts: list[str], automaton) -> list[list[tuple[int, int, int]]]:
    """(start, end, value) of leftmost-longest matches that do not overlap and stand between ASCII word borders.

    A match that fails at the borders still hides what overlaps it."""
    out = []
    for text in texts:
        at, kept = 0, []
        for start, end, value, free in longest_matches(text, automaton) if text else []:
            if start < at:
                continue
            at = end
            if free:
                kept.append((start, end, value))
        out.append(kept)
    return out


def build_automaton(names: list[tuple[str, int]]):
    """Of names that fold alike the first in the list counts."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for name, value in names:
        low = name.translate(_FOLD)
        if len(name) >= LEAST_NAME and not a.exists(low):
            a.add_word(low, (len(low), value))
    if len(a):
        a.make_automaton()
    return a


def find_mentions(chunks: DataFrame, entities: DataFrame, limit: int = AUTOMATON_NAMES) -> DataFrame:
    """(chunk_id, entity_id, start_off, end_off) in UTF-8 bytes. entities: id, name, and first_seq for ties.

    Up to ``limit`` names every worker holds one automaton; above that ``join_mentions`` finds the same rows."""
    order = ["first_seq", "id"] if "first_seq" in entities.columns else ["id"]
    usable = entities.where(F.length("name") >= LEAST_NAME)
    names = [(r["name"], r["id"]) for r in usable.orderBy(*order).select("name", "id").limit(limit + 1).collect()]
    if len(names) > limit:
        return join_mentions(chunks, usable, limit)
    if not names:
        return chunks.sparkSession.createDataFrame([], _MENTION)
    shared = chunks.sparkSession.sparkContext.broadcast(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton(shared.value)
        for frame in frames:
            rows = []
            for cid, text, spans in zip(frame["id"], frame["text"], scan_texts(frame["text"].tolist(), automaton), strict=True):
                for s, e, value in spans:
                    a = len(text[:s].encode())
                    rows.append((cid, value, a, a + len(text[s:e].encode())))
            yield pd.DataFrame(rows, columns=["chunk_id", "entity_id", "start_off", "end_off"])

    return spread(chunks.select("id", "text").where("text is not null")).mapInPandas(run, _MENTION)


_MATCH = "row long, chunk_id long, s int, e int, entity_id long, free boolean, start_off int, end_off int"


def _group_matches(names):
    """All matches of one group of names, the longest at each place, with byte offsets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton(names.value)
        for frame in frames:
            rows = []
            for row, cid, text in zip(frame["row"], frame["id"], frame["text"], strict=True):
                at = off = 0
                for s, e, value, free in longest_matches(text, automaton):
                    off, at = off + len(text[at:s].encode()), s
                    rows.append((row, cid, s, e, value, free, off, off + len(text[s:e].encode())))
            yield pd.DataFrame(rows, columns=["row", "chunk_id", "s", "e", "entity_id", "free", "start_off", "end_off"])

    return run


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the sorted matches of each row those that do not overlap, from left to right; free ones are mentions."""
    row, at = None, 0
    for frame in frames:
        kept = []
        for i, (r, s, e, free) in enumerate(zip(frame["row"], frame["s"], frame["e"], frame["free"], strict=True)):
            if r != row:
                row, at = r, 0
            if s >= at:
                at = e
                if free:
                    kept.append(i)
        yield frame.iloc[kept][["chunk_id", "entity_id", "start_off", "end_off"]]


def join_mentions(chunks: DataFrame, entities: DataFrame, size: int = AUTOMATON_NAMES) -> DataFrame:
    """What find_mentions finds, for any number of names: they are dealt to groups of about ``size``, each an automaton
    that gives all its matches, also those inside words; the matches of a text are brought together and settled as one
    automaton would. Each group reads all texts; the driver holds the names of one group at a time."""
    spark = chunks.sparkSession
    s = Scratch(spark, "mentions")
    order = F.struct("first_seq", "id") if "first_seq" in entities.columns else F.struct("id")
    low = tx.ascii_fold(F.col("name"))
    names = s.cut(entities.where(F.length("name") >= LEAST_NAME).groupBy(low.alias("name")).agg(F.min_by("id", order).alias("id")))
    groups = -(-names.count() // size)
    if not groups:
        return spark.createDataFrame([], _MENTION)
    # Rows are numbered once, in a table: a chunk id that occurs twice is two texts.
    texts = spread(s.cut(chunks.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "id", "text")))
    matches = None
    for g in range(groups):
        mine = names.where(F.pmod(F.xxhash64("name"), F.lit(groups)) == g).select("name", "id").collect()
        if not mine:
            continue
        found = texts.mapInPandas(_group_matches(spark.sparkContext.broadcast([tuple(r) for r in mine])), _MATCH)
        matches = found if matches is None else matches.unionByName(found)
    return matches.repartition("row").sortWithinPartitions("row", "s", F.desc("e")).mapInPandas(_settle, _MENTION)


def cooccurrences(distinct_mentions: DataFrame, group: str = "chunk_id", item: str = "entity_id") -> DataFrame:
    """(src_id, dst_id, group): unordered pairs of the different items of a group, each once. Groups are chunks, whose
    length bounds their items."""
    sets = distinct_mentions.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("s"))
    each = sets.where("size(s) > 1").select(group, "s", F.posexplode("s").alias("i", "src_id"))
    return each.select(group, "src_id", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("dst_id"))


def accumulate(edges: DataFrame) -> DataFrame:
    """Edges by (src, dst, kind): weights add up, the evidence of the first insert stays. edges: with order and
    evidence_chunk_id, which may be null."""
    return edges.groupBy("src_id", "dst_id", "kind").agg(
        F.sum("weight").alias("weight"), F.min(F.struct("order", F.struct("evidence_chunk_id").alias("e")))["e"]["evidence_chunk_id"].alias("evidence_chunk_id")
    )


def derive_edges(mentions: DataFrame, definitions: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """co_occurs between the mentions of a chunk, mentions from what a chunk defines to what else it names, and links."""
    once = mentions.select("chunk_id", "entity_id").distinct()
    pairs = cooccurrences(once).select("src_id", "dst_id", F.lit("co_occurs").alias("kind"), F.lit(1.0).alias("weight"), F.col("chunk_id").alias("evidence_chunk_id"))
    owner = definitions.where("is_primary").groupBy("chunk_id").agg(F.min("entity_id").alias("src_id"))
    named = once.join(owner, "chunk_id").where("src_id <> entity_id").select("src_id", F.col("entity_id").alias("dst_id"), F.lit("mentions").alias("kind"), F.lit(1.0).alias("weight"), F.col("chunk_id").alias("evidence_chunk_id"))
    rows = pairs.unionByName(named).withColumn("order", F.struct(F.lit(0).alias("p"), F.col("evidence_chunk_id").alias("c")))
    if links is not None:
        rows = rows.unionByName(links)
    return accumulate(rows)


def document_entities(named: DataFrame) -> DataFrame:
    """(doc_id, entity_id): what the first section of a document names."""
    return named.where("idx = 0").select("doc_id", "entity_id")


def link_edges(chunks: DataFrame, documents: DataFrame, primary: DataFrame) -> DataFrame:
    """links_to edges from the entity of a document to the entity of the document that a [[target]] names by slug. Of
    documents with one slug the last by title counts; links to itself are left out."""
    titled = documents.select("doc_id", F.coalesce("title", F.lit("")).alias("title")).withColumn("slug", tx.slugify(F.col("title")))
    by_slug = titled.where("slug <> ''").groupBy("slug").agg(F.max_by("doc_id", F.struct("title", "doc_id")).alias("to_doc"))
    found = chunks.select("id", "doc_id", F.explode(tx.wikilink_targets(F.col("text"))).alias("target"))
    counted = found.groupBy("doc_id", tx.slugify(F.col("target")).alias("slug")).agg(F.count("*").alias("n"), F.min("id").alias("evidence_chunk_id"))
    dst = primary.select(F.col("doc_id").alias("to_doc"), F.col("entity_id").alias("dst_id"))
    src = primary.select("doc_id", F.col("entity_id").alias("src_id"))
    met = counted.join(by_slug, "slug").join(src, "doc_id").join(dst, "to_doc").where("src_id <> dst_id")
    return met.select("src_id", "dst_id", F.lit("links_to").alias("kind"), (F.col("n") * LINK_WEIGHT).alias("weight"), "evidence_chunk_id", F.struct(F.lit(1).alias("p"), F.col("evidence_chunk_id").alias("c")).alias("order"))


def document_tags(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, tag, n, evidence_chunk_id) of inline and frontmatter tags; the latter come first and have no evidence."""
    inline = chunks.select("doc_id", F.col("id").alias("chunk"), F.explode(tx.tags(F.col("text"))).alias("tag"))
    front = documents.select("doc_id", F.lit(None).cast("long").alias("chunk"), F.explode(tx.frontmatter_list(F.col("frontmatter"), "tags")).alias("tag"))
    both = inline.unionByName(front).where("tag is not null and tag <> ''")
    return both.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.when(F.count_if(F.col("chunk").isNull()) == 0, F.min("chunk")).alias("evidence_chunk_id"))


def tag_entities(tags: DataFrame) -> DataFrame:
    name = F.concat(F.lit("#"), F.col("tag"))
    rows = tags.select(F.lit("tag").alias("kind"), tx.slugify(F.col("tag")).alias("slug"), name.alias("name")).where("slug <> ''")
    one = rows.groupBy("kind", "slug").agg(F.max("name").alias("name"))
    return one.select(entity_id(F.col("kind"), F.col("slug")).alias("id"), "kind", "name", "slug", F.lit(None).cast("long").alias("canonical_id"), F.lit(1.0).cast("float").alias("confidence"))


def tag_edges(tags: DataFrame, primary: DataFrame) -> DataFrame:
    slug = tx.slugify(F.col("tag"))
    return tags.join(primary, "doc_id").where(slug != "").select(
        F.col("entity_id").alias("src_id"), entity_id(F.lit("tag"), slug).alias("dst_id"), F.lit("mentions").alias("kind"), F.col("n").cast("double").alias("weight"), "evidence_chunk_id",
        F.struct(F.when(F.col("evidence_chunk_id").isNull(), 1).otherwise(2).alias("p"), F.col("evidence_chunk_id").alias("c")).alias("order"),
    )


def aliases_of(documents: DataFrame, primary: DataFrame) -> DataFrame:
    """entity_aliases from frontmatter, one row per entity and norm, the first by document."""
    each = documents.select("doc_id", "title", F.posexplode(tx.frontmatter_list(F.col("frontmatter"), "aliases")).alias("at", "alias")).join(primary, "doc_id")
    rows = each.withColumn("norm", tx.normalize_alias(F.col("alias"))).where("norm <> ''")
    return rows.groupBy("entity_id", "norm").agg(F.min_by("alias", F.struct("title", "doc_id", "at")).alias("alias")).select("entity_id", "alias", "norm")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(id, rank): undirected, weighted, all kinds added up; self-loops and weights of 0 or less are left out. Nodes
    without edges keep (1 - d) / n; nothing is redistributed."""
    s = Scratch(nodes.sparkSession, "pagerank")
    ids = s.cut(nodes.select("id").distinct())
    n = ids.count()
    if n == 0:
        return ids.withColumn("rank", F.lit(0.0))
    good = edges.where("src_id <> dst_id and weight > 0")
    both = good.select("src_id", "dst_id", "weight").union(good.select("dst_id", "src_id", "weight")).groupBy("src_id", "dst_id").agg(F.sum("weight").alias("w"))
    known = both.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    strength = known.groupBy("src_id").agg(F.sum("w").alias("strength"))
    flow = s.cut(known.join(strength, "src_id").select("src_id", "dst_id", (F.col("w") / F.col("strength")).alias("share")))
    base = (1.0 - damping) / n
    # Only nodes with edges move; the others are constant and are put back at the end.
    linked = flow.select(F.col("src_id").alias("id")).distinct()
    ranks = s.cut(linked.withColumn("rank", F.lit(1.0 / n)))
    for i in range(rounds):
        came = flow.join(ranks.withColumnRenamed("id", "src_id"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("in"))
        fresh = came.select("id", (F.lit(base) + damping * F.col("in")).alias("rank"))
        if i % 5 == 4:
            fresh = s.cut(fresh)
        ranks = fresh
    return ids.join(ranks, "id", "left").select("id", F.coalesce("rank", F.lit(base if rounds else 1.0 / n)).alias("rank"))


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(id, hop): what undirected edges reach from the seeds (id) in at most ``hops`` steps, at the least distance; the
    seeds themselves are left out."""
    both = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).union(edges.select("dst_id", "src_id")).where("a <> b").distinct()
    start = seeds.select("id").distinct()
    seen, frontier = start.withColumn("hop", F.lit(0)), start
    for hop in range(1, hops + 1):
        reached = frontier.join(both, frontier["id"] == both["a"]).select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = reached
        seen = seen.unionByName(reached.withColumn("hop", F.lit(hop)))
    return seen.where("hop > 0")
