"""Ranked retrieval over the graph, lookups, checks and wiki pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..scratch import Scratch
from . import fulltext, graph

NAME_HITS, MOST_NEIGHBOURS = 20, 20
# The weights of a score.
WEIGHT_BM25, WEIGHT_NAME, WEIGHT_CENTRALITY, HOP_DECAY = 1.0, 2.0, 50.0, 0.5


@dataclass
class ExploreOptions:
    budget_tokens: int = 8000
    hops: int = 2
    kind: str | None = None
    candidate_limit: int = 100


def topic_last(kind: Column) -> Column:
    return (kind == "topic").cast("int")


def name_search(entities: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Entities whose name holds the whole query, ASCII letters compared without case; kinds other than topic first,
    then by centrality and id. An empty query matches every name."""
    hit = tx.ascii_fold(F.col("name")).contains(query.translate(str.maketrans(tx.UPPER, tx.LOWER)))
    found = entities.where(hit).orderBy(topic_last(F.col("kind")), F.desc("centrality"), "id")
    return found.limit(limit) if limit is not None else found


def by_slug(entities: DataFrame, slug: str) -> DataFrame:
    return entities.where(F.col("slug") == slug).orderBy(topic_last(F.col("kind")), F.desc("centrality"), "id").limit(1)


def by_alias(entities: DataFrame, aliases: DataFrame, alias: str) -> DataFrame:
    norm = " ".join(alias.split()).lower()
    ids = aliases.where(F.col("norm") == norm).select(F.col("entity_id").alias("id")).distinct()
    return entities.join(ids, "id").orderBy(F.desc("centrality"), "id").limit(1)


def primary_definitions(definitions: DataFrame) -> DataFrame:
    """One (entity_id, chunk_id, doc_id, page_no) per entity with a primary definition."""
    first = F.min(F.struct("chunk_id", "doc_id", "page_no")).alias("d")
    return definitions.where("is_primary").groupBy("entity_id").agg(first).select("entity_id", "d.chunk_id", "d.doc_id", "d.page_no")


def score(bm25: Column, name_match: Column, centrality: Column, hop: Column) -> Column:
    flat = WEIGHT_BM25 * F.greatest(F.lit(0.0), -bm25) + WEIGHT_CENTRALITY * centrality + F.when(name_match, WEIGHT_NAME).otherwise(0.0)
    return flat * F.pow(F.lit(HOP_DECAY), F.coalesce(hop, F.lit(0)))


def within_budget(scored: DataFrame, budget: int) -> DataFrame:
    """The prefix by score that fits the budget of tokens (bytes / 4, at least 1); the first item always stays."""
    tokens = F.greatest(F.lit(1), F.floor(F.octet_length("text") / 4))
    # Each item has at least one token, so more than ``budget`` items never fit: the window sees a bounded top-k.
    best = scored.withColumn("tokens", tokens).orderBy(F.desc("score"), "chunk_id").limit(max(budget, 1))
    w = Window.orderBy(F.desc("score"), "chunk_id")
    cum = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumn("position", F.row_number().over(w)).withColumn("cum", cum).where((F.col("position") == 1) | (F.col("cum") <= budget)).drop("cum")


def explore(g: dict[str, DataFrame], index: fulltext.Index, query: str, options: ExploreOptions | None = None) -> DataFrame:
    """(position, chunk_id, entity_name, entity_kind, chunk_kind, text, document, page, score, tokens) for a query.

    Seeds are entities whose name holds the query and those that the best chunks define; the graph is walked from them;
    the definition of every entity met is scored, and chunks that matched without defining anything follow."""
    o = options or ExploreOptions()
    # The hits, names and seeds are a few rows that several joins read; each is found once.
    s = Scratch(g["chunks"].sparkSession, "explore")
    fts = s.cut(fulltext.search(index, query, o.candidate_limit))
    names = s.cut(name_search(g["entities"], query, NAME_HITS).select("id", F.lit(True).alias("named")))
    owners = g["entity_defs"].where("is_primary").groupBy("chunk_id").agg(F.min("entity_id").alias("id"))
    seeds = s.cut(names.select("id").union(fts.join(owners, "chunk_id").select("id")).distinct())
    reached = s.cut(graph.expand(seeds, g["edges"], o.hops)) if o.hops > 0 else seeds.limit(0).withColumn("hop", F.lit(0))
    candidates = seeds.withColumn("hop", F.lit(None).cast("int")).unionByName(reached)
    ents = g["entities"].select("id", "name", "kind", "centrality", "slug")
    found = candidates.join(ents, "id").join(primary_definitions(g["entity_defs"]).withColumnRenamed("entity_id", "id"), "id").join(names, "id", "left")
    covered = found.select("chunk_id").distinct()
    if o.kind is not None:
        found = found.where(F.col("kind") == o.kind)
    hits = found.join(fts, "chunk_id", "left").select(
        "chunk_id", "doc_id", F.col("page_no").alias("page"), F.col("name").alias("entity_name"), F.col("kind").alias("entity_kind"),
        score(F.coalesce("bm25", F.lit(0.0)), F.coalesce("named", F.lit(False)), F.coalesce("centrality", F.lit(0.0)), F.col("hop")).alias("score"), "id",
    )
    # Of entities that share a defining chunk the best counts.
    best = hits.groupBy("chunk_id").agg(F.max(F.struct("score", (-F.col("id")).alias("o"), "doc_id", "page", "entity_name", "entity_kind")).alias("b"))
    rows = best.select("chunk_id", "b.doc_id", "b.page", "b.entity_name", "b.entity_kind", "b.score")
    chunks = g["chunks"].select(F.col("id").alias("chunk_id"), F.col("kind").alias("chunk_kind"), "text", "start_page", F.col("doc_id").alias("of_doc"))
    if o.kind is None:
        prose = fts.join(covered, "chunk_id", "left_anti").join(chunks, "chunk_id").select(
            "chunk_id", F.col("of_doc").alias("doc_id"), F.col("start_page").alias("page"), F.lit(None).cast("string").alias("entity_name"), F.lit(None).cast("string").alias("entity_kind"),
            F.greatest(F.lit(0.0), -F.col("bm25")).alias("score"),
        )
        rows = rows.unionByName(prose)
    titled = g["documents"].select("doc_id", F.col("title").alias("document"))
    full = rows.join(chunks.select("chunk_id", "chunk_kind", "text"), "chunk_id").join(titled, "doc_id", "left")
    return within_budget(full, o.budget_tokens).select("position", "chunk_id", "entity_name", "entity_kind", "chunk_kind", "text", "document", "page", "score", "tokens")


def neighbours(edges: DataFrame, entities: DataFrame, entity_ids: DataFrame | None = None, most: int = MOST_NEIGHBOURS) -> DataFrame:
    """(entity_id, id, name, kind, slug, weight, place): the strongest edge to each neighbour, at most ``most``."""
    both = edges.select(F.col("src_id").alias("entity_id"), F.col("dst_id").alias("id"), "weight").union(edges.select("dst_id", "src_id", "weight"))
    if entity_ids is not None:
        both = both.join(entity_ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    once = both.groupBy("entity_id", "id").agg(F.max("weight").alias("weight"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("weight"), "id")
    top = once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return top.join(entities.select("id", "name", "kind", "slug"), "id").select("entity_id", "id", "name", "kind", "slug", "weight", "place")


def entity_views(g: dict[str, DataFrame], entities: DataFrame) -> DataFrame:
    """(id, name, kind, definition, document, page, fields, neighbours) of the given entities."""
    ids = entities.select("id")
    titled = g["documents"].select("doc_id", F.col("title").alias("document"))
    texts = g["chunks"].select(F.col("id").alias("chunk_id"), F.col("text").alias("definition"))
    defs = primary_definitions(g["entity_defs"].join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi"))
    defs = defs.join(texts, "chunk_id").join(titled, "doc_id", "left").select(F.col("entity_id").alias("id"), "definition", "document", F.col("page_no").alias("page"))
    stated = g["entity_fields"].join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").join(titled, "doc_id", "left")
    fields = stated.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("key", "doc_id", "value", F.coalesce("document", F.lit("")).alias("document")))).alias("fields"))
    near = neighbours(g["edges"], g["entities"], ids).groupBy(F.col("entity_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "name", "kind", "weight", "id", "slug"))).alias("neighbours"))
    out = entities.select("id", "name", "kind").join(defs, "id", "left").join(fields, "id", "left").join(near.withColumnRenamed("of", "id"), "id", "left")
    return out


def get_entity(g: dict[str, DataFrame], name_or_slug: str) -> DataFrame:
    """The view of the entity with this slug, else of the first whose name holds the text; no row if there is none."""
    slug = g["entities"].sparkSession.range(1).select(tx.slugify(F.lit(name_or_slug))).first()[0]
    exact = by_slug(g["entities"], slug)
    chosen = exact if slug and exact.limit(1).count() else name_search(g["entities"], name_or_slug, 1)
    return entity_views(g, chosen)


def page_text(documents: DataFrame, pages: DataFrame, title: str, page_no: int) -> DataFrame:
    doc = documents.where(tx.ascii_fold(F.col("title")) == title.translate(str.maketrans(tx.UPPER, tx.LOWER))).orderBy("doc_id").limit(1).select("doc_id", "title")
    return pages.where(F.col("page_no") == page_no).join(F.broadcast(doc), "doc_id").select("title", "page_no", "text")


def contradictions(fields: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """(entity_id, entity, key, n_values, values): keys with more than one value, the latest statement first."""
    many = fields.where("value is not null").groupBy("entity_id", "key").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a <> b").select("entity_id", "key")
    dated = documents.select("doc_id", F.col("title").alias("document"), F.col("ingested_at").alias("at"))
    rows = fields.drop("ingested_at").join(many, ["entity_id", "key"]).join(dated, "doc_id")
    order = (F.struct((-F.unix_micros(F.col("at").cast("timestamp"))).alias("o"), "doc_id", "value", "document"))
    held = rows.groupBy("entity_id", "key").agg(F.array_sort(F.collect_list(order)).alias("v"), F.count_distinct("value").alias("n_values"))
    named = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity"))
    return held.join(named, "entity_id").select("entity_id", "entity", "key", "n_values", F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["document"].alias("document"))).alias("values"))


def orphans(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, name) of entities that no edge touches and no chunk mentions."""
    touched = edges.select(F.col("src_id").alias("id")).union(edges.select("dst_id")).distinct()
    return entities.join(touched, "id", "left_anti").join(mentions.select(F.col("entity_id").alias("id")), "id", "left_anti").select("id", "name")


def unresolved_wikilinks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(target, source_document, chunk_id): links whose slug is no document's; repeated links stay."""
    each = chunks.select("id", "doc_id", F.explode(tx.wikilink_targets(F.col("text"))).alias("target")).withColumn("slug", tx.slugify(F.col("target")))
    known = documents.where("title is not null").select(tx.slugify(F.col("title")).alias("slug")).distinct()
    titled = documents.select("doc_id", F.col("title").alias("source_document"))
    return each.join(known, "slug", "left_anti").join(titled, "doc_id", "left").select("target", "source_document", F.col("id").alias("chunk_id"))


def stats(documents: DataFrame, entities: DataFrame) -> DataFrame:
    d = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))
    e = entities.agg(F.count("*").alias("entities"))
    # Two tables of one row each.
    return d.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one").drop("one")


def wiki_candidates(entities: DataFrame, least: float = 0.0) -> DataFrame:
    """The best entity of each slug (no topic, then centrality), those under ``least`` left out afterwards."""
    rank = F.struct((-topic_last(F.col("kind"))).alias("a"), F.coalesce("centrality", F.lit(0.0)).alias("b"), (-F.col("id")).alias("c"))
    best = entities.groupBy("slug").agg(F.max(F.struct(rank.alias("r"), "id", "kind", "name")).alias("x"))
    rows = best.select("x.id", "x.kind", "x.name", "slug", F.col("x.r.b").alias("centrality"))
    return rows.where(F.col("centrality") >= least)


def wiki_pages(g: dict[str, DataFrame], today: str, least: float = 0.0) -> DataFrame:
    """(slug, kind, name, centrality, page): the text of each candidate's page."""
    chosen = wiki_candidates(g["entities"], least)
    views = entity_views(g, chosen).drop("name", "kind")
    defs = g["entity_defs"].join(chosen.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    titled = g["documents"].select("doc_id", F.col("title").alias("document"))
    places = defs.select("entity_id", "doc_id", "page_no", "is_primary").distinct().join(titled, "doc_id", "left")
    line = F.struct((~F.col("is_primary")).alias("o"), "doc_id", "page_no", F.format_string("- [[%s]] p.%d", tx.slugify(F.coalesce("document", F.lit(""))), "page_no").alias("line"))
    where = places.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("places"), F.count_distinct("doc_id").alias("sources"))
    rows = chosen.join(views, "id").join(where, "id", "left")
    head = F.concat(
        F.lit("---\ntitle: "), F.col("name"), F.lit("\nkind: "), F.col("kind"), F.lit(f"\ncreated: {today}\nlast_updated: {today}\nsource_count: "),
        F.coalesce("sources", F.lit(0)).cast("string"), F.lit("\nstatus: generated\n---\n\n"),
    )
    trimmed = F.regexp_replace("definition", r"(?U)^\s+|\s+$", "")
    quoted = F.array_join(F.transform(F.split(trimmed, "\r?\n"), lambda x: F.concat(F.lit("> "), x)), "\n")
    definition = F.when(
        F.col("definition").isNotNull(), F.concat(F.lit("## Definition\n\n"), quoted, F.lit("\n\n[Source: "), F.coalesce("document", F.lit("")), F.lit(" p."), F.col("page").cast("string"), F.lit("]\n\n"))
    ).otherwise(F.lit("_Nothing defines this so far; other texts only name it._\n\n"))
    keys = F.array_distinct(F.transform("fields", lambda f: f["key"]))

    def rows_of(k: Column) -> Column:
        mine = F.filter("fields", lambda f: f["key"] == k)
        lines = F.transform(mine, lambda f: F.concat(F.lit("| "), f["key"], F.lit(" | "), F.coalesce(f["value"], F.lit("")), F.lit(" | "), f["document"], F.lit(" |\n")))
        clash = F.when(F.size(mine) > 1, F.concat(F.lit("| _⚠ "), F.size(mine).cast("string"), F.lit(" statements differ about **"), k, F.lit("**_ | | |\n"))).otherwise("")
        return F.concat(F.array_join(lines, ""), clash)

    fields = F.when(F.size("fields") > 0, F.concat(F.lit("## Fields\n\n| key | value | source |\n|---|---|---|\n"), F.array_join(F.transform(keys, rows_of), ""), F.lit("\n"))).otherwise("")
    links = F.array_join(F.transform("neighbours", lambda x: F.concat(F.lit("[["), x["slug"], F.lit("]]"))), " · ")
    related = F.when(F.size("neighbours") > 0, F.concat(F.lit("## Related\n\n"), links, F.lit("\n\n"))).otherwise("")
    seen = F.array_join(F.transform("places", lambda p: F.concat(p["line"], F.lit("\n"))), "")
    appears = F.when(F.size("places") > 1, F.concat(F.lit("## Appears in\n\n"), seen, F.lit("\n"))).otherwise("")
    return rows.select("slug", "kind", "name", "centrality", F.concat(head, definition, fields, related, appears).alias("page"))


def wiki_index(pages: DataFrame, today: str) -> DataFrame:
    """(kind, section): one section of the index for each kind, entries by name."""
    line = F.struct("name", "slug", F.concat(F.lit("- [["), F.col("slug"), F.lit("]] — "), F.col("name"), F.lit("\n")).alias("line"))
    held = pages.groupBy("kind").agg(F.array_sort(F.collect_list(line)).alias("e"))
    title = F.concat(F.upper(F.substring("kind", 1, 1)), F.expr("substring(kind, 2)"))
    return held.select("kind", F.concat(F.lit("## "), title, F.lit("\n\n"), F.array_join(F.transform("e", lambda x: x["line"]), ""), F.lit("\n")).alias("section"))


def explore_markdown(items: list, query: str) -> str:
    out = [f"# Found for: {query}\n\n"]
    if not items:
        out.append("_Nothing matches._\n")
    for r in items:
        if r["entity_name"] is not None:
            out.append(f"## {r['entity_name']} ({r['entity_kind'] or ''})\n\n")
        out.append(f"{r['text'].strip()}\n\n[Source: {r['document']} p.{r['page']}]\n\n")
    return "".join(out)


def entity_markdown(view) -> str:
    out = [f"# {view['name']} ({view['kind']})\n\n"]
    if view["definition"] is None:
        out.append("_Nothing defines this so far._\n\n")
    else:
        out.append(f"{view['definition'].strip()}\n\n[Source: {view['document']} p.{view['page']}]\n\n")
    if view["fields"]:
        out.append("## Fields\n\n| key | value | source |\n|---|---|---|\n")
        out += [f"| {f['key']} | {f['value']} | {f['document']} |\n" for f in view["fields"]]
        out.append("\n")
    if view["neighbours"]:
        out.append("## Related\n\n" + " · ".join(f"[[{n['slug']}]]" for n in view["neighbours"]) + "\n")
    return "".join(out)


def lint_markdown(clashes: list, lonely: list, broken: list) -> str:
    out = ["# Checks of the store\n\n", f"## Values that differ ({len(clashes)})\n\n"]
    for c in clashes:
        out.append(f"- **{c['entity']}** states `{c['key']}` in several ways:\n")
        out += [f"  - {v['value']} ({v['document']})\n" for v in c["values"]]
    out.append("\n" if clashes else "None.\n\n")
    out.append(f"## Entities without links or mentions ({len(lonely)})\n\n")
    out += [f"- {r['name']}\n" for r in lonely]
    out.append("\n" if lonely else "None.\n\n")
    out.append(f"## Links that lead nowhere ({len(broken)})\n\n")
    out += [f"- [[{r['target']}]] is linked from {r['source_document']}\n" for r in broken] or ["None.\n"]
    return "".join(out)
