"""The whole index: sections, chunks, entities, fields, mentions, edges and centrality from documents and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import GENERIC, Pack
from ..operators import graph, segments
from ..scratch import Scratch

DERIVED = ["sections", "chunks", "entities", "entity_aliases", "entity_defs", "entity_fields", "mentions", "edges"]


def build_index(documents: DataFrame, pages: DataFrame, blocks: DataFrame, pack: Pack = GENERIC, keep: bool = True) -> dict[str, DataFrame]:
    """All tables of the graph. With ``keep`` each derived table is written once to the shared folder and read from
    there by what follows. Exactly repeated rows count once."""
    s = Scratch(documents.sparkSession, "index")
    cut = s.cut if keep else (lambda df: df)
    docs = documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    built = segments.build_sections(segments.indexable_blocks(docs, pages, blocks), pack.field_labels())
    sections = cut(segments.recognized_sections(built, pack))
    chunks = cut(segments.build_chunks(sections))
    named = cut(graph.section_entities(sections))
    entities = graph.entities_of(named)
    definitions = cut(graph.definitions_of(named))
    mentions = cut(graph.find_mentions(chunks, entities).withColumn("weight", F.lit(1.0)))
    primary = graph.document_entities(named)
    tags = cut(graph.document_tags(chunks, docs))
    links = graph.link_edges(chunks, docs, primary).unionByName(graph.tag_edges(tags, primary))
    edges = cut(graph.derive_edges(mentions, definitions, links))
    everything = cut(entities.drop("first_seq").unionByName(graph.tag_entities(tags).join(entities.select("id"), "id", "left_anti")))
    ranks = graph.pagerank(everything, edges)
    ranked = everything.join(ranks, "id", "left").withColumn("centrality", F.coalesce("rank", F.lit(0.0)))
    tree = sections.select(
        F.col("section_id").alias("id"), "doc_id", segments.section_id(F.col("doc_id"), F.col("parent_idx")).alias("parent_id"), "level", "title", "slug", "start_page", "end_page"
    )
    return {
        "documents": docs, "pages": pages, "blocks": blocks, "sections": tree, "chunks": chunks,
        "entities": cut(ranked.select("id", "kind", "name", "slug", "canonical_id", "centrality", "confidence")),
        "entity_aliases": graph.aliases_of(docs, primary), "entity_defs": definitions, "entity_fields": graph.fields_of(named), "mentions": mentions, "edges": edges,
    }


def index_report(g: dict[str, DataFrame]) -> DataFrame:
    """One row a derived table with its number of rows."""
    counts = [g[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in DERIVED]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def save(g: dict[str, DataFrame], root: str, run: str) -> str:
    """Write every table below root/run; a pointer file is moved to the run last, so readers see whole runs only."""
    for name, df in g.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{run}/{name}")
    spark = next(iter(g.values())).sparkSession
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    target = fs_path(f"{root}/CURRENT")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged = fs_path(f"{root}/CURRENT.{run}")
    out = fs.create(staged, True)
    out.write(bytearray(run.encode()))
    out.close()
    # One step that replaces the pointer: there is always an old or a new one.
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, target, options)
    return f"{root}/{run}"


def current_run(spark: SparkSession, root: str) -> str | None:
    found = spark.read.text(f"{root}/CURRENT").first() if _exists(spark, f"{root}/CURRENT") else None
    return found[0].strip() if found else None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    run = current_run(spark, root)
    if run is None:
        raise FileNotFoundError(root)
    return {n: spark.read.parquet(f"{root}/{run}/{n}") for n in schema.DDL if _exists(spark, f"{root}/{run}/{n}")}


def register_views(g: dict[str, DataFrame]) -> None:
    """The tables as temporary views, for SQL of one's own."""
    for name, df in g.items():
        df.createOrReplaceTempView(name)
