"""One object for all commands: init, ingest, index, explore, get, page, compile, lint, stats."""

from __future__ import annotations

import json
import os
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import config, schema
from .functions import text as tx
from .operators import fulltext, layout, retrieve
from .plans import pipeline
from .scratch import Scratch
from .sources import cache, files, pdf, plain, rows, sql

INGESTED = ["documents", "pages", "blocks"]


class Engine:
    """A folder with settings, tables below ``store`` and wiki pages below ``wiki``; tables are Parquet and may be large."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root, os.path.join(root, ".quireforge", "store")
        self._graph: dict[str, DataFrame] | None = None
        self._index: fulltext.Index | None = None

    @classmethod
    def init(cls, spark: SparkSession, root: str, pack: str = "generic") -> Engine:
        """Make the folders and settings; again on an old folder only the pack changes."""
        try:
            settings = config.load_settings(root)
            settings.pack = pack
        except config.NotInitialized:
            settings = config.Settings(pack=pack)
        config.save_settings(root, settings)
        for d in ("raw", "wiki", "packs"):
            os.makedirs(os.path.join(root, d), exist_ok=True)
        return cls(spark, root)

    # tables

    def _tables(self, names: list[str]) -> dict[str, DataFrame]:
        found = pipeline.load(self.spark, self.store) if pipeline.current_run(self.spark, self.store) else {}
        return {n: found[n] if n in found else self.spark.createDataFrame([], schema.schema(n)) for n in names}

    def _save(self, tables: dict[str, DataFrame]) -> None:
        current = pipeline.current_run(self.spark, self.store)
        run = f"run-{int(current.rsplit('-', 1)[-1]) + 1 if current else 1:06d}"
        pipeline.save(tables, self.store, run)
        self._graph = self._index = None

    def graph(self) -> dict[str, DataFrame]:
        if self._graph is None:
            self._graph = self._tables(list(schema.DDL))
        return self._graph

    def full_text(self) -> fulltext.Index:
        if self._index is None:
            self._index = fulltext.build_index(self.graph()["chunks"])
        return self._index

    # commands

    def ingest(self, folder: str | None = None, force: bool = False, ocr: str | None = None, fetch=None, native=None) -> dict[str, int]:
        """Read new and changed files and the sources of sources.toml. Unchanged content is skipped; a file or address
        that can't be read is counted as failed and tried again the next time. fetch reads an address, native the words
        of PDF files, where these are not those of ``sources``. What is read is written once, words of PDF files also
        to a cache by content."""
        s = Scratch(self.spark, "ingest")
        settings = config.load_settings(self.root)
        mode = ocr or settings.ocr
        old = self._tables(INGESTED)
        found = files.content_sha(files.route(files.discover(self.spark, folder or os.path.join(self.root, "raw"))))
        read = s.cut(files.structured_documents(found, fetch))
        failed = read.where("error is not null").select("path", "error")
        shaped = files.with_fingerprint(read.where("error is null"))
        shaped = shaped.select("path", "title", "sha256", F.when(F.col("reader") == "urls", "url").when(F.col("reader") == "markdown", "md").otherwise("adoc").alias("kind"), "frontmatter", "blocks", F.lit(None).cast("long").alias("bytes"))
        for doc in self._sources():
            shaped = shaped.unionByName(doc)
        fresh = s.cut(files.new_documents(shaped, old["documents"], force))
        text = found.where("reader = 'plain'").select("path", "sha256", F.col("extension").alias("kind"), "length", plain.plain_text(F.col("content").cast("string"), F.col("path")).alias("text"))
        text = files.new_documents(text, old["documents"], force)
        scans = files.new_documents(found.where("reader = 'pdf'"), old["documents"], force)
        words = self._plain_words(text)
        if (native or pdf.available()["pdftotext"]) and scans.limit(1).count():
            extracted = cache.extract_cached(scans, lambda new: (native or pdf.native_words)(new.select(F.col("sha256").alias("path"), "content")).withColumnRenamed("path", "sha256"), os.path.join(self.store, "words"), s)
            held = s.cut(scans.select("path", "sha256").join(extracted, "sha256").drop("sha256"))
            failed = failed.unionByName(held.where("error is not null").select("path", "error").distinct())
            scans = scans.join(failed.select("path"), "path", "left_anti")
            held = held.where("error is null").drop("error")
            if mode != "never" and pdf.available()["tesseract"]:
                pages = pdf.thin_pages(held, settings.thin_text_chars) if mode == "auto" else held.select("path", "page_no").distinct()
                held = pdf.merge_backends(held, pdf.scanned_words(scans, pages), mode, settings.thin_text_chars)
            words = words.unionByName(held.select(words.columns))
        else:
            scans = scans.limit(0)
        words = s.cut(words)
        stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
        paged = text.select("path", "sha256", "kind", F.col("length").alias("bytes")).unionByName(scans.select("path", "sha256", F.lit("pdf").alias("kind"), F.col("length").alias("bytes")))
        paged = paged.select("path", stem.alias("title"), "sha256", "kind", F.lit(None).cast("string").alias("frontmatter"), "bytes")
        docs = fresh.select("path", "title", "sha256", "kind", "frontmatter", "bytes").unionByName(paged)
        docs = docs.withColumn("doc_id", F.xxhash64("path"))
        blocks = layout.strip_chrome(self._laid_out(words, docs))
        pages, block_rows = self._rows(fresh, docs, blocks, words)
        counts = words.groupBy("path").agg(F.max("page_no").alias("page_count"), F.max(F.col("confidence").isNotNull()).alias("ocr"))
        docs = docs.join(counts, "path", "left").select(
            "doc_id", "path", "sha256", "title", "kind", F.coalesce("page_count", F.lit(1)).alias("page_count"), "bytes", F.current_timestamp().alias("ingested_at"),
            F.when(F.col("ocr"), "tesseract").when(F.col("kind") == "pdf", "poppler").otherwise("plain").alias("extractor"), F.coalesce("ocr", F.lit(False)).alias("ocr"), "frontmatter",
        )
        docs = s.cut(docs)
        n = docs.count()
        self._one_id_a_path(old["documents"], docs)
        replaced = old["documents"].join(docs.select("path"), "path", "left_semi").select("doc_id")
        gone_pages = old["pages"].join(replaced, "doc_id", "left_semi").select(F.col("id").alias("page_id"))
        known, n_failed = found.count(), failed.select("path").distinct().count()
        self._save({
            "documents": files.upsert(old["documents"], docs), "pages": old["pages"].join(replaced, "doc_id", "left_anti").unionByName(pages, True),
            "blocks": old["blocks"].join(gone_pages, "page_id", "left_anti").unionByName(block_rows, True),
        })
        return {"ingested": n, "skipped": max(known - n - n_failed, 0), "failed": n_failed}

    def _one_id_a_path(self, old: DataFrame, docs: DataFrame) -> None:
        """Ids are 64-bit hashes of paths; should two paths ever have one, nothing is written."""
        both = old.select("doc_id", "path").unionByName(docs.select("doc_id", "path"))
        clash = both.groupBy("doc_id").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a <> b").first()
        if clash:
            raise ValueError(f"{clash['a']} and {clash['b']} have the same id; rename one of them")

    def _sources(self):
        path = os.path.join(self.root, "sources.toml")
        if not os.path.exists(path):
            return
        with open(path) as f:
            sources = config.parse_sources(f.read())
        for s in sources:
            for q in s.queries:
                df = sql.read_source(self.spark, s, q)
                made = rows.row_blocks(df.withColumn("__n", F.monotonically_increasing_id()), ["__n"], q.heading_column or df.columns[0]).where("not startswith(text, '__n: ')")
                one = made.agg(F.array_sort(F.collect_list(F.struct(F.col("row_key.__n").alias("n"), "ord", "kind", "text", "heading_level"))).alias("b"))
                blocks = F.transform("b", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), b["heading_level"].alias("heading_level")))
                doc = one.select(F.lit(f"datasource://{s.name}/{q.name}").alias("path"), F.lit(q.name).alias("title"), F.lit(f"{s.kind}-query").alias("kind"), F.lit(None).cast("string").alias("frontmatter"), blocks.alias("blocks"), F.lit(None).cast("long").alias("bytes"))
                yield files.with_fingerprint(doc).select("path", "title", "sha256", "kind", "frontmatter", "blocks", "bytes")

    def _plain_words(self, text: DataFrame) -> DataFrame:
        words = plain.text_words(text, "path").withColumnRenamed("doc_id", "path")
        size = words.groupBy("path").agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
        joined = words.join(size, "path")
        return joined.select("path", F.lit(1).alias("page_no"), "width", "height", F.col("word").alias("text"), "x0", "y0", "x1", "y1", F.lit(None).cast("float").alias("confidence"))

    def _laid_out(self, words: DataFrame, docs: DataFrame) -> DataFrame:
        return layout.layout_pages(words.join(docs.select("path", "doc_id"), "path").drop("path", "confidence"))

    def _rows(self, fresh: DataFrame, docs: DataFrame, blocks: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
        page_id = lambda doc, no: F.xxhash64(doc.cast("long"), no.cast("int"), F.lit("page"))
        ids = docs.select("path", "doc_id")
        shaped = fresh.join(ids, "path")
        own = shaped.select(
            page_id(F.col("doc_id"), F.lit(1)).alias("id"), "doc_id", F.lit(1).alias("page_no"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"),
            F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("text"), F.lit(None).cast("float").alias("ocr_conf"), F.lit(False).alias("low_confidence"),
        )
        conf = words.join(ids, "path").groupBy("doc_id", "page_no").agg(F.avg("confidence").cast("float").alias("ocr_conf"), F.max("width").alias("width"), F.max("height").alias("height"))
        read = layout.reading_text(blocks).join(conf, ["doc_id", "page_no"], "right")
        laid = read.select(
            page_id(F.col("doc_id"), F.col("page_no")).alias("id"), "doc_id", "page_no", "width", "height", "text", "ocr_conf",
            tx.low_confidence(F.col("ocr_conf"), F.col("text")).alias("low_confidence"),
        )
        each = shaped.select("doc_id", F.posexplode("blocks").alias("ord", "b"))
        box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
        y = F.col("ord").cast("double")
        made = each.select(page_id(F.col("doc_id"), F.lit(1)).alias("page_id"), F.lit(0).alias("col"), "ord", box(F.lit(0.0), y, F.lit(1.0), y + 1).alias("bbox"), "b.kind", "b.text", "b.heading_level")
        set_ = blocks.select(page_id(F.col("doc_id"), F.col("page_no")).alias("page_id"), "col", "ord", box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"), "kind", "text", F.lit(None).cast("int").alias("heading_level"))
        all_blocks = made.unionByName(set_)
        block_id = F.xxhash64("page_id", "ord").bitwiseAND(F.lit((1 << 62) - 1))
        return own.unionByName(laid), all_blocks.withColumn("id", block_id)

    def pack(self, name: str | None = None) -> config.Pack:
        name = name or config.load_settings(self.root).pack
        path = os.path.join(self.root, "packs", f"{name}.toml")
        if os.path.exists(path):
            return config.load_pack(path)
        if name == "generic":
            return config.GENERIC
        raise FileNotFoundError(path)

    def index(self, pack: str | None = None) -> dict[str, int]:
        """Build all derived tables anew from what was ingested."""
        base = self._tables(INGESTED)
        g = pipeline.build_index(base["documents"], base["pages"], base["blocks"], self.pack(pack))
        self._save(g)
        return {r["table_name"]: r["n"] for r in pipeline.index_report(self.graph()).collect()}

    def explore(self, query: str, budget: int = 8000, hops: int = 2, kind: str | None = None) -> DataFrame:
        return retrieve.explore(self.graph(), self.full_text(), query, retrieve.ExploreOptions(budget, hops, kind))

    def explore_text(self, query: str, as_json: bool = False, **options) -> str:
        items = self.explore(query, **options).orderBy("position").collect()
        if as_json:
            return json.dumps({"query": query, "items": [r.asDict(True) for r in items], "total_tokens": sum(r["tokens"] for r in items)}, ensure_ascii=False)
        return retrieve.explore_markdown(items, query)

    def get(self, name: str, as_json: bool = False) -> str:
        found = retrieve.get_entity(self.graph(), name).first()
        if found is None:
            raise KeyError(name)
        return json.dumps(found.asDict(True), ensure_ascii=False) if as_json else retrieve.entity_markdown(found)

    def page(self, document: str, page_no: int) -> str:
        found = retrieve.page_text(self.graph()["documents"], self.graph()["pages"], document, page_no).first()
        if found is None:
            raise KeyError(f"{document} p.{page_no}")
        return found["text"] or ""

    def lint(self, as_json: bool = False) -> str:
        g = self.graph()
        clashes = retrieve.contradictions(g["entity_fields"], g["entities"], g["documents"]).orderBy("entity", "key").collect()
        lonely = retrieve.orphans(g["entities"], g["edges"], g["mentions"]).orderBy("name", "id").collect()
        broken = retrieve.unresolved_wikilinks(g["chunks"], g["documents"]).orderBy("source_document", "chunk_id", "target").collect()
        if as_json:
            return json.dumps({"contradictions": [r.asDict(True) for r in clashes], "orphans": [r["name"] for r in lonely], "unresolved_wikilinks": [r.asDict() for r in broken]}, ensure_ascii=False)
        return retrieve.lint_markdown(clashes, lonely, broken)

    def compile(self, out: str | None = None, least: float = 0.0, today: str | None = None) -> dict[str, int]:
        """Write a page for each entity; pages whose first 20 lines say that a person keeps them are left alone."""
        out, today = out or os.path.join(self.root, "wiki"), today or date.today().isoformat()
        os.makedirs(out, exist_ok=True)
        pages = retrieve.wiki_pages(self.graph(), today, least)
        written = kept = 0
        for r in pages.select("slug", "page").toLocalIterator():
            path = os.path.join(out, f"{r['slug']}.md")
            if read_status(path) == "curated":
                kept += 1
                continue
            with open(path, "w") as f:
                f.write(r["page"])
            written += 1
        sections = [r["section"] for r in retrieve.wiki_index(pages, today).orderBy("kind").toLocalIterator()]
        with open(os.path.join(out, "index.md"), "w") as f:
            f.write(f"# Pages of this wiki\n\n_As of {today}_\n\nListed by kind; pages of too little weight are not written.\n\n" + "".join(sections))
        log = os.path.join(out, "log.md")
        fresh = not os.path.exists(log)
        with open(log, "a") as f:
            f.write(("# History\n\nOne entry for each time that the pages were written.\n\n" if fresh else "") + f"## [{today}] {written} pages written, {kept} left as they are\n")
        return {"written": written, "kept": kept}

    def stats(self) -> dict[str, int]:
        return retrieve.stats(self.graph()["documents"], self.graph()["entities"]).first().asDict()

    def tool(self, name: str, **args) -> str:
        """explore, get, page and stats as JSON; a failure is an object with ``error``."""
        try:
            if name == "explore":
                return self.explore_text(args.pop("query"), True, **args)
            if name == "get":
                return self.get(args["entity"], True)
            if name == "page":
                return json.dumps({"text": self.page(args["doc"], int(args["page"]))}, ensure_ascii=False)
            if name == "stats":
                return json.dumps(self.stats())
            raise KeyError(f"no tool {name}")
        except Exception as x:  # noqa: BLE001
            return json.dumps({"error": str(x)})


def read_status(path: str) -> str | None:
    """The status a page states in its first 20 lines, if it begins with a fence; null without one or without a file."""
    try:
        with open(path) as f:
            lines = [line.strip() for _, line in zip(range(20), f, strict=False)]
    except FileNotFoundError:
        return None
    if not lines or lines[0] != "---":
        return None
    return next((x.split(":", 1)[1].strip() for x in lines[1:] if x.startswith("status:")), None)
