"""Files of a folder as structured documents, and which of them are new."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

EXTENSIONS = ["pdf", "md", "markdown", "adoc", "url", "urls", "txt", "text", "html", "htm", "xml", "rst"]
STRUCTURED = {"md": "markdown", "markdown": "markdown", "adoc": "asciidoc", "url": "urls", "urls": "urls"}
BLOCKS = "array<struct<kind: string, text: string, heading_level: int>>"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, extension, content, length) of a folder's files with a known ending, none below a folder named assets."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    inner = F.replace(F.col("path"), F.lit(root.rstrip("/")), F.lit(""))
    return files.withColumn("extension", ext).where(ext.isin(EXTENSIONS) & ~inner.rlike(r"(^|/)assets(/|$)")).select("path", "extension", "content", "length")


def route(files: DataFrame) -> DataFrame:
    """files with ``reader``: markdown, asciidoc, urls, pdf or plain."""
    reader = F.coalesce(*[F.when(F.col("extension") == e, r) for e, r in STRUCTURED.items()], F.when(F.col("extension") == "pdf", "pdf"), F.lit("plain"))
    return files.withColumn("reader", reader)


def content_sha(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def _structured(fetch):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from . import asciidoc, frontmatter, markdown, urls

        for frame in frames:
            rows = []
            for path, reader, content in zip(frame["path"], frame["reader"], frame["content"], strict=True):
                text = bytes(content).decode("utf-8", "replace")
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    if reader == "markdown":
                        values, body = frontmatter.split(text)
                        given = values.get("title")
                        docs = [(path, given if isinstance(given, str) and given else stem, frontmatter.to_json(values), markdown.parse(body), None)]
                    elif reader == "asciidoc":
                        values, blocks = asciidoc.parse(text)
                        docs = [(path, asciidoc.title(values, blocks, stem), frontmatter.to_json(values), blocks, None)]
                    else:
                        docs = [(url, title, None, blocks, error) for url, title, blocks, error in urls.documents(text, fetch or urls.http_fetch)]
                except Exception as x:  # noqa: BLE001
                    docs = [(path, None, None, [], f"{type(x).__name__}: {x}")]
                rows += [(p, t, reader, j, [{"kind": k, "text": x, "heading_level": n} for k, x, n in b], e) for p, t, j, b, e in docs]
            yield pd.DataFrame(rows, columns=["path", "title", "reader", "frontmatter", "blocks", "error"])

    return run


def structured_documents(files: DataFrame, fetch=None) -> DataFrame:
    """(path, title, reader, frontmatter, blocks, error) of the files whose format tells its structure; an address list
    gives one document for each address. What can't be read has an error and nothing else; the others go on."""
    routed = files.where(F.col("reader").isin("markdown", "asciidoc", "urls")).select("path", "reader", "content")
    return routed.mapInPandas(_structured(fetch), f"path string, title string, reader string, frontmatter string, blocks {BLOCKS}, error string")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs with sha256: that of the title and the texts of the blocks."""
    return docs.withColumn("sha256", tx.fingerprint(F.col("title"), F.transform("blocks", lambda b: b["text"])))


def new_documents(found: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Those whose hash is not among the known ones. Known is a snapshot: equal content at two paths of one run is two
    documents. With ``force`` all are new."""
    return found if force else found.join(known.select("sha256").where("sha256 is not null").distinct(), "sha256", "left_anti")


def upsert(current: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """current without the rows that fresh replaces by key, and fresh."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
