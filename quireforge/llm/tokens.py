"""Token ids of a whole corpus, every distinct word encoded once.

Workers split texts into pre-tokens and number the distinct ones of a batch; batches send each of their distinct words
once, with its number; the words meet in a shuffle, each distinct one is encoded once and goes back to the batches
that hold it, where the ids are put in order of position. What travels per occurrence is one number.
"""

from __future__ import annotations

import base64
import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, spread

TOKENIZERS = os.environ.get("QUIREFORGE_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
# Fixed value: the public pattern that splits texts for this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_CHARS = 4_000_000
"""A batch of documents ends after so many characters; the text that reaches them is its last, however long."""
BATCH_IDS = 1_000_000
"""The same for rows of ids."""
BATCHES_PER_SALT, MOST_TASKS = 20_000, 100_000


@functools.lru_cache(2)
def _ranks(folder: str, name: str) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def encoding(folder: str = TOKENIZERS, name: str = NAME):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(folder, name), special_tokens={})


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_SPLIT = "batch string, doc_id long, at array<int>, words array<string>"
_SPLIT_ARROW = pa.schema([("batch", pa.string()), ("doc_id", pa.int64()), ("at", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows (batch, doc_id, at) and one row of words for each batch."""
    import regex

    find = regex.compile(PATTERN).findall
    number, ids, places, chars = _Numbers(), [], [], 0

    def flush():
        name = uuid.uuid4().hex
        lens = np.fromiter((len(p) for p in places), np.int64, len(places))
        at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lens.cumsum()]).astype(np.int32)), pa.array(np.concatenate([*places, np.zeros(0, np.int32)]).astype(np.int32)))
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(ids, pa.int64()), at, pa.nulls(n, pa.list_(pa.string()))], schema=_SPLIT_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([list(number)], pa.list_(pa.string()))], schema=_SPLIT_ARROW)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = find(text) if text else []
            ids.append(doc)
            places.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            chars += len(text or "")
            if chars >= BATCH_CHARS:
                yield from flush()
                number, ids, places, chars = _Numbers(), [], [], 0
    if ids:
        yield from flush()


def split_corpus(documents: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(batch, doc_id, at): the numbers of each document's words in order; (batch, at, word): what the numbers mean; and
    how many batches there are."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    split = scratch.cut(spread(rows).mapInArrow(_split, _SPLIT))
    docs = split.where("words is null").select("batch", "doc_id", "at")
    words = split.where("words is not null").select("batch", F.posexplode("words").alias("at", "word"))
    return docs, words, split.where("words is not null").count()


def encode_words(words: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(word, ids) of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, name).encode_ordinary
        for batch in batches:
            ids = [encode(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def _reassemble(docs: pa.Table, table: pa.Table) -> pa.Table:
    """Ids of a batch's documents, by gathering the ids of each word at its positions."""
    at = docs["at"].combine_chunks()
    at = at.chunk(0) if isinstance(at, pa.ChunkedArray) else at
    bounds, flat = at.offsets.to_numpy(), at.values.to_numpy()
    order = table["at"].to_numpy()
    held = table["ids"].combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) and held.num_chunks else held
    if table.num_rows:
        starts, ends, pool = np.zeros(order.max() + 1, np.int64), np.zeros(order.max() + 1, np.int64), held.values.to_numpy()
        starts[order], ends[order] = held.offsets.to_numpy()[:-1], held.offsets.to_numpy()[1:]
        lens = (ends - starts)[flat]
        total = np.concatenate([[0], lens.cumsum()])
        ids = pool[np.repeat(starts[flat] - total[:-1], lens) + np.arange(total[-1])]
    else:
        total, ids = np.zeros(len(flat) + 1, np.int64), np.zeros(0, np.int32)
    out = pa.ListArray.from_arrays(pa.array(total[bounds].astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.table({"doc_id": docs["doc_id"], "ids": out})


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, ids) of every row, without special tokens. Null and empty texts have an empty list; a blank text has
    the ids of its white space. Repeated ids stay repeated."""
    s = Scratch(documents.sparkSession, "tokens")
    docs, words, n = split_corpus(documents, s, id_col, text_col)
    distinct = encode_words(words.select("word").distinct(), folder, name)
    # A word has at most one row for each batch that holds it; with very many batches its rows are dealt to salts.
    salts = 1 + n // BATCHES_PER_SALT
    salted = words.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)))
    spread_out = distinct.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    table = salted.join(spread_out, ["word", "salt"]).select(F.col("batch").alias("held_by"), "at", "ids")
    # About one batch a task, so that what a task holds does not grow with the corpus.
    parts = max(1, min(n, MOST_TASKS))
    return docs.repartition(parts, "batch").groupBy("batch").cogroup(table.repartition(parts, "held_by").groupBy("held_by")).applyInArrow(_reassemble, "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(id, bytes) of the vocabulary, a table of fixed size."""
    return spark.createDataFrame(sorted((i, b) for b, i in _ranks(folder, name).items()), "id int, bytes binary")


_IDS = pa.schema([("batch", pa.string()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("held", pa.list_(pa.int32()))])


def _gather_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, doc_id, ids), and for each batch one row of the distinct ids that it holds."""

    def flush(part: list[pa.RecordBatch]):
        name = uuid.uuid4().hex
        held = np.unique(np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in part]).astype(np.int32))
        for b in part:
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), b.column(0), b.column(1), pa.nulls(b.num_rows, pa.list_(pa.int32()))], schema=_IDS)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([held], pa.list_(pa.int32()))], schema=_IDS)

    part, size = [], 0
    for batch in batches:
        if batch.column(1).flatten().null_count:
            raise ValueError("null is no token id")
        ends = np.diff(batch.column(1).offsets.to_numpy()).cumsum()
        low = 0
        # A batch of rows is cut where it reaches the number of ids that are gathered at once.
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = min(int(np.searchsorted(ends, before + BATCH_IDS - size)) + 1, batch.num_rows)
            part.append(batch.slice(low, high - low))
            size += int(ends[high - 1] - before)
            low = high
            if size >= BATCH_IDS:
                yield from flush(part)
                part, size = [], 0
    if part:
        yield from flush(part)


def _spell(docs: pa.Table, table: pa.Table) -> pa.Table:
    """Texts of a batch's documents, by gathering the bytes of each id."""
    ids = docs["ids"].combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    bounds, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
    order, spelled = table["id"].to_numpy(), table["bytes"].to_pylist()
    unknown = [int(i) for i, b in zip(order, spelled, strict=True) if b is None]
    if unknown:
        raise ValueError(f"no token has the id {unknown[0]}")
    index = np.zeros(len(order), np.int64)
    index[np.argsort(order)] = np.arange(len(order))
    place = np.searchsorted(np.sort(order), flat)
    by_place = [b for _, b in sorted(zip(index.tolist(), spelled, strict=True))]
    texts = [b"".join(map(by_place.__getitem__, place[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"doc_id": docs["doc_id"], "text": pa.array(texts, pa.string())})


def decode_corpus(encoded: DataFrame, folder: str = TOKENIZERS, name: str = NAME, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) from ids: as in encoding, each batch of rows sends its distinct ids once, these are joined with the
    token-byte table (broadcast, as its size is fixed) and go back to be put in the order of the rows' ids. An unknown or
    null id fails. Ids that do not end at a character give the replacement character. Null or no ids give the empty
    text. Repeated rows stay repeated."""
    s = Scratch(encoded.sparkSession, "texts")
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    split = s.cut(rows.mapInArrow(_gather_ids, "batch string, doc_id long, ids array<int>, held array<int>"))
    held = split.where("held is not null").select(F.col("batch").alias("held_by"), F.explode_outer("held").alias("id"))
    table = held.where("id is not null").join(F.broadcast(token_bytes(encoded.sparkSession, folder, name)), "id", "left").select("held_by", "id", "bytes")
    parts = max(1, min(split.where("held is not null").count(), MOST_TASKS))
    docs = split.where("held is null").select("batch", "doc_id", "ids").repartition(parts, "batch")
    return docs.groupBy("batch").cogroup(table.repartition(parts, "held_by").groupBy("held_by")).applyInArrow(_spell, "doc_id long, text string")


def count_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = NAME, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_tokens); null texts count 0."""
    kept = [F.col(id_col).alias("doc_id"), *keep]
    schema = documents.select(*kept, F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, name).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return spread(documents.select(*kept, F.col(text_col).alias("__text"))).mapInArrow(run, schema)
