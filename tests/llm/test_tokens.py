import os

import pytest

from quireforge.llm import tokens as tk

pytestmark = pytest.mark.skipif(not os.path.isdir(tk.TOKENIZERS), reason="no tokenizer files")
TEXTS = [None, "", " ", "\n\n  x", "Hello world, hello WORLD's 1234 ½ ½", "日本語 текст 😀 ​ é", "<|endoftext|> plain", "a" * 5000 + " b" * 5000, "tab\tand\r\nend  ", "Hello world, hello WORLD's 1234 ½ ½"]


def test_equals_tiktoken_and_comes_back(spark, monkeypatch):
    monkeypatch.setattr(tk, "BATCH_CHARS", 40)
    df = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "clash", [1])], "doc_id long, text string, batch string, ids array<int>")
    encoded = tk.encode_corpus(df)
    encode = tk.encoding().encode_ordinary
    got = sorted((r["doc_id"], list(r["ids"])) for r in encoded.collect())
    assert got == sorted([(i, encode(t) if t else []) for i, t in enumerate(TEXTS)] + [(4, encode(TEXTS[4]))])
    back = {r["doc_id"]: r["text"] for r in tk.decode_corpus(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    counted = {r["doc_id"]: r["n_tokens"] for r in tk.count_tokens(df).collect()}
    assert counted == {i: len(ids) for i, ids in got}


def test_each_word_is_encoded_once(spark):
    df = spark.createDataFrame([(i, "same words here " * 50) for i in range(20)], "doc_id long, text string")
    _, words, n = tk.split_corpus(df, tk.Scratch(spark, "t"))
    assert tk.encode_words(words.select("word").distinct()).count() == words.select("word").distinct().count() == 5
    assert n == words.select("batch").distinct().count()


def test_words_dealt_to_salts(spark, monkeypatch):
    monkeypatch.setattr(tk, "BATCH_CHARS", 10)
    monkeypatch.setattr(tk, "BATCHES_PER_SALT", 2)
    df = spark.createDataFrame([(i, f"one word and {i}") for i in range(40)], "doc_id long, text string")
    encode = tk.encoding().encode_ordinary
    assert {r["doc_id"]: list(r["ids"]) for r in tk.encode_corpus(df).collect()} == {i: encode(f"one word and {i}") for i in range(40)}


@pytest.mark.parametrize("size", [3, 1000, 1_000_000])
def test_decoding_of_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(tk, "BATCH_IDS", size)
    ids = tk.encoding().encode_ordinary("日本")
    rows = [(1, None), (2, []), (3, ids), (3, ids), (None, ids), (4, ids[:1]), (5, [1] * 50_000)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in tk.decode_corpus(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect())
    cut = tk.encoding().decode_bytes(ids[:1]).decode("utf-8", "replace")
    assert got == sorted([("1", ""), ("2", ""), ("3", "日本"), ("3", "日本"), ("None", "日本"), ("4", cut), ("5", tk.encoding().decode([1]) * 50_000)])
    with pytest.raises(Exception, match="null"):
        tk.decode_corpus(spark.createDataFrame([(1, [5, None])], "doc_id long, ids array<int>")).collect()


def test_empty_table(spark):
    assert tk.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_all_empty(spark):
    got = tk.encode_corpus(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert sorted((r["doc_id"], list(r["ids"])) for r in got.collect()) == [(1, []), (2, [])]


def test_unknown_id_fails(spark):
    with pytest.raises(Exception, match="999999"):
        tk.decode_corpus(spark.createDataFrame([(1, [999999])], "doc_id long, ids array<int>")).collect()
