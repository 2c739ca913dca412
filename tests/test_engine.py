import json
import os

import pytest

from quireforge import cli
from quireforge.engine import Engine


def write(root, name, text):
    with open(os.path.join(root, "raw", name), "w") as f:
        f.write(text)


def test_from_files_to_wiki(spark, tmp_path, capsys):
    root = str(tmp_path)
    assert cli.main(["--root", root, "init"], spark) == 0
    write(root, "a.md", "---\ntitle: Copper Lantern\ntags: [light]\n---\n# Copper Lantern\n\nA lamp near [[Stone Bridge]].\n")
    write(root, "b.adoc", "= Stone Bridge\n\nBuilt beside the Copper Lantern. See [[Nowhere]].\n")
    e = Engine(spark, root)
    assert e.ingest() == {"ingested": 2, "skipped": 0, "failed": 0} and e.ingest()["ingested"] == 0
    counts = e.index()
    assert counts["sections"] == 2 and counts["entities"] == 3 and e.index() == counts
    assert "## Copper Lantern (topic)" in e.explore_text("lantern") and json.loads(e.tool("explore", query="lantern"))["items"]
    assert "error" in json.loads(e.tool("get", entity="zzz")) and json.loads(e.tool("stats"))["documents"] == 2
    assert "[[Nowhere]] is linked from Stone Bridge" in e.lint() and "Copper Lantern" in e.page("copper lantern", 1)
    with open(os.path.join(root, "wiki", "stone-bridge.md"), "w") as f:
        f.write("---\nstatus: curated\n---\nmine\n")
    assert e.compile(today="2026-01-01") == {"written": 2, "kept": 1}
    assert open(os.path.join(root, "wiki", "stone-bridge.md")).read().endswith("mine\n")
    assert "## Topic" in open(os.path.join(root, "wiki", "index.md")).read()
    write(root, "b.adoc", "= Stone Bridge\n\nRebuilt.\n")
    assert e.ingest()["ingested"] == 1
    assert e.index()["sections"] == 2 and e.stats()["documents"] == 2
    assert cli.main(["--root", root, "get", "zzz"], spark) == 1 and cli.main(["--root", root, "--json", "stats"], spark) == 0
    assert '"documents": 2' in capsys.readouterr().out


def words_of(files):
    """Stands for the outside program: a file that begins with % is read, any other is damaged."""
    import pandas as pd

    from quireforge.sources import pdf

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                texts = content.decode().split("\n")[1:] if content[:1] == b"%" else []
                rows = [(path, no, 600.0, 800.0, w, 10.0 * i, 10.0, 10.0 * i + 8, 20.0, None, None) for no, t in enumerate(texts, 1) for i, w in enumerate(t.split())]
                yield pd.DataFrame(rows or [(path, *[None] * 9, "damaged")], columns=["path", *[c.split()[0] for c in pdf.WORDS.split(", ")], "error"])

    return files.mapInPandas(run, f"path string, {pdf.WORDS}, error string")


def test_one_bad_file_stops_nothing(spark, tmp_path):
    root = str(tmp_path)
    e = Engine.init(spark, root)
    write(root, "good.pdf", "%PDF\nCopper lamps were made here\nand sold there")
    write(root, "bad.pdf", "no such thing")
    write(root, "list.urls", "http://dead.example\n/// Alive\nhttp://alive.example\n")
    write(root, "a.md", "# A\n\ntext\n")
    fetch = lambda u: "<h1>Alive</h1><p>here" if "alive" in u else [][0]
    assert e.ingest(fetch=fetch, native=words_of, ocr="never") == {"ingested": 3, "skipped": 0, "failed": 2}
    docs = {r["path"].rsplit("/", 1)[-1]: r for r in e.graph()["documents"].collect()}
    assert set(docs) == {"good.pdf", "alive.example", "a.md"} and docs["good.pdf"]["page_count"] == 2
    assert (docs["good.pdf"]["extractor"], docs["good.pdf"]["ocr"]) == ("poppler", False)
    stored = spark.read.parquet(os.path.join(e.store, "words"))
    assert stored.select("sha256").distinct().count() == 1 and "sold there" in e.page("good", 2)
    again = e.ingest(fetch=fetch, native=words_of, ocr="never")
    assert again["failed"] == 2 and again["ingested"] == 0
    write(root, "bad.pdf", "%PDF\nmended")
    assert e.ingest(fetch=lambda u: "<p>x", native=words_of, ocr="never")["failed"] == 0
    assert e.index()["sections"] == 1 and e.stats()["documents"] == 5


def test_a_clash_of_ids_is_told(spark, tmp_path):
    e = Engine.init(spark, str(tmp_path))
    docs = spark.createDataFrame([(7, "a"), (8, "b")], "doc_id long, path string")
    e._one_id_a_path(docs, docs)
    with pytest.raises(ValueError, match="same id"):
        e._one_id_a_path(docs, spark.createDataFrame([(7, "c")], "doc_id long, path string"))
