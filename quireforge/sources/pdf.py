"""Words of PDF files: native text by pdftotext, scans by tesseract, page by page; the programs are optional.

The parsers are pure functions; the readers run the programs on each file in a task's own folder.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCAN_DPI, PAGES_AT_ONCE = 300, 16
WORDS = "page_no int, width double, height double, text string, x0 double, y0 double, x1 double, y1 double, confidence float"
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")


def available() -> dict[str, bool]:
    return {p: shutil.which(p) is not None for p in ("pdftotext", "pdfinfo", "pdftoppm", "tesseract")}


def supports(extension: str, ocr: bool = False) -> bool:
    return extension.lower() == "pdf" or ocr and extension.lower() in IMAGES


def _number(s: str | None) -> float:
    try:
        return float(s or 0)
    except ValueError:
        return 0.0


def parse_bbox(xhtml: str, first_page: int = 1) -> list[tuple]:
    """Rows of WORDS from the XHTML of ``pdftotext -bbox-layout``; blank words are dropped, bad numbers are 0. A page
    without words gives one row without text, so that it is not lost."""
    out, no = [], first_page - 1
    xhtml = re.sub(r"<!DOCTYPE[^>]*>", "", xhtml)
    for el in ET.fromstring(xhtml.encode()).iter():
        if el.tag.split("}")[-1] != "page":
            continue
        no += 1
        w, h = _number(el.get("width")), _number(el.get("height"))
        words = [(x, (x.text or "").strip()) for x in el.iter() if x.tag.split("}")[-1] == "word"]
        rows = [(no, w, h, t, _number(x.get("xMin")), _number(x.get("yMin")), _number(x.get("xMax")), _number(x.get("yMax")), None) for x, t in words if t]
        out += rows or [(no, w, h, None, None, None, None, None, None)]
    return out


def parse_tsv(rows: DataFrame, dpi: int = SCAN_DPI) -> DataFrame:
    """(page_key, width, height, text, x0, y0, x1, y1, confidence) from tesseract's TSV: page_key, tsv. Level 1 gives
    the page's size, level 5 its words; pixels become points; a confidence below 0 is null."""
    lines = rows.select("page_key", F.explode(F.split("tsv", "\r?\n")).alias("line")).select("page_key", F.split("line", "\t").alias("c")).where("size(c) >= 12 and c[0] rlike '^[0-9]+$'")
    pt = 72.0 / dpi
    cells = lines.select("page_key", *[F.col("c")[i].try_cast("double").alias(a) for i, a in ((0, "level"), (6, "left"), (7, "top"), (8, "w"), (9, "h"), (10, "conf"))], F.array_join(F.slice("c", 12, F.size("c")), "\t").alias("text"))
    size = cells.where("level = 1").groupBy("page_key").agg((F.max("w") * pt).alias("width"), (F.max("h") * pt).alias("height"))
    words = cells.where("level = 5 and trim(text) <> ''").select(
        "page_key", F.trim("text").alias("text"), (F.col("left") * pt).alias("x0"), (F.col("top") * pt).alias("y0"), ((F.col("left") + F.col("w")) * pt).alias("x1"),
        ((F.col("top") + F.col("h")) * pt).alias("y1"), F.when(F.col("conf") >= 0, F.col("conf")).cast("float").alias("confidence"),
    )
    return size.join(words, "page_key", "left")


def page_confidence(words: DataFrame) -> DataFrame:
    """Mean of the confidences of a page's words, null without any."""
    return words.groupBy("page_key").agg(F.avg("confidence").alias("ocr_conf"))


def _run(args: list[str], **env: str) -> bytes:
    return subprocess.run(args, capture_output=True, check=True, env=os.environ | env).stdout


def _said(x: Exception) -> str:
    """What went wrong, with what an outside program wrote about it."""
    told = (getattr(x, "stderr", None) or b"").decode("utf-8", "replace").strip()
    return f"{type(x).__name__}: {x} {told}".strip()


def _native(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in WORDS.split(", ")]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            error = None
            try:
                with tempfile.TemporaryDirectory() as d:
                    file = os.path.join(d, "in.pdf")
                    with open(file, "wb") as f:
                        f.write(content)
                    rows = parse_bbox(_run(["pdftotext", "-bbox-layout", file, "-"]).decode("utf-8", "replace"))
            except Exception as x:  # noqa: BLE001
                rows, error = [(None,) * len(names)], _said(x)
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "path", path)
            yield out.assign(error=error)


def native_words(files: DataFrame) -> DataFrame:
    """(path, words, error) of binary files (path, content). A file that can't be read gives one row with an error and no
    words; the others go on."""
    return files.select("path", "content").mapInPandas(_native, f"path string, {WORDS}, error string")


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content, numbers in zip(frame["path"], frame["content"], frame["numbers"], strict=True):
            rows = []
            with tempfile.TemporaryDirectory() as d:
                file = os.path.join(d, "in.pdf")
                with open(file, "wb") as f:
                    f.write(content)
                for no in map(int, numbers):
                    try:
                        _run(["pdftoppm", "-r", str(SCAN_DPI), "-png", "-f", str(no), "-l", str(no), "-singlefile", file, os.path.join(d, "page")])
                        # One thread a page: parts of files are the unit of parallel work.
                        rows.append((path, no, _run(["tesseract", os.path.join(d, "page.png"), "-", "--psm", "3", "tsv"], OMP_THREAD_LIMIT="1").decode("utf-8", "replace")))
                    except Exception:  # noqa: BLE001
                        # A page that can't be scanned keeps its native words.
                        continue
            yield pd.DataFrame(rows, columns=["path", "page_no", "tsv"])


def scanned_words(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Words of the given pages (path, page_no) by OCR. A file travels once for PAGES_AT_ONCE of its pages."""
    parts = pages.distinct().groupBy("path", F.floor(F.col("page_no") / PAGES_AT_ONCE).alias("part")).agg(F.array_sort(F.collect_list("page_no")).alias("numbers"))
    todo = parts.join(files.select("path", "content"), "path").repartition("path", "part")
    tsv = todo.mapInPandas(_scan, "path string, page_no int, tsv string")
    words = parse_tsv(tsv.select(F.struct("path", "page_no").alias("page_key"), "tsv"))
    return words.select("page_key.path", "page_key.page_no", "width", "height", "text", "x0", "y0", "x1", "y1", "confidence")


def thin_pages(words: DataFrame, least: int = 100) -> DataFrame:
    """(path, page_no) with fewer than ``least`` characters."""
    return words.groupBy("path", "page_no").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).where(F.col("n") < least).select("path", "page_no")


def merge_backends(native: DataFrame, scanned: DataFrame, mode: str = "auto", least: int = 100) -> DataFrame:
    """Words by mode: never takes the native ones, always the scanned ones, auto replaces just the thin pages."""
    if mode == "never":
        return native
    if mode == "always":
        return scanned
    thin = thin_pages(native, least)
    better = scanned.join(thin, ["path", "page_no"], "left_semi")
    # A thin page that gave no scan stays as it was.
    return native.join(better.select("path", "page_no").distinct(), ["path", "page_no"], "left_anti").unionByName(better)


def parse_page_count(info: str) -> int:
    """The number of pages that pdfinfo states; 0 without one."""
    found = re.search(r"^Pages:\s*(\d+)", info, re.M)
    return int(found[1]) if found else 0


def page_count(path: str) -> int:
    return parse_page_count(_run(["pdfinfo", path]).decode("utf-8", "replace"))


def page_range(n_pages: int, first: int | None = None, last: int | None = None) -> range:
    """The pages from first to last that the file has, all by default."""
    return range(max(first or 1, 1), min(last or n_pages, n_pages) + 1)
