"""File sources: document folders, page texts, Markdown, block lists, images; engine options from JSON.

Metadata is filtered before any content is read. Formats that need a PDF library are adaptors over one: without it they
give no rows, as a missing library must not stop a batch.
"""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import basename, content_name, stem, suffix

MAX_BYTES = 100 << 20
DEFAULTS = {"mineru_token": None, "output_dir": None, "last_check_ts": None, "mode": None}


def list_files(spark: SparkSession, path: str, glob: str = "*.pdf", modified_after: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path, modificationTime, length, name): metadata only, the content column is pruned away."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    r = r.option("modifiedAfter", modified_after) if modified_after else r
    f = r.load(path).select("path", "modificationTime", "length", basename(F.col("path")).alias("name"))
    return f.filter(F.col("length") <= max_bytes) if max_bytes else f


def read_binary(spark: SparkSession, path: str, glob: str = "*.pdf", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files with content; larger ones are skipped by a pushed-down filter on length before they are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= max_bytes)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, md): one row per file, line ends made uniform."""
    t = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return t.select(stem(F.input_file_name()).alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("md"))


def read_content_lists(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, items): JSON block lists as text, for parse_content_list."""
    t = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return t.select(stem(F.input_file_name()).alias("doc_id"), F.col("value").alias("items"))


def read_images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(path, name): images under content-addressed names."""
    return read_binary(spark, path, glob).select("path", content_name(F.col("content"), F.substring(suffix(F.col("path")), 2, 10)).alias("name"))


def library_available(name: str) -> bool:
    return importlib.util.find_spec(name) is not None


class Extractor:
    """Where page texts come from; subclass it for another library. ``is_available`` is asked once, before any file is read."""

    def is_available(self) -> bool:
        return library_available("pypdf")

    def pages(self, data: bytes) -> list[str]:
        import io

        import pypdf

        return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]


def read_pages(files: DataFrame, extract: Callable[[bytes], list[str]] | Extractor | None = None) -> DataFrame:
    """(path, page_idx, text, error) of binary files by an extractor of page texts.

    A file that the extractor fails on gives one row with the error and null page and text, so that it can be set aside
    (see quarantine); a file without pages gives none. An extractor whose library is missing gives no rows.
    """
    how = extract if callable(extract) else (extract or Extractor())
    fn = how if callable(how) else how.pages if how.is_available() else lambda _: []

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            rows: list[tuple] = []
            for path, data in zip(p.path, p.content):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(fn(bytes(data)))]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:500]))
            out = pd.DataFrame(rows, columns=["path", "page_idx", "text", "error"])
            yield out.astype({"page_idx": "Int32"})

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("page_idx", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
    return files.select("path", "content").mapInPandas(run, schema)


def quarantine(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable pages, failed files with their error)."""
    return pages.filter("error IS NULL").drop("error"), pages.filter("error IS NOT NULL").select("path", "error").distinct()


def output_state(spark: SparkSession, path: str) -> tuple[bool, int | None]:
    """(writable, free bytes) of an output folder or the nearest folder above it that exists; free space is None where the file system doesn't tell."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while p.getParent() is not None and not fs.exists(p):
        p = p.getParent()
    try:
        fs.access(p, jvm.org.apache.hadoop.fs.permission.FsAction.WRITE)
        writable = True
    except Exception:  # noqa: BLE001
        writable = False
    left = fs.getStatus(p).getRemaining()
    return writable, left if 0 < left < 2**62 else None


def load_options(path: str | Path) -> dict:
    """Known options of a JSON file; a missing or broken file, unknown keys and wrong types fall back to the defaults."""
    try:
        raw = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        raw = {}
    raw = raw if isinstance(raw, dict) else {}
    return {k: raw[k] if isinstance(raw.get(k), str) and raw[k] else v for k, v in DEFAULTS.items()}


def engine_mode(options: dict) -> str:
    """The explicit mode, else precision with a token, else flash."""
    mode = options.get("mode")
    return mode if mode in ("flash", "precision") else "precision" if options.get("mineru_token") else "flash"


def incomplete(files: DataFrame, done: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """Files of the last hours whose name isn't among ``done`` (name)."""
    young = files.filter(F.col("modificationTime") >= now - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))
    return young.join(done.select("name").distinct(), "name", "left_anti")
