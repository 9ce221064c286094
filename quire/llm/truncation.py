"""Text cut off by field limits or in transfer, and how often each source cuts.

The main evidence is a self-join by prefix: all distinct values are range-partitioned and sorted, where a value is a
strict prefix of another one exactly if it is a prefix of its successor. That needs one comparison per value whatever
the groups of equal beginnings are. Values with an open end that have a longer copy are cut, and the lengths at which
open ends pile up in a source are its limits; a value that reaches such a limit and has a longer copy is cut even if it
happens to end with a full stop.

Most cut values have no longer copy anywhere, so the prefix join alone can't find them. For these the end itself is
judged: markup left open, a broken character, an ellipsis that isn't a recurring phrase, prose that stops in the middle
of a sentence. ``evidence`` says which it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quire.llm.canonical import canonical_array
from quire.llm.ocr import SCAN_SOURCES, split_lines, with_titles
from quire.session import materialise

#: characters after which a text may end
TERMINAL = "。．.？！?!）)】\\]》」』〉”\"’'；;:：…"
#: a phrase before an ellipsis: its last letters and digits, out of how many characters; the share of all ellipses from which they are a phrase
TAIL, PHRASE_CHARS, PHRASE_SHARE, PHRASE_LEAST = 6, 48, 0.01, 3


def strict_prefixes(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """(value, longer): each distinct non-empty value that is a strict prefix of another one, with its successor.

    Two shuffles of the distinct values (equal values are combined before either), none of pairs. Nulls are ignored.
    """
    v = df.filter(F.length(column) > 0).select(F.col(column).alias("value")).distinct()
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None
        for b in batches:
            rows = b.column(0).to_pylist()
            if not rows:
                continue
            first = rows[0] if first is None else first
            chain = rows if last is None else [last, *rows]
            hit = [(x, y) for x, y in zip(chain, chain[1:]) if y.startswith(x)]
            last = rows[-1]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(hit), pa.int32()), pa.array([False] * len(hit)), pa.array([x for x, _ in hit], pa.string()), pa.array([y for _, y in hit], pa.string())], names=["part", "edge", "value", "longer"])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([True]), pa.array([last], pa.string()), pa.array([first], pa.string())], names=["part", "edge", "value", "longer"])

    found = materialise(v.repartitionByRange(n, "value").sortWithinPartitions("value").mapInArrow(run, "part int, edge boolean, value string, longer string"))
    # the last value of a partition against the first of the next one that isn't empty: a row a partition
    edge = found.filter("edge").withColumn("longer", F.lead("longer").over(W.orderBy("part"))).filter(F.col("longer").startswith(F.col("value")))
    return found.filter("NOT edge").unionByName(edge).select("value", "longer")


@pandas_udf(T.StringType())
def _tidy(text, title):  # noqa: ANN001, ANN202
    """Canonical text without the furniture lines of a scanned page; null for null."""
    import pandas as pd

    a, b = canonical_array(pa.array(text, pa.string())).to_pylist(), canonical_array(pa.array(title, pa.string())).to_pylist()
    return pd.Series([None if x is None else "\n".join(split_lines(x, y)[0]) for x, y in zip(a, b)])


def _ends(body: Column) -> dict[str, Column]:
    """What the end of a text says. Patterns look at its last characters alone where no more can matter, so they cost the same for any length."""
    text = F.rtrim(body, F.lit(" \t\n\r\x0b\x0c"))
    last = F.right(text, F.lit(8))
    dots = text.endswith("…") | text.endswith("...")
    # what stands before the ellipsis, however many marks it has
    bare = F.right(F.rtrim(text, F.lit("….\"'”’）)】] ")), F.lit(PHRASE_CHARS))
    number = last.rlike(r"\d\.$")
    # a number in a text of ideographs: the sentence it stands in is what follows the last full stop
    sentence = F.substring_index(F.translate(text, "？！", "。。"), "。", -1)
    return {
        "dots": dots,
        "tail": F.when(dots, F.right(F.regexp_replace(bare, r"[^\p{L}\p{N}]", ""), F.lit(TAIL))),
        "open": ~last.rlike(rf"[{TERMINAL}]$") | (number & sentence.rlike(r"\p{IsHan}")),
        "number": number,
        "broken": text.endswith("\ufffd"),
    }


def truncated(blocks: DataFrame, exams: DataFrame, scan_sources: tuple[str, ...] = SCAN_SOURCES, min_prose: int = 24, limit_cases: int = 5, limit_share: float = 0.1) -> DataFrame:
    """(block_id, source, evidence): one row per block of text, equation or table; ``evidence`` is null for whole blocks.

    ``longer_copy`` (open end and a longer copy exists), ``limit`` (at a length limit of its source, and a longer copy
    exists or it ends within a number), ``markup``, ``broken_char``, ``ellipsis``, ``open_end``. Null and blank content is whole; so are title
    blocks, options, sub-questions that end in a semicolon and page furniture. Redelivered blocks count once. Blocks
    whose exam is unknown have a null source.

    Prose of less than ``min_prose`` characters is not told from headings and labels by its end, so it counts as whole
    unless it holds open markup or a broken character. A length is a limit of its source if at least ``limit_cases`` open ends and a ``limit_share`` of all have it.
    """
    use = blocks.select("block_id", "doc_id", "block_type", "content", "text_level", "block_ord").filter(F.col("block_type").isin("text", "equation", "table"))
    known = with_titles(use, exams).select("block_id", "block_type", "content", "text_level", "source", "title")
    lost = use.join(exams.select("doc_id").distinct(), "doc_id", "left_anti").select("block_id", "block_type", "content", "text_level", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("title"))
    rows = known.unionByName(lost)
    prose = (F.col("block_type") == "text") & (F.coalesce("text_level", F.lit(0)) != 1)
    need = prose & (F.col("source").isin(*scan_sources) | F.right(F.rtrim("content"), F.lit(4)).rlike(r"(?:…|\.\.\.)\s*$"))
    body = F.coalesce(F.col("tidy"), F.col("content"), F.lit(""))
    rows = rows.withColumn("tidy", _tidy(F.when(need, F.col("content")), F.when(need, F.col("title"))))
    e = _ends(body)
    plain = F.replace(body, F.lit("\\$"))
    dollars = F.length(plain) - F.length(F.replace(plain, F.lit("$")))
    double = (F.length(plain) - F.length(F.replace(plain, F.lit("$$")))) / 2
    opened = (F.length(body) - F.length(F.replace(body, F.lit("\\begin{")))) / 7
    closed = (F.length(body) - F.length(F.replace(body, F.lit("\\end{")))) / 5
    markup = (body.contains("<table") & ~body.contains("</table>")) | (double % 2 == 1) | ((F.col("block_type") != "table") & ((dollars - 2 * double) % 2 == 1)) | (opened > closed)
    option = F.left(F.ltrim(body), F.lit(4)).rlike(r"^\s*[(（]?[A-H][.．、)）:：]")
    rows = materialise(
        rows.select(
            "block_id",
            "source",
            F.xxhash64("content").alias("h1"),
            F.xxhash64("content", F.lit(1)).alias("h2"),
            F.length("content").alias("chars"),
            F.octet_length("content").alias("bytes"),
            (prose & (F.length(F.trim(body)) > 0) & ~option).alias("prose"),
            (F.length(F.trim(body)) >= min_prose).alias("long"),
            F.coalesce(markup, F.lit(False)).alias("markup"),
            e["broken"].alias("broken"),
            e["dots"].alias("dots"),
            e["tail"].alias("tail"),
            e["open"].alias("open"),
            e["number"].alias("number"),
        ).dropDuplicates(["block_id"])
    )
    longer = strict_prefixes(blocks.filter(F.col("block_type").isin("text", "equation", "table")), "content")
    longer = longer.select(F.xxhash64("value").alias("h1"), F.xxhash64("value", F.lit(1)).alias("h2"), F.lit(True).alias("copy"))
    # phrases before an ellipsis: at most 1 / PHRASE_SHARE of them
    tails = rows.filter("prose AND dots").groupBy("tail").count()
    every = tails.agg(F.sum("count")).first()[0] or 0
    phrase = tails.filter(F.col("count") >= max(PHRASE_LEAST, PHRASE_SHARE * every)).select("tail", F.lit(True).alias("phrase"))
    # limits of a source: lengths in characters or bytes at which open ends pile up
    size = rows.filter("prose AND long AND open AND NOT dots").select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))).alias("u")).groupBy("source", "u.unit", "u.n").agg(F.count("*").alias("k"))
    total = size.groupBy("source", "unit").agg(F.sum("k").alias("all"))
    limit = size.join(total, ["source", "unit"]).filter((F.col("k") >= limit_cases) & (F.col("k") >= limit_share * F.col("all"))).select("source", "unit", F.col("n").alias("len"))
    by_chars = limit.filter("unit = 'chars'").select("source", F.col("len").alias("chars"), F.lit(True).alias("at_c"))
    by_bytes = limit.filter("unit = 'bytes'").select("source", F.col("len").alias("bytes"), F.lit(True).alias("at_b"))
    r = rows.join(longer, ["h1", "h2"], "left").join(phrase, "tail", "left").join(by_chars, ["source", "chars"], "left").join(by_bytes, ["source", "bytes"], "left")
    no = F.lit(False)
    copy, at = F.coalesce("copy", no), F.coalesce("at_c", "at_b", no)
    prose_open = F.col("prose") & F.col("long") & F.col("open") & ~F.col("dots")
    evidence = (
        F.when(copy & (prose_open | F.col("markup")), "longer_copy")
        .when(F.col("markup"), "markup")
        .when(F.col("prose") & F.col("broken"), "broken_char")
        .when(F.col("prose") & F.col("long") & F.col("dots") & F.isnull("phrase"), "ellipsis")
        .when(prose_open, "open_end")
        .when(F.col("prose") & F.col("long") & at & (copy | F.col("number")), "limit")
    )
    return r.select("block_id", "source", evidence.alias("evidence"))


def truncation_by_source(blocks: DataFrame, exams: DataFrame) -> DataFrame:
    """(source, n_blocks, n_cut, share_cut): all blocks of a source, of any type, and those that are cut."""
    cut = truncated(blocks, exams).filter("evidence IS NOT NULL").select("block_id", F.lit(1).alias("cut"))
    src = exams.groupBy("doc_id").agg(F.min("source").alias("source"))
    every = blocks.select("block_id", "doc_id").distinct().join(src, "doc_id", "left").join(cut, "block_id", "left")
    return every.groupBy("source").agg(F.countDistinct("block_id").alias("n_blocks"), F.count("cut").alias("n_cut")).withColumn("share_cut", F.col("n_cut") / F.col("n_blocks"))
