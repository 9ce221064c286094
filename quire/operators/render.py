"""Questions as HTML cards, and exams as HTML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import collapse_blanks, escape_html, pad_qnum, wrap_latex
from quire.operators.running import running


def badge(q_type: Column, multi: Column) -> Column:
    """Label of a question's kind; choices tell single from multiple where that is known."""
    choice = F.when(multi.isNull(), "选择").when(multi, "多选").otherwise("单选")
    return F.when(q_type == "choice", choice).when(q_type == "fill_blank", "填空").when(q_type == "calculation", "计算").when(q_type == "experiment", "实验").otherwise("其他")


BUCKETS = ("K1", "K2", "K3", "K4", "K5")


def assemble(questions: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """questions (doc_id, q_index, bucket, ...) with ``section``: the part of the document that a question is shown in.

    A document whose questions have just the buckets K1 to K5, and as many questions as ``totals`` (doc_id, total) says, is
    shown in one part in order of number; so is one without buckets. Others keep their buckets; questions without one
    come last, in part ``_rest``.
    """
    q = questions
    state = q.groupBy("doc_id").agg(F.count("*").alias("__n"), F.count_if(F.col("bucket").isin(*BUCKETS)).alias("__k"), F.count("bucket").alias("__b"), *[F.max(F.coalesce(F.col("bucket") == b, F.lit(False))).alias(f"__{b}") for b in BUCKETS])
    state = state.join(totals.groupBy("doc_id").agg(F.max("total").alias("__total")), "doc_id", "left") if totals is not None else state.withColumn("__total", F.col("__n"))
    every = F.lit(True)
    for b in BUCKETS:
        every = every & F.col(f"__{b}")
    flat = (F.col("__b") == 0) | ((F.col("__k") == F.col("__n")) & every & F.coalesce(F.col("__total") == F.col("__n"), F.lit(False)))
    return q.join(state.select("doc_id", flat.alias("__flat")), "doc_id").withColumn("section", F.when(F.col("__flat"), "_all").otherwise(F.coalesce("bucket", F.lit("_rest")))).drop("__flat")


def cards(questions: DataFrame) -> DataFrame:
    """(doc_id, seq, html) from doc_id, q_ord, q_index, content_md, q_type, multi: numbered 1..n per document in order of number and position.

    The running number goes by ranges of number and position, so a document of any size is counted in many tasks.
    """
    q = questions.withColumn("num", pad_qnum(F.coalesce("q_index", F.lit(0))))
    rank = F.coalesce("q_index", F.lit(0)).cast("bigint") * F.lit(1 << 32) + F.coalesce("q_ord", F.lit(0))
    n = running(q.withColumn("rank", rank), ["doc_id"], ["rank"], seq=("sum", F.lit(1)))
    body = collapse_blanks(wrap_latex(escape_html(F.coalesce("content_md", F.lit("")))))
    html = F.concat(F.lit('<section class="q" id="q'), F.col("seq").cast("string"), F.lit('"><span class="badge">'), badge(F.col("q_type"), F.col("multi")), F.lit("</span><b>"), F.col("num"), F.lit("</b>"), F.lit("<div>"), body, F.lit("</div></section>"))
    return n.select("doc_id", F.col("seq").cast("bigint").alias("seq"), html.alias("html"))


def write_exams(cards: DataFrame, titles: DataFrame, path: str, per_part: int = 1000) -> None:
    """A folder per exam and part with one HTML file of at most ``per_part`` cards, in order between a head and a tail; the job commit is atomic per run.

    Cards are routed by exam and part and sorted within the task, so a part is streamed and no task sees a whole large exam.
    A repeated title row counts once (the least title).
    """
    c = cards.withColumn("part", F.floor((F.col("seq") - 1) / per_part).cast("int"))
    t = titles.groupBy("doc_id").agg(F.min("title").alias("title"))
    part = c.select("doc_id", "part").distinct().join(t, "doc_id", "left")
    head = part.select("doc_id", "part", F.lit(-1).cast("bigint").alias("seq"), F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), escape_html(F.coalesce("title", F.col("doc_id"))), F.lit("</title>")).alias("html"))
    tail = part.select("doc_id", "part", F.lit(1 << 62).alias("seq"), F.lit("<footer></footer>").alias("html"))
    rows = c.select("doc_id", "part", "seq", "html").unionByName(head).unionByName(tail).repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", "seq")
    rows.select("doc_id", "part", F.col("html").alias("value")).write.mode("overwrite").partitionBy("doc_id", "part").text(path)
