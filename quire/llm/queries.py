"""Registered queries of the training-data operators. Each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import canonical, leak, mixing, neardup, ocr, topics, truncation
from quire.session import table as t

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(t(s, d, "blocks"), t(s, d, "exams")).filter("evidence IS NOT NULL").select("block_id").distinct()


def p1_sources(s: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_by_source(t(s, d, "blocks"), t(s, d, "exams"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return ocr.scan_noise(t(s, d, "blocks"), t(s, d, "exams"))


def p2_repaired(s: SparkSession, d: str) -> DataFrame:
    return ocr.repair_scanned(t(s, d, "blocks"), t(s, d, "exams")).withColumn("noise", F.array_join("noise", ","))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return canonical.same_look_pairs(t(s, d, "blocks"), "block_id", "content")


def p3_canonical(s: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_text(t(s, d, "blocks"), "content", keep=["block_id"]).dropDuplicates(["block_id"])


def p3_classes(s: SparkSession, d: str) -> DataFrame:
    """Blocks that look like differently stored ones, by class."""
    return canonical.same_look_classes(t(s, d, "blocks"), "block_id", "content")


def p5_classes(s: SparkSession, d: str) -> DataFrame:
    """Questions with their representative and the number of links that it has to other texts."""
    return neardup.question_classes(t(s, d, "questions"), t(s, d, "blocks"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return neardup.similar_questions(t(s, d, "questions"), t(s, d, "blocks"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return leak.eval_leaks(t(s, d, "documents"), t(s, d, "eval_items")).select("doc_id", "item_id").distinct()


def p6_reordered(s: SparkSession, d: str) -> DataFrame:
    """Documents whose tiles cover at least half of an item, in whatever order its parts stand."""
    return leak.eval_leaks(t(s, d, "documents"), t(s, d, "eval_items"), min_coverage=0.5).filter("coverage >= 0.5").select("doc_id", "item_id", F.round("coverage", 6).alias("coverage")).distinct()


def p6_items(s: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents that leak it and the most of it found in one."""
    hit = leak.eval_leaks(t(s, d, "documents"), t(s, d, "eval_items")).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.round(F.max("coverage"), 6).alias("max_coverage"))
    return t(s, d, "eval_items").select("item_id", "exam_set").join(hit, "item_id", "left").fillna(0, ["n_docs", "max_coverage"])


def p7_mix(s: SparkSession, d: str) -> DataFrame:
    return mixing.mix(t(s, d, "documents"), t(s, d, "mix_targets"))


def p7_shares(s: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(t(s, d, "documents"), t(s, d, "mix_targets"))


def _subjects(s: SparkSession, d: str) -> DataFrame:
    return topics.document_subjects(t(s, d, "documents"), t(s, d, "subject_labels"), t(s, d, "subject_areas"), t(s, d, "eval_items"))


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return _subjects(s, d).select("doc_id", "subject").distinct()


def p8_makeup(s: SparkSession, d: str) -> DataFrame:
    """Documents, characters and expected documents (sum of posteriors) of each subject."""
    return _subjects(s, d).join(t(s, d, "documents").select("doc_id", "n_chars"), "doc_id").groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum("probability").alias("expected_docs"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_sources, p2_found, p2_repaired, p3_found, p3_canonical, p3_classes, p5_found, p5_classes, p6_found, p6_reordered, p6_items, p7_mix, p7_shares, p8_found, p8_makeup)}


def oracle_sql() -> dict[str, str]:
    """None: decoding, tokenising, look-alike folding and similarity search aren't expressible in SQL; tests/llm compares with brute force."""
    return {}
