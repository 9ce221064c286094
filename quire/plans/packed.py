"""Queries of the packed-value operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators.packed import split_packed
from quire.session import table as t


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return split_packed(t(s, d, "questions"), ["question_id"], "options", only_packed=True).select("question_id", "val_pos").distinct()


def p4_options(s: SparkSession, d: str) -> DataFrame:
    return split_packed(t(s, d, "questions"), ["question_id"], "options").distinct()


QUERIES = {f.__name__: f for f in (p4_found, p4_options)}
ORACLE: dict[str, str] = {}
