"""Versioned tables: changes that happen whole or not at all, an audit log, and compositions that clean up after a failure.

A table is a folder of numbered versions. A version is written beside the others and becomes the current one by a single
rename; readers take the highest one, so they see all of a change or nothing of it, and a failed job leaves no trace but a
staging folder that the next commit removes. The rename is atomic on file systems that have one (HDFS, local disks).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, ascending; empty for a table that was never written."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; a table that was never written is an error."""
    return spark.read.parquet(f"{path}/v{versions(spark, path)[-1]}")


def commit(df: DataFrame, path: str, keep: int = 2) -> int:
    """Write ``df`` as the next version and return its number. Of the older ones the last ``keep`` - 1 stay, for readers that have begun."""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    try:
        df.write.parquet(staging)
        done = versions(spark, path)
        new = (done[-1] if done else 0) + 1
        if not fs.rename(at(staging), at(f"{path}/v{new}")):
            raise OSError(f"version {new} of {path} can't be committed")
    except Exception:
        fs.delete(at(staging), True)
        raise
    for old in (done + [new])[:-keep]:
        fs.delete(at(f"{path}/v{old}"), True)
    return new


def update_batch(spark: SparkSession, path: str, updates: DataFrame, key: str, valid: Column | None = None) -> int:
    """Replace the columns of ``updates`` in the rows with its keys, all together; the number of rows that were changed.

    If one update has a null key, a key that occurs twice or fails ``valid``, nothing is changed and the result is 0, as
    it is if none matches. Updates of unknown keys change nothing. Columns that the table lacks are ignored.
    """
    table = current(spark, path)
    cols = [c for c in updates.columns if c != key and c in table.columns]
    ok = F.col(key).isNotNull() & (F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True))
    u = updates.withColumn("__ok", ok).groupBy(key).agg(F.count("*").alias("__n"), F.bool_and("__ok").alias("__ok"), F.first(F.struct(*cols) if cols else F.struct(F.lit(1).alias("none"))).alias("__u"))
    state = u.agg(F.bool_or(~F.col("__ok") | (F.col("__n") > 1)).alias("bad")).first()
    changed = 0 if state.bad is None or state.bad else u.join(table.select(key), key, "left_semi").count()
    if not changed:
        return 0
    merged = table.join(u.drop("__n", "__ok"), key, "left")
    commit(merged.select(*[F.when(F.col("__u").isNotNull(), F.col(f"__u.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in table.columns]), path)
    return changed


def append_log(spark: SparkSession, path: str, **entry: str | int | None) -> None:
    """One row of an audit table: ``entry`` and the time. Never fails: what can't be logged is left out."""
    try:
        row = spark.createDataFrame([tuple(None if v is None else str(v) for v in entry.values())], ", ".join(f"{k} string" for k in entry))
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001, S110
        pass


def compose(spark: SparkSession, path: str, tables: dict[str, DataFrame], write: Callable[[str], None], log: str | None = None, **entry: str | int | None) -> dict[str, int]:
    """Commit several tables and an output together: (table: version). If any step fails all that was done is undone.

    ``tables`` are committed under ``path`` by name; ``write`` gets the folder of the output. After a failure the versions
    that were added are deleted, so that the former ones are current again, the output is removed, the failure is logged
    and raised.
    """
    fs, at = _fs(spark, path)
    output = f"{path}/output-{uuid.uuid4().hex}"
    done: dict[str, int] = {}
    try:
        for name, df in tables.items():
            done[name] = commit(df, f"{path}/{name}")
        write(output)
    except Exception as e:
        for name, v in done.items():
            fs.delete(at(f"{path}/{name}/v{v}"), True)
        fs.delete(at(output), True)
        if log:
            append_log(spark, log, **entry, status="failed", detail=str(e)[:500])
        raise
    if log:
        append_log(spark, log, **entry, status="done", detail=output)
    return done
