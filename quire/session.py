"""Session and storage helpers that behave alike in tests and on a cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where it is unset a local session, as in tests, gets a folder of its own; on a cluster that is an error, as executors
    would each write to their own disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        folder = sc._jsc.sc().getCheckpointDir()
        at = folder.get() if folder.isDefined() else None
        if not at and not spark.conf.get("spark.master", sc.master).split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage by a table written to the shared folder, with a folder for each value of ``by``; survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(at)
    to = df.write.mode("overwrite").option("compression", "zstd")
    (to.partitionBy(by) if by else to).parquet(at)
    return spark.read.schema(df.schema).parquet(at) if by else spark.read.parquet(at)


def read_part(path: str, columns: list[str]) -> pa.Table:
    """One file of a materialised table, read within a task; any file system that Arrow knows."""
    store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return pq.read_table(at, columns=columns, filesystem=store, partitioning=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> int:
    """Delete the tables that this session materialised in the shared folder; call it when their results are no longer needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for at in _written.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(at)
        done += bool(p.getFileSystem(conf).delete(p, True))
    return done
