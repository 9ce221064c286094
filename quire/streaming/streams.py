"""Streams: inbox draining, deduplication and windows over late data. Batch operators are used inside them unchanged."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quire.session import shared_dir


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def inbox_stream(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """New files of an inbox; the query's checkpoint is the archive of what has been taken."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).load(path)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Take all that is there and stop; ``each`` gets every micro-batch. A later call goes on where this one ended."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def dedup_stream(stream: DataFrame, keys: list[str], ts: str, delay: str = "3 days") -> DataFrame:
    """First row of each key within the watermark; later repeats beyond it may come through, so state stays bounded."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def count_windows(stream: DataFrame, ts: str, key: str, width: str = "1 day", delay: str = "3 days") -> DataFrame:
    """Rows per key and tumbling window of event time, late rows within the delay included."""
    w = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return w.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def job_states(stream: DataFrame, ts: str, key: str, ttl: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """(key, n, last, state) each time a job's state changes: ``alive`` with its rows so far and the time of the last one, and
    ``expired`` once the watermark is past that time by ``ttl``, when its state is dropped. Rows without a time or key are left out.
    """
    w = stream.withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, delay)
    span = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(k, pdfs, state):  # noqa: ANN001, ANN202
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "n": [n], "last": [pd.Timestamp(last, unit="us")], "state": ["expired"]})
            return
        n, last = state.get if state.exists else (0, 0)
        for p in pdfs:
            n, last = n + len(p), max(last, int(p[ts].max().value // 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last": [pd.Timestamp(last, unit="us")], "state": ["alive"]})

    kind = stream.schema[key].dataType.simpleString()
    return w.select(key, ts).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, last timestamp, state string", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def progress(query) -> dict:  # noqa: ANN001
    """State of a job that runs as a streaming query: queued, processing, done or failed, with its batch and rows so far."""
    failed = query.exception()
    last = query.lastProgress
    state = "failed" if failed else "processing" if query.isActive and last else "queued" if query.isActive else "done"
    return {"state": state, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0, "error": str(failed)[:500] if failed else None}


def collect_stream(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream into a table in the shared folder and read it: all rows (append) or the last result (complete)."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def each(df: DataFrame, batch: int) -> None:
        if mode == "complete":
            df.write.mode("overwrite").parquet(f"{at}/out")
        else:
            df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")  # a repeated batch replaces itself

    drain(stream, f"{at}/checkpoint", each, mode)
    out = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")
    return out
