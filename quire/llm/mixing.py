"""Mixing sources to target weights by weighted fair queueing.

Every use of a document gets a virtual finish time: the tokens of its source up to and including it, in shuffled order
and counting earlier rounds through the source, divided by the source's weight. All uses ordered by that time and cut at
the token budget are the mix. A source whose uses run out before the cut can't reach its share, and the others fill up.

How often a document is surely used follows from the time up to which all uses fit the budget, which the sums per source
give; only the few uses between that time and the one by which the budget must be spent are written out, range-sorted over
all sources and cut. So a source may be repeated any number of times without a row a repetition.

Both running sums (tokens within a source, tokens of the range-sorted uses) are two-level: sums of ranges first, then a
window within a range. No task sees a whole source, so a source may hold any part of all rows. A repeated document counts
once, by a stated rule and not by arrival, so the mix doesn't depend on how the input is partitioned.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import materialise

TOKENIZER = "byte_bpe_50k.tiktoken"
#: documents of a source that a task of the running sum should see
RANGE_ROWS = 100_000


@cache
def _encoding(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _rank_file(name: str, pattern: str | None) -> tuple[str, str]:
    """(path, split pattern) of a rank file.

    A path needs its pattern. A bare name is looked up in the package ``public_tokenizers`` (the vocabulary files that come
    with the machine, described in /opt/tokenizers/README.md), whose pattern is then the default.
    """
    if "/" in name and pattern:
        return name, pattern
    try:
        import public_tokenizers
    except ModuleNotFoundError as e:
        raise ValueError("without the package public_tokenizers, give the path of a rank file and its split pattern") from e
    return (name if "/" in name else public_tokenizers.path(name)), pattern or public_tokenizers.PATTERN


def count_tokens(df: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """``keep`` columns and n_tokens (bigint); null text has 0. Narrow."""
    src = df.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(*_rank_file(tokenizer, pattern))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return src.mapInArrow(run, T.StructType([*(src.schema[k] for k in keep), T.StructField("n_tokens", T.LongType())]))


def source_key(c: str | Column) -> Column:
    """One spelling per source: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def _spent(goal: list[tuple[float, int, int]], time: float) -> float:
    """Tokens that sources (weight, tokens of one round, rounds) are due by a time."""
    return sum(min(w * time, float(n * k)) for w, n, k in goal)


def _time_of(goal: list[tuple[float, int, int]], tokens: float) -> float:
    """The time by which the sources are due so many tokens; infinite if all their rounds have no more."""
    ends = sorted(n * k / w for w, n, k in goal)
    low = 0.0
    for end in ends:
        if _spent(goal, end) > tokens:
            rate = sum(w for w, n, k in goal if n * k / w > low)
            return low + (tokens - _spent(goal, low)) / rate
        low = end
    return math.inf


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, uses): documents of the mix and how often each is used.

    ``docs`` has doc_id, text, source; ``targets`` has source, target_share, max_repeats. Sources are compared in one
    spelling (see source_key); documents of other or null sources, and documents without tokens, aren't used. A repeated
    doc_id counts once: of its rows that could be used, the one with the least (source, hash of the text). The default
    budget is all tokens of the targeted sources; the mix is the longest beginning of the order that does not exceed the
    budget. Shares need not sum to 1; those that are null or not above 0 mean that the source isn't wanted; a null or
    lower max_repeats means 1. Empty tables give no rows. ``tokenizer`` and ``pattern``: see _rank_file.
    """
    spark = docs.sparkSession
    goal = targets.select(source_key("source").alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats")).filter("source IS NOT NULL AND target_share > 0")
    goal = goal.groupBy("source").agg(F.sum("target_share").alias("weight"), F.max("max_repeats").cast("bigint").alias("repeats"))
    d = docs.select("doc_id", source_key("source").alias("source"), "text").withColumn("at", F.xxhash64("text"))
    d = count_tokens(d, "text", ["doc_id", "source", "at"], tokenizer, pattern).filter("n_tokens > 0").join(goal.select("source"), "source", "left_semi")
    one = d.groupBy("doc_id").agg(F.min(F.struct("source", "at", "n_tokens")).alias("r"))
    d = materialise(one.select("doc_id", "r.source", "r.n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("h")))
    # a row a source, of which targets has a few
    size = {r.source: r for r in d.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("longest"), F.count("*").alias("n")).join(goal, "source").collect()}
    if budget is None:
        budget = sum(r.t for r in size.values())
    due = [(r.weight, r.t, r.repeats) for r in size.values()]
    # up to ``sure`` all uses fit; by ``over`` the budget is spent whatever document each source is in the middle of
    sure, over = _time_of(due, budget) * (1 - 1e-9), _time_of(due, budget + sum(r.longest for r in size.values())) * (1 + 1e-9)
    # running tokens within a source, in the order of the hash: ranges of equal width, cut so that a task sees about RANGE_ROWS rows
    bits = min(40, max(0, math.ceil(math.log2(max([1, *(r.n for r in size.values())]) / RANGE_ROWS))))
    d = d.withColumn("part", F.shiftright("h", 63 - bits) if bits else F.lit(0).cast("bigint"))
    part = d.groupBy("source", "part").agg(F.sum("n_tokens").alias("t"))
    before = part.withColumn("before", F.sum("t").over(W.partitionBy("source").orderBy("part")) - F.col("t")).select("source", "part", "before")
    w = W.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    known = spark.createDataFrame([(k, r.weight, r.repeats, r.t) for k, r in size.items()], "source string, weight double, repeats long, size long")
    run = d.join(before, ["source", "part"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(w)).join(F.broadcast(known), "source")

    def finish(k: Column) -> Column:
        return (F.col("upto") + (k - 1) * F.col("size")) / F.col("weight")

    def rounds(time: float) -> Column:
        """Rounds of a document that finish by the time, by the very numbers that are compared later."""
        if math.isinf(time):
            return F.col("repeats")
        k = F.floor((F.lit(time) * F.col("weight") - F.col("upto")) / F.col("size")).cast("bigint") + 1
        k = F.when(finish(k) > time, k - 1).when(finish(k + 1) <= time, k + 1).otherwise(k)
        return F.greatest(F.lit(0), F.least("repeats", k))

    use = materialise(run.select("doc_id", "source", "n_tokens", "weight", "repeats", "size", "upto", rounds(sure).alias("k0"), rounds(over).alias("k1")))
    left = budget - (use.agg(F.sum(F.col("n_tokens") * F.col("k0"))).first()[0] or 0)
    base = use.filter("k0 > 0").select("doc_id", "source", "n_tokens", F.col("k0").alias("uses"))
    # the edge holds at most twice the tokens of every source's longest document, whatever the collection has
    edge = use.filter("k1 > k0").withColumn("round", F.explode(F.sequence(F.col("k0") + 1, F.col("k1")))).withColumn("finish", finish(F.col("round")))
    order = ["finish", "source", "doc_id", "round"]
    edge = materialise(edge.select("n_tokens", *order).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = edge.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    carry = sums.withColumn("before", F.sum("t").over(W.orderBy("part")) - F.col("t")).select("part", "before")  # a row a partition
    w = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    taken = edge.join(F.broadcast(carry), "part").withColumn("run", F.col("before") + F.sum("n_tokens").over(w)).filter(F.col("run") <= left)
    every = base.unionByName(taken.select("doc_id", "source", "n_tokens", F.lit(1).cast("bigint").alias("uses")))
    return every.groupBy("doc_id", "source", "n_tokens").agg(F.sum("uses").alias("uses"))


def mix_shares(docs: DataFrame, targets: DataFrame, **kw) -> DataFrame:
    """(source, target_share, actual_share, mix_tokens, n_docs, n_uses, is_met) per target, also if nothing of it could be used.

    ``is_met``: the actual share is within half a percent point of the target (shares scaled to sum to 1).
    """
    mixed = mix(docs, targets, **kw)
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("mix_tokens"), F.count("*").alias("n_docs"), F.sum("uses").alias("n_uses"))
    goal = targets.filter("target_share > 0 AND source IS NOT NULL").groupBy(source_key("source").alias("source")).agg(F.sum("target_share").alias("w"))
    r = goal.join(got, "source", "left").fillna(0, ["mix_tokens", "n_docs", "n_uses"])
    every = W.partitionBy()  # a row a target
    r = r.withColumn("target_share", F.col("w") / F.sum("w").over(every)).withColumn("actual_share", F.coalesce(F.col("mix_tokens") / F.nullif(F.sum("mix_tokens").over(every), F.lit(0)), F.lit(0.0)))
    return r.select("source", "target_share", "actual_share", "mix_tokens", "n_docs", "n_uses", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.005).alias("is_met"))
