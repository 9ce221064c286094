"""Question bank records: deduplication, idempotent insert, job and version tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import rx
from quire.functions.text import semver
from quire.operators import setjoin
from quire.session import materialise


def content_key(c: Column) -> Column:
    """SHA-256 of a text in lower case without white space."""
    return F.sha2(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{rx.S}+", ""), 256)


def dedup_exact(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """df with ``content_key``, ``kept_id`` (the smallest id of equal texts) and ``is_new``.

    The smallest id per key comes from a map-side combined aggregate, so a text that a third of all rows share is no
    hot window; the join back is split by the adaptive planner if it is skewed.
    """
    k = df.withColumn("content_key", content_key(F.col(text)))
    first = k.groupBy("content_key").agg(F.min(id_col).alias("kept_id"))
    return k.join(first, "content_key").withColumn("is_new", F.col("kept_id") == F.col(id_col))


def insert_new(bank: DataFrame, drafts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, summary): drafts whose text isn't in the bank, one per text. Running it again appends nothing."""
    d = drafts.withColumn("__key", content_key(F.col(text)))
    known = bank.select(content_key(F.col(text)).alias("__key")).distinct()
    new = d.join(known, "__key", "left_anti").dropDuplicates(["__key"]).drop("__key")
    both = d.select(F.lit(1).alias("d"), F.lit(0).alias("i")).unionByName(new.select(F.lit(0).alias("d"), F.lit(1).alias("i")))
    total = both.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("drafts"), F.coalesce(F.sum("i"), F.lit(0)).alias("inserted"))
    return new, total.withColumn("skipped", F.col("drafts") - F.col("inserted"))


def insert_similar(bank: DataFrame, drafts: DataFrame, text: str, id_col: str, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, is_new, similarity, reason, match_id): what becomes of every draft that is offered to the bank.

    ``exact``: the same text (see content_key) is in the bank or in a draft of a smaller id; ``near_dup``: word shingles
    overlap by ``threshold`` or more with such a row; else ``new``. ``similarity`` is 1 for exact copies, the largest
    overlap for near ones and 0 for new drafts; ``match_id`` is the row it was found with. The bank's ids need not differ
    from the drafts'. Null text counts as empty.
    """
    side = lambda df, k: df.select(F.struct(F.lit(k).alias("side"), F.col(id_col).alias("id")).alias("id"), F.col(text).alias("text"))
    every = side(bank, 0).unionByName(side(drafts, 1)).withColumn("key", F.unhex(content_key(F.col("text"))))
    # written once, with a digest of each row's shingles: the branches below read narrow columns of it
    every = materialise(set_digests(every, words))
    first = every.groupBy("key").agg(F.min("id").alias("first"))
    mine = every.filter("id.side = 1").select("id", "key").join(first, "key").select("id", F.when(F.col("first") != F.col("id"), F.col("first")).alias("same"))
    equal = every.filter("digest IS NOT NULL").select("id", "digest")
    kept = equal.groupBy("digest").agg(F.min("id").alias("kept"), F.max("id").alias("last")).filter("kept != last").select("digest", "kept")
    member = materialise(equal.join(kept, "digest").filter("id != kept").select("id", "digest", "kept"))
    rep = every.filter("digest IS NOT NULL").select("id", "digest", "text").join(member.select("id", "digest"), ["id", "digest"], "left_anti").select("id", "text")
    cand = setjoin.candidates(rep, lambda arr, rank: word_sets(arr, words, rank), threshold).filter("b.side = 1")
    pairs = set_similarity(cand, every.select("id", "text"), words).filter(F.col("similarity") >= threshold - 1e-9).select(F.col("b").alias("id"), "similarity", F.col("a").alias("other"))
    near = member.filter("id.side = 1").select("id", F.lit(1.0).alias("similarity"), F.col("kept").alias("other")).unionByName(pairs)
    near = near.groupBy("id").agg(F.max("similarity").alias("similarity"), F.min_by("other", F.struct(-F.col("similarity"), F.col("other"))).alias("other"))
    r = mine.join(near, "id", "left")
    reason = F.when(F.col("same").isNotNull(), "exact").when(F.col("other").isNotNull(), "near_dup").otherwise("new")
    return r.select(F.col("id.id").alias("id"), (reason == "new").alias("is_new"), F.when(F.col("same").isNotNull(), 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"), reason.alias("reason"), F.coalesce("same.id", "other.id").alias("match_id"))


TOKEN = re.compile("[a-zà-ÿ0-9]+|[一-鿿]")


def word_hashes(texts: Iterable[str | None], words: int, known: dict[str, int]) -> Iterator[np.ndarray]:
    """For each text the hashes of its runs of ``words`` words (an ideograph is a word); ``known`` keeps the words' hashes."""
    for t in texts:
        w = TOKEN.findall(t.lower()) if t else []
        code = np.array([known.get(x) or known.setdefault(x, xxhash.xxh64_intdigest(x) or 1) for x in w], np.uint64)
        h = np.zeros(max(0, len(w) - words + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(words if len(h) else 0):
                h = (h ^ code[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        if len(known) > 1_000_000:
            known.clear()
        yield h


def shingle_sets(df: DataFrame, text: str, id_col: str, words: int) -> DataFrame:
    """(id, s): sorted distinct hashes of runs of ``words`` words (an ideograph is a word), a batch at a time. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            sets = [np.unique(h.view(np.int64)) for h in word_hashes(b.column(1).to_pylist(), words, known)]
            off = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["id", "s"])

    return df.select(F.col(id_col).alias("id"), text).mapInArrow(run, T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("s", T.ArrayType(T.LongType()))]))


def set_digests(df: DataFrame, words: int) -> DataFrame:
    """df (id, text, key) with ``digest``: 128 bits of the set of word shingles, null where there are none. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            got = [xxhash.xxh128_digest(np.unique(h).tobytes()) if len(h) else None for h in word_hashes(b.column(1).to_pylist(), words, known)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=["id", "text", "key", "digest"])

    return df.select("id", "text", "key").mapInArrow(run, T.StructType([df.schema["id"], df.schema["text"], df.schema["key"], T.StructField("digest", T.BinaryType())]))


def word_sets(arr: pa.Array, words: int, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of every text as setjoin takes them: 50 bits of their hashes."""
    sets = list(word_hashes(arr.to_pylist(), words, {}))
    v = setjoin.mix(np.concatenate([np.zeros(0, np.uint64), *sets])) >> np.uint64(14)
    return setjoin.distinct(setjoin.ranked(v, rank), np.repeat(np.arange(len(sets), dtype=np.uint64), [len(x) for x in sets]), len(sets))


def set_similarity(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """pairs (a, b) with ``similarity``, the exact overlap of their texts' word shingles; texts (id, text) are read for the ids of pairs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            each = zip(*(word_hashes(b.column(i).to_pylist(), words, known) for i in (2, 3)))
            both = [(x, y, len(np.intersect1d(x, y))) for x, y in ((np.unique(x), np.unique(y)) for x, y in each)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k / max(1, len(x) + len(y) - k) for x, y, k in both], pa.float64())], names=["a", "b", "similarity"])

    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = materialise(texts.join(need, "id", "left_semi").distinct())
    both = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("similarity", T.DoubleType())]))


def dedup_jaccard(df: DataFrame, text: str, id_col: str, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b, similarity): pairs of different texts whose word shingles overlap by ``threshold`` or more; exact.

    Prefix filter: two such sets must share one of their first n - ceil(threshold * n) + 1 shingles in any fixed order.
    The order is by how many sets hold a shingle, rarest first, so that shared phrases stay out of the prefixes; those in
    one set only are not joined. Equal sets are joined once, through the smallest id of each: the pairs are those of
    representatives, and ``jaccard_members`` gives the other members. Texts shorter than ``words`` words have no shingles
    and no pairs.
    """
    s = shingle_sets(df, text, id_col, words).filter(F.size("s") > 0)
    # written once: four branches below read it, and the texts are shingled a single time
    rep = materialise(s.groupBy("s").agg(F.min("id").alias("id")).withColumn("n", F.size("s")))
    tok = rep.select("id", "n", F.explode("s").alias("h"))
    held = tok.groupBy("h").agg(F.count("*").alias("held"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("held", "h"))
    head = tok.join(held, "h").withColumn("rank", rank).filter(f"rank <= n - CAST(ceil({threshold} * n - 1e-9) AS INT) + 1 AND held > 1").select("id", "n", "h")
    a, b = head.select("h", F.col("id").alias("id_a"), F.col("n").alias("na")), head.select("h", F.col("id").alias("id_b"), F.col("n").alias("nb"))
    cand = a.join(b, "h").filter((F.col("id_a") < F.col("id_b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).select("id_a", "id_b").distinct()
    full = cand.join(rep.select(F.col("id").alias("id_a"), F.col("s").alias("sa")), "id_a").join(rep.select(F.col("id").alias("id_b"), F.col("s").alias("sb")), "id_b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.withColumn("similarity", both / (F.size("sa") + F.size("sb") - both)).filter(F.col("similarity") >= threshold - 1e-9).select("id_a", "id_b", "similarity")


def jaccard_members(df: DataFrame, text: str, id_col: str, words: int = 5) -> DataFrame:
    """(id, kept_id, n_equal): for every row the smallest id with the same word shingles, its representative in ``dedup_jaccard``, and how many rows have them.

    Rows of one representative are similar by 1; those of two that ``dedup_jaccard`` pairs are as similar as these. One row
    a member, so a group of copies grows in proportion. Texts shorter than ``words`` words have no shingles and stand for
    themselves.
    """
    s = shingle_sets(df, text, id_col, words)
    same = s.filter(F.size("s") > 0).groupBy("s").agg(F.min("id").alias("kept_id"), F.count("*").alias("n_equal"))
    return s.join(same, "s", "left").select("id", F.coalesce("kept_id", "id").alias("kept_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))


def recent(df: DataFrame, ts: str, now: Column, hours: float) -> DataFrame:
    """Rows no older than ``hours`` before ``now``; unknown times are left out."""
    return df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))


def live_jobs(df: DataFrame, ts: str, key: str, now: Column, ttl_hours: float = 1.0, most: int = 1000) -> DataFrame:
    """The newest ``most`` jobs within their time to live. The limit is the feature: a bounded job table."""
    return recent(df, ts, now, ttl_hours).orderBy(F.desc(ts), F.desc(key)).limit(most)


def throttled(last: Column, now: Column, forced: Column, hours: int = 24) -> Column:
    """Whether a check must wait: the last one was less than ``hours`` ago. Unreadable times and forced checks don't wait."""
    at = F.try_to_timestamp(last)
    return F.coalesce(~F.coalesce(forced, F.lit(False)) & (at > now - F.expr(f"INTERVAL {hours} HOURS")), F.lit(False))


def is_newer(latest: Column, current: Column) -> Column:
    """latest > current by version numbers; null if either can't be read."""
    return semver(latest) > semver(current)


def fetch_paper(bank: DataFrame, paper: str, since: Column, name: str = "source_paper", at: str = "created_at", order: str = "source_qnum") -> DataFrame:
    """Rows of a paper since a time; if there are none, all rows of the paper. In order of time and number.

    Whether there are any is asked first and stops at the first row; then one branch is planned.
    """
    own = bank.filter(F.col(name) == paper)
    young = own.filter(F.col(at) >= since)
    return (own if young.isEmpty() else young).orderBy(at, order)


def preflight(files: DataFrame, max_bytes: int = 100 << 20, writable: bool = True, free_bytes: int | None = None, min_free: int = 200 << 20) -> DataFrame:
    """files (path, length, ...) with ``error``: the first failed check, or null. Nothing is read but metadata.

    ``writable`` and ``free_bytes`` tell of the output folder (see sources.files.output_state); unknown space is enough.
    """
    bad = F.when(F.col("path").isNull(), "FILE_NOT_FOUND").when(~F.lower("path").endswith(".pdf"), "NOT_A_PDF").when(F.col("length") > max_bytes, "FILE_TOO_LARGE").when(F.coalesce(F.col("encrypted"), F.lit(False)), "PDF_ENCRYPTED")
    return files.withColumn("error", bad.when(F.lit(not writable), "OUTPUT_NOT_WRITABLE").when(F.lit(free_bytes is not None and free_bytes < min_free), "DISK_FULL"))


def latest_per_key(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row a key: the one delivered last (ties by all columns), by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(ts, *[c for c in rest if c != ts])).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order (not just any)."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
