"""Near-duplicate records: an exact set-similarity join of the distinct character shingles of every record.

Candidates come from ``operators.setjoin``: prefixes of size groups, with bounds that hold for every pair, and parity
sketches. What is left is verified by exact similarity. Records with equal text are joined once, through a
representative.

The named pigeonhole over sketch segments has no guarantee here: at a threshold of 0.6 it needs segments of two shingles, of
which many are empty and say nothing; wider segments lost most pairs of short texts. The price of the guarantee: where
all texts are made of the same phrases, the work grows with the square of the collection (README has measured figures).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.arrowtext import codepoints, owners
from quire.operators.setjoin import M1, candidates, distinct, mix, parity_bits, ranked
from quire.session import materialise

__all__ = ["parity_bits", "question_classes", "question_texts", "shingles", "similar_pairs", "similar_questions"]


def windows(cp: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every window of k characters that lies within a row, in order of place; hashes of 50 bits."""
    n, c = len(cp) - k + 1, cp.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * M1 + c[i : n + i]
    h = mix(h) >> np.uint64(14)
    own = owners(off)
    ok = own[:n] == own[k - 1 :]
    return h[ok], own[:n][ok].astype(np.uint64)


def shingles(arr: pa.Array, k: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct k-character shingles of every row as 50-bit hashes, sorted within the row. Rows shorter than k have none.

    With ``rank`` (see shingle_order) the class in the hash is replaced by its rank, so that the rarest come first.
    """
    cp, off = codepoints(arr)
    if len(cp) < k:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    h, own = windows(cp, off, k)
    return distinct(ranked(h, rank), own, len(off) - 1)


def jaccard_rows(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """Exact similarity of the shingle sets of a[i] and b[i]; two rows without shingles are 1 if equal, else 0."""
    x, xo = shingles(a, k)
    y, yo = shingles(b, k)
    own = np.concatenate([owners(xo), owners(yo)])
    v = np.concatenate([x, y])
    o = np.lexsort((v, own))
    v, own = v[o], own[o]
    both = np.zeros(len(a), np.int64)
    if len(v) > 1:
        same = (v[1:] == v[:-1]) & (own[1:] == own[:-1])
        both = np.bincount(own[1:][same], minlength=len(a))
    union = np.diff(xo) + np.diff(yo) - both
    return np.where(union > 0, both / np.maximum(union, 1), 0.0)


def similar_pairs(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.6, group: int = 25_000_000) -> tuple[DataFrame, DataFrame]:
    """(pairs, copies): pairs (a, b, similarity), a < b, of representatives, and copies (id, rep) of equal texts.

    A representative is the smallest id of the records with equal text; records without a copy aren't in ``copies``.
    Null text counts as empty; texts shorter than ``k`` characters have no shingles and are similar only to equal ones.
    A repeated id counts once per distinct text. Other columns are ignored. ``group`` is how many shingles of records a
    task compares with as many others; it doesn't change the result.
    """
    return _similar(df, id_col, text_col, k, threshold, group)[:2]


def _similar(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.6, group: int = 25_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """similar_pairs and the table (id, text, h1, h2) of the texts and their hashes."""
    text = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = materialise(text.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64("text", F.lit(1))))
    same = text.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep != last").select("h1", "h2", "rep")
    copies = materialise(text.select("id", "h1", "h2").join(same, ["h1", "h2"]).select("id", "rep").distinct())
    rep_text = text.select("id", "text").join(copies.filter("id != rep").select("id"), "id", "left_anti")
    cand = candidates(rep_text, lambda arr, rank: shingles(arr, k, rank), threshold, group)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = jaccard_rows(b.column(2), b.column(3), k)
            ok = pa.array(s >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(s).filter(ok)], names=["a", "b", "similarity"])

    # few pairs are left: take the texts of their records only
    need = cand.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = materialise(text.select("id", "text").join(need, "id", "left_semi").distinct())
    both = cand.join(some.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    pair = T.StructType([T.StructField("a", text.schema["id"].dataType), T.StructField("b", text.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])
    return both.select("a", "b", "ta", "tb").mapInArrow(verify, pair), copies, text


def question_texts(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question_id, text): label and text blocks in order, lower case, without white space; one shuffle.

    Questions and blocks are grouped together by (doc_id, q_ord), redelivered rows collapse in the sets. A null label
    is empty; a question without blocks is its label; blocks outside questions are left out.
    """
    q = questions.select("doc_id", "q_ord", F.col("question_id"), F.coalesce("label", F.lit("")).alias("label"), F.lit(None).cast("struct<o:int,i:bigint,c:string>").alias("block"))
    b = blocks.filter((F.col("block_type") == "text") & F.col("q_ord").isNotNull()).select("doc_id", "q_ord", F.lit(None).cast("bigint").alias("question_id"), F.lit(None).cast("string").alias("label"), F.struct(F.col("block_ord").cast("int").alias("o"), F.col("block_id").cast("bigint").alias("i"), F.coalesce("content", F.lit("")).alias("c")).alias("block"))
    g = q.unionByName(b).groupBy("doc_id", "q_ord").agg(F.collect_set(F.when(F.col("question_id").isNotNull(), F.struct("question_id", "label"))).alias("qs"), F.collect_set("block").alias("bs"))
    body = F.concat_ws("", F.transform(F.array_sort("bs"), lambda x: x["c"]))
    return g.filter(F.size("qs") > 0).select(F.explode("qs").alias("q"), body.alias("body")).select(F.col("q.question_id").alias("question_id"), F.regexp_replace(F.lower(F.concat("q.label", "body")), r"(?U)\s+", "").alias("text"))


def similar_questions(questions: DataFrame, blocks: DataFrame, **kw) -> DataFrame:
    """(question_id_a, question_id_b), a < b: pairs of different questions whose texts are similar, copies expanded.

    Where every id has one text a pair comes out once as it is. Only pairs that a repeated id with several texts may give
    again are made distinct, so the expanded pairs, which may be many times the input, aren't shuffled.
    """
    pairs, copies, text = _similar(question_texts(questions, blocks), "question_id", "text", **kw)
    hashes = F.struct("h1", "h2")
    odd = materialise(text.groupBy("id").agg(F.min(hashes).alias("lo"), F.max(hashes).alias("hi")).filter("lo != hi").select("id"))

    def expanded(pairs: DataFrame, copies: DataFrame) -> DataFrame:
        a, b = copies.select(F.col("rep").alias("a"), F.col("id").alias("a2"), F.col("odd").alias("oa")), copies.select(F.col("rep").alias("b"), F.col("id").alias("b2"), F.col("odd").alias("ob"))
        wide = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"), (F.col("odd") | F.coalesce("oa", F.lit(False)) | F.coalesce("ob", F.lit(False))).alias("odd"))
        same = copies.select("rep", F.col("id").alias("x"), F.col("odd").alias("oa")).join(copies.select("rep", F.col("id").alias("y"), F.col("odd").alias("ob")), "rep").filter("x < y").select("x", "y", (F.col("oa") | F.col("ob")).alias("odd"))
        return wide.unionByName(same).filter("x != y").select(F.least("x", "y").alias("question_id_a"), F.greatest("x", "y").alias("question_id_b"), "odd")

    if odd.isEmpty():
        return expanded(pairs.select("a", "b", F.lit(False).alias("odd")), copies.withColumn("odd", F.lit(False))).drop("odd")
    # an id is odd if it, or the representative of one of its texts, has several texts
    mark = lambda c: odd.select(F.col("id").alias(c), F.lit(True).alias(f"odd_{c}"))
    any_of = lambda *c: F.coalesce(*[F.col(f"odd_{x}") for x in c], F.lit(False)).alias("odd")
    near = materialise(pairs.join(mark("a"), "a", "left").join(mark("b"), "b", "left").select("a", "b", any_of("a", "b")))
    copies = copies.join(mark("id"), "id", "left").join(mark("rep"), "rep", "left").select("id", "rep", any_of("id", "rep"))
    # an id's copies of several representatives are all odd, as it is odd itself
    every = expanded(near, materialise(copies))
    return every.filter("NOT odd").drop("odd").unionByName(every.filter("odd").drop("odd").distinct())


def question_classes(questions: DataFrame, blocks: DataFrame, **kw) -> DataFrame:
    """(question_id, rep, n_copies, n_links): every question with the representative of its text, how many questions have that
    text, and to how many different texts it is similar. A row a question, so copies are never expanded into pairs."""
    texts = materialise(question_texts(questions, blocks))
    pairs, copies = similar_pairs(texts, "question_id", "text", **kw)
    pairs = materialise(pairs.select("a", "b"))
    link = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    size = copies.groupBy("rep").agg(F.count("*").alias("n_copies"))
    r = texts.select(F.col("question_id").alias("id")).distinct().join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    r = r.join(size, "rep", "left").join(link, "rep", "left")
    return r.select(F.col("id").alias("question_id"), "rep", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
