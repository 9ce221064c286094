"""Running sums, maxima and last values per document that don't need a whole document in one task.

A document may hold any part of all rows, so a plain window over it is a hot partition. Here each document is cut into
buckets of its order; buckets are aggregated first (map-side combined), the few bucket rows get their carry from a window,
and the rows of a bucket only need their own bucket and its carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = 4096


def running(df: DataFrame, part: list[str], order: list[str], **what: tuple[str, Column]) -> DataFrame:
    """``df`` with a column per keyword: its ('sum' | 'max' | 'last', column) up to and including the row.

    The first column of ``order`` must be a non-negative integer; rows with a null there come first. 'last' is the last
    non-null value. Ties in ``order`` get an unspecified order among themselves, so make it unique.
    """
    # null parts get a key of their own, so that joins and windows share one plain hash partitioning
    keys = {f"__p{i}": F.coalesce(F.col(p).cast("string"), F.lit("\u0000")) for i, p in enumerate(part)}
    b = df.withColumns(keys | {"__b": F.floor(F.coalesce(F.col(order[0]), F.lit(0)) / BUCKET)} | {f"__v_{k}": c for k, (_, c) in what.items()})
    k, at = [*keys, "__b"], F.struct(*order)
    agg = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), at))}
    per = b.groupBy(*k).agg(*[agg[kind](F.col(f"__v_{n}")).alias(f"__c_{n}") for n, (kind, _) in what.items()])
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    win = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    carry = per.select(*k, *[win[kind](F.col(f"__c_{n}")).over(before).alias(f"__c_{n}") for n, (kind, _) in what.items()])
    joined = b.join(carry, k, "left")
    own = W.partitionBy(*k).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = {}
    for n, (kind, _) in what.items():
        here, carried = win[kind](F.col(f"__v_{n}")).over(own), F.col(f"__c_{n}")
        out[n] = F.coalesce(carried, F.lit(0)) + F.coalesce(here, F.lit(0)) if kind == "sum" else F.greatest(here, carried) if kind == "max" else F.coalesce(here, carried)
    return joined.withColumns(out).select(*[c for c in df.columns if c not in what], *what)
