"""Relational coverage over the star schema and the event table: scans, joins, aggregates, windows, set operations, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.session import table as t
from quire.streaming import streams


def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    p = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t(s, d, "lineitem").filter("l_shipdate <= '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(p), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


def nation_revenue(s: SparkSession, d: str) -> DataFrame:
    """Revenue by region and nation of the supplier, with subtotals; the dimension tables are small and joined first."""
    geo = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = t(s, d, "supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    rev = t(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    return rev.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).rollup("r_name", "n_name").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.count("*").alias("suppliers"))


def top_orders(s: SparkSession, d: str) -> DataFrame:
    """The three dearest orders of each market segment."""
    o = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = W.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("c_mktsegment", "o_orderkey", "o_totalprice", "rank")


def idle_customers(s: SparkSession, d: str) -> DataFrame:
    """Customers without a large order."""
    return t(s, d, "customer").join(t(s, d, "orders").filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_acctbal")


def part_sets(s: SparkSession, d: str) -> DataFrame:
    """Parts that were returned and also shipped open, but never refused."""
    p = lambda f: t(s, d, "lineitem").filter(f).select("l_partkey")
    return p("l_returnflag = 'R'").intersect(p("l_linestatus = 'O'")).exceptAll(p("l_quantity < 5").distinct())


def status_pivot(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: runs of events less than an hour apart."""
    e = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def event_running(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"), F.lag("event_type").over(w).alias("previous"), F.ntile(4).over(w).alias("quarter"))


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    e = streams.table_stream(s, f"{d}/events.parquet")
    return streams.collect_stream(s, streams.dedup_stream(e, ["event_id"], "ts", "400 days").select("event_id", "user_id"))


def stream_jobs(s: SparkSession, d: str) -> DataFrame:
    """Last state of every user's activity: rows, time of the last one, and whether it was dropped after a day without any.

    Updates of a state come one after another, so the row with most events is its last one; the files are one batch.
    """
    e = streams.table_stream(s, f"{d}/events.parquet")
    r = streams.collect_stream(s, streams.job_states(e.select("ts", "user_id"), "ts", "user_id", ttl="1 day"))
    return r.groupBy("user_id").agg(F.max("n").alias("n"), F.max("last").cast("timestamp_ntz").alias("last"), F.bool_or(F.col("state") == "expired").alias("expired"))


def stream_windows(s: SparkSession, d: str) -> DataFrame:
    e = streams.table_stream(s, f"{d}/events.parquet")
    r = streams.collect_stream(s, streams.count_windows(e, "ts", "event_type"), "complete")
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (pricing_summary, nation_revenue, top_orders, idle_customers, part_sets, status_pivot, event_sessions, event_running, stream_dedup, stream_jobs, stream_windows)}
_REV = "round(sum(rev), 2) AS revenue, count(*) AS suppliers"
ORACLE = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "nation_revenue": f"WITH r AS (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem GROUP BY ALL) SELECT r_name, n_name, {_REV} FROM r JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "top_orders": "SELECT c_mktsegment, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 3",
    "idle_customers": "SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "part_sets": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5",
    "status_pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM n GROUP BY user_id, k",
    "event_running": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running, lag(event_type) OVER w AS previous, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "stream_dedup": "SELECT DISTINCT event_id, user_id FROM events",
    "stream_jobs": "SELECT user_id, count(*) AS n, date_trunc('microsecond', max(ts)) AS last, max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) AS expired FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
