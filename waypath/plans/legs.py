"""Stand-in facts over the driver's tables: legs of tails between places, and observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.session import table


class Registry:
    """Queries of a module with their SQL; a query's name is its function's."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return add


def legs(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its order, supplier and customer as legs. A cancelled leg has no times."""
    l, o, s, c = (table(spark, d, t) for t in ("lineitem", "orders", "supplier", "customer"))
    s, c = s.select("s_suppkey", "s_nationkey"), c.select("c_custkey", "c_nationkey")
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    cancelled = F.col("l_partkey") % 41 == 0
    dep = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("l_linenumber") * 97 + F.col("l_quantity") * 13).cast("int"))
    arr = dep + F.make_dt_interval(mins=(30 + F.col("l_partkey") % 300).cast("int"))
    return rows.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("leg_id"),
        F.col("l_suppkey").alias("tail"),
        F.concat(F.lit("C"), (F.col("l_partkey") % 9).cast("string")).alias("carrier"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("origin"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("dest"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.when(~cancelled, dep).alias("dep_ts"),
        F.when(~cancelled, arr).alias("arr_ts"),
        F.when(~cancelled, F.col("l_quantity") - 15).alias("dep_delay"),
        F.when(~cancelled, F.col("l_quantity") - 18 + F.col("l_discount") * 100).alias("arr_delay"),
        cancelled.cast("int").alias("cancelled"),
        (F.col("l_partkey") % 43 == 0).cast("int").alias("diverted"),
        F.col("l_extendedprice").alias("distance"),
        F.col("l_tax").alias("wind"),
    )


LEGS = """legs AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS leg_id, l_suppkey AS tail, 'C' || (l_partkey % 9) AS carrier,
         'N' || s_nationkey AS origin, 'N' || c_nationkey AS dest, CAST(o_orderdate AS DATE) AS day,
         CASE WHEN l_partkey % 41 <> 0 THEN o_orderdate + to_minutes(CAST(l_linenumber * 97 + l_quantity * 13 AS BIGINT)) END AS dep_ts,
         CASE WHEN l_partkey % 41 <> 0 THEN o_orderdate + to_minutes(CAST(l_linenumber * 97 + l_quantity * 13 AS BIGINT)) + to_minutes(30 + l_partkey % 300) END AS arr_ts,
         CASE WHEN l_partkey % 41 <> 0 THEN l_quantity - 15 END AS dep_delay,
         CASE WHEN l_partkey % 41 <> 0 THEN l_quantity - 18 + l_discount * 100 END AS arr_delay,
         CAST(l_partkey % 41 = 0 AS INTEGER) AS cancelled, CAST(l_partkey % 43 = 0 AS INTEGER) AS diverted,
         l_extendedprice AS distance, l_tax AS wind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
)"""


def chained(spark: SparkSession, d: str) -> DataFrame:
    """Completed legs with the two before on the same tail, and the gap to the one before."""
    from waypath.operators import rotation

    done = legs(spark, d).where("cancelled = 0 and diverted = 0")
    got = rotation.neighbours(done, "tail", "dep_ts", "leg_id", ["arr_delay", "dep_delay", "arr_ts", "dest"], hops=2, following=False)
    return got.withColumn("turnaround", F.timestamp_diff("MINUTE", "prev1_arr_ts", "dep_ts"))


CHAINED = f"""{LEGS}, chained AS (
  SELECT *, datesub('minute', prev1_arr_ts, dep_ts) AS turnaround FROM (
    SELECT *, lag(arr_delay) OVER w AS prev1_arr_delay, lag(arr_delay, 2) OVER w AS prev2_arr_delay, lag(dep_delay) OVER w AS prev1_dep_delay,
           lag(dep_delay, 2) OVER w AS prev2_dep_delay, lag(arr_ts) OVER w AS prev1_arr_ts, lag(arr_ts, 2) OVER w AS prev2_arr_ts,
           lag(dest) OVER w AS prev1_dest, lag(dest, 2) OVER w AS prev2_dest
    FROM legs WHERE cancelled = 0 AND diverted = 0 WINDOW w AS (PARTITION BY tail ORDER BY dep_ts NULLS FIRST, leg_id)
  )
)"""
