"""Windows (W), sorts and top-k (O), set operations (U)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.operators import rotation, tables
from waypath.plans.legs import CHAINED, LEGS, Registry, chained, legs
from waypath.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_ROT = ["leg_id", "origin", "dest", "arr_ts", "dep_ts", "dep_delay", "arr_delay", "day"]


@query("""
SELECT user_id, event_id, ts, lag(event_id) OVER w AS prev_event_id, lead(event_id) OVER w AS next_event_id,
       datesub('minute', lag(ts) OVER w, ts) AS gap_minutes,
       count(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS day_number,
       round(sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS day_sum
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def W01_W05_rotation(spark, d):
    """Previous and next event of a key, gap, and counters of the day."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    e = rotation.neighbours(e, "user_id", "ts", "event_id", ["event_id"]).withColumn("_prev_ts", F.lag("ts").over(rotation.ordered("user_id", "ts", "event_id")))
    day = W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.select("user_id", "event_id", "ts", "prev_event_id", "next_event_id", F.timestamp_diff("MINUTE", "_prev_ts", "ts").alias("gap_minutes"), F.count("ts").over(day).alias("day_number"), F.round(F.sum("value").over(day), 4).alias("day_sum"))


@query(f"""WITH {LEGS}
SELECT leg_id, lag(leg_id) OVER w AS prev_leg_id, lag(origin) OVER w AS prev_origin, lag(dest) OVER w AS prev_dest, lag(arr_ts) OVER w AS prev_arr_ts,
       round(lag(arr_delay) OVER w, 4) AS prev_arr_delay, lag(day) OVER w AS prev_day,
       datesub('minute', lag(arr_ts) OVER w, dep_ts) AS turnaround_minutes,
       CASE WHEN lag(dest) OVER w = origin THEN 1 ELSE 0 END AS continuity_flag
FROM legs WINDOW w AS (PARTITION BY tail ORDER BY dep_ts NULLS FIRST, leg_id)""")
def W01_lag_columns(spark, d):
    got = rotation.links(rotation.neighbours(legs(spark, d), "tail", "dep_ts", "leg_id", _ROT))
    return got.select("leg_id", "prev_leg_id", "prev_origin", "prev_dest", "prev_arr_ts", F.round("prev_arr_delay", 4).alias("prev_arr_delay"), "prev_day", "turnaround_minutes", "continuity_flag")


@query(f"""WITH {LEGS}
SELECT leg_id, lead(leg_id) OVER w AS next_leg_id, lead(origin) OVER w AS next_origin, lead(dest) OVER w AS next_dest, lead(dep_ts) OVER w AS next_dep_ts,
       round(lead(dep_delay) OVER w, 4) AS next_dep_delay, datesub('minute', arr_ts, lead(dep_ts) OVER w) AS next_turnaround_minutes,
       CASE WHEN lead(origin) OVER w = dest THEN 1 ELSE 0 END AS next_continuity_flag
FROM legs WINDOW w AS (PARTITION BY tail ORDER BY dep_ts NULLS FIRST, leg_id)""")
def W02_lead_columns(spark, d):
    got = rotation.links(rotation.neighbours(legs(spark, d), "tail", "dep_ts", "leg_id", _ROT))
    return got.select("leg_id", "next_leg_id", "next_origin", "next_dest", "next_dep_ts", F.round("next_dep_delay", 4).alias("next_dep_delay"), "next_turnaround_minutes", "next_continuity_flag")


@query(f"""WITH {CHAINED}
SELECT leg_id, round(prev1_arr_delay, 4) AS prev1_arr_delay, round(prev2_arr_delay, 4) AS prev2_arr_delay, round(prev1_dep_delay, 4) AS prev1_dep_delay,
       round(prev2_dep_delay, 4) AS prev2_dep_delay, turnaround, datesub('minute', prev2_arr_ts, dep_ts) AS since_prev2
FROM chained""")
def W03_two_hop(spark, d):
    r = lambda c: F.round(c, 4).alias(c)
    return chained(spark, d).select("leg_id", r("prev1_arr_delay"), r("prev2_arr_delay"), r("prev1_dep_delay"), r("prev2_dep_delay"), "turnaround", F.timestamp_diff("MINUTE", "prev2_arr_ts", "dep_ts").alias("since_prev2"))


@query(f"""WITH {LEGS}
SELECT leg_id, count(dep_ts) OVER w AS leg_number_day, round(sum(dep_delay) OVER w, 4) AS cum_dep_delay_day, round(sum(arr_delay) OVER w, 4) AS cum_arr_delay_day
FROM legs WINDOW w AS (PARTITION BY tail, day ORDER BY dep_ts NULLS FIRST, leg_id ROWS UNBOUNDED PRECEDING)""")
def W04_W05_day_counters(spark, d):
    got = rotation.day_counters(legs(spark, d), "tail", F.col("day"), "dep_ts", "leg_id")
    return got.select("leg_id", "leg_number_day", F.round("cum_dep_delay_day", 4).alias("cum_dep_delay_day"), F.round("cum_arr_delay_day", 4).alias("cum_arr_delay_day"))


_PRIOR = f"""WITH {LEGS}
SELECT leg_id, round(coalesce(sum(arr_delay) OVER (PARTITION BY tail, day ORDER BY dep_ts NULLS FIRST, leg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS prior_delay FROM legs"""


@query(_PRIOR)
def W06_prior_cumulative(spark, d):
    """Delays of the day before this leg: nothing of the leg itself."""
    return legs(spark, d).select("leg_id", F.round(rotation.before("arr_delay", "tail", "day", order=["dep_ts", "leg_id"]), 4).alias("prior_delay"))


@query(_PRIOR)
def W17_scoped_shift(spark, d):
    """The shift inside its keys, where an unscoped one would take a neighbour key's last sum."""
    w = W.partitionBy("tail", "day").orderBy("dep_ts", "leg_id")
    rows = legs(spark, d).withColumn("_sum", F.sum("arr_delay").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select("leg_id", F.round(F.coalesce(F.lag("_sum").over(w), F.lit(0)), 4).alias("prior_delay"))


_HOURLY = "hourly AS (SELECT origin, date_trunc('hour', dep_ts) AS hour, count(*) AS legs, avg(dep_delay) AS mean_delay, avg(CAST(dep_delay > 15 AS INTEGER)) AS late FROM legs WHERE dep_ts IS NOT NULL GROUP BY 1, 2)"


def _hourly(spark, d, *keys):
    rows = legs(spark, d).where("dep_ts is not null").groupBy(*keys, F.date_trunc("hour", "dep_ts").cast("timestamp_ntz").alias("hour"))
    return rows.agg(F.count("*").alias("legs"), F.avg("dep_delay").alias("mean_delay"), F.avg((F.col("dep_delay") > 15).cast("int")).alias("late"))


def _rolling(keys):
    return [F.round(rotation.rolling_mean(c, keys, ["hour"], h), 4).alias(f"{c}_{h}") for h in (1, 3, 6) for c in ("mean_delay", "late")]


def _rolling_sql(keys):
    return ", ".join(f"round(avg({c}) OVER (PARTITION BY {keys} ORDER BY hour ROWS {h - 1} PRECEDING), 4) AS {c}_{h}" for h in (1, 3, 6) for c in ("mean_delay", "late"))


@query(f"WITH {LEGS}, {_HOURLY} SELECT origin, CAST(hour AS TIMESTAMP) AS hour, legs, {_rolling_sql('origin')} FROM hourly")
def W07_rolling_place(spark, d):
    return _hourly(spark, d, "origin").select("origin", "hour", "legs", *_rolling(["origin"]))


@query(f"""WITH {LEGS}, {_HOURLY.replace("origin, date", "origin, dest, date").replace("BY 1, 2", "BY 1, 2, 3")}
SELECT origin || '_' || dest AS route, CAST(hour AS TIMESTAMP) AS hour, legs, {_rolling_sql('origin, dest')} FROM hourly""")
def W08_rolling_route(spark, d):
    rows = _hourly(spark, d, "origin", "dest")
    return rows.select(F.concat_ws("_", "origin", "dest").alias("route"), "hour", "legs", *_rolling(["origin", "dest"]))


@query(f"""WITH {LEGS}, y AS (SELECT year(day) AS year, origin || '_' || dest AS route, count(*) AS n FROM legs GROUP BY 1, 2)
SELECT *, dense_rank() OVER (PARTITION BY year ORDER BY n DESC) AS place FROM y""")
def W09_dense_rank(spark, d):
    y = legs(spark, d).groupBy(F.year("day").cast("long").alias("year"), F.concat_ws("_", "origin", "dest").alias("route")).agg(F.count("*").alias("n"))
    return y.withColumn("place", F.dense_rank().over(W.partitionBy("year").orderBy(F.desc("n"))).cast("long"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS of FROM events""")
def W10_row_number(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("place"), F.count("*").over(W.partitionBy("user_id")).alias("of"))


@query("""SELECT event_id, round((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / count(*) OVER (PARTITION BY user_id), 6) AS position FROM events""")
def W11_relative_position(spark, d):
    return table(spark, d, "events").select("event_id", F.round(rotation.relative_position("user_id", ["ts", "event_id"]), 6).alias("position"))


@query("""SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS so_far FROM events""")
def W12_cumsum_shift(spark, d):
    return table(spark, d, "events").select("event_id", F.round(rotation.before("value", "user_id", order=["ts", "event_id"]), 4).alias("so_far"))


@query("""SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 4) END AS mean5
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)""")
def W13_rolling_min_periods(spark, d):
    return table(spark, d, "events").select("event_id", F.round(rotation.rolling_mean("value", ["user_id"], ["ts", "event_id"], 5, least=5), 4).alias("mean5"))


@query("""SELECT event_id, round(value - lag(value) OVER w, 4) AS change, datesub('second', lag(ts) OVER w, ts) AS seconds
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def W14_diff(spark, d):
    w = rotation.ordered("user_id", "ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 4).alias("change"), F.timestamp_diff("SECOND", F.lag("ts").over(w), "ts").alias("seconds"))


@query(f"""WITH {CHAINED}
SELECT leg_id, CASE WHEN prev1_arr_delay > 15 AND dep_ts - prev1_arr_ts <= INTERVAL 8 HOUR AND dep_ts >= prev1_arr_ts THEN 1 ELSE 0 END AS inherits FROM chained""")
def W15_gated_lag(spark, d):
    gap = F.col("dep_ts") - F.col("prev1_arr_ts")
    ok = (F.col("prev1_arr_delay") > 15) & (gap <= F.expr("interval 8 hours")) & (gap >= F.expr("interval 0 hours"))
    return chained(spark, d).select("leg_id", F.when(ok, 1).otherwise(0).alias("inherits"))


@query(f"""WITH {LEGS}, t AS (
  SELECT leg_id, tail, day, hour(dep_ts) * 100 + minute(dep_ts) AS dep_hhmm, hour(arr_ts) * 100 + minute(arr_ts) AS arr_hhmm FROM legs WHERE dep_ts IS NOT NULL
), p AS (
  SELECT *, datediff('day', DATE '1995-01-01', day) * 1440 + (dep_hhmm // 100) * 60 + dep_hhmm % 100 AS dep_abs,
         datediff('day', DATE '1995-01-01', day) * 1440 + (arr_hhmm // 100) * 60 + arr_hhmm % 100 AS arr_abs FROM t)
SELECT leg_id, dep_abs - lag(arr_abs) OVER (PARTITION BY tail ORDER BY dep_abs, leg_id) AS turnaround FROM p""")
def W16_absolute_minutes(spark, d):
    from waypath.functions.clock import clock_minutes

    hhmm = lambda c: F.hour(c) * 100 + F.minute(c)
    base = F.datediff("day", F.to_date(F.lit("1995-01-01"))) * 1440
    t = legs(spark, d).where("dep_ts is not null").select("leg_id", "tail", (base + clock_minutes(hhmm("dep_ts"))).alias("dep_abs"), (base + clock_minutes(hhmm("arr_ts"))).alias("arr_abs"))
    return t.select("leg_id", (F.col("dep_abs") - F.lag("arr_abs").over(W.partitionBy("tail").orderBy("dep_abs", "leg_id"))).alias("turnaround"))


@query("""SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def W18_keep_last(spark, d):
    return tables.one_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts")


@query("SELECT s_nationkey, s_suppkey, round(s_acctbal, 2) AS s_acctbal, row_number() OVER (ORDER BY s_nationkey NULLS FIRST, s_suppkey) AS place FROM supplier")
def O01_multi_key_sort(spark, d):
    """An order as a column: the place inside a first key, after the rows of all smaller first keys."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))
    before = W.orderBy(F.asc_nulls_first("s_nationkey")).rowsBetween(W.unboundedPreceding, -1)  # over a row for each first key
    sizes = s.groupBy("s_nationkey").agg(F.count("*").alias("n")).select(F.col("s_nationkey").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    placed = s.withColumn("r", inside).join(sizes, F.col("s_nationkey").eqNullSafe(F.col("k")))
    return placed.select("s_nationkey", "s_suppkey", "s_acctbal", (F.col("before") + F.col("r")).alias("place"))


@query(f"""WITH {LEGS}, t AS (SELECT carrier, origin, round(avg(arr_delay), 4) AS delay, count(*) AS n FROM legs GROUP BY 1, 2)
SELECT * FROM t ORDER BY carrier, delay DESC NULLS FIRST, origin LIMIT 40""")
def O02_mixed_sort(spark, d):
    t = legs(spark, d).groupBy("carrier", "origin").agg(F.round(F.avg("arr_delay"), 4).alias("delay"), F.count("*").alias("n"))
    return t.orderBy("carrier", F.desc_nulls_first("delay"), "origin").limit(40)


@query(f"WITH {LEGS} SELECT origin || '_' || dest AS route, count(*) AS n FROM legs GROUP BY 1 ORDER BY n DESC, route LIMIT 10")
def O03_top_routes(spark, d):
    return legs(spark, d).groupBy(F.concat_ws("_", "origin", "dest").alias("route")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "route").limit(10)


@query(f"""WITH {LEGS}, t AS (SELECT carrier, count(*) // 100 AS hundreds FROM legs GROUP BY 1)
SELECT carrier, hundreds FROM (SELECT *, rank() OVER (ORDER BY hundreds DESC) AS r FROM t) WHERE r <= 3""")
def O04_top_with_ties(spark, d):
    t = legs(spark, d).groupBy("carrier").agg(F.floor(F.count("*") / 100).alias("hundreds"))
    return t.withColumn("r", F.rank().over(W.orderBy(F.desc("hundreds")))).where("r <= 3").drop("r")


@query(f"""WITH {CHAINED}, m AS (
  SELECT carrier, round(avg(CAST((prev1_arr_delay > 15) = (arr_delay > 15) AS INTEGER)), 4) AS accuracy, round(avg(abs(arr_delay - prev1_arr_delay)), 4) AS mae
  FROM chained WHERE prev1_arr_delay IS NOT NULL GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY accuracy DESC, mae, carrier) AS place FROM m""")
def O05_leaderboard(spark, d):
    late = lambda c: F.col(c) > 15
    m = chained(spark, d).where("prev1_arr_delay is not null").groupBy("carrier").agg(
        F.round(F.avg((late("prev1_arr_delay") == late("arr_delay")).cast("int")), 4).alias("accuracy"), F.round(F.avg(F.abs(F.col("arr_delay") - F.col("prev1_arr_delay"))), 4).alias("mae")
    )
    return m.withColumn("place", F.row_number().over(W.orderBy(F.desc("accuracy"), "mae", "carrier")).cast("long"))


@query(f"""WITH {LEGS} SELECT leg_id, row_number() OVER (PARTITION BY tail ORDER BY day, hour(dep_ts) * 100 + minute(dep_ts) NULLS FIRST, leg_id) AS place FROM legs""")
def O06_stable_order(spark, d):
    w = W.partitionBy("tail").orderBy("day", F.asc_nulls_first(F.hour("dep_ts") * 100 + F.minute("dep_ts")), "leg_id")
    return legs(spark, d).select("leg_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"WITH {LEGS} SELECT p AS place FROM (SELECT origin AS p FROM legs UNION SELECT dest FROM legs) WHERE p IS NOT NULL AND length(p) = 3")
def U01_union_distinct(spark, d):
    x = legs(spark, d)
    both = x.select(F.col("origin").alias("place")).unionByName(x.select(F.col("dest").alias("place")))
    return both.where(F.col("place").isNotNull() & (F.char_length("place") == 3)).distinct()


@query("""SELECT CAST(o_orderkey AS DOUBLE) AS k, o_totalprice AS v FROM orders UNION ALL SELECT CAST(s_suppkey AS DOUBLE), s_acctbal FROM supplier""")
def U02_union_widened(spark, d):
    """Columns by name, to the wider type."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("double").alias("k"), F.col("o_totalprice").alias("v"))
    return o.unionByName(table(spark, d, "supplier").select(F.col("s_acctbal").alias("v"), F.col("s_suppkey").cast("int").alias("k")))


@query("""WITH a AS (SELECT s_suppkey AS k, s_name AS name, NULL::VARCHAR AS segment, 0 AS p FROM supplier), b AS (SELECT c_custkey AS k, NULL::VARCHAR AS name, c_mktsegment AS segment, 1 AS p FROM customer)
SELECT k, name, segment FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE r = 1""")
def U03_priority_union(spark, d):
    """Missing columns are null; of a key in both, the first source's row."""
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return tables.by_priority(["k"], [], a, b)


@query(f"WITH {LEGS} SELECT count(*) AS places FROM (SELECT origin FROM legs UNION SELECT dest FROM legs)")
def U04_set_union(spark, d):
    x = legs(spark, d)
    return x.select("origin").union(x.select("dest")).distinct().agg(F.count("*").alias("places"))


@query("""SELECT 'found' AS side, k FROM (SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
UNION ALL SELECT 'missing', k FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT o_custkey FROM orders)""")
def U05_difference_intersection(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    used = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return used.intersect(rich).select(F.lit("found").alias("side"), "k").union(rich.subtract(used).select(F.lit("missing"), "k"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def U06_distinct_keep_all(spark, d):
    return tables.one_per_key(table(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")
