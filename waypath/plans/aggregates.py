"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.functions import buckets, clock
from waypath.operators import ranks, tables
from waypath.plans.legs import CHAINED, LEGS, Registry, chained, legs
from waypath.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def r4(c, name):
    return F.round(c, 4).alias(name)


def late(c="dep_delay", over=15):
    return (F.col(c) > over).cast("int")


def _hour(ts):
    return F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")


def hourly(df, keys, ts, delay, optional):
    """Counts, delays and the means of those ``optional`` columns that are there, of an hour and key."""
    means = [r4(F.avg(c), f"mean_{c}") for c in tables.optional(df, optional)]
    return df.groupBy(*keys, _hour(ts)).agg(F.count("*").alias("n"), r4(F.avg(delay), "mean"), r4(F.median(delay), "median"), r4(F.avg(late(delay)), "late"), *means)


@query(f"""WITH {LEGS} SELECT origin, CAST(date_trunc('hour', dep_ts) AS TIMESTAMP) AS hour, count(*) AS n, round(avg(dep_delay), 4) AS mean, round(median(dep_delay), 4) AS median,
 round(avg(CAST(dep_delay > 15 AS INTEGER)), 4) AS late, round(avg(cancelled), 4) AS mean_cancelled, round(avg(wind), 4) AS mean_wind FROM legs GROUP BY 1, 2""")
def A01_hourly_departures(spark, d):
    return hourly(legs(spark, d), ["origin"], "dep_ts", "dep_delay", ["cancelled", "wind", "ceiling"])


@query(f"""WITH {LEGS} SELECT dest, CAST(date_trunc('hour', arr_ts) AS TIMESTAMP) AS hour, count(*) AS n, round(avg(arr_delay), 4) AS mean, round(median(arr_delay), 4) AS median,
 round(avg(CAST(arr_delay > 15 AS INTEGER)), 4) AS late, round(avg(diverted), 4) AS mean_diverted FROM legs GROUP BY 1, 2""")
def A02_hourly_arrivals(spark, d):
    return hourly(legs(spark, d), ["dest"], "arr_ts", "arr_delay", ["diverted"])


@query(f"""WITH {LEGS} SELECT origin || '_' || dest AS route, origin, dest, CAST(date_trunc('hour', dep_ts) AS TIMESTAMP) AS hour, count(*) AS n, round(avg(dep_delay), 4) AS mean, round(median(dep_delay), 4) AS median,
 round(avg(CAST(dep_delay > 15 AS INTEGER)), 4) AS late, round(avg(distance), 4) AS mean_distance, round(avg(cancelled), 4) AS mean_cancelled, round(avg(wind), 4) AS mean_wind FROM legs GROUP BY 1, 2, 3, 4""")
def A03_route_hours(spark, d):
    return hourly(legs(spark, d).withColumn("route", F.concat_ws("_", "origin", "dest")), ["route", "origin", "dest"], "dep_ts", "dep_delay", ["distance", "cancelled", "wind", "taxi_out"])


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem")
def A04_cardinality(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query(f"WITH {CHAINED} SELECT count(*) FILTER (prev1_arr_delay IS NULL) AS prev1_arr_delay, count(*) FILTER (prev2_arr_delay IS NULL) AS prev2_arr_delay, count(*) FILTER (tail IS NULL) AS tail FROM chained")
def A05_null_counts(spark, d):
    return tables.null_counts(chained(spark, d), ["prev1_arr_delay", "prev2_arr_delay", "tail"])


@query("SELECT l_suppkey, l_shipdate, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def A06_duplicate_keys(spark, d):
    return tables.duplicate_keys(table(spark, d, "lineitem"), ["l_suppkey", "l_shipdate"])


@query("""SELECT count(value) AS n, count(*) - count(value) AS nulls, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min,
 round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, max(value) AS max FROM events""")
def A07_describe(spark, d):
    x = tables.describe(table(spark, d, "events"), "value")
    return x.select("n", "nulls", *(r4(F.col(c), c) for c in ("mean", "std")), "min", *(r4(F.col(c), c) for c in ("q25", "q50", "q75")), "max")


@query(f"WITH {LEGS} SELECT round(avg(cancelled), 6) AS cancelled, round(avg(diverted), 6) AS diverted, round(avg(CAST(dep_delay > 15 AS INTEGER)), 6) AS dep_late, round(avg(CAST(arr_delay > 15 AS INTEGER)), 6) AS arr_late FROM legs")
def A08_global_rates(spark, d):
    return legs(spark, d).agg(*(F.round(F.avg(c), 6).alias(n) for c, n in ((F.col("cancelled"), "cancelled"), (F.col("diverted"), "diverted"), (late(), "dep_late"), (late("arr_delay"), "arr_late"))))


@query(f"""WITH {CHAINED} SELECT count(*) FILTER (prev1_arr_delay > 15) AS n_late, round(avg(arr_delay) FILTER (prev1_arr_delay > 15), 4) AS after_late, round(avg(arr_delay) FILTER (prev1_arr_delay <= 15), 4) AS after_other FROM chained""")
def A09_conditional(spark, d):
    p, a = F.col("prev1_arr_delay"), F.col("arr_delay")
    return chained(spark, d).agg(F.count_if(p > 15).alias("n_late"), r4(F.avg(F.when(p > 15, a)), "after_late"), r4(F.avg(F.when(p <= 15, a)), "after_other"))


@query(f"WITH {CHAINED} SELECT count(*) FILTER (turnaround < 0) AS negative, count(*) FILTER (turnaround < 20) AS short, count(*) FILTER (turnaround > 1000) AS long FROM chained")
def A10_thresholds(spark, d):
    t = F.col("turnaround")
    return chained(spark, d).agg(F.count_if(t < 0).alias("negative"), F.count_if(t < 20).alias("short"), F.count_if(t > 1000).alias("long"))


@query(f"WITH {CHAINED} SELECT round(avg(CASE WHEN prev1_dest = origin THEN 1 ELSE 0 END), 6) AS continuous, round(avg(CASE WHEN turnaround < 60 THEN 1 ELSE 0 END), 6) AS tight FROM chained")
def A11_flag_shares(spark, d):
    return chained(spark, d).agg(F.round(F.avg(buckets.sure(F.col("prev1_dest") == F.col("origin"))), 6).alias("continuous"), F.round(F.avg(buckets.sure(F.col("turnaround") < 60)), 6).alias("tight"))


@query(f"WITH {LEGS} SELECT carrier, origin, count(*) AS n, round(avg(arr_delay), 4) AS delay FROM legs GROUP BY 1, 2 HAVING count(*) > 50 ORDER BY n DESC, carrier, origin LIMIT 15")
def A12_having_top(spark, d):
    x = legs(spark, d).groupBy("carrier", "origin").agg(F.count("*").alias("n"), r4(F.avg("arr_delay"), "delay"))
    return x.where("n > 50").orderBy(F.desc("n"), "carrier", "origin").limit(15)


@query(f"""WITH {LEGS}, m AS (SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(count(dep_ts) AS DOUBLE) AS with_time, round(avg(arr_delay), 4) AS mean_delay FROM legs)
UNPIVOT m ON rows, with_time, mean_delay INTO NAME metric VALUE amount""")
def A13_summary_long(spark, d):
    m = legs(spark, d).agg(F.count("*").cast("double").alias("rows"), F.count("dep_ts").cast("double").alias("with_time"), r4(F.avg("arr_delay"), "mean_delay"))
    return m.unpivot([], ["rows", "with_time", "mean_delay"], "metric", "amount")


@query(f"WITH {LEGS} SELECT origin, count(*) AS n, count(DISTINCT dest) AS dests, round(avg(dep_delay), 4) AS delay FROM legs GROUP BY 1")
def A14_hub_stats(spark, d):
    return legs(spark, d).groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("dest").alias("dests"), r4(F.avg("dep_delay"), "delay"))


@query(f"WITH {LEGS} SELECT carrier, round(avg(dep_delay - arr_delay), 4) AS mean, round(median(dep_delay - arr_delay), 4) AS median, count(*) AS n, round(100 * avg(CAST(arr_delay <= 15 AS INTEGER)), 4) AS on_time FROM legs GROUP BY 1")
def A15_padding(spark, d):
    pad = F.col("dep_delay") - F.col("arr_delay")
    return legs(spark, d).groupBy("carrier").agg(r4(F.avg(pad), "mean"), r4(F.median(pad), "median"), F.count("*").alias("n"), r4(100 * F.avg((F.col("arr_delay") <= 15).cast("int")), "on_time"))


@query(f"WITH {LEGS} SELECT carrier, CASE WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'weekday' END AS part, count(*) AS n, round(avg(arr_delay), 4) AS delay FROM legs GROUP BY 1, 2")
def A16_two_keys(spark, d):
    part = F.when(clock.iso_weekday(F.col("day")) >= 6, "weekend").otherwise("weekday").alias("part")
    return legs(spark, d).groupBy("carrier", part).agg(F.count("*").alias("n"), r4(F.avg("arr_delay"), "delay"))


@query(f"WITH {LEGS} SELECT carrier, month(day) IN (7, 12) AS holiday, count(*) AS n, round(avg(arr_delay), 4) AS delay FROM legs GROUP BY GROUPING SETS ((carrier, holiday), (holiday))")
def A17_rollup(spark, d):
    """Per carrier and over all in one pass."""
    legs(spark, d).withColumn("holiday", F.month("day").isin(7, 12)).createOrReplaceTempView("_a17")
    return spark.sql("SELECT carrier, holiday, count(*) AS n, round(avg(arr_delay), 4) AS delay FROM _a17 GROUP BY GROUPING SETS ((carrier, holiday), (holiday))")


@query(f"""WITH {CHAINED}, x AS (SELECT carrier, greatest(least(prev1_arr_delay, dep_delay), 0) AS inherited, greatest(dep_delay - greatest(prev1_arr_delay, 0), 0) AS fresh FROM chained WHERE prev1_arr_delay IS NOT NULL AND dep_delay IS NOT NULL)
SELECT carrier, round(avg(inherited), 4) AS inherited, round(avg(fresh), 4) AS fresh, round(avg(inherited) / nullif(avg(fresh), 0), 4) AS ratio FROM x GROUP BY 1""")
def A18_inherited_delay(spark, d):
    zero, p, dep = F.lit(0.0), F.col("prev1_arr_delay"), F.col("dep_delay")
    x = chained(spark, d).where("prev1_arr_delay is not null and dep_delay is not null")
    x = x.select("carrier", F.greatest(F.least(p, dep), zero).alias("inherited"), F.greatest(dep - F.greatest(p, zero), zero).alias("fresh"))
    return x.groupBy("carrier").agg(r4(F.avg("inherited"), "inherited"), r4(F.avg("fresh"), "fresh"), r4(F.try_divide(F.avg("inherited"), F.avg("fresh")), "ratio"))


@query(f"WITH {LEGS} SELECT datediff('day', DATE '1996-12-25', day) AS relative, count(*) AS n, round(avg(arr_delay), 4) AS delay FROM legs WHERE abs(datediff('day', DATE '1996-12-25', day)) <= 3 GROUP BY 1")
def A19_holiday_relative(spark, d):
    rel = F.datediff("day", F.to_date(F.lit("1996-12-25"))).cast("long")
    return legs(spark, d).where(F.abs(rel) <= 3).groupBy(rel.alias("relative")).agg(F.count("*").alias("n"), r4(F.avg("arr_delay"), "delay"))


def _case(c, ladder, op="<"):
    steps, above = ladder
    return f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {c} {op} {u} THEN '{n}'" for u, n in steps) + f" ELSE '{above}' END"


@query(f"""WITH {CHAINED} SELECT {_case('turnaround', buckets.TURNAROUND)} AS bucket, hour(dep_ts) AS hour, round(avg(CAST(dep_delay > 15 AS INTEGER)), 4) AS late, round(avg(prev1_arr_delay), 4) AS prev, count(*) AS n
FROM chained GROUP BY 1, 2 HAVING count(*) >= 30""")
def A20_bucketed_rates(spark, d):
    b = buckets.ladder(F.col("turnaround"), *buckets.TURNAROUND).alias("bucket")
    x = chained(spark, d).groupBy(b, F.hour("dep_ts").cast("long").alias("hour")).agg(r4(F.avg(late()), "late"), r4(F.avg("prev1_arr_delay"), "prev"), F.count("*").alias("n"))
    return x.where("n >= 30")


@query(f"""WITH {CHAINED} SELECT {_case('prev1_arr_delay', buckets.PREVIOUS_DELAY, '<=')} AS bucket, count(*) AS n, round(avg(dep_delay), 4) AS mean, round(median(dep_delay), 4) AS median, round(avg(CAST(dep_delay > 15 AS INTEGER)), 4) AS p
FROM chained WHERE prev1_arr_delay IS NOT NULL AND dep_delay IS NOT NULL GROUP BY 1""")
def A21_previous_delay(spark, d):
    b = buckets.ladder(F.col("prev1_arr_delay"), *buckets.PREVIOUS_DELAY, closed=True).alias("bucket")
    return chained(spark, d).dropna(subset=["prev1_arr_delay", "dep_delay"]).groupBy(b).agg(F.count("*").alias("n"), r4(F.avg("dep_delay"), "mean"), r4(F.median("dep_delay"), "median"), r4(F.avg(late()), "p"))


@query(f"""WITH {CHAINED}, x AS (SELECT *, row_number() OVER (PARTITION BY tail, day ORDER BY dep_ts, leg_id) AS leg FROM chained)
SELECT {_case('turnaround', buckets.TURNAROUND_FINE)} AS bucket, least(leg, 4) AS leg, count(*) AS n, round(avg(dep_delay), 4) AS delay FROM x WHERE turnaround IS NOT NULL GROUP BY 1, 2""")
def A22_rotation_fragility(spark, d):
    x = chained(spark, d).withColumn("leg", F.row_number().over(W.partitionBy("tail", "day").orderBy("dep_ts", "leg_id"))).where("turnaround is not null")
    b = buckets.ladder(F.col("turnaround"), *buckets.TURNAROUND_FINE).alias("bucket")
    return x.groupBy(b, F.least("leg", F.lit(4)).cast("long").alias("leg")).agg(F.count("*").alias("n"), r4(F.avg("dep_delay"), "delay"))


@query(f"WITH {LEGS} SELECT origin, dest, count(*) AS weight, round(avg(arr_delay), 4) AS delay FROM legs GROUP BY 1, 2")
def A23_route_edges(spark, d):
    return legs(spark, d).groupBy("origin", "dest").agg(F.count("*").alias("weight"), r4(F.avg("arr_delay"), "delay"))


@query(f"""WITH {LEGS} SELECT year(day) AS year, origin || '_' || dest AS route, count(*) AS n, count(*) FILTER (arr_delay > 15) AS late, round(avg(coalesce(arr_delay, 0)), 4) AS delay, round(100.0 * count(*) FILTER (arr_delay > 15) / count(*), 4) AS pct
FROM legs GROUP BY 1, 2""")
def A24_year_route(spark, d):
    x = legs(spark, d).groupBy(F.year("day").cast("long").alias("year"), F.concat_ws("_", "origin", "dest").alias("route"))
    n_late = F.count_if(F.col("arr_delay") > 15)
    return x.agg(F.count("*").alias("n"), n_late.alias("late"), r4(F.avg(F.coalesce("arr_delay", F.lit(0.0))), "delay"), r4(100.0 * n_late / F.count("*"), "pct"))


@query(f"WITH {LEGS} SELECT year(day) AS year, carrier, {_case('dep_delay', buckets.DELAY_STATE, '<=')} AS state, count(*) AS n FROM legs GROUP BY 1, 2, 3")
def A25_group_frequency(spark, d):
    s = buckets.ladder(F.col("dep_delay"), *buckets.DELAY_STATE, closed=True).alias("state")
    return legs(spark, d).groupBy(F.year("day").cast("long").alias("year"), "carrier", s).agg(F.count("*").alias("n"))


@query(f"WITH {LEGS} SELECT CASE WHEN hour(dep_ts) < 6 THEN 'Night' WHEN hour(dep_ts) < 12 THEN 'Morning' WHEN hour(dep_ts) < 18 THEN 'Midday' ELSE 'Evening' END AS part, month(day) AS month, count(*) AS n FROM legs WHERE dep_delay > 15 GROUP BY 1, 2")
def A26_late_by_part(spark, d):
    return legs(spark, d).where("dep_delay > 15").groupBy(clock.four_parts(F.hour("dep_ts")).alias("part"), F.month("day").cast("long").alias("month")).agg(F.count("*").alias("n"))


@query(f"WITH {LEGS} SELECT CAST(date_trunc('week', dep_ts) AS TIMESTAMP) AS week, count(*) AS n, round(avg(dep_delay), 4) AS delay FROM legs WHERE dep_ts IS NOT NULL GROUP BY 1")
def A27_weekly(spark, d):
    x = legs(spark, d).where("dep_ts is not null").groupBy(F.date_trunc("week", "dep_ts").cast("timestamp_ntz").alias("week"))
    return x.agg(F.count("*").alias("n"), r4(F.avg("dep_delay"), "delay"))


@query("SELECT CAST(floor(value / 10) AS BIGINT) AS severity, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def A28_floor_bucket(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.col("value") / 10).alias("severity")).agg(F.count("*").alias("n"), r4(F.avg("value"), "mean"))


@query("SELECT user_id, round(avg(value), 4) AS value_mean, max(value) AS value_max, round(stddev_samp(value), 4) AS value_std FROM events GROUP BY 1 HAVING count(*) > 1")
def A29_multi_stat(spark, d):
    x = table(spark, d, "events").groupBy("user_id").agg(r4(F.avg("value"), "value_mean"), F.max("value").alias("value_max"), r4(F.stddev_samp("value"), "value_std"))
    return x.where("value_std is not null")


@query("""WITH b AS (SELECT user_id, date_trunc('hour', ts) AS bin, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM b GROUP BY 1)
SELECT user_id, CAST(bin AS TIMESTAMP) AS bin, round(v, 4) AS mean, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (user_id, bin)""")
def A30_resample(spark, d):
    """Hourly bins of each key, the empty ones between its first and last too."""
    b = table(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bin")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    g = b.groupBy("user_id").agg(F.explode(F.sequence(F.min("bin"), F.max("bin"), F.expr("interval 1 hour"))).alias("bin"))
    return g.join(b, ["user_id", "bin"], "left").select("user_id", "bin", r4(F.col("v"), "mean"), F.coalesce("n", F.lit(0)).alias("n"))


_BIN = "OVER (PARTITION BY user_id, date_trunc('day', ts))"


@query(f"""SELECT event_id, round(avg(value) {_BIN}, 4) AS mean, round(median(value) {_BIN}, 4) AS median, round(stddev_samp(value) {_BIN}, 4) AS std, min(value) {_BIN} AS min, max(value) {_BIN} AS max, count(value) {_BIN} AS n FROM events""")
def A31_resample_transform(spark, d):
    w = W.partitionBy("user_id", F.date_trunc("day", "ts"))
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", r4(F.avg(v).over(w), "mean"), r4(F.median(v).over(w), "median"), r4(F.stddev_samp(v).over(w), "std"), F.min(v).over(w).alias("min"), F.max(v).over(w).alias("max"), F.count(v).over(w).alias("n")
    )


@query("SELECT event_id, round(value / max(value) OVER (PARTITION BY user_id), 4) AS relative FROM events")
def A32_max_broadcast(spark, d):
    return table(spark, d, "events").select("event_id", r4(F.col("value") / F.max("value").over(W.partitionBy("user_id")), "relative"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE)) AS n FROM events")
def A33_size_broadcast(spark, d):
    return table(spark, d, "events").select("event_id", F.count("*").over(W.partitionBy("event_type", F.to_date("ts"))).alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY CAST(ts AS DATE), hour(ts)) AS n FROM events")
def A34_congestion(spark, d):
    return table(spark, d, "events").select("event_id", F.count("*").over(W.partitionBy(F.to_date("ts"), F.hour("ts"))).alias("n"))


_FOLD = f"""{LEGS}, f AS (SELECT carrier, year(day) AS fold, avg(CAST(arr_delay > 15 AS INTEGER)) AS rate FROM legs GROUP BY 1, 2)"""


def _folds(spark, d):
    return legs(spark, d).groupBy("carrier", F.year("day").alias("fold")).agg(F.avg(late("arr_delay")).alias("rate"))


@query(f"WITH {_FOLD} SELECT carrier, round(avg(rate), 4) AS mean, round(min(rate), 4) AS min, round(max(rate), 4) AS max, round(stddev_pop(rate), 4) AS std FROM f GROUP BY 1")
def A35_fold_summary(spark, d):
    return _folds(spark, d).groupBy("carrier").agg(*(r4(fn("rate"), n) for fn, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"), (F.stddev_pop, "std"))))


@query(f"WITH {_FOLD} SELECT carrier, 'rate' AS metric, round(avg(rate), 4) AS value FROM f GROUP BY 1")
def A36_metric_means(spark, d):
    return _folds(spark, d).unpivot(["carrier", "fold"], ["rate"], "metric", "v").groupBy("carrier", "metric").agg(r4(F.avg("v"), "value"))


@query(f"WITH {LEGS} SELECT count(*) AS n, (SELECT count(*) FROM (SELECT origin FROM legs UNION SELECT dest FROM legs)) AS places, round(avg(arr_delay), 4) AS mean, round(min(arr_delay), 4) AS min, round(max(arr_delay), 4) AS max FROM legs")
def A37_run_summary(spark, d):
    x = legs(spark, d)
    places = x.select(F.explode(F.array("origin", "dest")).alias("p")).agg(F.countDistinct("p").alias("places"))
    s = x.agg(F.count("*").alias("n"), r4(F.avg("arr_delay"), "mean"), r4(F.min("arr_delay"), "min"), r4(F.max("arr_delay"), "max"))
    return s.join(places).select("n", "places", "mean", "min", "max")


@query("SELECT o_orderkey, datediff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate) AS day FROM orders")
def A38_global_min(spark, d):
    o = table(spark, d, "orders")
    first = o.agg(F.min("o_orderdate")).first()[0]
    return o.select("o_orderkey", F.datediff("o_orderdate", F.lit(first)).cast("long").alias("day"))


@query(f"WITH {LEGS} SELECT count(dep_ts) AS dep_ts, count(arr_delay) AS arr_delay, count(tail) AS tail FROM legs")
def A39_filled(spark, d):
    return legs(spark, d).agg(*(F.count(c).alias(c) for c in ("dep_ts", "arr_delay", "tail")))


@query("""WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, user_id LIMIT 5) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM t)""")
def A40_top_categories(spark, d):
    e = table(spark, d, "events")
    top = e.groupBy("user_id").count().where("count >= 5").orderBy(F.desc("count"), "user_id").limit(5)
    return e.join(top, "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT user_id, list(event_id ORDER BY ts, event_id) AS events FROM events WHERE event_type = 'purchase' GROUP BY 1")
def A41_collected(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("s"))
    return e.select("user_id", F.col("s.event_id").alias("events"))


@query(f"WITH {CHAINED} SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM (SELECT prev1_arr_delay > 15 AS p, arr_delay > 15 AS a FROM chained WHERE prev1_arr_delay IS NOT NULL AND arr_delay IS NOT NULL)")
def A42_confusion(spark, d):
    x = chained(spark, d).dropna(subset=["prev1_arr_delay", "arr_delay"]).select((F.col("prev1_arr_delay") > 15).alias("p"), (F.col("arr_delay") > 15).alias("a"))
    p, a = F.col("p"), F.col("a")
    return x.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))


_MEASURES = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"""WITH x AS (SELECT * FROM lineitem WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _MEASURES)})
{" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM x" for a in _MEASURES for b in _MEASURES)}""")
def A43_correlation(spark, d):
    """The matrix of all numeric measures over rows that lack none, in one pass."""
    return tables.correlations(table(spark, d, "lineitem"), list(_MEASURES)).select("a", "b", F.round("r", 4).alias("r"))


@query("SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1")
def A44_value_counts(spark, d):
    """Null is a value like any other."""
    return table(spark, d, "events").groupBy(F.when(F.col("user_id") % 10 != 0, F.col("event_type")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT round(quantile_cont(l_quantity, 0.01), 4) AS p1, round(quantile_cont(l_quantity, 0.99), 4) AS p99, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def A45_limits_trend(spark, d):
    rows = table(spark, d, "lineitem")
    p1, p99 = ranks.quantiles(rows, ["l_quantity"], [0.01, 0.99])["l_quantity"]
    return rows.agg(r4(F.lit(p1), "p1"), r4(F.lit(p99), "p99"), r4(F.regr_slope("l_extendedprice", "l_quantity"), "slope"), r4(F.regr_intercept("l_extendedprice", "l_quantity"), "intercept"))


@query("SELECT min(ts) AS first, max(ts) AS last, count(*) FILTER (event_id IS NULL) AS event_id, count(*) FILTER (user_id IS NULL) AS user_id, count(*) FILTER (event_type IS NULL) AS event_type, count(*) FILTER (value IS NULL) AS value, count(*) FILTER (props IS NULL) AS props FROM events")
def A46_range_and_nulls(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), *(F.count_if(F.col(c).isNull()).alias(c) for c in e.columns if c != "ts"))


@query(f"""WITH {CHAINED} SELECT carrier, origin, {_case('prev1_arr_delay', buckets.PREVIOUS_DELAY, '<=')} AS previous, count(*) AS n, round(avg(CAST(arr_delay > 15 AS INTEGER)), 4) AS actual, round(avg(0.5 + dep_delay / 100), 7) AS risk
FROM chained GROUP BY 1, 2, 3""")
def A47_patterns(spark, d):
    """Groups whose key is null are kept."""
    p = buckets.ladder(F.col("prev1_arr_delay"), *buckets.PREVIOUS_DELAY, closed=True).alias("previous")
    return chained(spark, d).groupBy("carrier", "origin", p).agg(F.count("*").alias("n"), r4(F.avg(late("arr_delay")), "actual"), F.round(F.avg(0.5 + F.col("dep_delay") / 100), 7).alias("risk"))


@query("""WITH t AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)
SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, event_id, event_type FROM events WHERE user_id = (SELECT user_id FROM t)""")
def A48_busiest_story(spark, d):
    e = table(spark, d, "events")
    top = e.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1)
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.join(top, "user_id", "left_semi").select((F.row_number().over(w) - 1).cast("long").alias("i"), "event_id", "event_type")
