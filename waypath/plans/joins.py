"""Joins (J) and projections, filters and shape (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waypath.functions import text
from waypath.operators import ranks, rotation, tables
from waypath.operators.asof import asof_ends, asof_join
from waypath.plans.legs import CHAINED, LEGS, Registry, chained, legs
from waypath.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _observations(spark, d, kind):
    return table(spark, d, "events").where(F.col("event_type") == kind)


@query("""SELECT s_suppkey, o.n_name AS dep_name, r.r_name AS dep_region, x.n_name AS arr_name FROM supplier
LEFT JOIN nation o ON s_nationkey = o.n_nationkey LEFT JOIN region r ON o.n_regionkey = r.r_regionkey LEFT JOIN nation x ON (s_nationkey + s_suppkey) % 30 = x.n_nationkey""")
def J01_role_dimension(spark, d):
    """One dimension in two roles; a place outside it keeps nulls."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("from"), ((F.col("s_nationkey") + F.col("s_suppkey")) % 30).alias("to"))
    s = s.join(tables.role(n, "from", "dep_"), "from", "left").join(tables.role(n, "to", "arr_"), "to", "left")
    return s.select("s_suppkey", "dep_name", "dep_region", "arr_name")


def _asof_sql(hours: int) -> str:
    return f"""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click')
SELECT p.event_id, p.ts, CASE WHEN p.ts - c.ts <= INTERVAL {hours} HOUR THEN c.ts END AS wx_ts, CASE WHEN p.ts - c.ts <= INTERVAL {hours} HOUR THEN round(c.value, 4) END AS wx_value
FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts"""


def _asof(spark, d, hours):
    p = _observations(spark, d, "purchase").select("event_id", "user_id", "ts")
    c = _observations(spark, d, "click").select("user_id", "ts", "value")
    got = asof_join(p, c, ["user_id"], "ts", "ts", ["value"], f"{hours} hours", prefix="wx_")
    return got.select("event_id", "ts", "wx_ts", F.round("wx_value", 4).alias("wx_value"))


@query(_asof_sql(2))
def J02_asof_departure(spark, d):
    return _asof(spark, d, 2)


@query(_asof_sql(24))
def J02_asof_departure_24h(spark, d):
    return _asof(spark, d, 24)


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT p.event_id, CASE WHEN p.ts - c.ts <= INTERVAL 24 HOUR THEN c.ts END AS dep_ts, CASE WHEN p.ts - v.ts <= INTERVAL 24 HOUR THEN v.ts END AS arr_ts
FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def J03_asof_both_ends(spark, d):
    p = _observations(spark, d, "purchase").select("event_id", "user_id", "ts")
    p = p.withColumns({"from": F.lit("click"), "to": F.lit("view")})  # what is observed stands for the place
    seen = table(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("user_id", "event_type", "ts", "value")
    got = asof_ends(p, seen, ["event_id"], ["user_id", "event_type"], "ts", ["value"], "24 hours", {"dep_": (["user_id", "from"], "ts"), "arr_": (["user_id", "to"], "ts")})
    return got.select("event_id", "dep_ts", "arr_ts")


@query(_asof_sql(2))
def J02_asof_bucketed(spark, d):
    """The same by time buckets, for keys with a large share of all rows."""
    p = _observations(spark, d, "purchase").select(F.col("event_id").alias("leg_id"), "user_id", "ts")
    c = _observations(spark, d, "click").select("user_id", "ts", "value")
    got = asof_join(p, c, ["user_id"], "ts", "ts", ["value"], "120 minutes", prefix="wx_")
    return got.select(F.col("leg_id").alias("event_id"), "ts", "wx_ts", F.round("wx_value", 4).alias("wx_value"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN n_name END AS zone FROM customer JOIN nation ON c_nationkey = n_nationkey")
def J04_lookup(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 20")
    return tables.lookup(table(spark, d, "customer"), n, "c_nationkey", "n_nationkey", {"n_name": "zone"}).select("c_custkey", "zone")


@query("SELECT k, n_name FROM (SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT 99) LEFT JOIN nation ON k = n_nationkey")
def J05_unique_to_reference(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(spark.range(99, 100).select(F.col("id").cast("int"))).distinct()
    return keys.join(table(spark, d, "nation"), F.col("k") == F.col("n_nationkey"), "left").select("k", "n_name")


@query("""SELECT s_suppkey, r_name FROM supplier LEFT JOIN (SELECT DISTINCT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) ON CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END = n_nationkey""")
def J06_bridge_to_history(spark, d):
    history = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name").distinct()
    bridge = table(spark, d, "supplier").withColumn("key", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")))  # a quarter have no bridge
    return bridge.join(history, F.col("key") == F.col("n_nationkey"), "left").select("s_suppkey", "r_name")


@query("""SELECT n_nationkey, p_partkey FROM (
  SELECT n_nationkey, p_partkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY CASE WHEN p_name LIKE '%bolt%' THEN 2 WHEN p_name LIKE '%ring%' THEN 1 ELSE 0 END DESC, p_size DESC, p_partkey) AS r
  FROM nation JOIN part ON p_partkey % 25 = n_nationkey WHERE p_size >= 10 AND p_size - 8 <= 35) WHERE r = 1""")
def J07_best_match(spark, d):
    """Of the candidates whose validity overlaps, the best name, then the latest end, then the smallest id."""
    score = F.when(F.col("p_name").contains("bolt"), 2).when(F.col("p_name").contains("ring"), 1).otherwise(0)
    both = table(spark, d, "nation").join(table(spark, d, "part"), F.col("p_partkey") % 25 == F.col("n_nationkey")).where("p_size >= 10 and p_size - 8 <= 35")
    return tables.one_per_key(both, ["n_nationkey"], [score.desc(), F.desc("p_size"), F.asc("p_partkey")]).select("n_nationkey", "p_partkey")


@query(f"""WITH {LEGS}, o AS (SELECT origin AS place, date_trunc('hour', dep_ts) AS hour, count(*) AS dep, round(avg(dep_delay), 4) AS dep_delay FROM legs GROUP BY 1, 2),
a AS (SELECT dest AS place, date_trunc('hour', arr_ts) AS hour, count(*) AS arr, round(avg(arr_delay), 4) AS arr_delay FROM legs GROUP BY 1, 2)
SELECT coalesce(o.place, a.place) AS place, CAST(coalesce(o.hour, a.hour) AS TIMESTAMP) AS hour, coalesce(dep, 0) AS dep, coalesce(arr, 0) AS arr, coalesce(dep, 0) + coalesce(arr, 0) AS total, dep_delay, arr_delay
FROM o FULL JOIN a ON o.place = a.place AND o.hour = a.hour""")
def J08_full_outer(spark, d):
    """Departures and arrivals of a place and hour; hours that are null don't match each other."""
    x = legs(spark, d)
    side = lambda place, ts, n, delay: x.groupBy(F.col(place).alias("place"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias(n), F.round(F.avg(delay), 4).alias(delay))
    both = side("origin", "dep_ts", "dep", "dep_delay").join(side("dest", "arr_ts", "arr", "arr_delay"), ["place", "hour"], "full_outer").fillna(0, ["dep", "arr"])
    return both.select("place", "hour", "dep", "arr", (F.col("dep") + F.col("arr")).alias("total"), "dep_delay", "arr_delay")


_TAILKEY = "regexp_replace(regexp_replace(upper({}), '[^A-Z0-9]', '', 'g'), '^N', '')"


def _registered(spark, d, how):
    """Tails written in two ways, met under one key."""
    a = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_custkey").cast("string"), F.lit("-x")).alias("tail"))
    b = table(spark, d, "supplier").select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), F.lit("X")).alias("reg"))
    return a.withColumn("k", text.tail_key(F.col("tail"))).join(b.withColumn("k", text.tail_key(F.col("reg"))), "k", how).select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def J09_normalised_key(spark, d):
    return _registered(spark, d, "left")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, p_name, p_size AS part_size, l_quantity AS size FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON l_partkey = p_partkey""")
def J10_reference_with_clash(spark, d):
    """A column name that both sides have is given apart."""
    p = table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.col("p_size").alias("size"))
    l = table(spark, d, "lineitem").withColumnRenamed("l_quantity", "size")
    return l.join(p.withColumnRenamed("size", "part_size"), "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "p_name", "part_size", "size")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey")
def J11_parameterised_how(spark, d):
    return _registered(spark, d, "inner")


@query("""SELECT count(*) AS n, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS matched FROM customer""")
def J12_semi_with_rate(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return c.join(o.withColumn("hit", F.lit(True)), "c_custkey", "left").agg(F.count("*").alias("n"), F.count("hit").alias("matched"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def J13_membership(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def J14_block_list(spark, d):
    blocked = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("user_id"))
    return table(spark, d, "events").join(blocked, "user_id", "left_anti").select("event_id", "user_id")


@query(f"""WITH {LEGS} SELECT leg_id, tail, count(*) OVER (PARTITION BY origin, dest) AS route_n, count(*) OVER (PARTITION BY origin) AS origin_n, count(*) OVER (PARTITION BY dest) AS dest_n FROM legs""")
def J15_counts_joined_back(spark, d):
    """Group sizes joined back: the counts are small, so the rows aren't shuffled for them."""
    x = legs(spark, d)
    for n, keys in (("route_n", ["origin", "dest"]), ("origin_n", ["origin"]), ("dest_n", ["dest"])):
        x = x.join(legs(spark, d).groupBy(*keys).agg(F.count("*").alias(n)), keys)
    return x.select("leg_id", "tail", "route_n", "origin_n", "dest_n")


@query("""WITH h AS (SELECT * FROM (VALUES (DATE '1996-12-25', 'Christmas'), (DATE '1996-12-28', 'Late'), (DATE '1997-07-04', 'July')) t(h, name)),
w AS (SELECT CAST(unnest(generate_series(h - INTERVAL 3 DAY, h + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) AS day, h, name FROM h),
f AS (SELECT day, name, h FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY h) AS r FROM w) WHERE r = 1)
SELECT o_orderkey, name AS holiday, CAST(datediff('day', h, day) AS INTEGER) AS relative FROM orders LEFT JOIN f ON CAST(o_orderdate AS DATE) = day""")
def J16_holiday_windows(spark, d):
    h = spark.createDataFrame([("1996-12-25", "Christmas"), ("1996-12-28", "Late"), ("1997-07-04", "July")], "h string, name string").withColumn("h", F.to_date("h"))
    w = h.select(F.explode(F.sequence(F.date_sub("h", 3), F.date_add("h", 3))).alias("day"), "h", "name")
    w = tables.one_per_key(w, ["day"], [F.asc("h")])
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.join(w, "day", "left").select("o_orderkey", F.col("name").alias("holiday"), F.datediff("day", "h").alias("relative"))


@query(f"""WITH {LEGS}, m AS (SELECT origin AS place, count(DISTINCT dest) AS degree FROM legs GROUP BY 1), s AS (SELECT dest AS place, round(avg(arr_delay), 4) AS delay FROM legs WHERE dest <> 'N3' GROUP BY 1)
SELECT place, degree, delay FROM m LEFT JOIN s USING (place)""")
def J17_metrics_with_stats(spark, d):
    x = legs(spark, d)
    m = x.groupBy(F.col("origin").alias("place")).agg(F.countDistinct("dest").alias("degree"))
    s = x.where("dest <> 'N3'").groupBy(F.col("dest").alias("place")).agg(F.round(F.avg("arr_delay"), 4).alias("delay"))
    return m.join(s, "place", "left")


@query(f"""WITH {LEGS}, h AS (SELECT n AS k, n % 4 AS hop FROM range(20) t(n)) SELECT leg_id, tail FROM legs JOIN h a ON origin = 'N' || a.k JOIN h b ON dest = 'N' || b.k WHERE a.hop = b.hop + 1""")
def J18_hop_gradient(spark, d):
    hops = spark.range(20).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("place"), (F.col("id") % 4).alias("hop"))
    x = tables.lookup(legs(spark, d), hops, "origin", "place", {"hop": "from_hop"})
    return tables.lookup(x, hops, "dest", "place", {"hop": "to_hop"}).where("from_hop = to_hop + 1").select("leg_id", "tail")


@query("SELECT s_suppkey, round(s_acctbal / 100, 4) AS score, CAST(s_acctbal > 0 AS INTEGER) AS label FROM supplier")
def J19_bound_by_key(spark, d):
    """Columns put side by side by key, never by position."""
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.round(F.col("s_acctbal") / 100, 4).alias("score")).join(s.select("s_suppkey", (F.col("s_acctbal") > 0).cast("int").alias("label")), "s_suppkey")


@query("""SELECT event_id, n_name FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey""")
def J20_enrichment(spark, d):
    """Stream-static in streaming (see R); the same join in batch."""
    return table(spark, d, "events").withColumn("n_nationkey", (F.col("user_id") % 25).cast("int")).join(table(spark, d, "nation"), "n_nationkey", "left").select("event_id", "n_name")


@query(f"""WITH {CHAINED}, l AS (SELECT leg_id, lag(leg_id) OVER w AS last, lag(leg_id, 2) OVER w AS second_last FROM chained WINDOW w AS (PARTITION BY tail ORDER BY dep_ts, leg_id)) SELECT * FROM l""")
def J21_previous_legs(spark, d):
    done = legs(spark, d).where("cancelled = 0 and diverted = 0")
    got = rotation.neighbours(done, "tail", "dep_ts", "leg_id", ["leg_id"], hops=2, following=False)
    return got.select("leg_id", F.col("prev1_leg_id").alias("last"), F.col("prev2_leg_id").alias("second_last"))


@query("SELECT kind, count(event_id) AS n FROM (VALUES ('click'), ('view'), ('refund')) t(kind) LEFT JOIN events ON event_type = kind GROUP BY 1")
def J22_completed_vocabulary(spark, d):
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return tables.complete(n, "kind", ["click", "view", "refund"], ["n"])


# projections, filters, shape


@query("SELECT s_suppkey, s_name FROM supplier")
def P01_existing_columns(spark, d):
    return tables.widen(table(spark, d, "supplier"), ["s_suppkey", "missing", "s_name"])


@query("SELECT s_suppkey, s_name AS aircraft_s_name, s_nationkey AS aircraft_s_nationkey, s_acctbal AS aircraft_s_acctbal FROM supplier")
def P02_prefix(spark, d):
    return tables.role(table(spark, d, "supplier"), "s_suppkey", "aircraft_")


@query("SELECT s_suppkey AS supp_key, s_name AS supplier_name, s_name AS supplier_name_1, s_acctbal AS crs_dep_time FROM supplier")
def P03_snake_case(spark, d):
    s = table(spark, d, "supplier")
    return text.snake_columns(s.select(F.col("s_suppkey").alias("SuppKey"), F.col("s_name").alias("Supplier Name"), F.col("s_name").alias("supplierName"), F.col("s_acctbal").alias("CRSDepTime")))


@query("SELECT s_suppkey AS key, s_name AS name FROM supplier")
def P04_case_insensitive(spark, d):
    return text.resolve(table(spark, d, "supplier"), {"key": ("S_SUPPKEY",), "name": ("title", "S_Name")})


@query("SELECT s_suppkey, s_name FROM supplier")
def P05_drop(spark, d):
    return table(spark, d, "supplier").drop("s_nationkey", "s_acctbal", "not_there")


@query(f"""WITH {LEGS} SELECT leg_id, tail FROM legs WHERE (origin IN ('N1', 'N2', 'N3') OR dest IN ('N1', 'N2', 'N3')) AND ((origin = 'N1' AND dest = 'N5') OR (origin = 'N2' AND dest = 'N7')) AND origin IN ('N1', 'N2')""")
def P06_route_filter(spark, d):
    return tables.routes(legs(spark, d), places=["N1", "N2", "N3"], pairs=[("N1", "N5"), ("N2", "N7")], origins=["N1", "N2"]).select("leg_id", "tail")




@query(f"""WITH {LEGS}, h AS (SELECT DISTINCT origin FROM legs WHERE origin NOT IN ('N1', 'N2') AND dest IN ('N1', 'N2'))
SELECT leg_id, tail FROM legs WHERE dest IN ('N1', 'N2') OR (origin NOT IN ('N1', 'N2') AND dest IN (SELECT origin FROM h))""")
def P07_two_hop_inbound(spark, d):
    """Legs into the core, and into places with a leg into the core; none out of the core to outside."""
    return tables.two_hop_inbound(legs(spark, d), ["N1", "N2"]).select("leg_id", "tail")


@query(f"WITH {LEGS} SELECT leg_id, tail FROM legs WHERE (origin = 'N1' AND dest IN ('N2', 'N3')) OR (origin IN ('N2', 'N3') AND dest = 'N1')")
def P08_both_directions(spark, d):
    near = ["N2", "N3"]
    return legs(spark, d).where(((F.col("origin") == "N1") & F.col("dest").isin(near)) | (F.col("origin").isin(near) & (F.col("dest") == "N1"))).select("leg_id", "tail")


@query(f"WITH {LEGS} SELECT leg_id, tail FROM legs WHERE cancelled = 0 AND diverted = 0 AND arr_delay IS NOT NULL AND tail IS NOT NULL AND dep_ts IS NOT NULL AND arr_ts IS NOT NULL")
def P09_completed(spark, d):
    return legs(spark, d).where("cancelled = 0 and diverted = 0").dropna(subset=["arr_delay", "tail", "dep_ts", "arr_ts"]).select("leg_id", "tail")


@query("SELECT event_id FROM events WHERE value BETWEEN 10 - 0.5 AND 40 + 0.5 AND user_id BETWEEN 5 AND 50")
def P10_bounding_box(spark, d):
    return table(spark, d, "events").where(F.col("value").between(10 - 0.5, 40 + 0.5) & F.col("user_id").between(5, 50)).select("event_id")


@query(f"WITH {CHAINED} SELECT leg_id, tail FROM chained WHERE turnaround BETWEEN 0 AND 72000 AND datesub('minute', prev2_arr_ts, dep_ts) BETWEEN 0 AND 144000")
def P11_gap_ranges(spark, d):
    x = chained(spark, d)
    return x.where(F.col("turnaround").between(0, 72000) & F.timestamp_diff("MINUTE", "prev2_arr_ts", "dep_ts").between(0, 144000)).select("leg_id", "tail")


@query(f"WITH {CHAINED} SELECT leg_id, tail FROM chained WHERE prev1_arr_delay IS NOT NULL AND prev2_arr_delay IS NOT NULL")
def P12_drop_nulls(spark, d):
    return chained(spark, d).dropna(subset=["prev1_arr_delay", "prev2_arr_delay"]).select("leg_id", "tail")


@query(f"WITH {LEGS} SELECT leg_id, tail, round(coalesce(dep_delay, 0), 4) AS dep_delay, round(coalesce(arr_delay, 0), 4) AS arr_delay FROM legs")
def P13_fill_constant(spark, d):
    return legs(spark, d).fillna(0.0, ["dep_delay", "arr_delay"]).select("leg_id", "tail", F.round("dep_delay", 4).alias("dep_delay"), F.round("arr_delay", 4).alias("arr_delay"))


@query(f"""WITH {LEGS}, m AS (SELECT median(arr_delay) AS m FROM legs WHERE year(day) < 2000) SELECT leg_id, tail, round(coalesce(arr_delay, m), 4) AS arr_delay FROM legs, m WHERE year(day) >= 2000""")
def P14_median_impute(spark, d):
    """The median of the training years fills the later ones."""
    x = legs(spark, d)
    m = ranks.quantiles(x.where("year(day) < 2000"), ["arr_delay"], [0.5])["arr_delay"][0]
    return x.where("year(day) >= 2000").fillna(m, ["arr_delay"]).select("leg_id", "tail", F.round("arr_delay", 4).alias("arr_delay"))


@query("""SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def P15_forward_fill(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_id") % 3 == 0, F.col("value")), ignorenulls=True).over(w).alias("filled"))


@query("SELECT event_id, user_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '|7'), event_id LIMIT (SELECT count(*) // 10 FROM events)")
def P16_sample(spark, d):
    """Exactly a tenth of the rows, the first in the order of a seeded hash of the key: a sampling operator."""
    return ranks.sample(table(spark, d, "events").select("event_id", "user_id"), "event_id", fraction=0.1, seed=7)


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type, CASE WHEN r <= n * 25 // 100 THEN 'test' ELSE 'train' END AS part FROM r""")
def P17_stratified_split(spark, d):
    """A quarter of each event type for testing: the first of the type in the order of a hash of the id."""
    return ranks.stratified(table(spark, d, "events"), "event_type", "event_id", 25).select("event_id", "event_type", "part")


@query("SELECT s_suppkey, 0.0::DOUBLE AS wind, s_acctbal FROM supplier")
def P18_missing_as_zero(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", *(F.col(c) if c in s.columns else F.lit(0.0).alias(c) for c in ("wind", "s_acctbal")))


@query("SELECT s_acctbal, s_name, s_suppkey FROM supplier")
def P19_required_columns(spark, d):
    """Only the union of what the feature sets need is read."""
    sets = {"a": ["s_suppkey", "s_name"], "b": ["s_suppkey", "s_acctbal"]}
    return table(spark, d, "supplier").select(*sorted({c for s in sets.values() for c in s}))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20")
def P20_head(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(20)
