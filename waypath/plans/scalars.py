"""Scalar functions: dates (D), text (T), numbers (M), nested values (N), function surface (F)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from waypath.functions import buckets, clock, text
from waypath.operators import features, ranks
from waypath.plans.features import FEATURED, featured
from waypath.plans.legs import CHAINED, LEGS, Registry, chained, legs
from waypath.session import cut, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Holidays for the stand-in data.
HOLIDAYS = ["1996-01-01", "1996-07-04", "1996-11-28", "1996-12-25", "1997-01-01", "1997-07-04", "1997-11-27", "1997-12-25"]
_H = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)


def _events(spark, d):
    return table(spark, d, "events")


_CLOCK = "lpad(CAST(hour(ts) * 100 + minute(ts) AS VARCHAR), 4, '0')"


@query(f"SELECT event_id, {_CLOCK} AS hhmm FROM events")
def D01_hhmm(spark, d):
    n = (F.hour("ts") * 100 + F.minute("ts")).cast("double")
    return _events(spark, d).select("event_id", clock.hhmm(n).alias("hhmm"))


@query(f"""SELECT event_id, try_strptime(strftime(ts, '%Y-%m-%d') || ' ' || CASE WHEN event_id % 50 = 0 THEN '2400' ELSE {_CLOCK} END, '%Y-%m-%d %H%M') AS at FROM events""")
def D02_clock_timestamp(spark, d):
    hhmm = F.when(F.col("event_id") % 50 == 0, "2400").otherwise(clock.hhmm(F.hour("ts") * 100 + F.minute("ts")))
    return _events(spark, d).select("event_id", clock.clock_ts(F.to_date("ts"), hhmm).alias("at"))


@query(f"""SELECT event_id, CASE WHEN event_id % 50 = 0 THEN CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) ELSE date_trunc('minute', ts) END AS at FROM events""")
def D03_midnight_next_day(spark, d):
    hhmm = F.when(F.col("event_id") % 50 == 0, "2400").otherwise(clock.hhmm(F.hour("ts") * 100 + F.minute("ts")))
    return _events(spark, d).select("event_id", clock.clock_ts(F.to_date("ts"), hhmm, midnight_24=True).alias("at"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_shipdate < o_orderdate THEN l_shipdate + INTERVAL 1 DAY ELSE l_shipdate END AS arrival
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def D04_overnight(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clock.after(F.col("o_orderdate"), F.col("l_shipdate")).alias("arrival"))


_ZONE = "CASE event_id % 5 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Los_Angeles' WHEN 2 THEN 'Pacific/Honolulu' WHEN 3 THEN 'Bad/Zone' END"


def _zone():
    n = F.col("event_id") % 5
    return F.when(n == 0, "America/New_York").when(n == 1, "America/Los_Angeles").when(n == 2, "Pacific/Honolulu").when(n == 3, "Bad/Zone")


@query(f"""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN ts + to_hours(CASE event_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE 10 END) END AS utc FROM events""")
def D05_local_to_utc(spark, d):
    """January: no daylight saving in these zones, which the SQL relies on; the switches are tested by hand."""
    return _events(spark, d).select("event_id", clock.to_utc(F.col("ts"), _zone()).alias("utc"))


@query("""SELECT event_id, ts - to_hours(CASE event_id % 5 WHEN 1 THEN 8 WHEN 2 THEN 10 ELSE 5 END) AS local FROM events""")
def D06_utc_to_local(spark, d):
    return _events(spark, d).select("event_id", clock.to_local(F.col("ts"), _zone()).alias("local"))


@query("SELECT event_id, CAST(ts AS DATE) AS day, hour(ts) AS hour, isodow(ts) AS weekday, month(ts) AS month, year(ts) AS year FROM events")
def D07_calendar_parts(spark, d):
    long = lambda c, n: c.cast("long").alias(n)
    return _events(spark, d).select("event_id", F.to_date("ts").alias("day"), long(F.hour("ts"), "hour"), long(clock.iso_weekday(F.col("ts")), "weekday"), long(F.month("ts"), "month"), long(F.year("ts"), "year"))


@query("SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM events")
def D08_hour_start(spark, d):
    return _events(spark, d).select("event_id", clock.hour_start(F.col("ts")).alias("hour"))


@query("""SELECT leg_id, datesub('minute', prev1_arr_ts, dep_ts) AS minutes, datesub('hour', prev1_arr_ts, dep_ts) AS hours, datesub('day', prev1_arr_ts, dep_ts) AS days FROM chained""".replace("SELECT leg_id", f"WITH {CHAINED} SELECT leg_id", 1))
def D09_whole_units(spark, d):
    diff = lambda u: F.timestamp_diff(u, "prev1_arr_ts", "dep_ts").alias(f"{u.lower()}s")
    return chained(spark, d).select("leg_id", diff("MINUTE"), diff("HOUR"), diff("DAY"))


@query("""SELECT event_id, date_trunc('second', ts) AS at FROM events""")
def D10_many_formats(spark, d):
    """The same instant written in three ways, one of them per row, read back."""
    fmt = F.col("event_id") % 3
    written = F.when(fmt == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(fmt == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyyMMdd HHmmss"))
    return _events(spark, d).select("event_id", clock.parsed(written, "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd HHmmss").alias("at"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def D11_epoch(spark, d):
    """Epoch values whose unit is told by their median."""
    e = _events(spark, d).select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).alias("n"))
    ms = ranks.quantiles(e, ["n"], [0.5])["n"][0] > 1e12
    return e.select("event_id", clock.epoch(F.col("n"), ms).alias("at"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def D12_date_text(spark, d):
    return _events(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS minutes FROM events")
def D13_clock_minutes(spark, d):
    return _events(spark, d).select("event_id", clock.clock_minutes(F.hour("ts") * 100 + F.minute("ts")).cast("long").alias("minutes"))


@query(f"SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) IN ({_H}) THEN 1 ELSE 0 END AS holiday FROM orders")
def D14_holiday_flag(spark, d):
    return table(spark, d, "orders").select("o_orderkey", clock.is_holiday(F.col("o_orderdate"), HOLIDAYS).cast("int").alias("holiday"))


@query(f"SELECT o_orderkey, CAST(list_min(list_transform([{_H}], lambda h: abs(datediff('day', h, CAST(o_orderdate AS DATE))))) AS BIGINT) AS days FROM orders")
def D15_nearest_holiday(spark, d):
    return table(spark, d, "orders").select("o_orderkey", clock.days_to_holiday(F.to_date("o_orderdate"), HOLIDAYS).cast("long").alias("days"))


@query("""SELECT o_orderkey, CASE WHEN abs(datediff('day', DATE '1996-11-28', CAST(o_orderdate AS DATE))) <= 3 THEN 'Thanksgiving'
 WHEN abs(datediff('day', DATE '1996-12-25', CAST(o_orderdate AS DATE))) <= 3 THEN 'Christmas'
 WHEN abs(datediff('day', DATE '1996-07-04', CAST(o_orderdate AS DATE))) <= 3 THEN 'July_4th' ELSE 'Non-Holiday' END AS holiday FROM orders""")
def D16_holiday_windows(spark, d):
    near = lambda h: F.abs(F.datediff("o_orderdate", F.to_date(F.lit(h)))) <= 3
    return table(spark, d, "orders").select("o_orderkey", F.when(near("1996-11-28"), "Thanksgiving").when(near("1996-12-25"), "Christmas").when(near("1996-07-04"), "July_4th").otherwise("Non-Holiday").alias("holiday"))


@query("""SELECT event_id, CASE WHEN hour(ts) < 6 THEN 1 WHEN hour(ts) < 11 THEN 2 WHEN hour(ts) < 14 THEN 3 WHEN hour(ts) < 18 THEN 4 WHEN hour(ts) < 21 THEN 5 ELSE 6 END AS six,
 CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 12 THEN 'Morning' WHEN hour(ts) < 18 THEN 'Midday' ELSE 'Evening' END AS four FROM events""")
def D17_parts_of_day(spark, d):
    return _events(spark, d).select("event_id", clock.six_parts(F.hour("ts")).alias("six"), clock.four_parts(F.hour("ts")).alias("four"))


@query("""SELECT event_id, CASE WHEN hour(ts) < 6 THEN '0001-0559' ELSE printf('%02d00-%02d59', hour(ts), hour(ts)) END AS block FROM events""")
def D18_hour_block(spark, d):
    return _events(spark, d).select("event_id", clock.hour_block(F.hour("ts")).alias("block"))


@query("""WITH t AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1)
SELECT o_custkey, CAST(x AS DATE) AS "from", CAST(least(x + INTERVAL 14 DAY, b) AS DATE) AS "to" FROM (SELECT o_custkey, unnest(generate_series(a, b, INTERVAL 15 DAY)) AS x, b FROM t)""")
def D19_date_ranges(spark, d):
    """The days between each customer's first and last order, 15 at a time."""
    r = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return r.select("o_custkey", F.inline(clock.day_ranges(F.col("a"), F.col("b"), 15)))


_LON, _LAT = "-160 + (event_id % 91)", "25 + (event_id % 30)"


@query(f"""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN x < -154 THEN 'Pacific/Honolulu' WHEN x <= -130 THEN 'America/Anchorage' WHEN x <= -114 THEN 'America/Los_Angeles'
 WHEN x <= -109 AND y BETWEEN 31 AND 38 THEN 'America/Phoenix' WHEN x <= -101 THEN 'America/Denver' WHEN x <= -85 THEN 'America/Chicago' ELSE 'America/New_York' END AS zone
FROM (SELECT event_id, {_LON} AS x, {_LAT} AS y FROM events)""")
def D20_zone_of_place(spark, d):
    lon = F.when(F.col("event_id") % 17 != 0, F.expr(_LON))
    return _events(spark, d).select("event_id", clock.zone_of(lon, F.expr(_LAT)).alias("zone"))


SQL["F01_no_row_function"] = SQL["D20_zone_of_place"]
SQL["F02_vector_zones"] = SQL["D05_local_to_utc"]
QUERIES["F01_no_row_function"] = D20_zone_of_place
QUERIES["F02_vector_zones"] = D05_local_to_utc


# text


@query("SELECT s_suppkey, s_name || '|' || CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS key FROM supplier")
def T01_concat(spark, d):
    """A null part makes the whole null."""
    part = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey").cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit("|"), part).alias("key"))


@query("SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS up, lower(p_brand) AS low FROM part")
def T02_trim_case(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))).alias("up"), F.lower("p_brand").alias("low"))


@query("SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') || lpad(CAST(p_size AS VARCHAR), 5, '0') AS station FROM part")
def T03_station_id(spark, d):
    return table(spark, d, "part").select("p_partkey", text.station_id(F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("station"))


@query("SELECT n_nationkey, n_name FROM nation WHERE length('N' || n_nationkey) = 3")
def T04_length(spark, d):
    return table(spark, d, "nation").where(F.char_length(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))) == 3).select("n_nationkey", "n_name")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS score FROM part""")
def T05_name_score(spark, d):
    n = F.col("p_partkey") % 3
    name = F.when(n == 0, F.concat("p_name", F.lit(" intl airport"))).when(n == 1, F.concat("p_name", F.lit(" Airport"))).otherwise("FIELD")
    return table(spark, d, "part").select("p_partkey", text.name_score(name).alias("score"))


@query("""SELECT s_suppkey, regexp_replace(regexp_replace(upper('n-' || s_name), '[^A-Z0-9]', '', 'g'), '^N', '') AS tail, regexp_replace(s_name, '[^0-9]', '', 'g') AS digits,
 round(s_acctbal, 2) AS number FROM supplier""")
def T06_regex_replace(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", text.tail_key(F.concat(F.lit("n-"), "s_name")).alias("tail"), text.digits(F.col("s_name")).alias("digits"), F.round(text.number(F.concat(F.lit("$"), F.col("s_acctbal").cast("decimal(12,2)").cast("string"))), 2).alias("number"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round((event_id % 1000) * 100 * 0.3048::DOUBLE, 1) END AS ceiling FROM events")
def T07_ceiling(spark, d):
    sky = F.when(F.col("event_id") % 4 == 0, "CLR").otherwise(F.concat(F.lit("OVC"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")))
    return _events(spark, d).select("event_id", text.ceiling_m(sky).alias("ceiling"))


def _tmp():
    n = F.col("event_id")
    return F.when(n % 7 == 0, "+9999,9").when(n % 7 == 1, "bad").otherwise(F.concat(F.when(n % 2 == 0, "+").otherwise("-"), F.lpad((n % 400).cast("string"), 4, "0"), F.lit(",1")))


_TMP = "CASE WHEN event_id % 7 = 0 THEN {miss} WHEN event_id % 7 = 1 THEN NULL ELSE (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * (event_id % 400) / 10 END"


@query(f"SELECT event_id, {_TMP.format(miss='999.9')} AS celsius FROM events")
def T08_packed_kept(spark, d):
    return _events(spark, d).select("event_id", text.packed(_tmp(), 0, 10, keep_missing=True).alias("celsius"))


@query(f"SELECT event_id, {_TMP.format(miss='NULL')} AS celsius FROM events")
def T09_packed_missing(spark, d):
    return _events(spark, d).select("event_id", text.packed(_tmp(), 0, 10).alias("celsius"))


@query("SELECT user_id, event_id, lpad(printf('%x', event_id * 2654435), 6, '0') AS hex FROM events")
def T10_hex_id(spark, d):
    return _events(spark, d).select("user_id", "event_id", text.hex_id(F.concat(F.lit("0X"), F.hex(F.col("event_id") * 2654435), F.lit("-"))).alias("hex"))


@query("SELECT s_suppkey, ltrim(regexp_extract(s_name, '([0-9]+)$', 1), '0') AS number FROM supplier")
def T11_last_token(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.last_token(F.concat(F.lit(" flight "), F.regexp_replace("s_name", "#", " "), F.lit("  "))).alias("number"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'none' END AS first FROM customer")
def T12_first_filled(spark, d):
    n = F.col("c_custkey") % 3
    a = F.when(n == 0, F.col("c_name")).when(n == 1, "")
    b = F.when(n == 1, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", text.first_filled(a, b, F.lit("none")).alias("first"))


# numbers


@query(f"WITH {CHAINED} SELECT leg_id, CASE WHEN arr_delay > 15 THEN 'late' ELSE 'other' END AS state, CASE WHEN prev1_arr_delay > 15 THEN 1 WHEN prev1_arr_delay IS NULL THEN -1 ELSE 0 END AS prev FROM chained")
def M01_when(spark, d):
    p = F.col("prev1_arr_delay")
    return chained(spark, d).select("leg_id", F.when(F.col("arr_delay") > 15, "late").otherwise("other").alias("state"), F.when(p > 15, 1).when(p.isNull(), -1).otherwise(0).alias("prev"))


@query(f"WITH {CHAINED} SELECT leg_id, CAST(prev1_arr_delay > 15 AS INTEGER) AS late FROM chained")
def M02_flag_keeps_null(spark, d):
    return chained(spark, d).select("leg_id", buckets.flag(F.col("prev1_arr_delay") > 15).cast("int").alias("late"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS size FROM part")
def M03_lenient_cast(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("x1")
    return table(spark, d, "part").select("p_partkey", t.try_cast("int").alias("size"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE least(greatest(p_size - 10, 0), 30) END AS age FROM part")
def M04_clip(spark, d):
    age = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") - 10)
    return table(spark, d, "part").select("p_partkey", buckets.clipped(age, 0, 30).alias("age"))


@query(f"WITH {CHAINED} SELECT leg_id, round(greatest(coalesce(prev1_arr_delay, 0) - coalesce(turnaround, 0) / 60.0, 0), 4) AS inherited, round(greatest(prev1_arr_delay, 0.0), 4) AS positive FROM chained")
def M05_greatest(spark, d):
    inherited = F.greatest(F.coalesce("prev1_arr_delay", F.lit(0)) - F.coalesce("turnaround", F.lit(0)) / 60.0, F.lit(0.0))
    return chained(spark, d).select("leg_id", F.round(inherited, 4).alias("inherited"), F.round(F.greatest("prev1_arr_delay", F.lit(0.0)), 4).alias("positive"))


@query("SELECT p_partkey, round(p_retailprice / nullif(p_size % 5, 0), 4) AS ratio, p_partkey // 7 AS whole, p_partkey % 7 AS rest FROM part")
def M06_division(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.try_divide("p_retailprice", F.col("p_size") % 5), 4).alias("ratio"), F.floor(F.col("p_partkey") / 7).alias("whole"), (F.col("p_partkey") % 7).alias("rest"))


@query("SELECT s_suppkey, abs(s_acctbal) AS a, floor(s_acctbal) AS f, round(sqrt(abs(s_acctbal)), 4) AS r FROM supplier")
def M07_round_root(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("a"), F.floor("s_acctbal").cast("double").alias("f"), F.round(F.sqrt(F.abs("s_acctbal")), 4).alias("r"))


@query("SELECT event_id, round(value * 0.514444, 6) AS m_s, round(value * 2.23694, 6) AS mph, round(value * 3.28084, 6) AS ft FROM events")
def M08_units(spark, d):
    return _events(spark, d).select("event_id", *(F.round(F.col("value") * k, 6).alias(n) for n, k in (("m_s", buckets.KNOT_M_S), ("mph", buckets.M_S_MPH), ("ft", buckets.M_FT))))


def _case(c: str, ladder, op: str = "<", null: str = "NULL") -> str:
    steps, above = ladder
    return f"CASE WHEN {c} IS NULL THEN {null} " + " ".join(f"WHEN {c} {op} {u} THEN '{n}'" for u, n in steps) + f" ELSE '{above}' END"


@query(f"SELECT event_id, {_case('value', buckets.WIND_MPH, '<=')} AS wind FROM events")
def M09_cut(spark, d):
    """Right-closed bins, the lowest value included."""
    return _events(spark, d).select("event_id", buckets.ladder(F.col("value"), *buckets.WIND_MPH, closed=True).alias("wind"))


@query(f"""WITH {CHAINED} SELECT leg_id, {_case('turnaround', buckets.TURNAROUND)} AS turn, {_case('turnaround', buckets.TURNAROUND_FINE)} AS turn_fine, {_case('prev1_arr_delay', buckets.PREVIOUS_DELAY, '<=')} AS previous,
 {_case('dep_delay', buckets.DELAY_STATE, '<=')} AS state, {_case('distance', buckets.PLANE_SIZE, '<=')} AS size, {_case('distance', buckets.CEILING_FT)} AS ceiling FROM chained""")
def M10_bucket_families(spark, d):
    b = lambda c, x, closed=False: buckets.ladder(F.col(c), *x, closed=closed)
    return chained(spark, d).select(
        "leg_id", b("turnaround", buckets.TURNAROUND).alias("turn"), b("turnaround", buckets.TURNAROUND_FINE).alias("turn_fine"), b("prev1_arr_delay", buckets.PREVIOUS_DELAY, True).alias("previous"),
        b("dep_delay", buckets.DELAY_STATE, True).alias("state"), b("distance", buckets.PLANE_SIZE, True).alias("size"), b("distance", buckets.CEILING_FT).alias("ceiling"),
    )


def _names(c: str, names: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " ELSE 'unknown' END"


@query(f"SELECT p_partkey, {_names('p_size % 14', buckets.ENGINES)} AS engine, {_names('p_size % 12', buckets.AIRCRAFT)} AS aircraft, {_names('p_size % 11', buckets.REGISTRANTS)} AS registrant, {_names('p_size % 5', buckets.WEIGHTS)} AS weight FROM part")
def M11_decode(spark, d):
    n = lambda k, t, a: buckets.decode(F.col("p_size") % k, t).alias(a)
    return table(spark, d, "part").select("p_partkey", n(14, buckets.ENGINES, "engine"), n(12, buckets.AIRCRAFT, "aircraft"), n(11, buckets.REGISTRANTS, "registrant"), n(5, buckets.WEIGHTS, "weight"))


@query(f"WITH {CHAINED} SELECT leg_id, round(turnaround / (1.0 + tail % 30), 4) AS turn_per_age, round(prev1_arr_delay * (tail % 30), 4) AS delay_x_age FROM chained")
def M12_interactions(spark, d):
    age = F.col("tail") % 30
    return chained(spark, d).select("leg_id", F.round(F.col("turnaround") / (age + 1.0), 4).alias("turn_per_age"), F.round(F.col("prev1_arr_delay") * age, 4).alias("delay_x_age"))


@query("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 4) AS z FROM supplier")
def M13_z_score(spark, d):
    """Mean and deviation come as one row, not through a window over all rows."""
    s = table(spark, d, "supplier")
    m = s.agg(F.avg("s_acctbal"), F.stddev_samp("s_acctbal")).first()
    return s.select("s_suppkey", F.round((F.col("s_acctbal") - m[0]) / m[1], 4).alias("z"))


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS brand FROM part")
def M14_ordinal(spark, d):
    """Codes from the distinct values, joined back: rows aren't gathered to be ranked."""
    from pyspark.sql import Window as W

    p = table(spark, d, "part")
    codes = p.select("p_brand").distinct().withColumn("brand", F.row_number().over(W.orderBy("p_brand")).cast("long"))
    return p.join(codes, "p_brand").select("p_partkey", "brand")


@query(f"SELECT event_id, {_case('value / 100', buckets.RISK)} AS tier FROM events")
def M15_risk_tier(spark, d):
    return _events(spark, d).select("event_id", buckets.ladder(F.col("value") / 100, *buckets.RISK).alias("tier"))


@query(f"WITH {CHAINED} SELECT leg_id, CASE WHEN prev2_arr_delay < 3 THEN 1 ELSE 0 END AS low, CASE WHEN prev1_arr_delay > 20 OR prev2_arr_delay > 20 THEN 1 ELSE 0 END AS high FROM chained")
def M16_sure_flags(spark, d):
    p1, p2 = F.col("prev1_arr_delay"), F.col("prev2_arr_delay")
    return chained(spark, d).select("leg_id", buckets.sure(p2 < 3).alias("low"), buckets.sure((p1 > 20) | (p2 > 20)).alias("high"))


@query(f"""WITH {CHAINED} SELECT leg_id, CAST(origin IN ('N1', 'N2', 'N3') AS INTEGER) AS origin_in, CAST(prev1_dest = origin AS INTEGER) AS feeds, CAST(prev1_arr_delay > 15 AS INTEGER) AS late1, CAST(prev2_arr_delay > 15 AS INTEGER) AS late2,
 CAST(turnaround < 45 AS INTEGER) AS tight, CAST(datesub('minute', prev2_arr_ts, dep_ts) < 180 AS INTEGER) AS compressed, round(coalesce(prev1_arr_delay, 0) + coalesce(prev2_arr_delay, 0), 4) AS sum2 FROM chained""")
def M17_chain_flags(spark, d):
    f = lambda c, n: buckets.flag(c).cast("int").alias(n)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chained(spark, d).select(
        "leg_id", f(F.col("origin").isin("N1", "N2", "N3"), "origin_in"), f(F.col("prev1_dest") == F.col("origin"), "feeds"), f(F.col("prev1_arr_delay") > 15, "late1"), f(F.col("prev2_arr_delay") > 15, "late2"),
        f(F.col("turnaround") < 45, "tight"), f(F.timestamp_diff("MINUTE", "prev2_arr_ts", "dep_ts") < 180, "compressed"), F.round(zero("prev1_arr_delay") + zero("prev2_arr_delay"), 4).alias("sum2"),
    )


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
 CASE WHEN o_orderkey % 24 IN (6, 7, 8, 9) THEN 'morning_push' WHEN o_orderkey % 24 IN (15, 16, 17, 18, 19) THEN 'afternoon_push' ELSE 'other' END AS push,
 CAST(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3000 END, 99999) < 1000 AS INTEGER) AS low FROM orders""")
def M18_season_push(spark, d):
    ceiling = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3000)
    return table(spark, d, "orders").select("o_orderkey", buckets.season(F.month("o_orderdate")).alias("season"), buckets.push_period(F.col("o_orderkey") % 24).alias("push"), buckets.flag(F.coalesce(ceiling, F.lit(99999)) < 1000).cast("int").alias("low"))


@query("""WITH m AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)
SELECT p_partkey, CAST(least(floor((p_retailprice - a) / (b - a) * 5) + 1, 5) AS BIGINT) AS bin FROM part, m""")
def M19_equal_width(spark, d):
    p = table(spark, d, "part")
    a, b = p.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    return p.select("p_partkey", F.least(F.floor((F.col("p_retailprice") - a) / (b - a) * 5) + 1, F.lit(5)).cast("long").alias("bin"))


# nested


@query("SELECT p_partkey, split_part(p_name, ' ', 2) AS second, NULL::VARCHAR AS ninth FROM part")
def N01_split_get(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.get(words, F.lit(1)).alias("second"), F.get(words, F.lit(8)).alias("ninth"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part")
def N02_split_struct(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.struct(F.get(words, F.lit(0)).alias("a"), F.get(words, F.lit(1)).alias("b")).alias("parts")).select("p_partkey", "parts.a", "parts.b")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def N03_nested_to_flat(spark, d):
    nested = F.struct(F.from_json("props", "k long").alias("inner"), "event_type")
    return _events(spark, d).select("event_id", nested.alias("r")).select("event_id", "r.inner.k", "r.event_type")


@query("SELECT s_suppkey, 'balance' AS metric, s_acctbal AS amount FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def N04_longer(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "metric", "amount")


@query(f"""WITH {LEGS} SELECT carrier, round(avg(arr_delay) FILTER (month(day) = 1), 4) AS "1", round(avg(arr_delay) FILTER (month(day) = 2), 4) AS "2", round(avg(arr_delay) FILTER (month(day) = 3), 4) AS "3" FROM legs GROUP BY 1""")
def N05_wider(spark, d):
    return legs(spark, d).withColumn("m", F.month("day")).groupBy("carrier").pivot("m", [1, 2, 3]).agg(F.round(F.avg("arr_delay"), 4))


def _step_sql(variant: str) -> str:
    shown = lambda c: f"coalesce(f.{c}, m.{c})" if c in features.TWO_HOP else f"f.{c}"
    earlier = lambda hop, gap: [*(f"prev{hop}_{k}" for k in ("arr_delay", "dep_delay", "arr_del15", "dep_del15")), gap, *(None for _ in features.AROUND)]
    current = [*(None for _ in features.KNOWN), *(c if c in features.VARIANTS[variant] else None for c in features.AROUND)]
    steps = (earlier(2, "time_since_prev2_arrival_minutes"), earlier(1, "prev1_turnaround_minutes"), current)
    return "[" + ", ".join("[" + ", ".join(f"round({shown(c)}, 4)" if c else "0.0::DOUBLE" for c in s) + "]" for s in steps) + "]"


@query(f"""WITH {FEATURED}, m AS (SELECT {", ".join(f"median({c}) AS {c}" for c in features.TWO_HOP)} FROM featured)
SELECT leg_id, {", ".join(f"{_step_sql(v)} AS {v}" for v in features.VARIANTS)} FROM featured f, m""")
def N06_sequences(spark, d):
    """Three steps of 29 features, oldest first, in both variants; missing delays and gaps are their medians."""
    x = cut(featured(spark, d).select("leg_id", *features.SHOWN), "featured")  # the windows run once, quantiles read this
    fill = {c: q[0] for c, q in ranks.quantiles(x, list(features.TWO_HOP), [0.5]).items() if q[0] is not None}
    x = x.select("leg_id", *(F.round(F.coalesce(c, F.lit(fill[c])) if c in fill else c, 4).alias(c) for c in features.SHOWN))
    return x.select("leg_id", *(features.sequences(x, v, {}).alias(v) for v in features.VARIANTS))


@query("SELECT h, CAST(unnest(generate_series(h - INTERVAL 3 DAY, h + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS h FROM orders)")
def N07_explode_dates(spark, d):
    """Three days to either side of every day with an order."""
    h = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("h")).distinct()
    return h.select("h", F.explode(F.sequence(F.date_sub("h", 3), F.date_add("h", 3))).alias("day"))


@query("SELECT event_id, event_type, round(value, 2) AS value FROM events")
def N08_xml_records(spark, d):
    """Two records to a document, read back with from_xml."""
    e = _events(spark, d).withColumn("doc", F.floor(F.col("event_id") / 2))
    one = F.format_string('<e id="%d" kind="%s"><v>%.2f</v></e>', "event_id", "event_type", "value")
    docs = e.groupBy("doc").agg(F.concat(F.lit("<es>"), F.concat_ws("", F.collect_list(one)), F.lit("</es>")).alias("x"))
    got = docs.select(F.explode(F.from_xml("x", "e array<struct<_id:long,_kind:string,v:double>>").getField("e")).alias("e"))
    return got.select(F.col("e._id").alias("event_id"), F.col("e._kind").alias("event_type"), F.round("e.v", 2).alias("value"))


class _Parts:
    """A table function: the parts of a text between signs, with their places."""

    def eval(self, text: str, sign: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split(sign), 1)


@query("SELECT p_partkey, CAST(i AS INTEGER) AS n, string_split(p_name, ' ')[i] AS part FROM (SELECT p_partkey, p_name, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS i FROM part)")
def F03_one_to_many(spark, d):
    """One text to n rows by a user's own table function, joined laterally in SQL. Rows go to it pickled in batches:
    by Arrow, the result of each single row would be a batch of its own."""
    spark.udtf.register("waypath_parts", F.udtf(_Parts, returnType="n int, part string", useArrow=False))
    return spark.sql("SELECT p_partkey, n, part FROM {parts}, LATERAL waypath_parts(p_name, ' ')", parts=table(spark, d, "part").select("p_partkey", "p_name"))


@query(f"WITH {LEGS} SELECT origin, list_sort(list(DISTINCT dest)) AS dests FROM legs WHERE cancelled = 1 GROUP BY 1")
def N09_adjacency(spark, d):
    return legs(spark, d).where("cancelled = 1").groupBy("origin").agg(F.array_sort(F.collect_set("dest")).alias("dests"))


@query(f"""WITH {LEGS} SELECT leg_id, row_number() OVER w AS n, round(sum(coalesce(arr_delay, 0)) OVER w, 4) AS total FROM legs WINDOW w AS (PARTITION BY tail, day ORDER BY dep_ts NULLS FIRST, leg_id ROWS UNBOUNDED PRECEDING)""")
def F04_state_machine(spark, d):
    """What a per-key state machine would hold after each row, as windows."""
    from pyspark.sql import Window as W

    w = W.partitionBy("tail", "day").orderBy("dep_ts", "leg_id")
    return legs(spark, d).select("leg_id", F.row_number().over(w).cast("long").alias("n"), F.round(F.sum(F.coalesce("arr_delay", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)), 4).alias("total"))


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id, CAST(ts AS DATE)), 6) AS off FROM events")
def F05_group_transform(spark, d):
    from pyspark.sql import Window as W

    return _events(spark, d).select("event_id", F.round(F.col("value") - F.avg("value").over(W.partitionBy("user_id", F.to_date("ts"))), 6).alias("off"))


@query("SELECT event_id, round(value * 2, 4) AS twice FROM events")
def F06_registered_function(spark, d):
    """A user's own vectorised function under a name in SQL."""
    spark.udf.register("waypath_twice", F.pandas_udf(lambda s: s * 2.0, "double"))
    return _events(spark, d).select("event_id", F.round(F.call_udf("waypath_twice", "value"), 4).alias("twice"))
