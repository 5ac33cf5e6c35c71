"""Streaming queries (R): each runs a stream over what is there to its end and returns its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from waypath.plans.legs import Registry
from waypath.session import table
from waypath.streaming import messages, run, state

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _xml():
    """A document of one message per event: types by kind, times by value, every 50th cut off."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = lambda n: F.col("ts") + F.make_dt_interval(mins=F.lit(n))
    kind = F.when(F.col("event_type") == "view", "trackInformation").otherwise("departureInformation")
    body = F.format_string(
        '<ns2:msgs><ns2:fltdMessage acid="AB%d" airline="AB" depArpt="K%d" arrArpt="K%d" msgType="%s"><ns2:departureInformation><ns3:ncsmFlightTimeData>'
        '<ns3:etd etdType="ESTIMATED" timeValue="%s"/><ns3:etd etdType="%s" timeValue="%s"/></ns3:ncsmFlightTimeData></ns2:departureInformation>'
        "<ns4:gufi>G%d</ns4:gufi><ns4:igtd>%s</ns4:igtd></ns2:fltdMessage></ns2:msgs>",
        F.col("user_id"), F.col("user_id") % 20, F.col("event_id") % 20, kind, iso(later(5)),
        F.when(F.col("event_id") % 2 == 0, "ACTUAL").otherwise("ESTIMATED"), iso(later(30)), F.col("event_id"), iso(F.col("ts")),
    )
    return F.when(F.col("event_id") % 50 == 0, F.substring(body, 1, 60)).otherwise(body).alias("xml")


def _documents(spark, d):
    return messages.parsed(run.source(spark, d, "events").select("event_id", _xml()))


_KEPT = "FROM events WHERE event_id % 50 <> 0 AND event_type <> 'view'"


@query(f"""SELECT 'G' || event_id AS flight_id, 'AB' || user_id AS callsign, 'K' || (user_id % 20) AS origin, date_trunc('second', ts) AS dep_sched {_KEPT}""")
def R01_message_parse(spark, d):
    return run.finished(messages.records(_documents(spark, d)).select("flight_id", "callsign", "origin", "dep_sched"), "r01")


@query("SELECT event_id, 'AB' || user_id AS callsign FROM events WHERE event_id % 50 <> 0")
def R02_explode(spark, d):
    docs = _documents(spark, d)
    return run.finished(docs.where(~messages.malformed(docs)).select("event_id", F.explode("doc.fltdMessage").alias("m")).select("event_id", F.col("m._acid").alias("callsign")), "r02")


@query(f"SELECT 'departureInformation' AS message_type, count(*) AS n {_KEPT}")
def R03_type_filter(spark, d):
    return run.finished(messages.records(_documents(spark, d)).groupBy("message_type").agg(F.count("*").alias("n")), "r03", "complete")


@query("SELECT event_id FROM events WHERE event_id % 50 = 0")
def R04_malformed(spark, d):
    docs = _documents(spark, d)
    return run.finished(docs.where(messages.malformed(docs)).select("event_id"), "r04")


@query(f"SELECT 'G' || event_id AS flight_id, CASE WHEN event_id % 2 = 0 THEN 30.0 ELSE 5.0 END AS dep_delay {_KEPT}")
def R05_actual_first(spark, d):
    return run.finished(messages.records(_documents(spark, d)).select("flight_id", "dep_delay"), "r05")


_CHAIN = """SELECT CAST(user_id AS VARCHAR) AS key, event_id AS leg_id, lag(event_id) OVER w AS prev_leg_id, lag(value) OVER w AS prev_arr_delay,
 CASE WHEN lag('K' || (event_id % 20)) OVER w = 'K' || (user_id % 20) THEN 1 ELSE 0 END AS continuity,
 CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS leg_number_day,
 round(sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS cum_delay_day
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def _rotation(spark, d):
    e = run.source(spark, d, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("leg_id"), F.concat(F.lit("K"), (F.col("user_id") % 20).cast("string")).alias("origin"),
        F.concat(F.lit("K"), (F.col("event_id") % 20).cast("string")).alias("dest"), F.col("ts").cast("timestamp").alias("dep_ts"),
        (F.col("ts") + F.make_dt_interval(mins=F.lit(20))).cast("timestamp").alias("arr_ts"), F.col("value").alias("dep_delay"), F.col("value").alias("arr_delay"),
    )
    end = state.end(e)
    got = run.closed(e, lambda x: state.rotation(x, "1 day"), end, "rotation", state.ROCKSDB)
    return got.select("key", "leg_id", "prev_leg_id", "prev_arr_delay", "continuity", "leg_number_day", F.round("cum_delay_day", 4).alias("cum_delay_day"))


@query(_CHAIN)
def R06_rotation_state(spark, d):
    """Equal to the windows over the same rows, in whatever order they arrive."""
    return _rotation(spark, d)


@query("SELECT event_id, n_name FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey")
def R07_fresh_lookup(spark, d):
    """Lookups that are held for ten minutes. The 25 rows of the dimension stand for the service that is asked."""
    names = {str(r.n_nationkey): r.n_name for r in table(spark, d, "nation").collect()}
    e = run.source(spark, d, "events").select("event_id", (F.col("user_id") % 25).cast("string").alias("place"))
    return run.finished(state.looked_up(e, "place", names.get, "n_name", ttl_seconds=600), "r07", conf=state.EXPIRING).select("event_id", "n_name")


@query("SELECT event_id, user_id FROM events")
def R08_flushed_batches(spark, d):
    """A file at a time, flushed in files of 1000 rows, and an end when all is read: no limit of rows or time is reached."""
    return run.flushed(run.source(spark, d, "events", files_per_trigger=1).select("event_id", "user_id"), "r08", 1000, seconds=3600)[0]


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events")
def R09_progress_counters(spark, d):
    return run.counted(run.source(spark, d, "events"), "r09", n=F.count("*"), errors=F.count_if(F.col("event_type") == "error"))[1]


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def R10_static_anti_join(spark, d):
    blocked = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("user_id"))
    return run.finished(run.source(spark, d, "events").join(blocked, "user_id", "left_anti").select("event_id", "user_id"), "r10")


@query()
def R11_debug_dump(spark, d):
    """The first five rows of each batch: a sampling operator."""
    return run.dumped(run.source(spark, d, "events").select("event_id", "props"), "r11", 5)


@query("SELECT x AS snapshot_time, 'v' || i AS id, CAST(i AS DOUBLE) AS longitude FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 05:00:00', INTERVAL 1 HOUR)) AS x), range(3) t(i)")
def R12_snapshot_polling(spark, d):
    from waypath.sources.snapshots import Snapshots

    spark.dataSource.register(Snapshots)
    s = spark.readStream.format("snapshots").options(start="2024-01-01T00:00:00", end="2024-01-01T05:00:00", every="3600").load()
    return run.finished(s.select(F.col("snapshot_time").cast("timestamp_ntz").alias("snapshot_time"), "id", "longitude"), "r12")


@query("""SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, round(avg(value), 4) AS mean FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def R13_hourly_windows(spark, d):
    """Hours that the watermark has closed: the streaming twin of the hourly table."""
    e = run.source(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")
    w = e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return run.finished(w.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", "mean"), "r13")


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def R14_dedup_within_watermark(spark, d):
    """Every event sent twice, taken once."""
    e = run.source(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 hours")
    twice = e.select("event_id", "at", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return run.finished(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "r14").agg(F.count("*").alias("n"))
