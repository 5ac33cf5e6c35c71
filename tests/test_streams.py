"""Streams: state over several batches, messages as they come."""

import random
import time
from datetime import datetime as dt
from datetime import timedelta

from pyspark.sql import functions as F

from waypath.session import having, scratch
from waypath.streaming import messages, run, state

LEG = "key string, leg_id long, origin string, dest string, dep_ts timestamp, arr_ts timestamp, dep_delay double, arr_delay double"


def rotated(spark, stream, lateness):
    return run.closed(stream, lambda x: state.rotation(x, lateness), state.end(stream), "t", state.ROCKSDB)


def chain(rows):
    """What a window over all legs of a key gives."""
    out = {}
    for key in {r[0] for r in rows}:
        prev, days = None, {}
        for _, leg, origin, dest, dep, arr, dep_delay, arr_delay in sorted((r for r in rows if r[0] == key), key=lambda r: (r[4], r[1])):
            n, total = days.get(dep.date(), (0, 0.0))
            days[dep.date()] = n + 1, total + (dep_delay or 0.0)
            gap = None if prev is None else (dep - prev[5]).total_seconds() / 60
            turn = round(gap, 1) if gap is not None and 0 <= gap <= 720 else None
            out[leg] = (prev and prev[1], prev and prev[7], turn, int(prev is not None and prev[3] == origin), n + 1, days[dep.date()][1])
            prev = (key, leg, origin, dest, dep, arr, dep_delay, arr_delay)
    return out


def test_shuffled_legs_over_many_chunks_and_batches(spark):
    rng, rows = random.Random(4), []
    for i in range(600):
        dep = dt(2024, 1, 1) + timedelta(minutes=rng.randrange(20 * 1440))
        rows.append((rng.choice(["X", "X", "X", "Y", "Z"]), i, rng.choice("AB"), rng.choice("AB"), dep, dep + timedelta(minutes=60), float(rng.randrange(9)), None if i % 9 == 0 else float(i)))
    rng.shuffle(rows)
    path = scratch(spark, "shuffled")
    for i in range(0, 600, 150):
        spark.createDataFrame(rows[i : i + 150], LEG).coalesce(1).write.mode("append").parquet(path)
    with having(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "10"}):
        got = rotated(spark, spark.readStream.schema(LEG).option("maxFilesPerTrigger", 1).parquet(path), "30 days").collect()
    assert len(got) == 600
    assert {r.leg_id: (r.prev_leg_id, r.prev_arr_delay, r.turnaround, r.continuity, r.leg_number_day, r.cum_delay_day) for r in got} == chain(rows)


def test_legs_are_given_out_by_the_watermark_and_late_ones_dropped(spark):
    leg = lambda i, h: ("X", i, "A", "A", dt(2024, 1, 1 + h // 24, h % 24), dt(2024, 1, 1 + h // 24, h % 24, 30), 0.0, 0.0)
    path = scratch(spark, "late")
    for part in ([leg(1, 5), leg(2, 3)], [leg(3, 4), leg(4, 12)], [leg(5, 8), leg(6, 1)], [leg(7, 30)]):
        spark.createDataFrame(part, LEG).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(LEG).option("maxFilesPerTrigger", 1).parquet(path)
    assert [r.leg_id for r in run.finished(state.rotation(stream, "2 hours"), "late", conf=state.ROCKSDB).collect() if r.leg_id == 7] == []  # it waits
    got = {r.leg_id: r.prev_leg_id for r in rotated(spark, stream, "2 hours").collect()}
    assert got == {2: None, 3: 2, 1: 3, 4: 1, 7: 4} or got == {2: None, 3: 2, 1: 3, 5: 1, 4: 5, 7: 4}
    assert 6 not in got  # seven hours behind the latest
    (name, store), = state.ROCKSDB.items()
    assert spark.conf.get(name) != store  # the session's own setting is back


def test_lookups_expire(spark):
    """Two reads while a value is held, one after; a null id isn't looked up, a null value isn't held."""
    path, out = scratch(spark, "lookups"), scratch(spark, "held")
    fetch = lambda k: None if k == "none" else f"{k}-{time.time_ns()}"
    seen = []
    for i in range(3):
        spark.createDataFrame([(i, "a"), (i, None), (i, "none")], "n int, id string").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("n int, id string").parquet(path)
        rows = run.finished(state.looked_up(stream, "id", fetch, "v", ttl_seconds=600, shards=2, copies=1), "held", path=out, conf=state.EXPIRING)
        seen.append({(r.n, r.id): r.v for r in rows.collect()})
    assert seen[2][0, "a"] == seen[2][1, "a"] == seen[2][2, "a"] and seen[2][0, "a"].startswith("a-")
    assert seen[2][1, None] is None and seen[2][1, "none"] is None
    path, out, seen = scratch(spark, "lookups"), scratch(spark, "held"), []
    for i in range(2):
        spark.createDataFrame([(i, "a")], "n int, id string").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("n int, id string").parquet(path)
        rows = run.finished(state.looked_up(stream, "id", fetch, "v", ttl_seconds=0.5, shards=2, copies=1), "held", path=out, conf=state.EXPIRING)
        seen = {r.n: r.v for r in rows.collect()}
        time.sleep(1)
    assert seen[0] != seen[1]  # fetched again


def test_state_goes_on_from_batch_to_batch(spark):
    path = scratch(spark, "legs")
    first = [("X", 2, "B", "C", dt(2024, 1, 1, 10), dt(2024, 1, 1, 11), 4.0, 7.0), ("X", 1, "A", "B", dt(2024, 1, 1, 8), dt(2024, 1, 1, 9), 1.0, None)]
    later = [("X", 3, "D", "E", dt(2024, 1, 2, 12), dt(2024, 1, 2, 13), 2.0, 0.0), ("Y", 9, "A", "A", dt(2024, 1, 2, 1), dt(2024, 1, 2, 2), None, None)]
    for rows in (first, later):
        spark.createDataFrame(rows, LEG).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(LEG).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.leg_id: (r.prev_leg_id, r.prev_arr_delay, r.turnaround, r.continuity, r.leg_number_day, r.cum_delay_day) for r in rotated(spark, stream, "1 hour").collect()}
    assert got[1] == (None, None, None, 0, 1, 1.0)
    assert got[2] == (1, None, 60.0, 1, 2, 5.0)
    assert got[3] == (2, 7.0, None, 0, 1, 2.0)  # over 12 hours isn't a turnaround; a new day
    assert got[9] == (None, None, None, 0, 1, 0.0)


XML = """<m xmlns:a="u"><a:fltdMessage acid="ab1" airline="AB" depArpt="KA" arrArpt="KB" msgType="departureInformation"><a:departureInformation><a:ncsmFlightTimeData>
<a:etd etdType="ESTIMATED" timeValue="2026-04-18T09:00:00Z"/><a:etd etdType="ACTUAL" timeValue="2026-04-18T09:06:00Z"/></a:ncsmFlightTimeData></a:departureInformation>
<b:gufi>G1</b:gufi><b:igtd>2026-04-18T08:46:00Z</b:igtd></a:fltdMessage>
<a:fltdMessage acid="AB2" msgType="departureInformation"><b:gufi>G2</b:gufi></a:fltdMessage>
<a:fltdMessage acid="AB3" msgType="trackInformation"><b:igtd>2026-04-18T08:46:00Z</b:igtd></a:fltdMessage></m>"""


def test_messages(spark):
    docs = messages.parsed(spark.createDataFrame([(1, XML), (2, "<m><broken"), (3, None)], "id int, xml string"))
    assert {r.id for r in docs.where(messages.malformed(docs)).collect()} == {2, 3}
    rows = messages.records(docs).collect()
    assert [(r.callsign, r.flight_id, r.dep_actual, r.dep_delay) for r in rows] == [("AB1", "G1", dt(2026, 4, 18, 9, 6), 20.0)]
    blocked = spark.createDataFrame([("AB1",)], "callsign string")
    assert messages.records(docs, blocked).count() == 0


def test_duplicates_are_taken_once(spark):
    path = scratch(spark, "dup")
    spark.createDataFrame([(1, dt(2024, 1, 1)), (1, dt(2024, 1, 1)), (2, dt(2024, 1, 1))], "id long, at timestamp").write.parquet(path)
    s = spark.readStream.schema("id long, at timestamp").parquet(path).withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["id"])
    assert run.finished(s, "dup").agg(F.count("*")).first()[0] == 2


def _files(spark, n):
    path = scratch(spark, "many")
    for i in range(n):
        spark.createDataFrame([(i, j) for j in range(5)], "f long, j long").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("f long, j long").option("maxFilesPerTrigger", 1).parquet(path)


def test_a_stream_ends_by_rows_by_time_or_when_read(spark):
    stream = _files(spark, 4)
    rows, why = run.flushed(stream, "f", 2)
    assert why == "read" and rows.count() == 20 and len(rows.inputFiles()) >= 12
    rows, why = run.flushed(stream, "f", 100, most=8)
    assert why == "records" and rows.count() == 10  # whole batches
    rows, why = run.flushed(stream, "f", 100, seconds=0)
    assert why == "time" and rows.count() == 5


def test_counters_cover_every_batch(spark):
    rows, totals = run.counted(_files(spark, 3), "c", n=F.count("*"), twos=F.count_if(F.col("j") == 2))
    assert rows.count() == 15 and tuple(totals.first()) == (15, 3)
