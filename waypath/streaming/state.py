"""Keyed state: what the last leg of a key leaves for the next, and lookups that expire."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Spark also starts a worker beside the driver for keyed state, which doesn't see files added to the job: the processors travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keyed state needs this store.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: And so do values that expire; without batches of no rows, which such state would ask for again and again, a run of what is there comes to an end.
EXPIRING = ROCKSDB | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
LONGEST_TURN = 720  # minutes; a longer or negative gap isn't a turnaround

LEG = "dep_us long, leg_id long, origin string, dest string, arr_us long, dep_delay double, arr_delay double, day string"
LAST = "leg_id long, dest string, arr_us long, arr_delay double, day string, legs int, cum_delay double"
OUTPUT = "key string, leg_id long, prev_leg_id long, prev_arr_delay double, turnaround double, continuity int, leg_number_day int, cum_delay_day double"
_FIELDS = [c.split()[0] for c in LEG.split(", ")]
_OUT = Row(*(c.split()[0] for c in OUTPUT.split(", ")))
#: Legs of a key that wait are kept by the day of departure, so that never more than a day of them is read at once.
BUCKET = 86_400_000_000
#: Rows of a key that are taken in before the buckets are written.
AT_ONCE = 10_000


def followed(key: str, legs: list[tuple], last: tuple | None) -> tuple[list[Row], tuple]:
    """OUTPUT of ``legs`` (LEG), in order of departure, after ``last`` (LAST), and what they leave.

    Counters start anew with a day; a delay that is missing counts as none.
    """
    out = []
    for dep, leg_id, origin, dest, arr, dep_delay, arr_delay, day in sorted(legs, key=lambda leg: leg[:2]):
        number, total = 1, dep_delay or 0.0
        prev_id = prev_delay = turn = None
        joined = 0
        if last is not None:
            prev_id, prev_dest, prev_arr, prev_delay, prev_day, prev_n, prev_total = last
            gap = None if prev_arr is None else (dep - prev_arr) / 60e6
            turn = round(gap, 1) if gap is not None and 0 <= gap <= LONGEST_TURN else None
            joined = int(prev_dest == origin)
            if prev_day == day:
                number, total = prev_n + 1, prev_total + total
        out.append(_OUT(key, leg_id, prev_id, prev_delay, turn, joined, number, total))
        last = (leg_id, dest, arr, arr_delay, day, number, total)
    return out, last


class Rotation(StatefulProcessor):
    """A reorder buffer and the last leg of each key.

    Legs wait in the key's state, in whatever order, chunk or batch they come. A timer of the key stands at its earliest
    waiting departure; when the watermark reaches it, all legs up to the watermark are given out in order of departure
    (then leg_id), a bucket at a time. No leg before the watermark can come later (Spark drops it as late), so the result
    depends on neither chunks nor batches.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)
        self.timer = handle.getValueState("timer", "at long")
        self.waiting = handle.getMapState("waiting", "bucket long", f"legs array<struct<{', '.join(f'{n}: {t}' for n, t in (c.split() for c in LEG.split(', ')))}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        earliest, found, held = None, [], self.timer.exists()  # a key without a timer has no legs that wait
        for row in rows:
            found.append(tuple(row[c] for c in _FIELDS))
            earliest = found[-1][0] if earliest is None else min(earliest, found[-1][0])
            if len(found) == AT_ONCE:
                self._wait(found, held)
                found, held = [], True
        self._wait(found, held)
        if earliest is not None:
            self._ring(-(-earliest // 1000))
        return iter(())

    def _wait(self, legs: list[tuple], some: bool) -> None:
        """Put ``legs`` into their buckets; ``some`` may be there already. A call to the state costs as much as many rows."""
        buckets: dict[int, list] = {}
        for leg in legs:
            buckets.setdefault(leg[0] // BUCKET, []).append(leg)
        for bucket, new in buckets.items():
            held = self.waiting.getValue((bucket,))[0] if some and self.waiting.containsKey((bucket,)) else []
            self.waiting.updateValue((bucket,), ([*map(tuple, held), *new],))

    def _ring(self, at: int) -> None:
        """The key's timer at ``at`` (ms), unless it stands earlier."""
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        last = tuple(self.last.get()) if self.last.exists() else None
        self.timer.clear()
        through, buckets = [], sorted(k[0] for k in self.waiting.keys())
        for bucket in buckets:
            if bucket * BUCKET > until:
                self._ring(-(-min(leg[0] for leg in self.waiting.getValue((bucket,))[0]) // 1000))
                break
            legs = [tuple(leg) for leg in self.waiting.getValue((bucket,))[0]]
            ready, left = [leg for leg in legs if leg[0] <= until], [leg for leg in legs if leg[0] > until]
            out, last = followed(key[0], ready, last)
            yield from out
            if left:
                self.waiting.updateValue((bucket,), (left,))
                self._ring(-(-min(leg[0] for leg in left) // 1000))
                break
            through.append(bucket)
        if len(through) == len(buckets):
            self.waiting.clear()
        else:
            for bucket in through:
                self.waiting.removeKey((bucket,))
        if last is not None:
            self.last.update(last)

    def close(self) -> None:
        pass


#: The departure that closes a stream: see :func:`waypath.streaming.run.closed`.
END = "9999-01-01"


def rotation(stream: DataFrame, lateness: str) -> DataFrame:
    """OUTPUT of a streaming frame of legs (key, leg_id, origin, dest, dep_ts, arr_ts, dep_delay, arr_delay).

    A leg is given out once the latest departure seen is ``lateness`` past it; one that comes after that is dropped as
    late. Legs without key or departure are left out. A leg that departs at END only moves the watermark.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    legs = stream.withWatermark("dep_ts", lateness).where((F.col("dep_ts") < F.lit(END).cast("timestamp")) & F.col("key").isNotNull())
    legs = legs.select("key", "dep_ts", us("dep_ts").alias("dep_us"), "leg_id", "origin", "dest", us("arr_ts").alias("arr_us"), "dep_delay", "arr_delay", F.date_format("dep_ts", "yyyy-MM-dd").alias("day"))
    return legs.groupBy("key").transformWithState(Rotation(), OUTPUT, "Append", "EventTime")


def end(stream: DataFrame) -> DataFrame:
    """One row for :func:`waypath.streaming.run.closed`. It has a key: a filter on keys is pushed below the watermark, which needs to see the row."""
    values = [F.lit("end") if f.name == "key" else F.lit(END) if f.name == "dep_ts" else F.lit(None) for f in stream.schema.fields]
    return stream.sparkSession.range(1).select(*(v.cast(f.dataType).alias(f.name) for v, f in zip(values, stream.schema.fields, strict=True)))


class Lookups(StatefulProcessor):
    """Values of a lookup, fetched when they aren't held or have expired.

    Rows come and go in Arrow batches: of single rows, Spark's worker would gather all that a key gives out in a batch of the stream.
    """

    def __init__(self, fetch: Callable[[str], str | None], column: str, names: list[str], value: str, ttl_ms: int):
        self.fetch, self.column, self.names, self.value, self.ttl_ms = fetch, column, names, value, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "id string", "value string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen: dict[str | None, str | None] = {None: None}
        for p in rows:
            ids = [None if pd.isna(x) else x for x in p[self.column]]
            for id_ in dict.fromkeys(ids):
                if id_ in seen:
                    continue
                if self.held.containsKey((id_,)):
                    seen[id_] = self.held.getValue((id_,))[0]
                elif (value := self.fetch(id_)) is not None:
                    self.held.updateValue((id_,), (value,))
                    seen[id_] = value
                else:
                    seen[id_] = None
            yield p[self.names].assign(**{self.value: pd.Series([seen[i] for i in ids], p.index, dtype=object)})

    def close(self) -> None:
        pass


def looked_up(stream: DataFrame, column: str, fetch: Callable[[str], str | None], value: str, ttl_seconds: float = 600, shards: int = 8, copies: int = 4) -> DataFrame:
    """``stream`` with ``value``: what ``fetch`` (run on executors) gives for the text in ``column``.

    A value is held in keyed state for ``ttl_seconds`` and then fetched anew. A null id gives null without a fetch, a null value
    isn't held. Ids are spread over ``shards``, and each id's rows over up to ``copies`` of them, so an
    id with a large share of the rows isn't one task's; it is fetched once for each copy.
    """
    salt = F.pmod(F.xxhash64(*stream.columns), F.lit(copies))
    dealt = stream.withColumn("_shard", F.pmod(F.xxhash64(column, salt), F.lit(shards)))
    kind = T.StructType([*stream.schema.fields, T.StructField(value, T.StringType())])
    return dealt.groupBy("_shard").transformWithStateInPandas(Lookups(fetch, column, stream.columns, value, int(ttl_seconds * 1000)), kind, "Append", "ProcessingTime")
