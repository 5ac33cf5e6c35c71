"""As-of join: to each row the latest (or next) right row of its key within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str], tolerance: str, prefix: str = "", direction: str = "backward") -> DataFrame:
    """``left`` with ``take`` columns and the time of the matched right row, named ``prefix`` + name.

    ``tolerance`` is a number and a unit, as in ``2 hours``. Time is cut into buckets as long as it: a left
    row's match lies in its own bucket or the one before (``forward``: after), so a right row goes to two
    buckets, and a key with a large share of all rows is spread over its time. One shuffle: both sides are
    put together, and in each key and bucket a left row takes the last right row before it (``forward``:
    the first after it), equal times included. Left rows without a key or time are set aside first and
    keep nulls. Of right rows with equal key and time, the one with the largest values of ``take`` wins.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    back = direction == "backward"
    number, unit = tolerance.split()
    width = float(number) * SECONDS[unit.rstrip("s")]
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(width * 1e6))
    whole = [F.col(k).isNotNull() for k in (*by, left_on)]
    can = whole[0]
    for c in whole[1:]:
        can = can & c
    payload = F.struct(F.col(right_on).alias("_at"), *take)
    kind = right.select(payload.alias("_p")).schema["_p"].dataType
    row = F.struct(*left.columns)
    rows = left.where(can).select(*by, bucket(left_on).alias("_b"), F.col(left_on).alias("_ts"), F.lit(1 if back else 0).alias("_side"), row.alias("_row"), F.lit(None).cast(kind).alias("_p"))
    row_kind = rows.schema["_row"].dataType
    own = bucket(right_on)
    buckets = F.explode(F.array(own, own + (1 if back else -1)))
    seen = right.where(F.col(right_on).isNotNull()).select(*by, buckets.alias("_b"), F.col(right_on).alias("_ts"), F.lit(0 if back else 1).alias("_side"), F.lit(None).cast(row_kind).alias("_row"), payload.alias("_p"))
    order = W.partitionBy(*by, "_b").orderBy("_ts", "_side", "_p")
    frame = order.rowsBetween(W.unboundedPreceding, 0) if back else order.rowsBetween(0, W.unboundedFollowing)
    pick = F.last("_p", ignorenulls=True) if back else F.first("_p", ignorenulls=True)
    both = rows.unionByName(seen).withColumn("_m", pick.over(frame)).where("_row is not null")
    gap = F.col("_ts") - F.col("_m._at") if back else F.col("_m._at") - F.col("_ts")
    match = F.when(gap <= F.expr(f"interval {tolerance}"), F.col("_m"))
    names = {right_on: "_at"} | {c: c for c in take}
    matched = both.withColumn("_m", match).select("_row.*", *(F.col(f"_m.{f}").alias(prefix + n) for n, f in names.items()))
    alone = left.where(~can)
    return matched.unionByName(alone.select("*", *(F.lit(None).cast(matched.schema[prefix + n].dataType).alias(prefix + n) for n in names)))


def asof_ends(left: DataFrame, right: DataFrame, key: list[str], by: list[str], right_on: str, take: list[str], tolerance: str, ends: dict[str, tuple[list[str], str]]) -> DataFrame:
    """``left`` with matches for several ends of a row in one pass: as :func:`asof_join` for each prefix in ``ends``.

    An end is (columns of ``left`` in the place of ``by``, its time). Each row sends a probe for every end, all of them
    meet ``right`` in one join, and the matches are put together by ``key``, which names a row of ``left``.
    So ``right`` is shuffled once, however many ends there are.
    """
    whole = F.struct(*left.columns)
    kind = left.select(whole.alias("_r")).schema["_r"].dataType
    # the first probe alone carries the row
    probe = lambda i, cols, on: F.struct(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(cols)), F.col(on).alias("_on"), F.lit(i).alias("_end"), (whole if i == 0 else F.lit(None).cast(kind)).alias("_left"))
    probes = left.select(*(F.col(c).alias(f"_key{k}") for k, c in enumerate(key)), F.inline(F.array(*(probe(i, *e) for i, e in enumerate(ends.values())))))
    mine = right.select(*(F.col(b).alias(f"_by{k}") for k, b in enumerate(by)), F.col(right_on).alias("_at0"), *(F.col(c).alias(f"_take{k}") for k, c in enumerate(take)))
    names = {"_at0": right_on} | {f"_take{k}": c for k, c in enumerate(take)}
    got = asof_join(probes, mine, [f"_by{k}" for k in range(len(by))], "_on", "_at0", [n for n in names if n != "_at0"], tolerance)
    match = F.struct(*(F.col(n).alias(c) for n, c in names.items()))
    sums = got.groupBy(*(f"_key{k}" for k in range(len(key)))).agg(F.first("_left", ignorenulls=True).alias("_left"), *(F.max(F.when(F.col("_end") == i, match)).alias(f"_m{i}") for i in range(len(ends))))
    return sums.select("_left.*", *(F.col(f"_m{i}.{c}").alias(prefix + c) for i, prefix in enumerate(ends) for c in names.values()))
