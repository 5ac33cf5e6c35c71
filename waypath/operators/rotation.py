"""Chains of legs per key: neighbours, gaps, day counters, two-hop features, rolling means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.functions.clock import minutes


def ordered(key: str, ts: str, tiebreak: str):
    """Rows of a key in time; equal times by ``tiebreak``. Null times come first."""
    return W.partitionBy(key).orderBy(ts, tiebreak)


def neighbours(df: DataFrame, key: str, ts: str, tiebreak: str, cols: list[str], hops: int = 1, following: bool = True) -> DataFrame:
    """``prev_*`` and ``next_*`` of ``cols`` (``prev1_*``, ``prev2_*`` for two hops). One shuffle for all."""
    w = ordered(key, ts, tiebreak)
    name = lambda c, h: f"prev_{c}" if hops == 1 else f"prev{h}_{c}"
    out = {name(c, h): F.lag(c, h).over(w) for c in cols for h in range(1, hops + 1)}
    if following:
        out |= {f"next_{c}": F.lead(c).over(w) for c in cols}
    return df.withColumns(out)


def links(df: DataFrame, dep: str = "dep_ts", arr: str = "arr_ts") -> DataFrame:
    """Turnaround to either side, and whether places join up (0 where there is no neighbour)."""
    return df.withColumns(
        {
            "turnaround_minutes": minutes(F.col(f"prev_{arr}"), F.col(dep)),
            "next_turnaround_minutes": minutes(F.col(arr), F.col(f"next_{dep}")),
            "continuity_flag": F.when(F.col("prev_dest") == F.col("origin"), 1).otherwise(0),
            "next_continuity_flag": F.when(F.col("next_origin") == F.col("dest"), 1).otherwise(0),
        }
    )


def day_counters(df: DataFrame, key: str, day: Column, ts: str, tiebreak: str) -> DataFrame:
    """Leg number of the day (rows without time don't count), and sums of delays so far, this leg included."""
    w = W.partitionBy(key, "_day").orderBy(ts, tiebreak).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_day", day).withColumns({"leg_number_day": F.count(ts).over(w), "cum_dep_delay_day": F.sum("dep_delay").over(w), "cum_arr_delay_day": F.sum("arr_delay").over(w)}).drop("_day")


def before(value: str, *keys: str, order: list[str]) -> Column:
    """The sum of earlier rows of the keys, without this one; 0 for the first. Nothing of another key leaks in."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def rolling_mean(value: str, keys: list[str], order: list[str], rows: int, least: int = 1) -> Column:
    """Mean of this and the ``rows`` - 1 rows before; null with under ``least`` rows."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
    mean = F.avg(value).over(w)
    return mean if least <= 1 else F.when(F.count(value).over(w) >= least, mean)


def relative_position(key: str, order: list[str]) -> Column:
    """Place in the key's rows, 0 for the first, as a share of their number."""
    return (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1) / F.count("*").over(W.partitionBy(key))
