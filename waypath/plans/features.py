"""The feature frame of the models over the stand-in legs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.operators import features
from waypath.plans.legs import CHAINED, chained, legs
from waypath.session import cut

#: Month and day of the stand-in's holidays, every year.
HOLIDAYS = ((1, 1), (7, 4), (11, 25), (12, 25))

#: Features that are a formula of a leg, alike in Spark and in DuckDB. Weather and airframes have no table: formulas stand in.
PLAIN = {
    "distance": "distance",
    "dep_hour_local": "CAST(hour(dep_ts) AS DOUBLE)",
    "dep_weekday_local": "CAST(dow AS DOUBLE)",
    "dep_month_local": "CAST(month(day) AS DOUBLE)",
    "dep_time_bucket": "CAST(floor(hour(dep_ts) / 6) AS DOUBLE)",
    "is_weekend": "CASE WHEN dow >= 6 THEN 1.0 ELSE 0.0 END",
    "is_holiday": "CASE WHEN near = 0 THEN 1.0 ELSE 0.0 END",
    "days_to_nearest_holiday": "CAST(near AS DOUBLE)",
    "crs_elapsed_time": "CAST(30 + leg_id % 300 AS DOUBLE)",
    **{f"{end}_{name}": formula for end, k in (("dep", 1), ("arr", 2)) for name, formula in (("temp_c", f"CAST(month(day) * {k} - 10 AS DOUBLE)"), ("wind_speed_m_s", f"round(wind * 100 * {k}, 2)"), ("wind_dir_deg", f"CAST(leg_id * {k} % 360 AS DOUBLE)"), ("ceiling_height_m", f"CAST(leg_id % 22 * 1000 / {k} AS DOUBLE)"))},
    "rotation_continuity_flag": "CASE WHEN prev1_dest = origin THEN 1.0 ELSE 0.0 END",
    "turnaround_minutes": "CASE WHEN turnaround BETWEEN 0 AND 72000 THEN CAST(turnaround AS DOUBLE) END",
    "tight_turnaround_flag": "CASE WHEN turnaround BETWEEN 0 AND 45 THEN 1.0 ELSE 0.0 END",
    "prev1_turnaround_minutes": "CAST(turnaround AS DOUBLE)",
    "time_since_prev2_arrival_minutes": "CAST(since2 AS DOUBLE)",
    **{f"prev{h}_{e}_delay": f"prev{h}_{e}_delay" for h in (1, 2) for e in ("arr", "dep")},
    **{f"prev{h}_{e}_del15": f"CASE WHEN prev{h}_{e}_delay >= 15 THEN 1.0 WHEN prev{h}_{e}_delay < 15 THEN 0.0 END" for h in (1, 2) for e in ("arr", "dep")},
    **{f"prev_{e}_delay": f"prev1_{e}_delay" for e in ("arr", "dep")},
    **{f"prev_{e}_del15": f"CASE WHEN prev1_{e}_delay >= 15 THEN 1.0 WHEN prev1_{e}_delay < 15 THEN 0.0 END" for e in ("arr", "dep")},
    "prev_arr_delayed_flag": "CASE WHEN prev1_arr_delay > 0 THEN 1.0 ELSE 0.0 END",
    "prev_total_delay": "prev1_arr_delay + prev1_dep_delay",
    "aircraft_year_mfr": "CAST(1980 + tail % 40 AS DOUBLE)",
    "aircraft_no_eng": "CAST(1 + tail % 4 AS DOUBLE)",
    "aircraft_no_seats": "CAST(50 + tail % 7 * 30 AS DOUBLE)",
    "aircraft_age": "CAST(year(day) - 1980 - tail % 40 AS DOUBLE)",
}
#: Features that need other legs: volumes, and the tail's day so far.
OTHER = (*features.VOLUME, "aircraft_leg_number_day", "relative_leg_position", "cum_dep_delay_aircraft_day", "cum_arr_delay_aircraft_day")


def featured(spark: SparkSession, d: str) -> DataFrame:
    """Completed legs with every feature of ``features.ALL``.

    Volumes are counts joined back: a route, origin or destination is one small row, so they are broadcast and the legs stay where
    they are. Routes are counted once, written, and added up by either end. A tail's day is short,
    so its windows are narrow; they share the chain's shuffle by tail.
    """
    x = chained(spark, d).where("arr_delay is not null")
    # a holiday of this year or of a neighbouring one may be the nearest
    days = [F.abs(F.date_diff("day", F.make_date(F.year("day") + k, F.lit(m), F.lit(n)))) for m, n in HOLIDAYS for k in (-1, 0, 1)]
    x = x.withColumns({"dow": F.weekday("day") + 1, "near": F.least(*days), "since2": F.timestamp_diff("MINUTE", "prev2_arr_ts", "dep_ts")})
    mine = W.partitionBy("tail", "day")
    so_far = mine.orderBy("dep_ts", "leg_id")
    before = so_far.rowsBetween(W.unboundedPreceding, -1)
    number = F.row_number().over(so_far)
    x = x.withColumns({
        "aircraft_leg_number_day": number.cast("double"), "relative_leg_position": number / F.count("*").over(mine),
        "cum_dep_delay_aircraft_day": F.coalesce(F.sum("dep_delay").over(before), F.lit(0.0)), "cum_arr_delay_aircraft_day": F.coalesce(F.sum("arr_delay").over(before), F.lit(0.0)),
    })
    routes = cut(legs(spark, d).groupBy("origin", "dest").agg(F.count("*").alias("n")), "routes")
    for name, keys in zip(features.VOLUME, (["origin", "dest"], ["origin"], ["dest"]), strict=True):
        x = x.join(F.broadcast(routes.groupBy(*keys).agg(F.sum("n").cast("double").alias(name))), keys)
    return x.select("leg_id", "tail", "day", "arr_delay", *(F.expr(PLAIN[f]).cast("double").alias(f) if f in PLAIN else F.col(f) for f in features.ALL))


def _near() -> str:
    return "least(" + ", ".join(f"abs(datediff('day', make_date(year(day) + {k}, {m}, {n}), day))" for m, n in HOLIDAYS for k in (-1, 0, 1)) + ")"


FEATURED = f"""{CHAINED}, near AS (
  SELECT *, isodow(day) AS dow, {_near()} AS near, datesub('minute', prev2_arr_ts, dep_ts) AS since2,
   CAST(row_number() OVER t AS DOUBLE) AS aircraft_leg_number_day, row_number() OVER t / CAST(count(*) OVER (PARTITION BY tail, day) AS DOUBLE) AS relative_leg_position,
   coalesce(sum(dep_delay) OVER b, 0) AS cum_dep_delay_aircraft_day, coalesce(sum(arr_delay) OVER b, 0) AS cum_arr_delay_aircraft_day
  FROM chained WHERE arr_delay IS NOT NULL
  WINDOW t AS (PARTITION BY tail, day ORDER BY dep_ts, leg_id), b AS (PARTITION BY tail, day ORDER BY dep_ts, leg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), featured AS (
  SELECT leg_id, tail, arr_delay, {", ".join(f"{PLAIN[f]} AS {f}" if f in PLAIN else f"x.{f}" for f in features.ALL)}
  FROM (SELECT near.*, r.n AS route_frequency, o.n AS origin_flight_volume, e.n AS dest_flight_volume FROM near
    JOIN (SELECT origin, dest, CAST(count(*) AS DOUBLE) AS n FROM legs GROUP BY 1, 2) r ON near.origin = r.origin AND near.dest = r.dest
    JOIN (SELECT origin, CAST(count(*) AS DOUBLE) AS n FROM legs GROUP BY 1) o ON near.origin = o.origin
    JOIN (SELECT dest, CAST(count(*) AS DOUBLE) AS n FROM legs GROUP BY 1) e ON near.dest = e.dest) x
)"""
