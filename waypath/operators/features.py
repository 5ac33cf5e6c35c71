"""Feature sets of the models, and sequences of three legs for recurrent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of the features, in blocks.
SCHEDULE = ("distance", "dep_hour_local", "dep_weekday_local", "dep_month_local", "dep_time_bucket", "is_weekend", "is_holiday", "days_to_nearest_holiday", "crs_elapsed_time")
WEATHER = ("dep_temp_c", "dep_wind_speed_m_s", "dep_wind_dir_deg", "dep_ceiling_height_m", "arr_temp_c", "arr_wind_speed_m_s", "arr_wind_dir_deg", "arr_ceiling_height_m")
VOLUME = ("route_frequency", "origin_flight_volume", "dest_flight_volume")
TWO_HOP = (
    "prev1_arr_delay", "prev1_dep_delay", "prev1_arr_del15", "prev1_dep_del15", "prev2_arr_delay", "prev2_dep_delay", "prev2_arr_del15", "prev2_dep_del15",
    "prev1_turnaround_minutes", "time_since_prev2_arrival_minutes",
)
POSITION = ("aircraft_leg_number_day", "relative_leg_position", "rotation_continuity_flag")
LOAD = ("cum_dep_delay_aircraft_day", "cum_arr_delay_aircraft_day", "turnaround_minutes", "tight_turnaround_flag")
PREVIOUS = ("prev_arr_delay", "prev_dep_delay", "prev_arr_del15", "prev_dep_del15", "prev_arr_delayed_flag", "prev_total_delay")
AIRFRAME = ("aircraft_year_mfr", "aircraft_no_eng", "aircraft_no_seats", "aircraft_age")

CONTEXT = SCHEDULE + WEATHER + VOLUME
FULL = CONTEXT + POSITION + TWO_HOP
SETS = {
    "schedule": SCHEDULE,
    "context": CONTEXT,
    "2hop_propagation": CONTEXT + TWO_HOP,
    "2hop_delay_only": SCHEDULE + TWO_HOP,
    "aircraft_state": SCHEDULE + VOLUME + POSITION + LOAD,
    "ops_full": CONTEXT + PREVIOUS + POSITION + LOAD + TWO_HOP,
    "full": FULL,
    "full_aircraft": AIRFRAME + FULL,
}
ALL = tuple(dict.fromkeys(f for fs in SETS.values() for f in fs))

#: What a step of a sequence holds: what is known of an earlier leg, and what surrounds the current one.
KNOWN = ("arr_delay_prev", "dep_delay_prev", "arr_del15_prev", "dep_del15_prev", "gap_minutes")
AROUND = CONTEXT + ("tight_turnaround_flag", "relative_leg_position", "cum_dep_delay_aircraft_day", "cum_arr_delay_aircraft_day")
STEP = KNOWN + AROUND
#: What the current leg's step shows of itself.
VARIANTS = {"context_full": AROUND, "delay_only": SCHEDULE}


#: The columns that :func:`sequences` reads.
SHOWN = tuple(dict.fromkeys((*(f"prev{h}_{k}" for h in (1, 2) for k in ("arr_delay", "dep_delay", "arr_del15", "dep_del15")), "time_since_prev2_arrival_minutes", "prev1_turnaround_minutes", *AROUND)))


def sequences(df: DataFrame, variant: str, fill: dict[str, float]) -> Column:
    """Three steps of STEP, oldest first: two earlier legs by their delays and the gap to now, the current one by
    the variant's features. What a step doesn't show is 0; what it shows and lacks is taken from ``fill``."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c]))) if c in fill else F.col(c).cast("double")
    earlier = lambda hop, gap: [*(value(f"prev{hop}_{k}") for k in ("arr_delay", "dep_delay", "arr_del15", "dep_del15")), value(gap), *(F.lit(0.0) for _ in AROUND)]
    current = [*(F.lit(0.0) for _ in KNOWN), *(value(c) if c in VARIANTS[variant] else F.lit(0.0) for c in AROUND)]
    return F.array(F.array(*earlier(2, "time_since_prev2_arrival_minutes")), F.array(*earlier(1, "prev1_turnaround_minutes")), F.array(*current))
