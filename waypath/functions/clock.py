"""Dates and times: packed clock values, zones, buckets, holidays.

Local and UTC times are both TIMESTAMP_NTZ, so no session zone takes part. What can't be
read is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zones that a zone column may name; others, and null, give null. Fixed: the zones of the reference data.
ZONES = (
    "America/New_York", "America/Chicago", "America/Denver", "America/Phoenix", "America/Los_Angeles",
    "America/Anchorage", "Pacific/Honolulu", "America/Puerto_Rico", "Pacific/Guam", "UTC",
)

#: Upper hours (exclusive) of the parts of a day; the last part has none. Fixed values.
SIX_PARTS = (6, 11, 14, 18, 21)
FOUR_PARTS = ((6, "Night"), (12, "Morning"), (18, "Midday"), (24, "Evening"))


def hhmm(c: Column) -> Column:
    """A clock number (5, 930, 1745.0 as text) as four digits; longer values stay as they are."""
    digits = F.regexp_replace(c.cast("string"), r"\.0$", "")
    digits = digits.try_cast("bigint").cast("string")
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def clock_ts(day: Column, clock: Column, midnight_24: bool = False) -> Column:
    """``day`` at a four-digit ``clock``; 2400 is null, or the next midnight with ``midnight_24``."""
    at = F.try_to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock), F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz")
    return F.when(clock == "2400", F.date_add(day, 1).cast("timestamp_ntz")).otherwise(at) if midnight_24 else at


def after(dep: Column, arr: Column) -> Column:
    """An arrival that would lie before its departure is on the next day."""
    return F.when(arr < dep, arr + F.expr("interval 1 day")).otherwise(arr)


def to_utc(local: Column, zone: Column, zones: tuple[str, ...] = ZONES) -> Column:
    """Local time of a row's own zone as UTC; of a doubled hour the first, of a missing one the later clock."""
    return F.when(zone.isin(*zones), F.convert_timezone(F.when(zone.isin(*zones), zone).otherwise("UTC"), F.lit("UTC"), local))


def to_local(utc: Column, zone: Column, default: str = "America/New_York", zones: tuple[str, ...] = ZONES) -> Column:
    """UTC as local time of a row's zone, or of ``default`` where the zone is unknown."""
    return F.convert_timezone(F.lit("UTC"), F.when(zone.isin(*zones), zone).otherwise(default), utc)


def iso_weekday(c: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(c) + 1


def hour_start(c: Column) -> Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def minutes(start: Column, end: Column) -> Column:
    """Whole minutes from ``start`` to ``end``, toward zero."""
    return F.timestamp_diff("MINUTE", start, end)


def parsed(c: Column, *formats: str) -> Column:
    """The first of several formats that fits, as a timestamp without zone."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def epoch(c: Column, milliseconds: bool) -> Column:
    """Seconds or milliseconds since 1970 as UTC."""
    return (F.timestamp_millis(c.cast("long")) if milliseconds else F.timestamp_seconds(c.cast("long"))).cast("timestamp_ntz")


def clock_minutes(c: Column) -> Column:
    """Minutes after midnight of a clock number: 1745 is 1065."""
    return F.floor(c / 100) * 60 + c % 100


def six_parts(hour: Column) -> Column:
    """1 (before 6) to 6 (from 21)."""
    out = F.lit(len(SIX_PARTS) + 1)
    for i, upper in reversed([*enumerate(SIX_PARTS, 1)]):
        out = F.when(hour < upper, i).otherwise(out)
    return F.when(hour.isNotNull(), out)


def four_parts(hour: Column) -> Column:
    out = F.lit(None).cast("string")
    for upper, name in reversed(FOUR_PARTS):
        out = F.when(hour < upper, name).otherwise(out)
    return out


def hour_block(hour: Column) -> Column:
    """0001-0559 before 6, then an hour each: 0600-0659."""
    return F.when(hour < 6, "0001-0559").otherwise(F.format_string("%02d00-%02d59", hour, hour))


def is_holiday(day: Column, holidays: list[str]) -> Column:
    return day.cast("date").isin(*[F.to_date(F.lit(h)) for h in holidays])


def days_to_holiday(day: Column, holidays: list[str]) -> Column:
    """Days to the nearest of ``holidays``, before or after."""
    return F.array_min(F.array(*[F.abs(F.datediff(day, F.to_date(F.lit(h)))) for h in holidays]))


def day_ranges(first: Column, last: Column, days: int) -> Column:
    """Array of (from, to) that covers first..last, both included, ``days`` at a time."""
    return F.transform(F.sequence(first, last, F.expr(f"interval {days} day")), lambda d: F.struct(d.alias("from"), F.least(F.date_add(d, days - 1), last).alias("to")))


def month_ranges(first: Column, last: Column) -> Column:
    """Array of (from, to, label) of the months that first..last touches, cut to it."""
    months = F.sequence(F.trunc(first, "month"), last, F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(F.greatest(m, first).alias("from"), F.least(F.last_day(m), last).alias("to"), F.date_format(m, "yyyy-MM").alias("label")))


#: Longitude up to which each zone reaches, from the west. Fixed values; east of all is New York.
ZONE_BORDERS = ((-130, "America/Anchorage"), (-114, "America/Los_Angeles"), (-101, "America/Denver"), (-85, "America/Chicago"))


def zone_of(lon: Column, lat: Column) -> Column:
    """IANA zone by longitude; below -154 Hawaii, and Arizona (31 to 38 north, to -109) inside Denver's strip."""
    out = F.lit("America/New_York")
    for border, zone in reversed(ZONE_BORDERS):
        if zone == "America/Denver":
            zone = F.when((lon <= -109) & lat.between(31, 38), "America/Phoenix").otherwise(zone)
        out = F.when(lon <= border, zone).otherwise(out)
    return F.when(lon.isNotNull(), F.when(lon < -154, "Pacific/Honolulu").otherwise(out))
