"""Ladders of cut points, code tables and flags over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(c: Column, steps: list[tuple[float, str]], above: str, closed: bool = False, null: str | None = None) -> Column:
    """The label of the first step that ``c`` lies below (with ``closed``: at or below), else ``above``.

    Null gives ``null``; pass ``above`` there to treat null as the top.
    """
    out = F.lit(above)
    for upper, label in reversed(steps):
        out = F.when(c <= upper if closed else c < upper, label).otherwise(out)
    return F.when(c.isNull(), F.lit(null)).otherwise(out)


def decode(c: Column, names: dict[int, str], other: str = "unknown") -> Column:
    """The name of a code; null and codes without one give ``other``."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[c.cast("int")], F.lit(other))


def flag(condition: Column) -> Column:
    """1 or 0; null stays null."""
    return condition.cast("tinyint")


def sure(condition: Column) -> Column:
    """1 or 0; null is 0."""
    return F.when(condition, 1).otherwise(0)


# Cut points and labels of the reference's analyses.
TURNAROUND = [(30, "<30"), (60, "30-60"), (90, "60-90"), (120, "90-120")], "120+"
TURNAROUND_FINE = [(30, "<30"), (45, "30-44"), (60, "45-59"), (90, "60-89")], "90+"
WIND_MPH = [(10, "0-10"), (20, "10-20"), (30, "20-30"), (40, "30-40")], "40+"
CEILING_FT = [(1500, "<1,500"), (3000, "1,500-2,999"), (6000, "3,000-5,999"), (10000, "6,000-9,999"), (16000, "10,000-15,999")], "16,000+"
PREVIOUS_DELAY = [(0, "On time / early"), (15, "1-15 min"), (30, "16-30 min"), (60, "31-60 min")], "60+ min"
DELAY_STATE = [(0, "on_time_or_early"), (15, "minor_delay"), (60, "moderate_delay")], "severe_delay"
PLANE_SIZE = [(500, "Small"), (1500, "Medium")], "Large"
SEATS = [(6, "very_small"), (12, "small"), (50, "regional"), (150, "narrowbody_like")], "large"
SPEED = [(200, "slow"), (400, "medium")], "fast"
AGE_CLASS = [(-0.5, "invalid_future_mfr"), (5, "new"), (10, "modern"), (20, "mid_life"), (30, "old")], "very_old"
AGE_BAND = [(3, "0_3"), (7, "4_7"), (12, "8_12"), (20, "13_20"), (30, "21_30")], "31_plus"
RISK = [(0.3, "Low risk"), (0.6, "Medium risk")], "High risk"

ENGINES = {0: "none", 1: "reciprocating", 2: "turbo_prop", 3: "turbo_shaft", 4: "turbo_jet", 5: "turbo_fan", 6: "ramjet", 7: "two_cycle", 8: "four_cycle", 9: "unknown_engine", 10: "electric", 11: "rotary"}
AIRCRAFT = {1: "glider", 2: "balloon", 3: "blimp_dirigible", 4: "fixed_wing_single_engine", 5: "fixed_wing_multi_engine", 6: "rotorcraft", 7: "weight_shift_control", 8: "powered_parachute", 9: "gyroplane", 10: "hybrid_lift"}
REGISTRANTS = {1: "individual", 2: "partnership", 3: "corporation", 4: "co_owned", 5: "government", 7: "llc", 8: "non_citizen_corporation", 9: "non_citizen_co_owned"}
WEIGHTS = {1: "up_to_12499", 2: "12500_to_19999", 3: "20000_and_over"}

KNOT_M_S, M_S_MPH, M_FT = 0.514444, 2.23694, 3.28084


def season(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ["winter", "spring", "summer", "fall"])), (F.floor(month % 12 / 3) + 1).cast("int"))


def push_period(hour: Column) -> Column:
    return F.when(hour.between(6, 9), "morning_push").when(hour.between(15, 19), "afternoon_push").otherwise("other")


def clipped(c: Column, least: float, most: float) -> Column:
    """``c`` moved into least..most; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(least)), F.lit(most)))


def synthetic_score(model: str, base: float, prev1: Column, prev2: Column, temp: Column, wind: Column) -> tuple[Column, Column]:
    """A closed-form stand-in for a model: (probability, minutes), rounded to 4 and 1 places.

    Its coefficients are fixed values of the reference's demo.
    """
    chain = F.least((prev1 + prev2) / 160.0, F.lit(1.0)) * 0.18
    weather = F.when(F.abs(temp) > 5, 0.04).otherwise(0.0) + F.when(wind > 10, 0.03).otherwise(0.0)
    wave = F.sin(F.lit(len(model) * 7) + prev1) * 0.06
    p = clipped(F.lit(base) + chain + weather + wave, 0.05, 0.97)
    late = F.greatest(F.lit(0.0), prev1 * 0.55 + prev2 * 0.15 + (p - 0.5) * 40 + 8)
    return F.round(p, 4), F.round(late, 1)
