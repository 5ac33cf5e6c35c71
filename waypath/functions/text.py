"""Identifiers, names and packed fields in text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an observation writes for a missing value. Fixed values of the format.
MISSING = ("+9999", "9999", "999", "99999")


def snake(name: str) -> str:
    """A column name in snake case: ``CRSDepTime`` is ``crs_dep_time``."""
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[0-9]+", re.sub(r"[^0-9A-Za-z]+", "_", name))
    return "_".join(w.lower() for w in words)


def unique_snake(names: list[str]) -> list[str]:
    """Snake-case names; a repeated one gets ``_1``, ``_2``."""
    seen: dict[str, int] = {}
    out = []
    for n in map(snake, names):
        out.append(f"{n}_{seen[n]}" if n in seen else n)
        seen[n] = seen.get(n, 0) + 1
    return out


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_snake(df.columns))


def resolve(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under canonical names, each from the first of its aliases that is there, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    found = {name: next((have[a.lower()] for a in (name, *aliases) if a.lower() in have), None) for name, aliases in wanted.items()}
    if missing := [n for n, c in found.items() if c is None]:
        raise KeyError(f"no column for {missing}; there are {df.columns}")
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


def tail_key(c: Column) -> Column:
    """A tail number for matching: upper case, only A-Z and 0-9, without the leading N."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), "^N", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def number(c: Column) -> Column:
    """A number out of decorated text (``$1,234.5``), or null."""
    return F.regexp_replace(c, "[^0-9.\\-]", "").try_cast("double")


def station_id(usaf: Column, wban: Column) -> Column:
    """Six and five digits, padded with zeros."""
    return F.concat(F.lpad(usaf, 6, "0"), F.lpad(wban, 5, "0"))


def hex_id(c: Column) -> Column:
    """Lower-case hex of six digits, without ``0x``."""
    return F.lpad(F.regexp_replace(F.regexp_replace(F.lower(c), "^0x", ""), "[^0-9a-f]", ""), 6, "0")


def last_token(c: Column) -> Column:
    """The last word, without leading zeros."""
    return F.regexp_replace(F.element_at(F.split(F.trim(c), "\\s+"), -1), "^0+", "")


def first_filled(*cs: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def packed(c: Column, i: int, scale: float = 1, keep_missing: bool = False) -> Column:
    """Part ``i`` of a comma-packed field as a number; missing marks are null unless kept."""
    part = F.get(F.split(c, ","), F.lit(i))
    value = part.try_cast("bigint") / F.lit(scale)
    return value if keep_missing else F.when(~part.isin(*MISSING), value)


def ceiling_m(c: Column) -> Column:
    """Metres from a sky code: its last three digits are hundreds of feet."""
    return F.round(F.nullif(F.regexp_extract(c, "([0-9]{3})$", 1), F.lit("")).try_cast("int") * 100 * 0.3048, 1)


def name_score(name: Column) -> Column:
    """2 for an international airport's station, 1 for an airport's, else 0."""
    n = F.upper(name)
    return F.when(n.contains("INTL") | n.contains("INTERNATIONAL"), 2).when(n.contains("AIRPORT"), 1).otherwise(0)
