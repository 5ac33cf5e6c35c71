"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES: list[str] = ["windows", "scalars", "joins", "aggregates", "network", "streams", "learning", "files"]


def _all(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        found = getattr(import_module(f"waypath.plans.{name}"), kind)
        if clash := out.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict[str, Query]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
