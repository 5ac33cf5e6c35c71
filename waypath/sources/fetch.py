"""Helpers around ingestion: retries, and the split of a request into smaller ones."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame


def retried(call: Callable[[], object], attempts: int = 4, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """``call()``, tried again after base * 2^n seconds and a little more at random; the last error is raised."""
    for n in range(attempts):
        try:
            return call()
        except OSError:
            if n == attempts - 1:
                raise
            sleep(base * 2**n + random.uniform(0, 0.75))
    raise ValueError("no attempt was allowed")


def fetched(requests: DataFrame, ask: Callable[[dict], object], attempts: int = 4, base: float = 1.0) -> DataFrame:
    """``requests`` with ``result`` (text) and ``attempts``: each row is a call of ``ask``, made and tried again where the row is.

    All rows of a batch are asked, then those that failed wait together for base * 2^n seconds and a little more at random,
    as in :func:`retried`, and are asked again: a batch waits ``attempts`` - 1 times, however many of its rows fail.
    A request whose last attempt fails has a null result, so the others aren't lost with it.
    """
    if attempts < 1:
        raise ValueError("no attempt was allowed")
    names = requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = p.to_dict("records")
            results, tries, open_ = [None] * len(rows), [0] * len(rows), range(len(rows))
            for n in range(attempts):
                failed = []
                for i in open_:
                    tries[i] += 1
                    try:
                        results[i] = str(ask(rows[i]))
                    except OSError:
                        failed.append(i)
                if not failed:
                    break
                open_ = failed
                if n < attempts - 1:
                    time.sleep(base * 2**n + random.uniform(0, 0.75))
            yield p.assign(result=pd.Series(results, p.index, dtype=object), attempts=pd.Series(tries, p.index, dtype="int32"))[[*names, "result", "attempts"]]

    return requests.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in requests.dtypes), "result string, attempts int"]))


def spans(requests: DataFrame, get: Callable[[list, date, date], list], windows: tuple[int, ...] = (15, 7, 3, 1)) -> DataFrame:
    """(key, got, failed) of ``requests`` (key, first, last): how many rows :func:`shrinking` gets for each key's days, and how many
    days stay without. Each row's windows are asked for where the row is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [shrinking([k], a, b, get, windows) for k, a, b in zip(p["key"], p["first"], p["last"], strict=True)]
            yield pd.DataFrame({"key": p["key"], "got": [len(rows) for rows, _ in found], "failed": [len(failed) for _, failed in found]})

    return requests.select("key", "first", "last").mapInPandas(run, f"key {dict(requests.dtypes)['key']}, got int, failed int")


def shrinking(keys: list[str], first: date, last: date, get: Callable[[list[str], date, date], list], windows: tuple[int, ...] = (15, 7, 3, 1)) -> tuple[list, list[tuple[str, date]]]:
    """All rows of ``get`` for first..last, and the (key, day) that stayed without.

    A window that fails is cut into the next smaller ones; a single day that fails is asked
    for each key alone.
    """
    rows: list = []
    failed: list[tuple[str, date]] = []

    def span(a: date, b: date, level: int) -> None:
        if level == len(windows):
            for k in keys:
                try:
                    rows.extend(get([k], a, b))
                except OSError:
                    failed.append((k, a))
            return
        at = a
        while at <= b:
            to = min(at + timedelta(days=windows[level] - 1), b)
            try:
                rows.extend(get(keys, at, to))
            except OSError:
                span(at, to, level + 1)
            at = to + timedelta(days=1)

    span(first, last, 0)
    return rows, failed
