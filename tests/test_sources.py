"""Readers and writers on files written by hand."""

import pytest
from pyspark.sql import types as T

from waypath.session import scratch
from waypath.sources import fetch, readers, writers


def test_strict_csv_fails_on_a_bad_value(spark):
    path = scratch(spark, "bad")
    writers.put_text(spark, f"{path}/a.csv", "a,b\n1,x\nNA,y\noops,z\n")
    with pytest.raises(Exception, match="oops|CAST"):
        readers.csv_strict(spark, path, T.StructType.fromDDL("a int, b string")).collect()


def test_null_marks(spark):
    path = scratch(spark, "nulls")
    writers.put_text(spark, f"{path}/a.csv", "a,b\n1,x\nNA,null\n,NULL\n")
    got = readers.csv_strict(spark, path, T.StructType.fromDDL("a int, b string")).collect()
    assert [tuple(r) for r in got] == [(1, "x"), (None, None), (None, None)]


def test_missing_year_raises(spark):
    path = scratch(spark, "years")
    writers.parquet(spark.createDataFrame([(1, 2019)], "a int, year int"), path, ["year"])
    assert readers.years(spark, path, [2019]).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.years(spark, path, [2019, 2020])


def test_whitelist_strict(spark):
    with pytest.raises(KeyError):
        writers.whitelisted(spark.range(1), scratch(spark, "w"), ["nope"], strict=True)


def test_retries_end():
    waits = []

    def fail():
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        fetch.retried(fail, attempts=3, sleep=waits.append)
    assert len(waits) == 2 and waits[1] > waits[0] - 0.75
