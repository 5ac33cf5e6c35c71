"""Writing: partitioned Parquet, CSV, JSON documents, Markdown, model runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.operators.tables import widen


def parquet(df: DataFrame, path: str, by: list[str] = (), mode: str = "overwrite", compression: str = "snappy") -> None:
    """Parquet by partition; with ``overwrite`` only partitions that ``df`` has are replaced.

    Rows of a partition value go to one task each only as far as the shuffle's size allows:
    ``rebalance`` splits large ones, so a value with most rows makes several files.
    """
    out = df.hint("rebalance", *by) if by else df
    writer = out.write.mode(mode).option("compression", compression).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON object of a small key-value table, keys sorted."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))
    return df.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON, nulls left out: what a dry run would print."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("json"))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's file system, so that any store takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def results(spark: SparkSession, path: str, payload: dict) -> None:
    put_text(spark, path, json.dumps(payload, indent=2, sort_keys=True, default=str))


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of a few rows."""
    cell = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r.get(c, "")) for c in columns) + " |" for r in rows)])


def whitelisted(df: DataFrame, path: str, columns: list[str], strict: bool = False) -> None:
    """Only ``columns``; missing ones raise with ``strict``."""
    widen(df, columns, strict).write.mode("overwrite").parquet(path)


def model_run(spark: SparkSession, path: str, model, predictions: DataFrame, summary: dict) -> None:
    """A run's folder: the model, predictions and a summary."""
    model.write().overwrite().save(f"{path}/model")
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    results(spark, f"{path}/summary.json", summary)
