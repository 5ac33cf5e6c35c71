"""Small relational operators: which row of a key, lookups, completion, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.operators.ranks import quantiles


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should leave no ties."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def by_priority(keys: list[str], order: list[Column], *sources: DataFrame) -> DataFrame:
    """All sources, missing columns null; a key is taken from the first source that has it."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)))
    return one_per_key(all_, keys, [F.col("_p"), *order]).drop("_p")


def role(dim: DataFrame, key: str, prefix: str) -> DataFrame:
    """A dimension for one role: ``key`` and every other column with ``prefix``."""
    return dim.withColumnsRenamed({c: (key if c == dim.columns[0] else prefix + c) for c in dim.columns})


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, values: dict[str, str]) -> DataFrame:
    """``df`` with columns of ``dim`` (renamed by ``values``) of the row where ``dim_key`` equals ``key``; null if none.

    Spark broadcasts the dimension if it is under its threshold, and shuffles otherwise.
    """
    d = dim.select(F.col(dim_key).alias("_k"), *(F.col(c).alias(n) for c, n in values.items()))
    return df.join(d, df[key] == d["_k"], "left").drop("_k")


def complete(df: DataFrame, key: str, vocabulary: list[str], counts: list[str]) -> DataFrame:
    """A row for every value of ``vocabulary``; counts are 0 where ``df`` has none."""
    spark = df.sparkSession
    return spark.createDataFrame([(v,) for v in vocabulary], f"{key} string").join(df, key, "left").fillna(0, counts)


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: how many nulls each column has."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in cols or df.columns))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, most frequent first."""
    return df.groupBy(*keys).count().where("count > 1").orderBy(F.desc("count"), *keys)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) of each two of ``cols`` over the rows that lack none; r is null where a column has one value."""
    whole = df.dropna(subset=cols)
    one = whole.agg(*(F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{min(i, j)}_{max(i, j)}").alias("r")) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return one.select(F.inline(F.array(*cells)))


def describe(df: DataFrame, *cols: str) -> DataFrame:
    """A row for each column: its name, count, nulls, mean, sample deviation, extremes and exact quartiles.

    The quartiles of all columns are found together (``ranks.quantiles``); the rest is one more pass.
    """
    found = quantiles(df, list(cols), [0.25, 0.5, 0.75])
    of = lambda c: (F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
    one = df.agg(*(F.struct(*of(c)).alias(f"_{i}") for i, c in enumerate(cols)))
    quartiles = lambda c: [F.lit(v).cast("double").alias(n) for n, v in zip(("q25", "q50", "q75"), found[c], strict=True)]
    rows = [F.struct(F.lit(c).alias("column"), *(F.col(f"_{i}.{f}").alias(f) for f in ("n", "nulls", "mean", "std", "min")), *quartiles(c), F.col(f"_{i}.max").alias("max")) for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def optional(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of ``wanted`` that ``df`` has."""
    return [c for c in wanted if c in df.columns]


def widen(df: DataFrame, wanted: list[str], strict: bool = False) -> DataFrame:
    """Projection to ``wanted``; a missing column raises with ``strict`` and is left out without."""
    missing = [c for c in wanted if c not in df.columns]
    if missing and strict:
        raise KeyError(f"missing {missing}")
    return df.select(*optional(df, wanted))


def two_hop_inbound(df: DataFrame, core: list[str]) -> DataFrame:
    """Legs between core places, into them, and into places with a leg into them; none out of core to outside."""
    inside, origin_in = F.col("dest").isin(*core), F.col("origin").isin(*core)
    hop1 = df.where(~origin_in & inside).select(F.col("origin").alias("_hop1")).distinct()
    marked = df.join(hop1, df["dest"] == hop1["_hop1"], "left")
    return marked.where(inside | (~origin_in & F.col("_hop1").isNotNull())).drop("_hop1")


def routes(df: DataFrame, places: list[str] = (), pairs: list[tuple[str, str]] = (), origins: list[str] = (), dests: list[str] = ()) -> DataFrame:
    """Legs that touch one of ``places``, are one of ``pairs``, and start or end as listed; empty lists don't filter."""
    if places:
        df = df.where(F.col("origin").isin(*places) | F.col("dest").isin(*places))
    if pairs:
        df = df.where(reduce(lambda a, b: a | b, ((F.col("origin") == o) & (F.col("dest") == d) for o, d in pairs)))
    if origins:
        df = df.where(F.col("origin").isin(*origins))
    return df.where(F.col("dest").isin(*dests)) if dests else df
