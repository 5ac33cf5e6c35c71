"""Training and evaluation over folds of time, with pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product
from math import isqrt
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.operators import metrics
from waypath.session import SMALL_GROUPS, SMALL_SPLITS, cut, having, uncut


@dataclass(frozen=True)
class Fold:
    """Learn from ``train``, judge on ``test``: values of a time column."""

    train: tuple[int, ...]
    test: int


def expanding(values: list[int], least: int) -> Iterator[Fold]:
    """Folds whose training part grows: all values before the tested one, ``least`` at the start."""
    for i in range(least, len(values)):
        yield Fold(tuple(values[:i]), values[i])


def expanding_in(df: DataFrame, group: str, value: str, least: int) -> DataFrame:
    """(``group``, test, train) of distinct values: :func:`expanding` inside each group. A group's values are few (months of a year)."""
    before = W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return df.select(group, F.col(value).alias("test"), F.collect_list(value).over(before).alias("train")).where(F.size("train") >= least)


def pipeline(numeric: list[str], categories: list[str], estimator: Estimator | None, strategy: str = "median") -> Pipeline:
    """Impute, index and one-hot (an unseen category is all zeros), assemble, fit (with an estimator): all learned from the training part."""
    indexed = [f"{c}_index" for c in categories]
    hot = [f"{c}_hot" for c in categories]
    filled = [f"{c}_filled" for c in numeric]
    stages = [Imputer(strategy=strategy, inputCols=numeric, outputCols=filled)] if numeric else []
    stages += [StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=hot)] if categories else []
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*filled, *hot], outputCol="features", handleInvalid="keep"), *([estimator] if estimator else [])])


def fitted(estimator: Estimator, df: DataFrame) -> Model:
    """``estimator`` fitted to ``df``, whose files are read in small splits meanwhile (see ``session.SMALL_SPLITS``)."""
    with having(df.sparkSession, SMALL_SPLITS):
        return estimator.fit(df)


def prepared(base: Pipeline, train: DataFrame, test: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both parts with ``features`` as ``base`` makes them (learned from ``train``) and the columns ``keep``, written: several
    estimators then fit to what was worked out once."""
    model = fitted(base, train)
    return tuple(cut(model.transform(x).select("features", *keep), "prepared", **SMALL_GROUPS) for x in (train, test))


def scored(model: Model, df: DataFrame) -> DataFrame:
    """``df`` with column ``score``: the probability of class 1."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def evaluated(model: Model, test: DataFrame, label: str) -> dict[str, float]:
    p = scored(model, test).select(label, "score").cache()
    try:
        row = metrics.classification(p, label, "score").first().asDict()
        return {"auc": metrics.auc(p, label, "score").first()[0]} | {k: row[k] for k in ("precision", "recall", "f1", "accuracy")}
    finally:
        p.unpersist()


def grid(**values: list) -> list[dict]:
    """Every combination."""
    return [dict(zip(values, x, strict=True)) for x in product(*values.values())]


def search(df: DataFrame, time: str, folds: list[Fold], configs: list[dict], base: Pipeline, build: Callable[[dict], Estimator], label: str, parallel: int = 4) -> list[dict]:
    """Mean metrics of each configuration over the folds, best first (AUC, then F1).

    A fold is prepared once: ``base`` (to column ``features``) learns from its training part, and both parts are written. All
    configurations then fit on these, up to ``parallel`` at a time. ``df`` should be written by ``time``: each fold then
    reads its own parts alone.
    """
    got: list[list[dict[str, float]]] = [[] for _ in configs]
    for f in folds:
        train, test = df.where(F.col(time).isin(*f.train)), df.where(F.col(time) == f.test)
        train, test = prepared(base, train, test, [label])
        with having(df.sparkSession, SMALL_SPLITS), ThreadPool(max(1, min(parallel, len(configs)))) as pool:
            for i, found in enumerate(pool.map(lambda c, a=train, b=test: evaluated(build(c).fit(a), b, label), configs)):
                got[i].append(found)
        uncut(train)
        uncut(test)
    out = [c | {k: sum(g[k] or 0.0 for g in of) / len(of) for k in of[0]} for c, of in zip(configs, got, strict=True)]
    return sorted(out, key=lambda r: (-r["auc"], -r["f1"]))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written with ``_i``: 0 to n - 1, each once, in no order. Only the parts' sizes are gathered."""
    rows = cut(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = dict(rows.groupBy(part.alias("p")).agg(F.count("*")).collect())  # a row for each part
    first, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        first.append(total)
        total += sizes.get(p, 0)
    offset = F.get(F.array(*(F.lit(x).cast("long") for x in first or [0])), part.cast("int"))
    return rows.withColumn("_i", offset + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


#: Rounds of the bijection, and steps after which a number that still lies outside would be given up (its chance is nil).
ROUNDS, WALK = 3, 64


def shuffled(i: Column, n: int, seed: int) -> Column:
    """A bijection of 0 to n - 1 that depends on ``seed``: a Feistel network over a rectangle of a * b >= n numbers.

    Each round adds a hash of one half to the other, which can be undone whatever the hash. A number that leaves
    the range goes on until it is back in it; fewer than a numbers lie outside.
    """
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    once = lambda v: _feistel(v, a, b, seed)
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(a * b - n, WALK) + 1)), once(i.cast("long")), lambda v, _: F.when(v < n, v).otherwise(once(v)))


def _feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """The rounds of :func:`shuffled`; halves are kept in a struct, so that none is worked out twice."""
    halves = F.struct(F.floor(x / b).alias("l"), F.pmod(x, F.lit(b)).alias("r"))
    add = lambda v, of, size, k: F.pmod(v + F.pmod(F.xxhash64(of, F.lit(seed), F.lit(k)), F.lit(size)), F.lit(size))

    out = F.array(halves)
    for k in range(ROUNDS):
        out = F.transform(out, lambda h, k=k: F.struct(add(h["l"], h["r"], a, 2 * k).alias("l"), h["r"].alias("r")))
        out = F.transform(out, lambda h, k=k: F.struct(h["l"].alias("l"), add(h["r"], h["l"], b, 2 * k + 1).alias("r")))
    return F.transform(out, lambda h: h["l"] * b + h["r"])[0]


def dealt(rows: DataFrame, n: int, columns: list[str], seed: int) -> DataFrame:
    """``rows`` (:func:`numbered`, ``n`` of them) with ``_given``: the values of ``columns`` of another row, each row's once.

    A row's values go to the row whose number a bijection names; one join by number for all columns, as wide as the session's shuffles.
    """
    given = rows.select(shuffled(F.col("_i"), n, seed).alias("_i"), F.struct(*columns).alias("_given"))
    return rows.join(given, "_i")


def permuted(model: Model, test: DataFrame, key: int, label: str, c: str, seed: int) -> float:
    """AUC with the values of column ``c`` dealt to other rows of ``test`` (:func:`numbered`, ``key`` of them, or :func:`dealt`
    by ``seed`` already): each value is used once."""
    if "_given" not in test.columns:
        test = dealt(test, key, [c], seed)
    return metrics.auc(scored(model, test.withColumn(c, F.col("_given")[c]).drop("_i", "_given")), label, "score").first()[0]


def importances(model: Model, test: DataFrame, label: str, columns: list[str], whole: float, repeats: int = 5, parallel: int = 4) -> list[tuple[str, float]]:
    """(column, ``whole`` less the mean AUC of its permutations). The rows are dealt once for a repeat, for all
    columns, and written; up to ``parallel`` columns are judged at a time."""
    used = {f for s in getattr(model, "stages", []) for f in _inputs(s)}
    rows = numbered(test.select(label, *(x for x in test.columns if x != label and (x in columns or x in used))))
    n, found = rows.count(), {c: [] for c in columns}
    for i in range(repeats):
        given = cut(dealt(rows, n, columns, i), "dealt")
        with ThreadPool(max(1, min(parallel, len(columns)))) as pool:
            for c, auc in zip(columns, pool.map(lambda c, g=given, i=i: permuted(model=model, test=g, key=n, label=label, c=c, seed=i), columns), strict=True):
                found[c].append(auc)
        uncut(given)
    uncut(rows)
    return [(c, whole - sum(found[c]) / repeats) for c in columns]


def _inputs(stage: Model) -> list[str]:
    """The columns that a stage reads."""
    named = (stage.getOrDefault(p) for p in stage.params if p.name in ("inputCol", "inputCols") and stage.isDefined(p))
    return [c for x in named for c in ([x] if isinstance(x, str) else x)]


def balanced(df: DataFrame, label: str, weight: str) -> DataFrame:
    """``df`` with a weight that makes every class count alike: all rows over classes times the class's rows."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    n = sizes.agg(F.sum("_n"), F.count("*")).first()
    return df.join(F.broadcast(sizes), label).withColumn(weight, F.lit(n[0] / n[1]) / F.col("_n")).drop("_n")  # a row for each class
