"""Boosted trees that go on from year to year."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.operators.learning import fitted
from waypath.session import SMALL_GROUPS, cut, uncut


def shares(rounds: int, years: int) -> list[int]:
    """How many of ``rounds`` trees each year gets: as many each, and the last the remainder."""
    each = rounds // years
    return [each] * (years - 1) + [rounds - each * (years - 1)]


def chance(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


@dataclass
class Boosted:
    """Trees whose values, times ``rate``, add up to the margin (the logit of the class)."""

    rate: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    #: Mean logistic loss of each year's rows before and after its trees.
    losses: dict[int, tuple[float, float]] = field(default_factory=dict)

    def margins(self, df: DataFrame, trees: list[DecisionTreeRegressionModel] | None = None, start: Column | None = None) -> DataFrame:
        """``df`` (with ``features``) with ``margin``."""
        df = df.withColumn("margin", F.lit(0.0) if start is None else start)
        for tree in self.trees if trees is None else trees:
            df = tree.transform(df).withColumn("margin", F.col("margin") + self.rate * F.col(tree.getPredictionCol())).drop(tree.getPredictionCol())
        return df

    def scored(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score``: the probability of class 1."""
        return self.margins(df).withColumn("score", chance(F.col("margin"))).drop("margin")


def _loss(df: DataFrame, label: str) -> float:
    m = F.col("margin")
    return df.agg(F.avg(F.greatest(m, F.lit(0.0)) - m * F.col(label) + F.log1p(F.exp(-F.abs(m))))).first()[0]


def by_year(df: DataFrame, time: str, years: list[int], label: str, rounds: int = 12, rate: float = 1.0, depth: int = 3, seed: int = 1) -> Boosted:
    """Boosting over ``df`` (features, ``label`` 0 or 1, ``time``), a year after the other.

    The margin is a column. A year's rows start from the margin of all trees before; each of its trees is fitted
    (by sums over histograms of the features, in the tasks) to the gradient of the loss at the margin, and moves it. So a
    year adds trees to what earlier years have learned and reads no rows but its own. A year without rows adds none.
    """
    model = Boosted(rate)
    for year, trees in zip(years, shares(rounds, len(years)), strict=True):
        rows = cut(model.margins(df.where(F.col(time) == year).select("features", label)), "margins", **SMALL_GROUPS)
        if rows.isEmpty():
            continue
        before, new = _loss(rows, label), []
        for k in range(trees):
            now = model.margins(rows, new, F.col("margin")) if new else rows
            gradient = now.withColumn("_gradient", F.col(label) - chance(F.col("margin")))
            fit = DecisionTreeRegressor(labelCol="_gradient", featuresCol="features", predictionCol="_step", maxDepth=depth, seed=seed + k)
            new.append(fitted(fit, gradient))
        model.trees += new
        model.losses[year] = before, _loss(model.margins(rows, new, F.col("margin")), label)
        uncut(rows)
    return model
