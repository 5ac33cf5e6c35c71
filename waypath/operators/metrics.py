"""Model metrics as one pass of SQL over (label, score) or (actual, predicted) columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waypath.session import cut


def by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) of each distinct score: what curves and areas need, however many rows there are."""
    return df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def cumulated(scores: DataFrame, step: int = 1000) -> DataFrame:
    """``scores`` with ``tp`` and ``fp``: positives and negatives at or above each score.

    Sums run inside ranges of scores, each added to the total of the ranges above it, so no
    task holds all distinct scores. ``step`` ranges are cut between the extremes. ``scores`` are written first:
    they are read for the extremes, for the ranges and by what is made of the sums, and would be worked out each time.
    """
    scores = cut(scores, "scores")
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    if lo is None:
        return scores.select("*", F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    width = (hi - lo) / step or 1.0
    part = scores.withColumn("_b", F.floor((F.col("score") - F.lit(lo)) / F.lit(width)))
    above = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    sums = part.groupBy("_b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    sums = sums.select("_b", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_n"))
    inside = W.partitionBy("_b").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    out = part.join(sums, "_b")
    return out.select("score", "pos", "neg", (F.col("_p") + F.sum("pos").over(inside)).alias("tp"), (F.col("_n") + F.sum("neg").over(inside)).alias("fp"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row ``auc``: the share of (positive, negative) pairs in the right order, ties half; null without both."""
    c = cumulated(by_score(df, label, score))
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return c.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, fpr, tpr) at each distinct score."""
    c = cumulated(by_score(df, label, score))
    p, n = c.agg(F.sum("pos"), F.sum("neg")).first()
    return c.select("score", (F.col("fp") / F.lit(n)).alias("fpr"), (F.col("tp") / F.lit(p)).alias("tpr"))


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row ``pr_auc``: precision times the step in recall, summed over distinct scores."""
    c = cumulated(by_score(df, label, score))
    return c.agg((F.sum(F.col("tp") / (F.col("tp") + F.col("fp")) * F.col("pos")) / F.sum("pos")).alias("pr_auc"))


def classification(df: DataFrame, label: str, score: str, least: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and accuracy at a threshold; a ratio without a denominator is 0."""
    p, y = F.col(score) >= least, F.col(label) == 1
    c = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
