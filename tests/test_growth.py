"""What must not grow with the rows: waits, passes over windows, what a learner's task holds."""

import time

import pytest
from pyspark.sql import functions as F

from waypath.operators import features, learning, metrics, network, ranks
from waypath.plans import features as featuring
from waypath.plans import learning as plans
from waypath.session import having
from waypath.sources import fetch

SF = "/root/testdata/sf0.001"


def test_a_graph_without_edges_has_no_ranks(spark):
    assert network.pagerank(network.edge_table(spark, []), 20).collect() == []


def test_rows_of_a_batch_wait_together(spark):
    asked: dict = {}

    def ask(row):
        asked[row["id"]] = asked.get(row["id"], 0) + 1
        if asked[row["id"]] <= row["id"] % 4:
            raise OSError
        return f"ok {row['id']}"

    began = time.monotonic()
    rows = fetch.fetched(spark.range(200).coalesce(1), ask, attempts=3, base=0.0).collect()
    assert time.monotonic() - began < 30  # one row after the other: some 75 s of waits
    assert all(r.attempts == min(r.id % 4 + 1, 3) and r.result == (f"ok {r.id}" if r.id % 4 < 3 else None) for r in rows) and len(rows) == 200


def test_volumes_do_not_move_the_legs(spark):
    with having(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = featuring.featured(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3


def _counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(a) or real(*a, **k))
    return calls


def test_quantile_keys_and_scores_are_written_once(spark, monkeypatch):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    keys, scores = _counted(monkeypatch, ranks, "cut"), _counted(monkeypatch, metrics, "cut")
    assert ranks.quantiles(df, ["x"], [0.5]) == {"x": [50.0]} and [a[1] for a in keys] == ["keys"]
    metrics.auc(df, "y", "x").collect()
    assert [a[1] for a in scores] == ["scores"]


def test_rows_are_dealt_once_for_a_repeat(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    df = spark.createDataFrame([(i, float(i % 2) * 2 - 1, float(i * 7 % 11), i % 2) for i in range(200)], "i long, x double, z double, label int")
    model = learning.pipeline(["x", "z"], [], LogisticRegression(labelCol="label", maxIter=10)).fit(df)
    dealt = _counted(monkeypatch, learning, "dealt")
    got = dict(learning.importances(model, df, "label", ["x", "z"], 1.0, repeats=2))
    assert len(dealt) == 2 and got["x"] > 0.3 and got["z"] == pytest.approx(0, abs=0.01)


def test_learners_read_small_splits(spark):
    class Seen:
        def fit(self, df):
            return df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert learning.fitted(Seen(), spark.range(1)) == str(16 << 20)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_sequences_show_only_what_they_list():
    assert len(features.SHOWN) == 34 and set(features.TWO_HOP) <= set(features.SHOWN)


def test_estimators_share_prepared_parts(spark, monkeypatch):
    calls = _counted(monkeypatch, learning, "prepared")
    assert plans.L13_elastic_net(spark, SF).count() == 5 and len(calls) == 1
