"""Queries evaluate all folds and features."""

import os

import pytest

from waypath.plans import learning as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_grid_search_takes_every_fold(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(plans.learning, "search", lambda x, year, folds, *rest: seen.extend(folds) or [(1,)])
    plans.L07_grid_search(spark, SF)
    years = sorted(r[0] for r in plans.frame(spark, SF).select("year").distinct().collect())
    assert seen == list(plans.learning.expanding(years, 4)) and len(seen) > 2


def test_every_feature_is_permuted_five_times(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(plans.learning, "permuted", lambda model, test, label, c, key, seed: seen.append((c, seed)) or 0.5)
    rows = plans.L21_permutation_importance(spark, SF).collect()
    assert [r.feature for r in rows] == list(plans.NUMERIC) and sorted(seen) == sorted((c, i) for c in plans.NUMERIC for i in range(5))
