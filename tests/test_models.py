from __future__ import annotations

import numpy as np
import pytest

from breathlake.operators import features as ft
from breathlake.operators import signal as sg
from breathlake.operators import stats
from breathlake.operators.ml import Classifier
from breathlake.operators.select import select_from_results


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(42)
    x = g.normal(size=(240, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, label double").cache()


@pytest.mark.parametrize("kind,params", [("logistic", {}), ("forest", {"n_estimators": 10}), ("boosting", {"n_estimators": 5}), ("svm", {"kernel": "linear"}), ("svm", {"kernel": "rbf", "components": 60}), ("network", {"hidden": [8], "max_iter": 60})])
def test_each_kind_learns_is_kept_and_ranks_its_features(spark, rows, tmp_path, kind, params):
    names = ["a", "b", "c", "d"]
    m = Classifier(kind, names, params=params).fit(rows.filter("id % 3 > 0"))
    p = {r.id: r.prediction for r in m.predict(rows).collect()}
    assert np.mean([p[r.id] == r.label for r in rows.filter("id % 3 = 0").collect()]) > 0.8  # rows it was not fitted on
    v = m.importances(rows)
    assert max(v, key=v.get) == "a" and set(v) == set(names)
    m.save(str(tmp_path / "m"))
    again = Classifier(kind, names, params=params).load(str(tmp_path / "m"))
    assert {r.id: r.prediction for r in again.predict(rows).collect()} == p


def test_one_sided_ranks_and_selection_from_results(spark):
    g = np.random.default_rng(0)
    data = [("f", k, float(g.normal(1.0 if k == "x" else 0.0))) for k in "xy" for _ in range(60)] + [("g", k, float(g.normal())) for k in "xy" for _ in range(60)]
    long = spark.createDataFrame(data, "feature string, label string, value double")
    p = {alt: {r.feature: r.p_value for r in stats.mann_whitney(long, "x", "y", alt).collect()} for alt in ("two-sided", "greater", "less")}
    assert p["greater"]["f"] == pytest.approx(p["two-sided"]["f"] / 2) and p["less"]["f"] > 0.99 and p["greater"]["f"] < 1e-3
    with pytest.raises(ValueError):
        stats.mann_whitney(long, "x", "y", "other")
    r = stats.compare_binary(long, "x", "y")
    assert [x.feature for x in select_from_results(r).collect()] == ["f"] and select_from_results(r, effect=0.99).count() == 0 and select_from_results(r, alpha=1.1, n=1).count() == 1


def test_labels_in_order_and_index_segments(spark):
    lab = spark.createDataFrame([("a", 1), ("b", None), (None, 2)], "k string, y int")
    assert [(r.k, r.y) for r in ft.labels_for(lab, "k", "y", ["b", "a", "z", "a"]).collect()] == [("b", None), ("a", 1), ("z", None), ("a", 1)]
    s = spark.createDataFrame([(1, i, float(i), 2.0) for i in range(10)], "recording_id long, idx long, x double, rate double")
    at = lambda *a: sorted(r.idx for r in sg.index_segment(s, *a).collect())
    assert at(2, 5) == [2, 3, 4] and at(-3) == [7, 8, 9] and at(1, -7) == [1, 2] and at(0, 0) == []


def test_pairwise_complete_correlations(spark):
    g = np.random.default_rng(3)
    x = g.normal(1e6, 1, size=(300, 3))
    x[:, 1] += x[:, 0]
    data = [tuple(None if g.random() < 0.1 else float(v) for v in r) + (7.0,) for r in x]
    got = {(r.feature_a, r.feature_b): r.r for r in stats.correlation_matrix(spark.createDataFrame(data, "a double, b double, c double, d double"), list("abcd")).collect()}
    v = np.array([[np.nan if u is None else u for u in r] for r in data])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        ok = np.isfinite(v[:, i]) & np.isfinite(v[:, j])
        assert got["abcd"[i], "abcd"[j]] == pytest.approx(np.corrcoef(v[ok, i], v[ok, j])[0, 1], abs=1e-9)
    assert got["a", "d"] is None
