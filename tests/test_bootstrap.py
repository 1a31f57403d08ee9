from __future__ import annotations

import inspect

import numpy as np
import pytest

from breathlake.operators import ml


def table(spark, n, seed=0):
    g = np.random.default_rng(seed)
    y = (g.random(n) < 0.2).astype(int)
    x = g.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 100, 5] + y[:, None] * [1, 3, 0.05]
    return spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x))], "k long, label int, a double, b double, c double")


def test_draws_keep_each_labels_share():
    d = ml.Draws({0.0: [700, 900], 1.0: [400]}, 30)
    for label, want in ((0.0, 1280), (1.0, 320)):
        t = np.concatenate([d.times(label, b, range(30)) for b in range(len(d.sizes[label]))])
        assert (t.sum(0) == want).all() and 0.40 < (t == 0).mean() < 0.50 and t.max() > 1
    assert (d.times(0.0, 1, range(30))[:, 7] == d.times(0.0, 1, range(7, 8))[:, 0]).all()


def test_few_rows_out_of_bag_are_a_split():
    d = ml.Draws({0.0: [10], 1.0: [5]}, 200)
    assert d.split
    for r in d.split:
        t = np.concatenate([d.times(c, 0, range(r, r + 1)) for c in (0.0, 1.0)])
        assert t.max() == 1 and t.sum() == 12


def test_rounds_fitted_together_are_those_fitted_one_by_one(spark):
    df = table(spark, 1500)
    a, b = ({r.metric: r for r in ml.bootstrap(df, ml.Classifier("logistic", ["a", "b", "c"]), "k", 3, together=t).collect()} for t in (True, False))
    for m in ("accuracy", "f1", "precision", "recall"):
        assert list(a[m][1:]) == pytest.approx(list(b[m][1:]), abs=4e-3)


def test_intervals_rest_on_a_thousand_rounds(spark):
    assert inspect.signature(ml.bootstrap).parameters["rounds"].default == 1000
    r = {x.metric: x for x in ml.bootstrap(table(spark, 400), ml.Classifier("logistic", ["a", "b", "c"]), "k").collect()}["accuracy"]
    assert r.ci_lower_95 == pytest.approx(r["mean"] - 1.96 * r["std"], abs=r["std"] / 3) and r.ci_lower_95 < r["mean"] < r.ci_upper_95


def test_folds_hold_out_every_row_once_and_evenly():
    f = ml.Folds({0.0: [7, 6], 1.0: [5]}, 3, repeats=2, whole=True)
    t = {c: np.concatenate([f.times(c, b, range(7)) for b in range(n)]) for c, n in ((0.0, 2), (1.0, 1))}
    for x in t.values():
        assert ((x[:, :3] == 0).sum(1) == 1).all() and (x[:, :3] == x[:, 3:6]).all() and (x[:, 6] == 1).all()
        held = (x[:, :3] == 0).sum(0)
        assert held.max() - held.min() <= 1


def test_sets_fitted_together_score_as_those_fitted_one_by_one(spark):
    df, grid = table(spark, 900), [{"C": 0.001}, {"C": 1.0}]
    base = ml.Classifier("logistic", ["a", "b", "c"])
    (m1, a), (m2, b) = (ml.grid_search(df, base, grid, "k", 3, together=t) for t in (True, False))
    for x, y in zip(a.orderBy("candidate").collect(), b.orderBy("candidate").collect()):
        assert x.mean_score == pytest.approx(y.mean_score, abs=0.02) and x.params == y.params
    assert m1.params == m2.params


def test_area_of_binned_scores_is_that_of_ranks(spark):
    df = table(spark, 600)
    a, b = ({r.metric: r for r in ml.bootstrap(df, ml.Classifier("logistic", ["a", "b", "c"]), "k", 2, together=t).collect()} for t in (True, False))
    assert a["auc"]["mean"] == pytest.approx(b["auc"]["mean"], abs=2e-3) and a["auc"]["mean"] > 0.7
    for m in ("sensitivity", "specificity"):
        assert a[m]["mean"] == pytest.approx(b[m]["mean"], abs=0.02)


def test_several_classes_have_an_average_area(spark):
    g = np.random.default_rng(1)
    y = g.integers(0, 3, 240)
    x = g.normal(size=(240, 2)) + np.c_[y == 1, y == 2] * 2.0
    df = spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x))], "k long, label int, a double, b double")
    pred = ml.Classifier("logistic", ["a", "b"]).fit(df).predict(df).cache()
    rows = pred.select("label", "scores").collect()
    want = []
    for c in range(3):
        p, q = [r.scores[c] for r in rows if r.label == c], [r.scores[c] for r in rows if r.label != c]
        want.append(np.mean([(u > v) + (u == v) / 2 for u in p for v in q]))
    got = {r["class"]: r.auc for r in ml.auc_by_class(pred).collect()}
    assert [got[c] for c in range(3)] == pytest.approx(want) and ml.auc_macro(pred).first()[0] == pytest.approx(np.mean(want))
    m = {r.metric: r["mean"] for r in ml.bootstrap(df, ml.Classifier("logistic", ["a", "b"]), "k", 2).collect()}
    assert m["auc"] > 0.8 and m["sensitivity"] is None


def test_rates_of_two_labels(spark):
    cells = spark.createDataFrame([(1, 1, 3), (1, 0, 1), (0, 0, 8), (0, 1, 2)], "label int, prediction int, n long")
    assert tuple(ml.binary_rates(cells).first()) == pytest.approx((11 / 14, 0.75, 0.8))
    assert tuple(ml.binary_rates(cells.limit(0)).first()) == (None, None, None)


def test_experiments_and_elimination(spark):
    g = np.random.default_rng(5)
    y = (g.random(500) < 0.4).astype(int)
    x = g.normal(size=(500, 5))
    x[:, 1] += 2 * y
    x[:, 3] -= 1.5 * y
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x))], "k long, label int, " + ", ".join(f"{n} double" for n in names)).cache()
    t, models = ml.experiments(df, ml.Classifier("logistic", names), ["f1", "f3"], [{"C": 0.01}, {"C": 1.0}], "k", 3, 40)
    r = {x.experiment: x for x in t.collect()}
    assert set(r) == {"All Features", "Significant Features", "LOO: -f1", "LOO: -f3"} == set(models)
    assert r["All Features"].dimension == 5 and r["LOO: -f1"].features_used == "f3" and r["LOO: -f1"].auc < r["LOO: -f3"].auc < r["Significant Features"].auc
    ranks, scores = ml.elimination_cv(df, names, "label", "k", keep=1, step=1, folds=3)
    by = {x.feature: x for x in ranks.collect()}
    assert by["f1"].rank == 1 and by["f3"].rank == 2 and sorted(x.rank for x in by.values()) == [1, 2, 3, 4, 5]
    assert by["f1"].selected and by["f3"].selected and [x.n_features for x in scores.collect()] == [5, 4, 3, 2, 1]
    with pytest.raises(ValueError):
        ml.elimination_cv(df.withColumn("label", df.label + 1), names, "label", "k")
    with pytest.raises(ValueError):
        ml.experiments(df.limit(0), ml.Classifier("logistic", names), [], [{}], "k")
