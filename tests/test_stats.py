from __future__ import annotations

import itertools

import numpy as np
import pytest

from breathlake.functions import distributions as dist
from breathlake.operators import features as ft
from breathlake.operators import ml, select, stats


def long(spark, groups):
    return spark.createDataFrame([("f", k, float(v) if v is not None else None) for k, vs in groups.items() for v in vs], "feature string, label string, value double")


def test_small_exact_mann_whitney(spark):
    r = stats.mann_whitney(long(spark, {"a": [1, 2, 3, None], "b": [4, 5, 6]}), "a", "b").first()
    assert (r.statistic, r.effect_size) == (0, 1) and r.p_value == pytest.approx(0.1)
    same = stats.mann_whitney(long(spark, {"a": [2, 2], "b": [2, 2, 2]}), "a", "b").first()
    assert same.statistic == 3 and same.p_value == 1


def test_exact_distribution_by_enumeration():
    n1, n2 = 3, 4
    us = [sum(c) - 3 for c in itertools.combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        tail = np.mean([x >= max(u, 12 - u) for x in us])
        assert dist.mann_whitney_exact(u, n1, n2) == pytest.approx(min(1, 2 * tail))


def test_distributions_against_quadrature():
    t = np.linspace(-60, 60, 1_200_001)
    for df, x in ((3, 1.7), (30, 2.4)):
        pdf = (1 + t**2 / df) ** (-(df + 1) / 2)
        want = np.trapezoid(np.where(np.abs(t) >= x, pdf, 0), t) / np.trapezoid(pdf, t)
        assert dist.t_two_sided(x, df) == pytest.approx(want, abs=2e-4)
    assert dist.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.f_tail(4.0, 1, 10) == pytest.approx(dist.t_two_sided(2.0, 10))
    assert dist.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert dist.approximate_power(0.5, 64) == pytest.approx(0.807, abs=2e-3) and dist.sample_size(0.5) == 63


def test_kruskal_anova_identities(spark):
    g = np.random.default_rng(0)
    data = {k: g.normal(i, 1, 30).round(1).tolist() for i, k in enumerate("abc")}
    df = long(spark, data)
    allv = np.concatenate(list(map(np.array, data.values())))
    ssb = sum(len(v) * (np.mean(v) - allv.mean()) ** 2 for v in data.values())
    a = stats.anova(df).first()
    assert a.eta_squared == pytest.approx(ssb / ((allv - allv.mean()) ** 2).sum())
    two = long(spark, {k: data[k] for k in "ab"})
    z, h = stats.mann_whitney(two, "a", "b").first().z, stats.kruskal(two).first().statistic
    assert h == pytest.approx(z**2, rel=0.1)  # but for the continuity correction
    t, f = stats.welch_t(two, "a", "b", equal_var=True).first().statistic, stats.anova(two).first().statistic
    assert f == pytest.approx(t**2) and stats.kruskal(df.limit(0)).count() == 0


def test_ranks_over_ranges_match_one_sort(spark):
    g = np.random.default_rng(5)
    v = np.r_[g.integers(0, 40, 500), np.full(300, 7)]
    r = {x.value: x["rank"] for x in stats.ranks(spark.createDataFrame([("f", float(x)) for x in v], "feature string, value double"), ["feature"], ranges=16, per_range=4).collect()}
    s = np.sort(v)
    assert all(r[u] == pytest.approx((np.searchsorted(s, u) + np.searchsorted(s, u, "right") + 1) / 2) for u in np.unique(v))


@pytest.mark.parametrize("method,want", [("fdr_bh", [0.04] * 4), ("bonferroni", [0.04, 0.08, 0.12, 0.16]), ("holm", [0.04, 0.06, 0.06, 0.06])])
def test_corrections(spark, method, want):
    df = spark.createDataFrame([(c, p) for c, p in zip("abcde", [0.01, 0.02, 0.03, 0.04, None])], "feature string, p_value double")
    got = {r.feature: r.p_adjusted for r in stats.adjust_p(df, method=method).collect()}
    assert [got[c] for c in "abcd"] == pytest.approx(want) and got["e"] is None


def test_planted_shift_is_found_and_selected(spark):
    g = np.random.default_rng(42)
    y = np.repeat([0, 1], 50)
    x = g.normal(size=(100, 20))
    x[y == 1, :5] += 3
    names = [f"feat_{i}" for i in range(20)]
    wide = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(y, x)], "label int, " + ", ".join(f"{n} double" for n in names))
    melted = ft.melt(wide, ["label"], names)
    r = stats.compare_binary(melted, 0, 1)
    assert {x.feature for x in r.filter("p_adjusted < 0.001").collect()} == set(names[:5])
    chosen = select.select_statistical(melted, wide, names, n=5).filter("selected")
    assert {x.feature for x in chosen.collect()} == set(names[:5])
    scores, loadings, variance = select.pca(wide.drop("label"), names, 3)
    assert scores.count() == 100 and len(scores.columns) == 3 and variance.filter("ratio <= 0").count() == 0
    fit = ml.Classifier("logistic", names).fit(wide)
    assert ml.summary(ml.confusion(fit.predict(wide).selectExpr("double(label) label", "prediction"))).first().accuracy > 0.95
    assert ml.auc(fit.predict(wide)).first().auc > 0.95


def test_table_operators(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (2, 3.0, 4.0), (3, None, 4.0)], "k int, a double, b double")
    clean = ft.missing_as_null(df, ["a", "b"])
    assert ft.fill_missing(clean, ["a", "b"], "mean").filter("k = 3").first().a == 2
    assert ft.fill_missing(clean, ["a", "b"], "drop").count() == 1
    z = {r.k: (r.a, r.b) for r in ft.normalize(clean, ["a", "b"]).collect()}
    assert z[2][0] == pytest.approx(0.70710678) and z[2][1] is None  # b is constant
    with pytest.raises(KeyError):
        ft.select_features(df, ["k"], ["c"])
    with pytest.raises(Exception, match="missing values"):
        ft.aggregate_windows(clean, ["k"], ["a"], ["mean"], nan_policy="raise").collect()
    labels = spark.createDataFrame([(1, 0), (1, 1)], "k int, y int")
    with pytest.raises(Exception, match="several labels"):
        ft.merge_labels(clean, labels, "k", "y").collect()


def test_neighbors_and_folds(spark):
    g = np.random.default_rng(1)
    v = g.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(300)], "vec_id long, embedding array<double>, label int")
    got = {(r.query_id, r["rank"]): r.neighbor_id for r in ml.nearest(df, df.filter("vec_id % 100 = 0"), 4, block=64).collect()}
    for q in (0, 100, 200):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        assert [got[q, k] for k in range(1, 5)] == np.argsort(d)[:4].tolist()
    f = ml.stratified_folds(df, "vec_id", "label", 5).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in f} == {20}


def test_spearman_and_kendall_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0), (None, 1.0)], "a double, y double")
    assert stats.outcome_correlation(df, ["a"], "y", "spearman").first().correlation == pytest.approx(0.8)
    assert stats.kendall_tau(df, "a", "y").first().tau == pytest.approx(4 / 6)


def test_tails_by_numbers_known_in_closed_form():
    from breathlake.functions import distributions as dist
    import math

    assert dist.t_two_sided(1.0, 1) == pytest.approx(0.5) and dist.t_two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6))
    for x in (0.01, 1.0, 7.5, 60.0):
        assert dist.chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2)) and dist.chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
        assert dist.f_tail(x, 2, 6) == pytest.approx((1 + x / 3) ** -3) and dist.chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)))
        assert dist.normal_tail(x / 5) == pytest.approx(math.erfc(x / 5 / math.sqrt(2)) / 2)
