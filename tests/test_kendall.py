from __future__ import annotations

import itertools

import numpy as np
import pytest

from breathlake.functions import distributions as dist
from breathlake.operators import stats
from breathlake.plans import feature_queries as fq


def tau_b(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    return (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())


def test_tau_of_many_values_is_exact(spark):
    g = np.random.default_rng(4)
    x = np.r_[g.normal(size=300), np.full(40, 0.25), g.normal(size=60).round(1)]
    data = {"few": (x, (x + g.normal(size=400) > 0).astype(float)), "many": (x, (x + g.normal(size=400)).round(2)), "down": (x, -x)}
    long = spark.createDataFrame([(k, float(a), float(b)) for k, (xs, ys) in data.items() for a, b in zip(xs, ys)], "feature string, value double, y double")
    got = {r.feature: r for r in stats.kendall(long).collect()}
    for k, (xs, ys) in data.items():
        assert got[k].tau == pytest.approx(tau_b(xs, ys), abs=1e-12) and got[k].n == 400
    assert got["many"].p_value < 1e-6


def test_outcome_and_matrix_know_kendall_and_spearman(spark):
    rows = [(1.0, 4.0, 1.0), (2.0, 3.0, 3.0), (3.0, 1.0, 2.0), (4.0, 2.0, 4.0), (None, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    r = stats.outcome_correlation(df, ["a"], "y", "kendall").first()
    assert (r.n, r.correlation, r.p_value) == (4, pytest.approx(4 / 6), pytest.approx(2 * 4 / 24))
    assert stats.outcome_correlation(df.limit(2), ["a"], "y", "kendall").first().correlation is None
    for method, want in (("kendall", -4 / 6), ("spearman", -0.8)):
        m = {(x.feature_a, x.feature_b): x.r for x in stats.correlation_matrix(df, ["a", "b", "y"], method).collect()}
        assert len(m) == 3 and m["a", "b"] == pytest.approx(want)


def test_p_by_enumeration():
    for n in (3, 5):
        pairs = n * (n - 1) // 2
        nums = [sum(1 if a < b else -1 for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        for num in sorted(set(nums)):
            want = np.mean([abs(x) >= abs(num) for x in nums])
            assert dist.kendall_two_sided(n, num, 0, 0, 0, 0, 0, 0) == pytest.approx(want)
    assert dist.kendall_two_sided(100, 900, 0, 0, 0, 0, 0, 0) == pytest.approx(2 * dist.normal_tail(900 / np.sqrt(100 * 99 * 205 / 18)))


def test_query_does_not_bin(spark, tmp_path, monkeypatch):
    g = np.random.default_rng(6)
    rate = g.uniform(0.2, 0.3, 200)
    y = (rate + g.normal(size=200) / 30 > 0.25).astype(int)
    features = spark.createDataFrame([(i, f"S{i}", float(r)) for i, r in enumerate(rate)], "feature_id long, subject string, rate double")
    labels = spark.createDataFrame([(f"S{i}", int(v)) for i, v in enumerate(y)], "subject string, survival int")
    monkeypatch.setattr(fq, "_features", lambda s, d, names=None: features)
    monkeypatch.setattr(fq, "_labels", lambda s, d: labels)
    assert fq.kendall(spark, str(tmp_path)).first().tau == pytest.approx(tau_b(rate, y), abs=1e-6)
