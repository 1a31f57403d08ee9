from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathlake.operators import features as ft
from breathlake.operators import quantiles as qt
from breathlake.operators import signal as sg


@pytest.mark.parametrize("kind", ["continuous", "tied", "constant"])
def test_one_group_holds_nearly_all_rows(spark, kind):
    g = np.random.default_rng(1)
    n = 60_000
    x = {"continuous": g.standard_cauchy(n), "tied": g.integers(0, 40, n).astype(float), "constant": np.full(n, 2.5)}[kind]
    key = np.where(np.arange(n) % 50 == 0, 1, 0)
    rows = [(None if k and i % 100 == 0 else int(k), float(v)) for i, (k, v) in enumerate(zip(key, x))] + [(0, None), (5, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    exact = {r.k: r.q for r in qt.group_quantiles(df, ["k"], "v", probs).collect()}
    two = {r.k: r.q for r in qt.bracketed_quantiles(df.withColumnRenamed("v", "_v").dropna(subset=["_v"]), ["k"], probs, accuracy=1000).collect()}
    assert set(exact) == set(two) == {0, 1, None}
    for k in exact:
        assert two[k] == pytest.approx(exact[k], rel=1e-12)
    plan = qt.bracketed_quantiles(df.withColumnRenamed("v", "_v"), ["k"], probs)._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_operators_are_the_same_either_way(spark, monkeypatch):
    g = np.random.default_rng(2)
    rows = [(i % 3, i, float(g.normal()), float(i % 7) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "r int, i int, a double, b double")
    samples = df.select(F.col("r").cast("long").alias("recording_id"), F.col("i").cast("long").alias("idx"), F.col("a").alias("x"), F.lit(2.0).alias("rate"))
    fns = ["mean", "median", "q25", "iqr"]

    def run():
        out = [ft.aggregate_windows(df, ["r"], ["a", "b"], fns, min_valid=3), ft.feature_statistics(df, ["a", "b"]), ft.normalize(df, ["a", "b"], "robust"), ft.fill_missing(df, ["a", "b"], "median"), sg.robust_threshold(samples)]
        return [sorted((tuple(r) for r in o.select(sorted(o.columns)).collect()), key=str) for o in out]

    small = run()
    monkeypatch.setattr(qt, "SMALL", 10)
    for a, b in zip(small, run()):
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            assert all(u == (pytest.approx(v, rel=1e-12) if isinstance(v, float) else v) for u, v in zip(x, y))


def test_flat_runs_at_a_thousand_and_one_rates(spark):
    rows = spark.range(1001).selectExpr("id as recording_id", "cast(id + 2 as double) as rate", "explode(sequence(0L, id + 21)) as idx")
    samples = rows.select("recording_id", "idx", "rate", F.expr("if(idx < 10, idx * 0.5, 7.25)").alias("x"))
    got = {r.recording_id: (r.start_idx, r.end_idx) for r in sg.flat_runs(samples, min_s=1.0).collect()}
    assert got == {i: (10, i + 22) for i in range(1001)}
