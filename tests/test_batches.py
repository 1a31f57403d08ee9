"""Recordings and windows in batches give what the operators with a row for each sample or breath give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathlake.functions.metrics import METRICS
from breathlake.operators import batches as bt
from breathlake.operators import breaths as br
from breathlake.operators import features as ft
from breathlake.plans import pipeline as pl

WINDOWS = "window_id long, recording_id long, start_idx long, sampling_rate double, window_data array<double>"


def wave(g, n, rate):
    t = np.arange(n) / rate
    x = g.uniform(0.5, 20) * np.sin(2 * np.pi * g.uniform(0.1, 0.6) * t + g.uniform(0, 6)) + g.normal(size=n) * g.choice([0, 0.1, 2])
    return np.round(x, int(g.choice([0, 1, 6])))  # few digits make plateaus and ties


@pytest.mark.parametrize("rules", [br.PeakRules(), br.PeakRules(sub_distance_s=0.9, volume_threshold=0.2, min_distance_s=1.0)])
def test_breaths_of_many_windows_are_those_of_each(rules):
    g = np.random.default_rng(3)
    for n in (3, 60, 181):
        rate = g.choice([2.0, 4.0, 6.0, 25.0], 60)
        x = np.array([wave(g, n, r) for r in rate])
        x[0], x[1] = 0.0, 1.0
        got, at = bt.breaths_of_many(x, rate, rules), 0
        for row in range(len(x)):
            for b in br.breaths_of(x[row], rate[row], rules):
                assert got["row"][at] == row
                for c in ("peak_location", "number_of_peaks", "peak_value", "volume", "duration", "start_time"):
                    assert got[c][at] == pytest.approx(b[c], rel=1e-9, abs=1e-12)
                assert got["interval"][got["interval_of"] == at].tolist() == b["intervals"] and got["ratio"][got["ratio_of"] == at].tolist() == pytest.approx(b["ratios"])
                at += 1
        assert at == len(got["row"]) and (n == 3 or at > 60)


def test_metrics_of_windows_and_recordings(spark):
    g = np.random.default_rng(4)
    rows = [(i, i // 3 if i // 3 else None, i % 3, r, [None if g.random() < 0.02 else float(v) for v in wave(g, n, r)]) for i in range(24) for r, n in [(float(g.choice([2, 6])), int(g.choice([2, 60, 180])))]]
    rows += [(90, 40, 0, 6.0, None), (91, 40, 1, 0.0, [1.0] * 60), (92, 41, 0, 6.0, [None] * 60)]
    w = spark.createDataFrame(rows, "window_id long, recording_id long, window_index int, sampling_rate double, window_data array<double>").cache()
    want = br.metrics(br.window_breaths(w), ["window_id"], "peak_location")
    multi = METRICS[23:]
    want = {r.window_id: r for r in w.select("window_id").join(want, "window_id", "left").fillna(0, list(multi)).collect()}
    m = bt.window_metrics(w).cache()
    for r in m.collect():
        assert all((r[c] is None) == (want[r.window_id][c] is None) and (r[c] is None or r[c] == pytest.approx(want[r.window_id][c], rel=1e-9, abs=1e-9)) for c in METRICS)
    want = ft.aggregate_windows(m, ["recording_id"], list(METRICS), list(bt.FUNCTIONS))
    got = bt.recordings_of(m, list(METRICS), bt.FUNCTIONS)
    assert got.dtypes == want.dtypes
    want = {r.recording_id: r for r in want.collect()}
    got = {r.recording_id: r for r in got.collect()}
    assert None in got and got.keys() == want.keys()
    assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)) for k in got for a, b in zip(got[k], want[k]))


@pytest.fixture(scope="module")
def odd(spark):
    g = np.random.default_rng(5)
    rows, i = [], 0
    for rec in range(12):
        rate = [2.0, 4.0, 6.0][rec % 3]
        n = int(g.integers(400, 1500))
        x = wave(g, n, rate).astype(object)
        if rec % 2:
            x[50: 50 + int(3 * rate)] = None
            x[200: 200 + int(12 * rate)] = 0.0
            x[300] = None
        if rec % 3 == 1:
            x[0: int(2 * rate)], x[330:360], x[380] = None, 3.25, 500.0
        if rec in (4, 5):
            x[-150:] = None
        if rec == 7:
            x[: 2 * n // 3] = None  # to reject
        if rec == 8:
            x[:-1] = None
        for a in range(-30 if rec == 9 else 0, n, 150):
            if rec == 10 and a == 300:
                continue  # a hole between windows
            d = [None if v is None else float(v) for v in x[max(a, 0): a + 180]]
            if rec == 3 and a == 150:
                d[5], d[9] = float("nan"), float("inf")
            rate_of = 4.0 if rec == 11 and a == 300 else rate  # two rates
            rows += [(i, rec, a, rate_of, d)] * (2 if a == 450 else 1)
            i += 1
    rows += [(900, 50, 0, 0.5, [1.0] * 200), (901, None, 0, 6.0, [1.0] * 200), (902, 51, 0, 6.0, None), (903, 52, 0, 6.0, [])]
    return spark.createDataFrame(rows, WINDOWS).cache()


@pytest.mark.parametrize("detrend", ["linear", None])
def test_recordings_cleaned_whole_are_those_cleaned_by_sample(odd, detrend):
    config = pl.Config(detrend=detrend)
    rows = lambda whole: {(r.recording_id, r.window_index): r for r in pl.clean_windows(odd, config, whole).collect()}
    got, want = rows(bt.WHOLE), rows(0)
    assert got.keys() == want.keys() and {k[0] for k in got} >= {0, 1, 2, 3, 9, 10, 11}
    for k, r in got.items():
        assert (r.window_id, r.sampling_rate, len(r.window_data)) == (want[k].window_id, want[k].sampling_rate, len(want[k].window_data))
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-7)) for a, b in zip(r.window_data, want[k].window_data)), k


def test_no_row_for_each_sample(odd):
    one = odd.filter("recording_id < 11")
    for df in (w := pl.clean_windows(one), pl.window_features(w, unique=True)):
        plan = df._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "Generate" not in plan


def test_a_recording_goes_on_in_the_next_batch(spark, odd):
    rows = lambda: {(r.recording_id, r.window_index): r.window_data for r in pl.clean_windows(odd).collect()}
    want = rows()
    m = bt.window_metrics(pl.clean_windows(odd)).cache()
    agg = lambda: sorted(map(str, bt.recordings_of(m, list(METRICS), ("min", "median")).collect()))
    both = agg()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "3")
        assert rows() == want and agg() == both
    finally:
        spark.conf.set(key, before)


def test_comparison_of_a_feature_in_one_task(spark):
    g = np.random.default_rng(6)
    rows = [(i, float(i % 3 == 0) if i % 7 else None, float(np.round(g.normal(), 1)) if g.random() < 0.8 else None, None, 2.5, i if i % 3 == 0 else None, float(g.normal()) if i < 20 else None) for i in range(150)]
    rows += [(200, 1.0, float("nan"), None, 2.5, 7, None)]
    df = spark.createDataFrame(rows, "recording_id int, recovery double, tied double, never double, same double, one int, few double").repartition(3)
    names = ["tied", "never", "same", "one", "few"]
    got, want = pl.compare_outcome(df, "recovery", names), pl.compare_outcome(df, "recovery", names, whole=0)
    assert got.dtypes == want.dtypes
    plan = got._jdf.queryExecution().toString()
    assert "Expand" not in plan and "Join" not in plan  # no row for each value, ranks are joined to none
    got, want = ({r.feature: r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() == {"tied", "same", "one", "few"}
    for f in got:
        for c, v in got[f].items():
            w = want[f][c]
            assert v == w or v == pytest.approx(w, rel=1e-9, abs=1e-12, nan_ok=True), (f, c)


def test_predictions_take_no_row_for_each_sample_or_value(spark, monkeypatch):
    from breathlake.plans import pipeline_queries as pq

    seen, cut = [], pq.cut
    for module in (pl, pq):
        monkeypatch.setattr(module, "cut", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    got = pq.pipeline_predictions(spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 4 and not any("Generate" in p or "Expand" in p for p in seen)
    assert len(got) > 10 and {r.held_out for r in got} == {True, False} and all(0 <= r.score <= 1 for r in got)
