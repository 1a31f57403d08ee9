from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathlake.operators.spikes import Chart, Limits, breath_spikes, confirmed_issues, flat_mask, run_mask, signal_spikes


def brute(x, rate, rules=Limits()):
    fin = x[np.isfinite(x)]
    m = np.median(fin)
    d = np.median(np.abs(fin - m))
    bad = np.zeros(len(x), bool)
    for i, v in enumerate(x):
        bad[i] = not np.isnan(v) and (abs(v - m) > 8 * d or abs(v) > 100)
    n = int(np.ceil(5 * rate))
    for i in range(len(x) - n + 1):
        s = x[i: i + n]
        if np.isfinite(s).all() and s.max() - s.min() <= 0.02 * d:
            bad[i: i + n] = True
    return bad


def signal(seed, n=3000, rate=5.0):
    g = np.random.default_rng(seed)
    x = np.round(3 * np.sin(np.arange(n) / rate * 1.6) + g.normal(0, 0.1, n), 3)
    for at in g.integers(0, n - 60, 6):
        x[at: at + 2] += 60
    x[500:540] = x[500]
    x[2030:2090] = x[2030] + g.normal(0, 0.001, 60).round(4)
    x[1000] = np.inf
    x[g.integers(0, n, 20)] = np.nan
    return x


def rows_of(x, rec, size=300, step=240, rate=5.0):
    out, k = [], 0
    for s in range(0, len(x) - 1, step):
        d = x[s: s + size]
        out.append((rec * 1000 + k, rec, s, rate, [None if np.isnan(v) else float(v) for v in d]))
        k += 1
    return out + out[:2]  # sent twice


SCHEMA = "window_id long, recording_id long, start_idx long, sampling_rate double, window_data array<double>"


@pytest.mark.parametrize("block", [8192, 700])
def test_signal_matches_brute_force_whole_and_in_blocks(spark, block):
    series = {i: signal(i) for i in range(1, 4)}
    rows = [r for i, x in series.items() for r in rows_of(x, i)]
    s = signal_spikes(spark.createDataFrame(rows, SCHEMA), block=block)
    got = {(r.window_id, r.p) for r in s.select(F.explode("windows").alias("w")).select("w.window_id", F.explode("w.sample_pos").alias("p")).collect()}
    want = set()
    for i, x in series.items():
        bad = brute(x, 5.0)
        want |= {(w, int(k)) for w, _, st, _, d in rows_of(x, i) for k in np.flatnonzero(bad[st: st + len(d)])}
    assert got == want
    issues = spark.createDataFrame([(1, 1, "Flat ", 505, 506), (2, 1, "gap", 505, 506), (3, 1, "outlier", 600, 600), (4, 9, "flat", 0, 10), (5, 1, None, 505, 506), (1, 1, "Flat ", 505, 506)], "issue_id long, recording_id long, issue_type string, start_idx long, end_idx long")
    assert [r.issue_id for r in confirmed_issues(issues, s, block=block).collect()] == [1]


def test_constant_empty_and_null_windows(spark):
    rows = [(1, 1, 0, 2.0, [1.0] * 9 + [5.0]), (2, 2, 0, 2.0, []), (3, 3, 0, 2.0, None), (4, 4, 0, None, [1.0]), (5, 5, 0, 2.0, [None, None])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.recording_id, r.bad) for r in signal_spikes(df).select("recording_id", F.expr("aggregate(runs, 0L, (a, r) -> a + r.end_idx - r.start_idx)").alias("bad")).collect()}
    assert got == {(1, 1), (5, 0)}  # nine equal samples at 2 Hz are too short to be frozen, the odd one lies beyond 8 x 0
    assert signal_spikes(df.limit(0)).count() == 0


def brute_breaths(rows):
    out = set()
    groups = {}
    for b, r, p, t, v in set(rows):
        if v is not None and v == v:
            groups.setdefault((r, p), []).append((t, b, v))
    for g in groups.values():
        g.sort()
        v = np.array([x[2] for x in g])
        bad = (np.abs(v) > 4 * np.median(np.abs(v))) | (np.abs(v) > 100) | run_mask(v, 6)
        out |= {g[i][1] for i in np.flatnonzero(bad)}
    return out


@pytest.mark.parametrize("bucket", [3600.0, 40.0])
def test_breaths_match_brute_force_over_buckets(spark, bucket):
    g = np.random.default_rng(3)
    rows = []
    for r in (1, 2):
        for i in range(200):
            v = float(np.round(5 + g.normal(), 2))
            if i % 50 == 7:
                v = 30.0
            if 90 <= i < 98 or (r == 1 and 20 <= i < 25):
                v = 4.5
            rows.append((r * 1000 + i, r, "inhale" if r == 1 else None, i * 3.1, v if i != 11 else None))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "breath_id long, recording_id long, phase string, start_time double, peak_value double")
    got = [r.breath_id for r in breath_spikes(df, bucket_s=bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_breaths(rows)
    assert breath_spikes(df.limit(0)).count() == 0


def test_the_chart_decides(spark):
    x = signal(5)
    df = spark.createDataFrame(rows_of(x, 1), SCHEMA)
    found = lambda **k: {(r.window_id, p) for r in signal_spikes(df, **k).select(F.explode("windows").alias("w")).select("w.window_id", "w.sample_pos").collect() for p in r.sample_pos}
    whole = found()
    assert whole == {(w, int(k)) for w, _, st, _, d in rows_of(x, 1) for k in np.flatnonzero(brute(x, 5.0)[st: st + len(d)])}
    # a chart that takes the spikes in follows them, and misses what comes next
    assert found(chart=Chart(weight=0.6, clip=50.0)) < whole
    b = spark.createDataFrame([(i, 1, "inhale", i * 3.0, 40.0 if i % 20 in (7, 8, 9) else 5.0 + i % 5) for i in range(100)], "breath_id long, recording_id long, phase string, start_time double, peak_value double")
    assert breath_spikes(b).count() == 15 and breath_spikes(b, chart=Chart(weight=0.6, clip=50.0)).count() < 15


def test_breaths_without_start_time_stay_in_bounded_buckets(spark):
    rows = [(i * 1000, 1, "inhale", None, 4.5 if i < 7 else 5.0 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "breath_id long, recording_id long, phase string, start_time double, peak_value double")
    assert {r.breath_id for r in breath_spikes(df).collect()} == {i * 1000 for i in range(7)}


def test_flat_mask():
    g = np.random.default_rng(0)
    y = np.round(g.normal(0, 1, 400).cumsum() * 0.05, 2)
    want = np.zeros(400, bool)
    for i in range(400 - 7 + 1):
        if np.ptp(y[i: i + 7]) <= 0.1:
            want[i: i + 7] = True
    assert (flat_mask(y, 7, 0.1) == want).all()
