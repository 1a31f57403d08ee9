from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathlake.operators import breaths as br
from breathlake.operators import signal as sg

S = "recording_id long, idx long, x double, rate double"


def frame(spark, x, rate=6.0, rec=1):
    return spark.createDataFrame([(rec, i, None if v is None or math.isnan(v) else float(v), rate) for i, v in enumerate(x)], S)


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_islands_over_block_edges(spark, block):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 19)], "idx long").selectExpr("1 recording_id", "idx")
    got = sorted((r.start_idx, r.end_idx) for r in sg.islands(df, ["recording_id"], block=block).collect())
    assert got == [(0, 10), (12, 13), (15, 17), (19, 20)]


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_interpolation_inside_and_at_the_ends(spark, block):
    x = [None, None, 2.0, 4.0, None, None, None, 12.0, 10.0, None]
    out = sg.interpolate(frame(spark, x), F.col("x").isNull(), block).orderBy("idx").collect()
    assert [r.x for r in out] == pytest.approx([-2, 0, 2, 4, 6, 8, 10, 12, 10, 8])
    assert sg.interpolate(frame(spark, [None, 1.0]), F.col("x").isNull()).filter("replaced").count() == 0


def test_repair_bridges_short_and_drops_long(spark):
    s = frame(spark, [1.0] + [9.0] * 3 + [5.0] + [9.0] * 11 + [5.0, 7.0], rate=1.0)
    runs = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (1, 5, 16), (1, 17, 18)], "recording_id long, start_idx long, end_idx long")
    got = [r.x for r in sg.repair(s, runs).orderBy("idx").collect()]
    assert got[:5] == [1.0, 2.0, 3.0, 4.0, 5.0] and got[5:16] == [None] * 11 and got[16:] == [5.0, 7.0]


@pytest.mark.parametrize("n,want", [(1799, 0), (1800, 1), (1800 + 1439, 1), (1800 + 1440, 2), (14400, 9)])
def test_window_counts(spark, n, want):
    shape = spark.createDataFrame([(1, n, 6.0)], "recording_id long, n_samples long, rate double")
    assert sg.window_count(shape, 300, 60).first().n_windows == want


def test_sliding_windows_are_full_and_match_the_formula(spark):
    x = np.arange(100.0)
    got = sg.window_stats(frame(spark, x, 1.0), 20, 5).orderBy("window_index").collect()
    assert len(got) == (100 - 20) // 15 + 1
    for r in got:
        assert r.mean_x == pytest.approx(x[r.start_idx: r.start_idx + 20].mean())
    with pytest.raises(ValueError):
        sg.sliding_windows(frame(spark, x), 5, 5)


def test_detrend_takes_off_a_ramp(spark):
    x = 0.5 * np.arange(50) + 3
    assert max(abs(r.x) for r in sg.detrend(frame(spark, x)).collect()) < 1e-9
    assert sum(r.x for r in sg.detrend(frame(spark, x), "constant").collect()) == pytest.approx(0, abs=1e-9)


def test_flat_runs_in_blocks(spark):
    x = np.r_[np.arange(20) % 5, np.full(15, 2.0), np.arange(20) % 3]
    for block in (16, 1 << 16):
        got = [(r.start_idx, r.end_idx) for r in sg.flat_runs(frame(spark, x, 2.0), 5.0, block=block).collect()]
        assert got == [(20, 35)]


def test_quality_report(spark):
    s = frame(spark, [0.5, 1.0] * 20 + [None] * 60, 6.0)
    issues = spark.createDataFrame([(1, "gap", 40, 100), (1, "flat", 90, 100)], "recording_id long, issue_type string, start_idx long, end_idx long")
    r = sg.quality_report(s, issues).first()
    assert (r.valid_samples, r.n_issues, r.recommendation) == (40, 2, "reject")


def test_sine_breaths_and_metrics(spark):
    t = np.arange(1800) / 6.0
    rows = [(1, 1, 6.0, (10 * np.sin(2 * np.pi * 0.25 * t)).tolist()), (2, 1, 6.0, [0.0] * 100), (3, 1, 6.0, None), (4, 1, 6.0, [None] * 50)]
    w = spark.createDataFrame(rows, "window_id long, recording_id long, sampling_rate double, window_data array<double>")
    b = br.window_breaths(w)
    assert {r.window_id for r in b.collect()} == {1}
    m = br.metrics(b, ["window_id"], "peak_location").first()
    assert m.inter_breath_interval == pytest.approx(4, rel=0.01) and m.rate == pytest.approx(0.25, rel=0.01)
    assert m.inhale_volume == pytest.approx(10 * 4 / np.pi, rel=0.05) and m.multiphasic_count == 0


def test_find_peaks_by_hand():
    x = np.array([0, 1, 0, 3, 3, 0, 2, 0.5, 2.5, 0])
    assert br.local_maxima(x).tolist() == [1, 3, 6, 8]
    assert br.find_peaks(x, distance=3).tolist() == [3, 8]
    assert br.prominences(x, np.array([1, 3, 6, 8]))[0].tolist() == [1, 3, 1.5, 2.5]
    assert br.find_peaks(x, prominence=1.6).tolist() == [3, 8]


def test_filter_keeps_the_band_and_phase():
    t = np.arange(3000) / 6.0
    b, a = br.butter(4, (0.05 / 3, 0.5 / 3), "band")
    y = br.zero_phase(b, a, [np.sin(2 * np.pi * 0.2 * t) + np.sin(2 * np.pi * 1.5 * t) + 5])[0]
    assert np.abs(y[300:-300] - np.sin(2 * np.pi * 0.2 * t)[300:-300]).max() < 0.02


@pytest.mark.parametrize("bucket", [3600.0, 5.0])
def test_pauses_and_intervals_over_buckets(spark, bucket):
    g = np.random.default_rng(1)
    left = sorted(g.integers(0, 200, 60).tolist())
    right = sorted(g.integers(0, 200, 15).tolist())
    l = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(left)], "g int, i int, t double")
    r = spark.createDataFrame([(1, float(v)) for v in right], "g int, u double")
    got = {x.i: x.next for x in br.next_after(l, r, ["g"], "t", "u", bucket).collect()}
    assert got == {i: min((float(u) for u in right if u > v), default=None) for i, v in enumerate(left)}
    prev = {x.i: x.prev for x in br.with_previous(l, ["g"], "t", "i", bucket).collect()}
    assert prev == {i: (float(left[i - 1]) if i else None) for i in range(len(left))}


def test_cleaning_drops_rejects_and_smooths_outliers(spark):
    good = [math.sin(i / 3) for i in range(120)]
    good[50] = 80.0
    bad = [None] * 80 + [1.0] * 20
    s = frame(spark, good).unionByName(frame(spark, bad, rec=2))
    out, report = sg.clean(s, None)
    assert {(r.recording_id, r.status) for r in report.collect()} == {(1, "ok"), (2, "rejected")}
    got = {r.idx: r.x for r in out.collect()}
    assert len(got) == 120 and got[50] == pytest.approx((good[49] + good[51]) / 2) and got[7] == good[7]
    assert sg.clean(s.limit(0))[0].count() == 0


def test_pipeline_from_windows_to_recordings(spark):
    from breathlake.plans.pipeline import compare_outcome, recording_features

    t = np.arange(600) / 6.0
    rows = [(10 * r + k, r, k, 6.0, (10 * np.sin(2 * np.pi * (0.2 + 0.02 * r) * t + k)).tolist()) for r in range(1, 5) for k in range(2)] + [(99, 9, 0, 6.0, [0.0] * 60)]
    w = spark.createDataFrame(rows, "window_id long, recording_id long, window_index int, sampling_rate double, window_data array<double>")
    f = {r.recording_id: r for r in recording_features(w).collect()}
    assert f[1].n_windows == 2 and f[3].rate_mean == pytest.approx(0.26, rel=0.02) and f[9].rate_mean is None and f[9].multiphasic_count_mean == 0
    df = spark.createDataFrame([(r.recording_id, r.rate_mean, r.recording_id % 2) for r in f.values()], "recording_id long, rate_mean double, y int")
    assert compare_outcome(df, "y", ["rate_mean"]).first().n1 == 2
    with pytest.raises(ValueError):
        compare_outcome(df.filter("y = 1"), "y", ["rate_mean"])


def test_cleaned_windows_of_recordings(spark):
    from breathlake.plans.pipeline import Config, clean_windows

    t = np.arange(600) / 6.0
    x = 10 * np.sin(2 * np.pi * 0.25 * t)
    bad = [None if 100 <= i < 104 else float(v) for i, v in enumerate(x)]
    rows = [(1, 5, 0, 6.0, [float(v) for v in x[:360]]), (2, 5, 300, 6.0, [float(v) for v in x[300:]]), (2, 5, 300, 6.0, [float(v) for v in x[300:]]), (3, 6, 0, 6.0, bad), (4, 7, 0, 6.0, [1.0] * 30), (5, None, 0, 6.0, [1.0] * 300)]
    w = spark.createDataFrame(rows, "window_id long, recording_id long, start_idx long, sampling_rate double, window_data array<double>")
    got = {(r.recording_id, r.window_index): r for r in clean_windows(w, Config(detrend=None)).collect()}
    assert {k for k in got if k[0] == 5} == {(5, i) for i in range(3)} and not any(k[0] in (7, None) for k in got)
    assert len({r.window_id for r in got.values()}) == len(got) and all(len(r.window_data) == 180 for r in got.values())
    assert got[5, 1].window_data == pytest.approx(list(x[144:324])) and got[5, 2].sampling_rate == 6.0
    assert clean_windows(w.limit(0)).count() == 0
    huge = w.withColumn("recording_id", F.lit(1 << 50))
    with pytest.raises(Exception, match="do not fit"):
        clean_windows(huge, Config(detrend=None)).collect()


def test_recordings_are_filtered_in_blocks_as_in_one_piece(spark):
    g = np.random.default_rng(4)
    n, cutoff = 9000, br.Cutoff("band", 0.1, 0.5, 2)
    x = np.cumsum(g.normal(size=n)) / 5 + np.sin(np.arange(n) / 6)
    rows = [(1, i, None if i in (50, 51, 4000) else float(v), 6.0) for i, v in enumerate(x)] + [(2, i, float(i % 3), 6.0) for i in range(10)] + [(3, i, float(i), 0.9) for i in range(200)] + [(4, 0, None, 6.0)]
    s = spark.createDataFrame(rows, "recording_id long, idx long, x double, rate double")
    got = {r: dict((y.idx, y.x) for y in br.filter_samples(s, cutoff, block=2048).filter(f"recording_id = {r}").collect()) for r in (1, 2, 3, 4)}
    b, a = cutoff.design(6.0)
    known = np.array([r[2] is not None for r in rows[:n]])
    want = br.zero_phase(b, a, [np.interp(np.arange(n), np.flatnonzero(known), x[known])])[0]
    assert len(got[1]) == n and all(got[1][i] is None for i in (50, 51, 4000))
    assert max(abs(got[1][i] - want[i]) for i in range(n) if known[i]) < 1e-7
    assert [got[2][i] for i in range(10)] == [float(i % 3) for i in range(10)] and got[3][199] == 199.0 and got[4] == {0: None}  # too short, cut-off beyond Nyquist, no reading
    assert br.filter_samples(s.limit(0), cutoff).count() == 0


def test_signals_filtered_together_are_those_filtered_alone():
    g = np.random.default_rng(1)
    b, a = br.butter(4, (0.05, 0.3), "band")
    xs = [g.normal(size=k) for k in (400, 5, 90, 250)]
    for x, y in zip(xs, br.zero_phase(b, a, xs)):
        assert np.allclose(br.zero_phase(b, a, [x])[0], y, atol=1e-12)


def test_the_chain_may_end_with_a_filter(spark):
    t = np.arange(3000)
    x = np.sin(2 * np.pi * 0.2 * t / 6) + np.sin(2 * np.pi * 2.0 * t / 6)
    s = spark.createDataFrame([(1, int(i), float(v), 6.0) for i, v in zip(t, x)], "recording_id long, idx long, x double, rate double")
    out = {r.idx: r.x for r in sg.clean(s, "constant", cutoff=br.Cutoff("low", high=0.5))[0].collect()}
    assert max(abs(out[i] - np.sin(2 * np.pi * 0.2 * i / 6)) for i in range(300, 2700)) < 0.02
