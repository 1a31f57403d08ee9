"""Samples are many times what Spark takes them for, so no join may broadcast them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathlake.operators import breaths as br
from breathlake.operators import quantiles as qt
from breathlake.operators import signal as sg

#: Columns that only frames of one row a sample have.
SAMPLES = {"idx", "x", "_x", "_i", "_v", "a", "b"}


@pytest.fixture
def samples(spark, tmp_path):
    """Of windows in a file whose size is far below the default limit for broadcasts."""
    g = np.random.default_rng(3)
    rows = [(r * 10 + k, r, k * 24, 6.0, [float(v) for v in g.normal(size=30)]) for r in range(3) for k in range(4)]
    spark.createDataFrame(rows, "window_id long, recording_id long, start_idx long, sampling_rate double, window_data array<double>").write.parquet(str(tmp_path / "w"))
    return sg.samples_from_windows(spark.read.parquet(str(tmp_path / "w")))


def broadcast(df) -> list[set[str]]:
    """Columns of each side that the plan broadcasts before anything has run."""
    out = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        if node.nodeName() == "BroadcastExchange":
            out.append({node.output().apply(i).name() for i in range(node.output().size())})
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_detrend_broadcasts_no_samples(spark, samples):
    got = sg.detrend(samples).select("recording_id", "idx", "x")
    assert not any(c & SAMPLES for c in broadcast(got))
    assert got.count() == 3 * 102


@pytest.mark.parametrize("small", [1_000_000, 10])
def test_outliers_broadcast_no_samples(spark, samples, monkeypatch, small):
    monkeypatch.setattr(qt, "SMALL", small)
    got = sg.outlier_runs(samples, 2.0)
    assert not any(c & SAMPLES for c in broadcast(got))
    assert got.count() > 0


def test_brackets_are_joined_by_merge_where_groups_are_many_or_unknown(spark, samples):
    d = samples.select("recording_id", F.col("x").alias("_v"))
    assert not any(c & {"_v"} for c in broadcast(qt.bracketed_quantiles(d, ["recording_id"], [0.5])))
    assert any(c & {"_cuts"} for c in broadcast(qt.bracketed_quantiles(d, ["recording_id"], [0.5], groups=3)))


def test_repair_broadcasts_no_samples(spark, samples):
    runs = spark.createDataFrame([(0, 3, 5), (1, 100, 102), (2, 10, 90)], "recording_id long, start_idx long, end_idx long")
    got = sg.repair(samples, runs, 2.0)
    assert not any(c & SAMPLES for df in (got, got.filter("repaired")) for c in broadcast(df))
    assert {(r.recording_id, r.mode): r.n for r in got.filter("repaired").groupBy("recording_id", F.when(F.col("x").isNull(), "drop").otherwise("line").alias("mode")).agg(F.count("*").alias("n")).collect()} == {(0, "line"): 2, (2, "drop"): 80}


def test_issues_broadcast_no_samples(spark, samples):
    issues = sg.all_issues(samples)
    assert not any(c & {*SAMPLES, "y", "w"} for df in (issues, sg.flat_runs(samples), sg.quality_report(samples, issues)) for c in broadcast(df))


def test_cleaning_broadcasts_no_samples(spark, samples):
    for df in (sg.remove_outliers(samples, 1.0), sg.fill_missing(samples), sg.clean(samples)[0]):
        assert not any(c & {*SAMPLES, "_p"} for d in (df, df.filter("replaced") if "replaced" in df.columns else df.select("recording_id", "idx", "x")) for c in broadcast(d))
    assert df.count() == 3 * 102


def test_filtered_cleaning_broadcasts_no_samples(spark, samples, monkeypatch):
    seen, cut = [], sg.cut
    monkeypatch.setattr(sg, "cut", lambda df: (seen.append(broadcast(df)), cut(df))[1])  # as each stage is planned
    df = sg.clean(samples, cutoff=br.Cutoff())[0]
    assert len(seen) > 5 and not any(c & {*SAMPLES, "_p", "y", "w"} for sides in [*seen, broadcast(df)] for c in sides)


def test_metrics_broadcast_no_breaths(spark, tmp_path):
    w = spark.range(2).selectExpr("id as window_id", "id as recording_id", "6.0D as sampling_rate", "transform(sequence(0, 599), i -> sin(i / 4.0D)) as window_data")
    w.write.parquet(str(tmp_path / "w"))
    got = br.metrics(br.window_breaths(spark.read.parquet(str(tmp_path / "w"))), ["window_id"], "peak_location")
    assert not any(c & {"volume", "start_time", "_t", "pause"} or c & {"ibi", "ibi_sd"} == {"ibi"} for c in broadcast(got))  # with ibi_sd it is a group's
    assert got.filter("inhale_volume > 0").count() == 2
