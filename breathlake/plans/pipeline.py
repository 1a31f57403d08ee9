"""Recordings to features, statistics and models by composing the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathlake.functions.metrics import METRICS
from breathlake.operators import batches as bt
from breathlake.operators import breaths as br
from breathlake.operators import features as ft
from breathlake.operators import signal as sg
from breathlake.operators import stats
from breathlake.session import cut


@dataclass(frozen=True)
class Config:
    """Parameters of the stages; ``functions`` are applied to each metric."""

    peaks: br.PeakRules = field(default_factory=br.PeakRules)
    functions: tuple[str, ...] = ("mean", "std", "min", "max", "median")
    min_windows: int = 1
    test: str = "mannwhitney"
    correction: str = "fdr_bh"
    alpha: float = 0.05
    size_s: float = 30.0
    overlap_s: float = 6.0
    detrend: str | None = "linear"


#: Bits of a window's id that hold its place in the recording: 16 million windows.
PLACE_BITS = 24


def clean_windows(windows: DataFrame, config: Config = Config(), whole: int = bt.WHOLE) -> DataFrame:
    """Windows of ``config`` cut from the cleaned recordings, as ``window_id, recording_id, window_index, sampling_rate, window_data``.

    Recordings that cleaning rejects have none, and windows that are not full
    drop out. An index beyond the id's bits, or a recording whose id leaves no
    room for them, is an error. A recording of at most ``whole`` samples and one rate
    is cleaned in one piece, others sample by sample; both give the same windows.
    """
    w = windows.withColumn("d", F.col("window_data").cast("array<double>")).select("recording_id", "window_id", "start_idx", F.col("sampling_rate").cast("double").alias("rate"), "d").dropna()
    per = w.groupBy("recording_id").agg(F.sum(F.size("d").cast("bigint")).alias("n"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    plain = (F.col("n") <= whole) & (F.col("low") == F.col("high")) & (F.col("low") > 0) & (F.col("high") < float("inf"))
    rest = cut(per.filter(~plain).select("recording_id"))
    if rest.isEmpty():
        return bt.cut_recordings(w, config.size_s, config.overlap_s, config.detrend, PLACE_BITS)
    found = bt.cut_recordings(w.join(rest, "recording_id", "left_anti"), config.size_s, config.overlap_s, config.detrend, PLACE_BITS)
    return found.unionByName(_clean_by_sample(windows.join(rest, "recording_id", "left_semi"), config))


def _clean_by_sample(windows: DataFrame, config: Config) -> DataFrame:
    """``clean_windows`` with a row for each sample, for recordings of any length."""
    samples = sg.clean(sg.samples_from_windows(windows), config.detrend)[0]
    e = sg.sliding_windows(samples, config.size_s, config.overlap_s)
    g = e.groupBy("recording_id", "window_index").agg(F.max("w").alias("w"), F.max("rate").alias("sampling_rate"), F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("d")).filter(F.size("d") == F.col("w"))
    place = F.shiftleft(F.col("recording_id").cast("bigint"), PLACE_BITS)
    fits = (F.col("window_index") < 1 << PLACE_BITS) & (F.shiftright(place, PLACE_BITS) == F.col("recording_id"))
    ident = F.when(fits, place + F.col("window_index")).otherwise(F.raise_error(F.lit("window ids do not fit")).cast("bigint"))
    return g.select(ident.alias("window_id"), "recording_id", "window_index", "sampling_rate", F.transform("d", lambda p: p["x"]).alias("window_data"))


def window_features(windows: DataFrame, config: Config = Config(), unique: bool = False) -> DataFrame:
    """The 35 metrics of each window, NULL or 0 where it has no breaths of both phases. ``unique``: no window comes twice."""
    return bt.window_metrics(windows if unique else windows.dropDuplicates(["window_id"]), config.peaks)


def recording_features(windows: DataFrame, config: Config = Config(), unique: bool = False) -> DataFrame:
    """One row per recording: each metric by each function; the window's time is no feature. Windows' metrics are materialised."""
    m = cut(window_features(windows, config, unique))
    largest = m.groupBy("recording_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= bt.MOST_WINDOWS and set(config.functions) <= set(bt.FUNCTIONS):
        return bt.recordings_of(m, list(METRICS), config.functions).filter(F.col("n_windows") >= config.min_windows)
    return ft.aggregate_windows(m, ["recording_id"], list(METRICS), list(config.functions), min_windows=config.min_windows)


def compare_outcome(features: DataFrame, outcome: str, names: list[str], config: Config = Config(), whole: int = stats.WHOLE_ROWS) -> DataFrame:
    """Group comparison of all features for one outcome; rows without outcome are left out.

    Two values compare by the configured test, more by its counterpart for
    several groups; fewer are an error. Mann-Whitney ranks a feature in one task
    while there are at most ``whole`` rows, with the same results.
    """
    rows = features.filter(F.col(outcome).isNotNull())
    sizes = rows.groupBy(outcome).count().orderBy(outcome).limit(3).collect()
    labels = [r[0] for r in sizes]
    if len(labels) < 2:
        raise ValueError(f"{outcome} has fewer than two groups")
    if len(labels) == 2 and config.test == "mannwhitney" and sizes[0][1] + sizes[1][1] <= whole:
        return stats.compare_binary_whole(rows, names, outcome, *labels, correction=config.correction)
    long = ft.melt(rows.withColumn("label", F.col(outcome)), ["label"], names)
    if len(labels) == 2:
        return stats.compare_binary(long, *labels, test=config.test, correction=config.correction)
    return stats.compare_multi(long, config.test == "ttest", config.correction)
