"""Cutting oversized items at natural boundaries.

Lexical cohesion on signals: the samples are read as words (level and slope),
the words before and after each gap are compared as two blocks, and valleys of
their similarity mark the boundaries between breaths and pauses. Each piece is
cut at the deepest valley within its size window; the next one starts the
overlap earlier.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CutRules:
    """``levels`` x 3 words; ``block_s`` seconds on either side of a gap; no cut before ``least`` of the window."""

    levels: int = 8
    block_s: float = 2.0
    least: float = 0.5
    slack_s: float = 0.01


def words(x: np.ndarray, levels: int) -> np.ndarray:
    """One word per sample: quantile level and slope; -1 where there is no reading."""
    ok = np.isfinite(x)
    out = np.full(len(x), -1)
    if ok.any():
        edges = np.quantile(x[ok], np.linspace(0, 1, levels + 1)[1:-1])
        step = np.diff(np.where(ok, x, 0.0), prepend=x[0] if ok[0] else 0.0)
        still = 0.02 * (np.quantile(x[ok], 0.9) - np.quantile(x[ok], 0.1))
        slope = np.where(step > still, 2, np.where(step < -still, 0, 1))
        level = np.searchsorted(edges, np.where(ok, x, 0.0), side="right")
        out[ok] = (level * 3 + slope)[ok]
    return out


#: Gaps compared at once, so that the counts of words take the same memory for an item of any length.
CHUNK = 1 << 14


def cohesion(w: np.ndarray, vocabulary: int, block: int) -> np.ndarray:
    """Cosine of the word counts of the ``block`` samples before and after each gap 1..n-1."""
    n = len(w)
    out = np.zeros(max(0, n - 1))
    for first in range(1, n, CHUNK):
        g = np.arange(first, min(first + CHUNK, n))
        lo, hi = max(0, first - block), min(n, int(g[-1]) + block)
        part = w[lo:hi]
        hot = np.zeros((len(part) + 1, vocabulary), np.int32)
        seen = np.flatnonzero(part >= 0)
        hot[seen + 1, part[seen]] = 1
        c = np.cumsum(hot, axis=0, dtype=np.int32)
        left = (c[g - lo] - c[np.maximum(g - block, 0) - lo]).astype(float)
        right = (c[np.minimum(g + block, n) - lo] - c[g - lo]).astype(float)
        norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
        out[g - 1] = np.divide((left * right).sum(1), norm, out=np.zeros(len(g)), where=norm > 0)
    return out


def depths(sim: np.ndarray) -> np.ndarray:
    """Valley depth of each gap: the climb to the nearest peak on either side, 0 off the minima."""
    n = len(sim)
    out = np.zeros(n)
    if n < 3:
        return out
    d = np.diff(sim)
    up = np.flatnonzero(np.r_[d < 0, True])  # no longer rising to the right
    peak_right = sim[up[np.searchsorted(up, np.arange(n))]]
    down = np.flatnonzero(np.r_[True, d > 0])  # no longer rising to the left
    peak_left = sim[down[np.searchsorted(down, np.arange(n), side="right") - 1]]
    low = np.r_[False, (sim[1:-1] <= sim[:-2]) & (sim[1:-1] <= sim[2:]), False]
    out[low] = (peak_left + peak_right - 2 * sim)[low]
    return out


def cut_points(x: np.ndarray, n: int, size: int, overlap: int, rate: float, rules: CutRules) -> list[tuple[int, int, str]]:
    """Pieces ``[start, end)`` of ``n`` samples, at most ``size`` long, and how each ends.

    A cut is tried at the deepest valley that lies at a crossing of the median
    or where the signal rests; else at the deepest valley; else at the limit.
    """
    depth, calm = np.zeros(n + 1), np.zeros(n + 1, bool)
    if len(x) >= 3:
        m = min(len(x), n)
        depth[1:m] = depths(cohesion(words(x[:m], rules.levels), rules.levels * 3, max(1, int(rules.block_s * rate))))
        with np.errstate(invalid="ignore"):
            y = x[:m] - np.nanmedian(x[:m]) if np.isfinite(x[:m]).any() else x[:m]
            rest = 0.05 * np.nanmedian(np.abs(y)) if np.isfinite(y).any() else 0.0
            calm[1:m] = (np.sign(y[1:]) != np.sign(y[:-1])) | (np.abs(np.diff(y)) <= rest) | ~np.isfinite(y[1:])
    pieces, s = [], 0
    while n - s > size:
        a, b = s + max(overlap + 1, int(rules.least * size)), s + size
        gaps = np.arange(min(a, b), b + 1)
        score = depth[gaps] + calm[gaps] * (depth[gaps] > 0)
        k = int(len(score) - 1 - np.argmax(score[::-1]))  # the last of equal ones
        e, how = (int(gaps[k]), "boundary" if calm[gaps[k]] else "valley") if score[k] > 0 else (b, "limit")
        pieces.append((s, e, how))
        s = e - overlap
    pieces.append((s, n, "end"))
    return pieces


_SCHEMA = "window_id bigint, piece int, pieces int, start_idx bigint, end_idx bigint, start_time double, end_time double, cut string, piece_data array<double>"
_ARROW = pa.schema([("window_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("start_idx", pa.int64()), ("end_idx", pa.int64()), ("start_time", pa.float64()), ("end_time", pa.float64()), ("cut", pa.string()), ("piece_data", pa.list_(pa.float64()))])


def _cutter(rules: CutRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _ARROW]
            for r in range(batch.num_rows):
                g = {c: batch.column(i)[r] for i, c in enumerate(batch.schema.names)}
                raw = g["window_data"].values
                x = raw.to_numpy(zero_copy_only=False).astype(float) if raw is not None else np.zeros(0)
                rate, start, n = g["sampling_rate"].as_py(), g["start_idx"].as_py() or 0, max(1, round(g["seconds"].as_py() * g["sampling_rate"].as_py()))
                size, overlap = int(g["window_size"].as_py() * rate + 1e-6), round(g["overlap"].as_py() * rate)
                pieces = cut_points(x, n, max(1, size), min(overlap, max(0, size - 1)), rate, rules)
                for k, (a, b, how) in enumerate(pieces):
                    data = pa.array(x[a:b], from_pandas=True) if raw is not None else None
                    for col, v in zip(out, (g["window_id"].as_py(), k, len(pieces), start + a, start + b, (start + a) / rate, (start + b) / rate, how, data)):
                        col.append(v)
            pieces = out[-1]
            ends = np.cumsum([0, *(0 if v is None else len(v) for v in pieces)])
            values = pa.concat_arrays([pa.array([], pa.float64()), *(v for v in pieces if v is not None)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([v is None for v in pieces], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*[pa.array(v, type=f.type) for v, f in zip(out[:-1], _ARROW)], lists], schema=_ARROW)

    return run


def cut_windows(windows: DataFrame, configs: DataFrame, rules: CutRules = CutRules()) -> DataFrame:
    """Pieces of the windows that are longer than their configuration allows.

    A window's length is ``end_time - start_time``, or samples over rate where
    ``end_time`` is null. Only windows longer than ``window_size`` by more than
    ``rules.slack_s`` are cut; every piece is at most ``window_size`` long and
    starts the configured overlap before the end of the one before. Repeated
    windows count once. A window whose configuration is missing or unusable (no
    size, size not above overlap), whose length is unknown, or without a
    positive rate is not cut. Missing samples still take up time. ``configs`` must have one row per
    ``config_id``; it is broadcast only while Spark's size limit allows.
    """
    c = configs.dropDuplicates(["config_id"]).select("config_id", "window_size", F.coalesce("overlap", F.lit(0.0)).alias("overlap")).filter("window_size > 0 and overlap >= 0 and overlap < window_size")
    seconds = F.coalesce(F.col("end_time") - F.col("start_time"), F.when(F.col("sampling_rate") > 0, F.size("window_data") / F.col("sampling_rate")))
    w = windows.select("window_id", "config_id", "start_idx", "sampling_rate", F.col("window_data").cast("array<double>").alias("window_data"), seconds.alias("seconds"))
    w = w.join(c, "config_id").filter((F.col("seconds") > F.col("window_size") + rules.slack_s) & (F.col("sampling_rate") > 0)).drop("config_id")
    w = w.dropDuplicates(["window_id"])  # after the filter: few are left
    return w.mapInArrow(_cutter(rules), _SCHEMA)
