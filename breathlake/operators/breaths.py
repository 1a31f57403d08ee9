"""Breaths: peak kernels on windows, pauses, and the per-window metrics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of breathing that one task orders at a time.
BUCKET_S = 3600.0


# --- kernels on one window's samples -------------------------------------------------


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Centres of plateaus that rise before and fall after."""
    if len(x) < 3:
        return np.zeros(0, int)
    d = np.diff(x)
    turn = np.flatnonzero(d != 0)
    if len(turn) < 2:
        return np.zeros(0, int)
    up = (d[turn[:-1]] > 0) & (d[turn[1:]] < 0)
    return (turn[:-1][up] + 1 + turn[1:][up]) // 2


def prominences(x: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Height over the higher of the two surrounding minima, and where those minima lie."""
    prom, left, right = np.zeros(len(peaks)), np.zeros(len(peaks), int), np.zeros(len(peaks), int)
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(x[:p] > x[p])
        a = higher[-1] + 1 if len(higher) else 0
        higher = np.flatnonzero(x[p + 1:] > x[p])
        b = p + 1 + higher[0] if len(higher) else len(x)
        seg_l, seg_r = x[a: p + 1], x[p:b]
        left[k] = a + len(seg_l) - 1 - np.argmin(seg_l[::-1])
        right[k] = p + np.argmin(seg_r)
        prom[k] = x[p] - max(x[left[k]], x[right[k]])
    return prom, left, right


def half_widths(x: np.ndarray, peaks: np.ndarray, prom: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Width at half prominence, with interpolated crossings."""
    out = np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        level = x[p] - prom[k] / 2
        i = p
        while i > left[k] and x[i] > level:
            i -= 1
        a = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i)
        j = p
        while j < right[k] and x[j] > level:
            j += 1
        b = j - (level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else float(j)
        out[k] = b - a
    return out


def spaced(x: np.ndarray, peaks: np.ndarray, distance: int) -> np.ndarray:
    """Peaks kept so that any two lie at least ``distance`` apart, higher ones first."""
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            keep[near] = False
    return peaks[keep]


def find_peaks(x: np.ndarray, distance: int = 1, prominence: float | None = None, width: float | None = None) -> np.ndarray:
    peaks = spaced(x, local_maxima(x), distance) if distance > 1 else local_maxima(x)
    if prominence is None and width is None:
        return peaks
    prom, left, right = prominences(x, peaks)
    ok = np.ones(len(peaks), bool)
    if prominence is not None:
        ok &= prom >= prominence
    if width is not None:
        ok &= half_widths(x, peaks, prom, left, right) >= width
    return peaks[ok]


@dataclass(frozen=True)
class PeakRules:
    """Defaults of the reference data model: seconds, or shares of the main peak."""

    min_distance_s: float = 2.0
    min_width_s: float = 0.4
    min_prominence: float = 0.01
    percentile: float = 90.0
    multiplier: float = 0.01
    min_duration_s: float = 0.25
    volume_threshold: float = 0.0
    upsample: int = 4
    sub_prominence: float = 0.1
    sub_ratio: float = 0.2
    sub_distance_s: float = 0.3


def breaths_of(x: np.ndarray, rate: float, r: PeakRules = PeakRules()) -> list[dict]:
    """Breaths of one window: segments of one sign with their main and secondary peaks."""
    if len(x) < 3:
        return []
    gap = max(1, int(r.min_distance_s * rate - 1))
    inhale, exhale = (find_peaks(s * x, gap, r.min_prominence, r.min_width_s * rate) for s in (1, -1))
    if len(inhale):
        v = x[inhale]
        top = v[v >= np.percentile(v, r.percentile)]
        least = r.multiplier * np.median(top)
        inhale = inhale[v > least]
        exhale = exhale[x[exhale] < -least]
    n, up = len(x), r.upsample
    fine = np.interp(np.linspace(0, n - 1, n * up), np.arange(n), x)
    sign = np.where(fine > r.volume_threshold, 1, np.where(fine < -r.volume_threshold, -1, 0))
    edge = np.flatnonzero(np.r_[True, np.diff(sign) != 0])
    segment = np.searchsorted(edge, np.arange(len(fine)), side="right") - 1
    stop = np.r_[edge[1:], len(fine)] - 1
    groups: dict[int, list[int]] = {}
    for p in np.sort(np.concatenate([inhale, exhale])):
        k = int(segment[min(int(p * up), len(fine) - 1)])
        if sign[edge[k]]:
            groups.setdefault(k, []).append(int(p))
    out = []
    for k, peaks in sorted(groups.items()):
        a, b = int(edge[k] / up), min(int(stop[k] / up), n - 1)
        main = peaks[int(np.argmax(np.abs(x[peaks])))]
        value = x[main]
        seg = x[a: b + 1]
        sub: list[int] = []
        if len(seg) >= 3:
            local = find_peaks(seg if value > 0 else -seg, max(1, int(r.sub_distance_s * rate)), r.sub_prominence * abs(value)) + a
            every = sorted({*local.tolist(), *(p for p in peaks if a <= p <= b)})
            sub = [p for p in every if p == main or (abs(x[p]) / abs(value) if value else 0.0) >= r.sub_ratio]
        many = len(sub) > 1
        out.append({
            "peak_location": main, "peak_value": float(value), "volume": float(np.trapezoid(seg) / rate), "duration": (b - a) / rate, "start_time": a / rate,
            "latency": (main - a) / rate, "number_of_peaks": len(sub), "sub_peaks": sub,
            "intervals": [float(q - p) / rate for p, q in zip(sub, sub[1:])] if many else [],
            "ratios": [float(abs(x[p]) / abs(value)) for p in sub if p != main] if many else [],
        })
    out = [b for b in out if b["duration"] >= r.min_duration_s]
    if out:
        mid = float(np.median([abs(b["volume"]) for b in out]))
        out = [b for b in out if abs(b["volume"]) > r.volume_threshold * mid]
    return out


def butter(order: int, cut: tuple[float, ...], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth filter by the bilinear transform; cut-offs as shares of the Nyquist rate."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warped = 4 * np.tan(np.pi * np.asarray(cut) / 2)
    if kind == "band":
        width, mid = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - mid**2 + 0j)
        poles, zeros, gain = np.r_[half + root, half - root], np.zeros(order), width**order
    elif kind == "low":
        poles, zeros, gain = poles * warped[0], np.zeros(0), warped[0] ** order
    elif kind == "high":
        gain = np.real(1 / np.prod(-poles))
        poles, zeros = warped[0] / poles, np.zeros(order)
    else:
        raise ValueError(f"unknown filter {kind}")
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    dz = np.r_[(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))]
    dp = (4 + poles) / (4 - poles)
    return gain * np.real(np.poly(dz)), np.real(np.poly(dp))


def zero_phase(b: np.ndarray, a: np.ndarray, signals: list[np.ndarray]) -> list[np.ndarray]:
    """Forward and backward filtering of many signals at once, with odd extension at both ends.

    Signals too short for the extension come back as they are.
    """
    n = max(len(a), len(b))
    pad = 3 * n
    at = [i for i, x in enumerate(signals) if len(x) > pad]
    out = list(signals)
    if not at:
        return out
    m = np.zeros((n - 1, n - 1))
    m[:, 0] = -a[1:]
    m[:-1, 1:] = np.eye(n - 2)
    steady = np.linalg.solve(np.eye(n - 1) - m, b[1:] - a[1:] * b[0])

    def forward(rows: list[np.ndarray]) -> list[np.ndarray]:
        x = np.zeros((max(map(len, rows)), len(rows)))
        for j, r in enumerate(rows):
            x[: len(r), j] = r
        y, z = np.empty_like(x), np.vstack([steady[:, None] * x[0], np.zeros(len(rows))])
        for t, v in enumerate(x):  # one step for all signals
            y[t] = o = b[0] * v + z[0]
            z[:-1] = z[1:] + b[1:, None] * v - a[1:, None] * o
        return [y[: len(r), j] for j, r in enumerate(rows)]

    e = [np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2: -pad - 2: -1]] for x in (signals[i] for i in at)]
    back = forward([y[::-1] for y in forward(e)])
    for i, y in zip(at, back):
        out[i] = y[::-1][pad:-pad]
    return out


@dataclass(frozen=True)
class Cutoff:
    """A Butterworth filter: ``band`` between ``low`` and ``high`` Hz, ``low`` below ``high``, or ``high`` above ``low``."""

    kind: str = "band"
    low: float = 0.05
    high: float = 0.5
    order: int = 4

    def edges(self) -> tuple[float, ...]:
        return {"band": (self.low, self.high), "low": (self.high,), "high": (self.low,)}[self.kind]

    def fits(self, rate: float | None) -> bool:
        """Whether the cut-offs lie below the Nyquist rate."""
        return bool(rate) and self.edges()[-1] < rate / 2

    def design(self, rate: float) -> tuple[np.ndarray, np.ndarray]:
        return butter(self.order, tuple(2 * e / rate for e in self.edges()), self.kind)

    def settles(self) -> float:
        """Seconds after which a past sample counts for less than 1e-11."""
        rate = 40 * self.edges()[-1]
        return float(25 / (-np.log(np.abs(np.roots(self.design(rate)[1])).max()) * rate))


def _filtered(cutoff: Cutoff, rates: list[float | None], signals: list[np.ndarray | None]) -> list[np.ndarray | None]:
    """Each signal filtered at its rate; as it is where the filter does not fit."""
    out = list(signals)
    for rate in {r for r in rates if cutoff.fits(r)}:
        at = [i for i, r in enumerate(rates) if r == rate and signals[i] is not None]
        for i, y in zip(at, zero_phase(*cutoff.design(rate), [signals[i] for i in at])):
            out[i] = y
    return out


# --- operators on windows ----------------------------------------------------------


def _clean(raw: pa.Scalar) -> np.ndarray | None:
    """Samples with gaps bridged; None where there is no reading at all."""
    if raw.values is None:
        return None
    return _bridged(raw.values.to_numpy(zero_copy_only=False).astype(float))


def _bridged(x: np.ndarray) -> np.ndarray | None:
    ok = np.isfinite(x)
    if not ok.any():
        return None
    return np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok])


_BREATH = "window_id bigint, recording_id bigint, phase string, peak_location int, peak_value double, volume double, duration double, start_time double, latency double, number_of_peaks int, intervals array<double>, ratios array<double>"
_BREATH_ARROW = pa.schema([("window_id", pa.int64()), ("recording_id", pa.int64()), ("phase", pa.string()), ("peak_location", pa.int32()), ("peak_value", pa.float64()), ("volume", pa.float64()), ("duration", pa.float64()), ("start_time", pa.float64()), ("latency", pa.float64()), ("number_of_peaks", pa.int32()), ("intervals", pa.list_(pa.float64())), ("ratios", pa.list_(pa.float64()))])


def window_breaths(windows: DataFrame, rules: PeakRules = PeakRules()) -> DataFrame:
    """Breaths of each window (exact peak rules), one row each.

    Windows count once; gaps are bridged by straight lines first. A window
    without readings or a positive rate has no breaths. No shuffle but for the
    repeated windows.
    """
    w = windows.select("window_id", "recording_id", "sampling_rate", F.col("window_data").cast("array<double>").alias("d")).dropDuplicates(["window_id"]).filter("sampling_rate > 0 and d is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                x = _clean(batch.column(3)[i])
                if x is None:
                    continue
                ids = {"window_id": batch.column(0)[i].as_py(), "recording_id": batch.column(1)[i].as_py()}
                for b in breaths_of(x, batch.column(2)[i].as_py(), rules):
                    b.pop("sub_peaks")
                    rows.append(ids | {"phase": "inhale" if b["peak_value"] > 0 else "exhale"} | b)
            yield pa.RecordBatch.from_pylist(rows, schema=_BREATH_ARROW)

    return w.mapInArrow(run, _BREATH)


def filter_windows(windows: DataFrame, kind: str = "band", low: float = 0.05, high: float = 0.5, order: int = 4) -> DataFrame:
    """Zero-phase Butterworth filter of each window's samples.

    A window comes back as it is where the cut-off reaches the Nyquist rate or
    it is too short for the padding. Missing samples stay missing; the filter
    runs over the bridged signal.
    """
    w = windows.select("window_id", "recording_id", "sampling_rate", F.col("window_data").cast("array<double>").alias("d")).dropDuplicates(["window_id"])
    schema = pa.schema([("window_id", pa.int64()), ("recording_id", pa.int64()), ("sampling_rate", pa.float64()), ("filtered", pa.list_(pa.float64()))])
    cutoff = Cutoff(kind, low, high, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates, bridged, out = batch.column(2).to_pylist(), [_clean(x) for x in batch.column(3)], []
            done = _filtered(cutoff, rates, bridged)
            for raw, x, y in zip(batch.column(3), bridged, done):
                if y is None or y is x:  # no reading, or no filter
                    out.append(raw.as_py())
                else:
                    out.append(pa.array(y, mask=~np.isfinite(raw.values.to_numpy(zero_copy_only=False).astype(float))).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64()))], schema=schema)

    return w.mapInArrow(run, "window_id bigint, recording_id bigint, sampling_rate double, filtered array<double>")


def filter_samples(samples: DataFrame, cutoff: Cutoff = Cutoff(), block: int = 16384) -> DataFrame:
    """``recording_id, idx, x, rate`` with each recording filtered as one signal, however long.

    A recording is filtered in blocks of samples that overlap for as long as the
    filter remembers (``Cutoff.settles``), so no task holds more than a block and
    its surroundings. Missing samples stay missing and are bridged within the
    block. A recording comes back as it is where the filter does not fit its rate or
    it is too short. Samples are unique by recording and index, and those without
    a row in between count as neighbours.
    """
    around = F.ceil(F.lit(cutoff.settles()) * F.coalesce("rate", F.lit(0.0)))
    s = samples.select("recording_id", F.col("idx").cast("bigint").alias("idx"), F.col("x").cast("double").alias("x"), F.col("rate").cast("double").alias("rate"))
    first, last = (F.floor((F.col("idx") + d) / block).cast("bigint") for d in (-around, around))
    s = s.withColumn("_b", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    g = s.groupBy("recording_id", "_b").agg(F.max("rate").alias("rate"), F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("s")).filter(F.exists("s", lambda v: F.floor(v["idx"] / block) == F.col("_b")))
    schema = pa.schema([("recording_id", pa.int64()), ("idx", pa.int64()), ("x", pa.float64()), ("rate", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates, rows = batch.column("rate").to_pylist(), [v.values for v in batch.column("s")]
            signals = [_bridged(v.field("x").to_numpy(zero_copy_only=False).astype(float)) for v in rows]
            done = _filtered(cutoff, rates, signals)
            for rec, at, rate, v, y in zip(batch.column("recording_id").to_pylist(), batch.column("_b").to_pylist(), rates, rows, done):
                idx, x = v.field("idx").to_numpy(), v.field("x").to_numpy(zero_copy_only=False).astype(float)
                own = idx // block == at
                y, k = x if y is None else y, int(own.sum())
                yield pa.RecordBatch.from_arrays([pa.array([rec] * k, pa.int64()), pa.array(idx[own]), pa.array(y[own], mask=~np.isfinite(x[own])), pa.array([rate] * k, pa.float64())], schema=schema)

    return g.select("recording_id", "_b", "rate", "s").mapInArrow(run, "recording_id bigint, idx bigint, x double, rate double")


# --- pauses and metrics, on Catalyst alone ----------------------------------------------


def with_previous(df: DataFrame, by: list[str], time: str, tie: str, bucket_s: float = BUCKET_S) -> DataFrame:
    """``prev``: the time of the row before, in time buckets with one row a bucket carried over."""
    d = df.withColumn("_b", F.floor(F.col(time) / bucket_s))
    last = d.groupBy(*by, "_b").agg(F.max(time).alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*by).orderBy("_b"))).drop("_last")
    w = Window.partitionBy(*by, "_b").orderBy(time, tie)
    return d.join(last.hint("shuffle_hash"), [*by, "_b"]).withColumn("prev", F.coalesce(F.lag(time).over(w), "_carry")).drop("_b", "_carry")


def next_after(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, bucket_s: float = BUCKET_S) -> DataFrame:
    """As-of join forwards: ``next`` is the earliest right time strictly after the left one, or NULL.

    Both sides lie on one timeline in time buckets; where a bucket has no later
    right row, the first one of the next bucket that has any is carried in.
    """
    right = right.select(*by, F.col(right_time).cast("double").alias("_t"))
    l = left.withColumn("_t", F.col(left_time).cast("double")).withColumn("_b", F.floor(F.col("_t") / bucket_s)).filter("_t is not null")
    r = right.filter("_t is not null").withColumn("_b", F.floor(F.col("_t") / bucket_s))
    first = r.groupBy(*by, "_b").agg(F.min("_t").alias("_first")).unionByName(l.select(*by, "_b").distinct(), allowMissingColumns=True).groupBy(*by, "_b").agg(F.min("_first").alias("_first"))
    back = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(*by, "_b", F.last("_first", True).over(back).alias("_carry"))
    # equal times: the left row comes after the right one, so that it does not match
    both = l.withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    down = Window.partitionBy(*by, "_b").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("_side") == 0, F.col("_t")), True).over(down)
    out = both.withColumn("next", nxt).filter("_side = 1").join(first.hint("shuffle_hash"), [*by, "_b"], "left")
    return out.withColumn("next", F.coalesce("next", "_carry")).drop("_t", "_b", "_side", "_carry")


def _within(value: Column, mean: Column, sd: Column, k: float) -> Column:
    """The 3-sigma rule: everything stays where the deviation is 0."""
    return (sd == 0) | (F.abs(value - mean) <= k * sd)


def pauses(breaths: DataFrame, by: list[str], min_s: float = 0.05) -> DataFrame:
    """Pauses after inhales and exhales: time from a breath's end to the next one of the other phase."""
    b = breaths.withColumn("end_time", F.col("start_time") + F.col("duration"))
    out = None
    for phase, other in (("inhale", "exhale"), ("exhale", "inhale")):
        p = next_after(b.filter(F.col("phase") == phase), b.filter(F.col("phase") == other), by, "end_time", "start_time")
        p = p.select(*by, F.lit(phase).alias("phase"), (F.col("next") - F.col("end_time")).alias("pause")).filter(F.col("pause") >= min_s)
        out = p if out is None else out.unionByName(p)
    return out


def metrics(breaths: DataFrame, by: list[str], tie: str, k: float = 3.0, min_pause_s: float = 0.05) -> DataFrame:
    """Breathing metrics of each group, in the reference data model's names (lower case).

    ``breaths`` needs ``phase, peak_value, volume, duration, start_time,
    number_of_peaks`` and, for the last four metrics, ``intervals`` and
    ``ratios``. Means are taken of what lies within ``k`` population deviations;
    exhale values and volumes count as absolute. Groups without inhales or
    without exhales have NULL metrics and 0 multi-peak ones. Rates are per second.
    """
    b = breaths.filter("phase in ('inhale', 'exhale')")
    size = lambda c: F.when(F.col("phase") == "exhale", F.abs(c)).otherwise(F.col(c))
    b = b.withColumn("peak_value", size("peak_value")).withColumn("volume", size("volume"))
    fields = ("volume", "duration", "peak_value")
    phases = ("inhale", "exhale")
    m = b.groupBy(*by, "phase").agg(*[f(c).alias(f"{n}_{c}") for c in fields for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    # groups are hashed, as Spark sizes breaths by the windows they were found in, and would broadcast them
    c = b.join(m.hint("shuffle_hash"), [*by, "phase"])
    kept = {f: F.when(_within(F.col(f), F.col(f"m_{f}"), F.col(f"s_{f}"), k), F.col(f)) for f in fields}
    of = lambda p, x: F.when(F.col("phase") == p, x)
    many = F.col("number_of_peaks") > 1
    aggs = [F.avg(of(p, kept[f])).alias(f"{p}_{f}") for p in phases for f in fields]
    aggs += [F.stddev_pop(of(p, kept[f])).alias(f"{p}_{f}_sd") for p in phases for f in ("volume", "duration")]
    aggs += [F.count(of(p, F.lit(1))).alias(f"n_{p}") for p in phases]
    aggs += [F.count(of(p, F.when(many, 1))).alias(f"multi_{p}") for p in phases]
    aggs += [F.avg("number_of_peaks").alias("peaks_mean"), F.max("number_of_peaks").alias("peaks_max")]
    g = c.groupBy(*by).agg(*aggs)
    ibi = with_previous(b.filter("phase = 'inhale'"), by, "start_time", tie).select(*by, (F.col("start_time") - F.col("prev")).alias("ibi")).filter("ibi is not null")
    im = ibi.groupBy(*by).agg(F.avg("ibi").alias("m"), F.stddev_pop("ibi").alias("s"))
    ibi = ibi.join(im.hint("shuffle_hash"), by).filter(_within(F.col("ibi"), F.col("m"), F.col("s"), k)).groupBy(*by).agg(F.avg("ibi").alias("ibi"), F.stddev_pop("ibi").alias("ibi_sd"))
    p = pauses(b, by, min_pause_s)
    pm = p.groupBy(*by, "phase").agg(F.avg("pause").alias("m"), F.stddev_pop("pause").alias("s"))
    p = p.join(pm.hint("shuffle_hash"), [*by, "phase"]).filter(_within(F.col("pause"), F.col("m"), F.col("s"), k))
    p = p.groupBy(*by).agg(*[f(of(ph, F.col("pause"))).alias(f"{ph}_pause_{n}") for ph in phases for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    g = g.join(ibi, by, "left").join(p, by, "left")
    if "intervals" in breaths.columns:
        extra = [b.filter(many).select(*by, F.explode(col).alias("v")).groupBy(*by).agg(F.avg("v").alias(f"{col}_mean"), F.stddev_pop("v").alias(f"{col}_sd")) for col in ("intervals", "ratios")]
        for e in extra:
            g = g.join(e, by, "left")
    both = (F.col("n_inhale") > 0) & (F.col("n_exhale") > 0)
    pos = F.when(F.col("ibi") > 0, F.col("ibi"))
    rate = 1 / pos
    tidal = F.col("inhale_volume") + F.col("exhale_volume")
    n = F.col("n_inhale") + F.col("n_exhale")
    real = {
        "inhale_volume": F.col("inhale_volume"), "exhale_volume": F.col("exhale_volume"), "inhale_duration": F.col("inhale_duration"), "exhale_duration": F.col("exhale_duration"),
        "inhale_value": F.col("inhale_peak_value"), "exhale_value": F.col("exhale_peak_value"), "inter_breath_interval": F.col("ibi"), "rate": rate, "tidal_volume": tidal, "minute_ventilation": rate * tidal,
        "duty_cycle_inhale": F.col("inhale_duration") / pos, "duty_cycle_exhale": F.col("exhale_duration") / pos,
        "cov_inhaledutycycle": F.try_divide("inhale_duration_sd", "inhale_duration"), "cov_exhaledutycycle": F.try_divide("exhale_duration_sd", "exhale_duration"),
        "cov_breathingrate": F.col("ibi_sd") / pos, "cov_inhalevolume": F.try_divide("inhale_volume_sd", "inhale_volume"), "cov_exhalevolume": F.try_divide("exhale_volume_sd", "exhale_volume"),
        "post_inhale_pause_mean": F.col("inhale_pause_mean"), "post_inhale_pause_std": F.col("inhale_pause_sd"), "post_exhale_pause_mean": F.col("exhale_pause_mean"), "post_exhale_pause_std": F.col("exhale_pause_sd"),
        "pause_dutycycle_inhale": F.col("inhale_pause_mean") / pos, "pause_dutycycle_exhale": F.col("exhale_pause_mean") / pos,
    }
    count = {
        "multiphasic_count": F.col("multi_inhale") + F.col("multi_exhale"), "multiphasic_ratio": F.try_divide(F.col("multi_inhale") + F.col("multi_exhale"), n),
        "multiphasic_inhale_count": F.col("multi_inhale"), "multiphasic_exhale_count": F.col("multi_exhale"),
        "multiphasic_inhale_ratio": F.try_divide("multi_inhale", "n_inhale"), "multiphasic_exhale_ratio": F.try_divide("multi_exhale", "n_exhale"), "peaksperbreath_mean": F.col("peaks_mean"), "peaksperbreath_max": F.col("peaks_max"),
    }
    if "intervals" in breaths.columns:
        count |= {"interpeakinterval_mean": F.col("intervals_mean"), "interpeakinterval_std": F.col("intervals_sd"), "secondarypeakratio_mean": F.col("ratios_mean"), "secondarypeakratio_std": F.col("ratios_sd")}
    return g.select(*by, *[F.when(both, c).alias(a) for a, c in real.items()], *[F.when(both, F.coalesce(c, F.lit(0))).otherwise(0).alias(a) for a, c in count.items()])
