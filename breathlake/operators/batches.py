"""Whole recordings, and many windows at a time, as numpy arrays in Arrow batches.

The rules are those of ``signal.clean``, ``signal.sliding_windows``,
``breaths.window_breaths`` and ``breaths.metrics``, which hold for units of any size with
a row for each sample or breath; here a sample costs no row. A task holds one
recording of at most ``WHOLE`` samples and the windows of one batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from breathlake.functions.metrics import COUNTS, METRICS
from breathlake.operators.breaths import PeakRules

#: Samples of a recording, copies counted, up to which one task may clean it whole.
WHOLE = 1 << 20
#: Samples whose breaths are looked for at once.
CHUNK = 1 << 19


# --- cleaning one recording ------------------------------------------------------------


def merged(start: np.ndarray, size: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index once with its largest finite reading, NaN where it has none."""
    idx = np.repeat(start - np.cumsum(size) + size, size) + np.arange(len(values))
    x = np.where(np.isfinite(values), values, np.nan)
    step = np.diff(idx)
    if (step == 1).all():
        return idx, x
    if (step < 0).any():
        order = np.argsort(idx, kind="stable")
        idx, x = idx[order], x[order]
    first = np.flatnonzero(np.r_[True, np.diff(idx) != 0])
    return idx[first], np.fmax.reduceat(x, first)


def _runs(flag: np.ndarray, idx: np.ndarray) -> list[tuple[int, int]]:
    """Half-open positions of runs of flagged consecutive indices."""
    at = np.flatnonzero(flag)
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(idx[at]) != 1)
    return list(zip(at[np.r_[0, new + 1]].tolist(), (at[np.r_[new, len(at) - 1]] + 1).tolist()))


def _flat(idx: np.ndarray, x: np.ndarray, w: int, below: float) -> np.ndarray | None:
    """Samples in a stretch of ``w`` whose deviation is under ``below``."""
    if w < 2 or len(x) < w:
        return None
    # no step within a flat stretch exceeds twice its largest distance from the mean
    big = np.cumsum(~(np.abs(np.diff(x, prepend=np.nan)) <= 2 * below * math.sqrt(w)) | (np.diff(idx, prepend=idx[0]) > 1))
    at = np.flatnonzero(big[w - 1:] == big[: len(x) - w + 1])
    if not len(at):
        return None
    view, part = np.lib.stride_tricks.sliding_window_view(x, w), max(1, CHUNK // w)
    at = np.concatenate([a[view[a].std(axis=1) < below] for a in np.split(at, range(part, len(at), part))])
    edge = np.zeros(len(x) + 1, int)
    edge[at] += 1
    edge[at + w] -= 1
    return np.cumsum(edge[:-1]) > 0


def _median(v: np.ndarray) -> float:
    k = len(v) // 2
    p = np.partition(v, [k - 1, k] if len(v) % 2 == 0 else k)
    return float(p[k] if len(v) % 2 else (p[k - 1] + p[k]) / 2)


def issue_samples(idx: np.ndarray, x: np.ndarray, rate: float) -> np.ndarray:
    """Samples in an issue of any detector of ``signal.all_issues``."""
    known = ~np.isnan(x)
    bad = np.zeros(len(x), bool)
    for flag in (~known, np.abs(x) < 1e-10):
        for a, b in _runs(flag, idx):
            if (b - a) / rate >= 1.0:
                bad[a:b] = True
    flat = _flat(idx, x, math.floor(5.0 * rate + 1e-9), 0.001)
    if flat is not None:
        bad |= flat
    v = x[known]
    if len(v):
        center = _median(v)
        reach = _median(np.abs(v - center))
        if reach < 1e-10:
            center, reach = v.mean(), v.std()
        bad |= np.abs(x - center) > 10.0 * reach
        bad |= np.abs(x) > 100.0
    return bad


def _repaired(idx: np.ndarray, x: np.ndarray, bad: np.ndarray, rate: float) -> np.ndarray:
    out = x.copy()
    for a, b in _runs(bad, idx):
        n = b - a
        if n > math.floor(10.0 * rate):
            out[a:b] = np.nan
        elif a and b < len(x) and idx[a - 1] == idx[a] - 1 and idx[b] == idx[b - 1] + 1:
            out[a:b] = x[a - 1] + (x[b] - x[a - 1]) * np.arange(1, n + 1) / (n + 1)
    return out


def _interpolated(idx: np.ndarray, x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Bad samples on the line through their neighbours, or through the nearest two beyond the ends."""
    at = np.flatnonzero(bad)
    good = np.flatnonzero(~bad & ~np.isnan(x))
    if not len(at) or len(good) < 2:
        return x
    k = np.clip(np.searchsorted(good, at), 1, len(good) - 1)
    a, b = good[k - 1], good[k]
    out = x.copy()
    out[at] = x[a] + (x[b] - x[a]) * (idx[at] - idx[a]) / (idx[b] - idx[a])
    return out


def cleaned(idx: np.ndarray, x: np.ndarray, rate: float, method: str | None = "linear", k: float = 5.0) -> np.ndarray | None:
    """The samples as ``signal.clean`` leaves them; None for a recording to reject."""
    bad = issue_samples(idx, x, rate)
    valid = (len(x) - np.count_nonzero(bad)) / len(x) * 100
    if valid < 50.0:
        return None
    if valid < 80.0:
        x = _repaired(idx, x, bad, rate)
    v = x[~np.isnan(x)]
    if len(v):
        x = _interpolated(idx, x, np.abs(x - v.mean()) > k * v.std())
    if not method:
        return x
    x = _interpolated(idx, x, np.isnan(x))
    known = ~np.isnan(x)
    if not known.any():
        return x
    level = x[known].mean()
    if method == "linear" and np.count_nonzero(known) > 1:
        t = idx - idx[known].mean()
        d = t[known]
        return x - (level + (d @ (x[known] - level)) / (d @ d) * t)
    return x - level


def full_windows(idx: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and first position of each window all of whose samples are there."""
    number, first = [], []
    for a, b in _runs(np.ones(len(idx), bool), idx):
        k = np.arange(max(0, -(-int(idx[a]) // step)), (int(idx[a]) + b - a - size) // step + 1)
        number.append(k)
        first.append(k * step - idx[a] + a)
    return np.concatenate(number), np.concatenate(first)


_WINDOW = pa.schema([("window_id", pa.int64()), ("recording_id", pa.int64()), ("window_index", pa.int64()), ("sampling_rate", pa.float64()), ("window_data", pa.list_(pa.float64()))])


def cut_recordings(windows: DataFrame, size_s: float, overlap_s: float, detrend: str | None, place_bits: int) -> DataFrame:
    """Windows cut anew from recordings that are cleaned whole.

    ``windows``: ``recording_id, rate, start_idx, d`` without NULL, one positive rate a
    recording. A recording's windows come to one task in order of ``start_idx``.
    """
    if detrend not in (None, "linear", "constant"):
        raise ValueError(f"unknown method {detrend}")
    w = windows.select("recording_id", "rate", "start_idx", "d").repartition("recording_id").sortWithinPartitions("recording_id", "start_idx")

    def windows_of(rec: int, rate: float, start: np.ndarray, size: np.ndarray, values: np.ndarray) -> tuple | None:
        n = math.floor(size_s * rate)
        step = n - math.floor(overlap_s * rate)
        if n <= 0 or step <= 0 or not len(values):
            return None
        idx, x = merged(start, size, values)
        y = cleaned(idx, x, rate, detrend)
        if y is None:
            return None
        number, first = full_windows(idx, n, step)
        if not len(number):
            return None
        if number[-1] >= 1 << place_bits or not -(1 << 63 - place_bits) <= rec < 1 << 63 - place_bits:
            raise ValueError("window ids do not fit")
        return (rec << place_bits) + number, np.full(len(number), rec), number, np.full(len(number), rate), np.full(len(number), n), y[first[:, None] + np.arange(n)].ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # parts of the last recording, which may go on in the next batch

        def done(parts: list[tuple]) -> tuple | None:
            rec, rate = parts[0][:2]
            return windows_of(rec, rate, *(parts[0][2:] if len(parts) == 1 else map(np.concatenate, zip(*(p[2:] for p in parts)))))

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            i, rec, number, rate, n, y = map(np.concatenate, zip(*found))
            d = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(y, mask=np.isnan(y)))
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(rec), pa.array(number), pa.array(rate), d], schema=_WINDOW)

        for batch in batches:
            if not batch.num_rows:
                continue
            rec, rate, start = (batch.column(c).to_numpy() for c in range(3))
            lists = batch.column(3)
            offset = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            edge = np.r_[0, np.flatnonzero(np.diff(rec)) + 1, len(rec)]
            found = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                part = (int(rec[a]), float(rate[a]), start[a:b], np.diff(offset[a: b + 1]), values[offset[a]: offset[b]])
                if held and held[0][0] != part[0]:
                    found.append(done(held))
                    held = []
                held.append(part)
            if found := [f for f in found if f]:
                yield batch_of(found)
        if held and (last := done(held)):
            yield batch_of([last])

    return w.mapInArrow(run, "window_id bigint, recording_id bigint, window_index bigint, sampling_rate double, window_data array<double>")


# --- breaths of many windows -------------------------------------------------------------


def _maxima(f: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``local_maxima`` of rows of ``n``: centres, and the steps up and down beside them, as flat positions."""
    d = np.diff(f)
    d[n - 1::n] = 0
    turn = np.flatnonzero(d)
    a, b = turn[:-1], turn[1:]
    up = (d[a] > 0) & (d[b] < 0) & (a // n == b // n)
    a, b = a[up], b[up]
    return (a + 1 + b) // 2, a, b


def _spaced(f: np.ndarray, peaks: np.ndarray, group: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """``spaced`` in every group at once: which peaks stay. ``peaks`` ascend within a group.

    A peak higher than all open ones near it stays and closes them; that is what going
    down from the highest does.
    """
    keep = np.zeros(len(peaks), bool)
    left = np.arange(len(peaks))
    while len(left):
        p, g, d = peaks[left], group[left], distance[left]
        v, pairs = f[p], []
        lost, near = np.zeros(len(p), bool), np.zeros(len(p), bool)
        for k in range(1, len(p)):
            i = np.flatnonzero((g[k:] == g[:-k]) & (p[k:] - p[:-k] < d[k:]))
            if not len(i):
                break
            pairs.append((i, i + k))
            later = v[i + k] >= v[i]  # of equal ones the later
            lost[i[later]] = True
            lost[i[~later] + k] = True
        for i, j in pairs:
            near[i[~lost[j]]] = True
            near[j[~lost[i]]] = True
        keep[left[~lost]] = True
        left = left[lost & ~near]
    return keep


def _lowest(f: np.ndarray, p: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    """Where the signal is lowest between a peak and the next higher sample or the end, the nearest such place."""
    low, at, top = f[p], p.copy(), f[p]
    i, q = np.arange(len(p)), p
    while True:
        go = q != end[i]
        i, q = i[go], q[go] + step
        v = f[q]
        go = v <= top[i]
        i, q, v = i[go], q[go], v[go]
        if not len(i):
            return at
        less = v < low[i]
        j = i[less]
        low[j], at[j] = v[less], q[less]


def _crossing(f: np.ndarray, p: np.ndarray, level: np.ndarray, base: np.ndarray, step: int) -> np.ndarray:
    """Where the signal falls to ``level`` on the way to ``base``, between samples."""
    at = p.copy()
    i = np.flatnonzero((at != base) & (f[at] > level))
    while len(i):
        at[i] += step
        q = at[i]
        i = i[(q != base[i]) & (f[q] > level[i])]
    out = at.astype(float)
    i = np.flatnonzero(f[at] < level)
    q = at[i]
    out[i] = q - step * (level[i] - f[q]) / (f[q - step] - f[q])
    return out


def _tops(f: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, right = _lowest(f, p, lo, -1), _lowest(f, p, hi, 1)
    return f[p] - np.maximum(f[left], f[right]), left, right


def _medians(v: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    out = np.full(size, np.nan)
    order = np.lexsort((v, group))
    v, g = v[order], group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    n = np.diff(np.r_[start, len(g)])
    out[g[start]] = (v[start + (n - 1) // 2] + v[start + n // 2]) / 2
    return out


def _least(v: np.ndarray, row: np.ndarray, m: int, r: PeakRules) -> np.ndarray:
    """Of each row ``multiplier`` times the median of the values from its percentile up; NaN without values."""
    order = np.lexsort((v, row))
    v, row = v[order], row[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    n = np.diff(np.r_[start, len(row)])
    at = (n - 1) * (r.percentile / 100)
    k = np.floor(at).astype(int)
    t = at - k
    a, b = v[start + k], v[start + np.minimum(k + 1, n - 1)]
    limit = np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)  # as np.percentile
    top = v >= np.repeat(limit, n)
    return r.multiplier * _medians(v[top], row[top], m)


def breaths_of_many(x: np.ndarray, rate: np.ndarray, r: PeakRules = PeakRules()) -> dict[str, np.ndarray]:
    """``breaths_of`` for each row of ``x``, in order: one entry a breath, ``row`` says whose.

    ``interval_of, interval`` and ``ratio_of, ratio`` are the entries of its lists.
    """
    m, n = x.shape
    none = np.zeros(0, int)
    if n < 3 or not m:
        return {c: none for c in ("row", "peak_location", "number_of_peaks", "interval_of", "ratio_of")} | {c: none.astype(float) for c in ("peak_value", "volume", "duration", "start_time", "interval", "ratio")}
    f, up = np.ascontiguousarray(x).ravel(), r.upsample
    gap = np.maximum(1, (r.min_distance_s * rate - 1).astype(int))
    maxima, main = {}, {}
    for s in (1, -1):
        g = s * f
        maxima[s] = _maxima(g, n)
        p = maxima[s][0]
        row = p // n
        p = p[_spaced(g, p, row, gap[row])]
        row = p // n
        prom, left, right = _tops(g, p, row * n, row * n + n - 1)
        ok = prom >= r.min_prominence
        p, prom, left, right, row = p[ok], prom[ok], left[ok], right[ok], row[ok]
        level = g[p] - prom / 2
        width = _crossing(g, p, level, right, 1) - _crossing(g, p, level, left, -1)
        main[s] = p[width >= r.min_width_s * rate[row]]
    inhale, exhale = main[1], main[-1]
    least = _least(f[inhale], inhale // n, m, r)
    inhale = inhale[f[inhale] > least[inhale // n]]
    exhale = exhale[~(f[exhale] >= -least[exhale // n])]  # all where there is no inhale
    pos = np.linspace(0, n - 1, n * up)
    j = np.minimum(pos.astype(int), n - 2)
    fine = (x[:, j + 1] - x[:, j]) * (pos - j) + x[:, j]
    fine[:, -1] = x[:, -1]
    sign = np.where(fine > r.volume_threshold, 1, np.where(fine < -r.volume_threshold, -1, 0)).astype(np.int8)
    turn = np.ones(sign.shape, bool)
    turn[:, 1:] = sign[:, 1:] != sign[:, :-1]
    edge, sign = np.flatnonzero(turn), sign.ravel()
    stop = np.r_[edge[1:], len(sign)] - 1
    # main peaks by segment
    p = np.sort(np.concatenate([inhale, exhale]))
    k = np.searchsorted(edge, p * up, "right") - 1
    ok = sign[edge[k]] != 0
    p, k = p[ok], k[ok]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else none
    b_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(k)]))
    top = p[np.lexsort((p, -np.abs(f[p]), b_of))[first]]
    k, row = k[first], p[first] // n
    a = edge[k] // up - row * n
    b = np.minimum(stop[k] // up - row * n, n - 1)
    value, lo, hi = f[top], row * n + a, row * n + b
    # the other peaks of each segment
    size = hi - lo + 1
    own = (p >= lo[b_of]) & (p <= hi[b_of]) & (size[b_of] >= 3)
    sub_b, sub_p = [b_of[own]], [p[own]]
    near = np.maximum(1, (r.sub_distance_s * rate).astype(int))
    for s in (1, -1):
        g, (c, rise, fall) = s * f, maxima[s]
        seg = np.flatnonzero(((value > 0) == (s > 0)) & (size >= 3))
        start, end = np.searchsorted(c, lo[seg], "left"), np.searchsorted(c, hi[seg], "right")
        count = end - start
        of = np.repeat(seg, count)
        at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        ok = (rise[at] >= lo[of]) & (fall[at] <= hi[of] - 1)
        of, q = of[ok], c[at[ok]]
        ok = _spaced(g, q, of, near[row[of]])
        of, q = of[ok], q[ok]
        ok = _tops(g, q, lo[of], hi[of])[0] >= r.sub_prominence * np.abs(value[of])
        sub_b.append(of[ok])
        sub_p.append(q[ok])
    key = np.unique(np.concatenate(sub_b) * len(f) + np.concatenate(sub_p))
    of, q = key // len(f), key % len(f)
    size_of = np.abs(value[of])
    ratio = np.divide(np.abs(f[q]), size_of, out=np.zeros(len(q)), where=size_of > 0)
    ok = (q == top[of]) | (ratio >= r.sub_ratio)
    of, q, ratio = of[ok], q[ok], ratio[ok]
    number = np.bincount(of, minlength=len(first))
    mean = np.append((f[1:] + f[:-1]) / 2, 0.0)
    area = np.add.reduceat(mean, np.c_[lo, hi].ravel())[::2] if len(lo) else np.zeros(0)
    volume = np.where(hi > lo, area, 0.0) / rate[row]
    duration = (b - a) / rate[row]
    keep = duration >= r.min_duration_s
    if keep.any():
        mid = _medians(np.abs(volume[keep]), row[keep], m)
        keep &= np.abs(volume) > r.volume_threshold * mid[row]
    place = np.cumsum(keep) - 1
    step = np.flatnonzero((of[1:] == of[:-1]) & keep[of[1:]])
    other = (q != top[of]) & (number[of] > 1) & keep[of]
    out = {"row": row, "peak_location": top - row * n, "peak_value": value, "volume": volume, "duration": duration, "start_time": a / rate[row], "number_of_peaks": number}
    out = {c: v[keep] for c, v in out.items()}
    return out | {"interval_of": place[of[step]], "interval": (q[step + 1] - q[step]) / rate[row[of[step]]], "ratio_of": place[of[other]], "ratio": ratio[other]}


# --- metrics of many windows -------------------------------------------------------------


def _moments(v: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each group, NaN without values; equal values give 0."""
    n = np.bincount(group, minlength=size).astype(float)
    n[n == 0] = np.nan
    base = np.zeros(size)
    base[group[::-1]] = v[::-1]  # sums count from a group's first value
    d = v - base[group]
    m = np.bincount(group, d, size) / n
    e = d - m[group]
    return base + m, np.sqrt(np.bincount(group, e * e, size) / n)


def _kept(v: np.ndarray, group: np.ndarray, size: int, k: float) -> np.ndarray:
    m, sd = _moments(v, group, size)
    return (sd[group] == 0) | (np.abs(v - m[group]) <= k * sd[group])


def _trimmed(v: np.ndarray, group: np.ndarray, size: int, k: float) -> tuple[np.ndarray, np.ndarray]:
    ok = _kept(v, group, size, k)
    return _moments(v[ok], group[ok], size)


def _pauses(row: np.ndarray, end: np.ndarray, other_row: np.ndarray, start: np.ndarray, min_s: float) -> tuple[np.ndarray, np.ndarray]:
    """From each end to the earliest start strictly after it in its row."""
    rows, t, side = np.r_[other_row, row], np.r_[start, end], np.r_[np.zeros(len(start), int), np.ones(len(end), int)]
    order = np.lexsort((side, t, rows))
    rows, t, side = rows[order], t[order], side[order]
    ask, have = np.flatnonzero(side), np.flatnonzero(side == 0)
    k = np.searchsorted(have, ask)
    ok = k < len(have)
    ask, nxt = ask[ok], have[k[ok]]
    gap = t[nxt] - t[ask]
    ok = (rows[nxt] == rows[ask]) & (gap >= min_s)
    return gap[ok], rows[ask[ok]]


def metrics_of_many(b: dict[str, np.ndarray], m: int, k: float = 3.0, min_pause_s: float = 0.05) -> dict[str, np.ndarray]:
    """``breaths.metrics`` of rows 0 to ``m``, NaN for NULL."""
    row, ex = b["row"], (~(b["peak_value"] > 0)).astype(int)
    side = 2 * row + ex
    split = lambda v: (v[::2], v[1::2])
    mean, sd = {}, {}
    for c in ("volume", "duration", "peak_value"):
        v = b[c] if c == "duration" else np.where(ex == 1, np.abs(b[c]), b[c])
        mean[c], sd[c] = map(split, _trimmed(v, side, 2 * m, k))
    number = b["number_of_peaks"]
    n_in, n_ex = split(np.bincount(side, minlength=2 * m))
    multi_in, multi_ex = split(np.bincount(side[number > 1], minlength=2 * m))
    peaks_mean = _moments(number.astype(float), row, m)[0]
    peaks_max = np.zeros(m, int)
    np.maximum.at(peaks_max, row, number)
    t, end = b["start_time"], b["start_time"] + b["duration"]
    i, e = np.flatnonzero(ex == 0), np.flatnonzero(ex)
    o = i[np.lexsort((b["peak_location"][i], t[i], row[i]))]
    same = row[o[1:]] == row[o[:-1]]
    ibi, ibi_sd = _trimmed((t[o[1:]] - t[o[:-1]])[same], row[o[1:]][same], m, k)
    pause = [_trimmed(*_pauses(row[p], end[p], row[q], t[q], min_pause_s), m, k) for p, q in ((i, e), (e, i))]
    interval, interval_sd = _moments(b["interval"], row[b["interval_of"]], m)
    ratio, ratio_sd = _moments(b["ratio"], row[b["ratio_of"]], m)
    both = (n_in > 0) & (n_ex > 0)

    def over(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.divide(a, c, out=np.full(m, np.nan), where=c != 0)

    pos = np.where(ibi > 0, ibi, np.nan)
    rate, tidal = over(np.ones(m), pos), mean["volume"][0] + mean["volume"][1]
    real = {
        "inhale_volume": mean["volume"][0], "exhale_volume": mean["volume"][1], "inhale_duration": mean["duration"][0], "exhale_duration": mean["duration"][1],
        "inhale_value": mean["peak_value"][0], "exhale_value": mean["peak_value"][1], "inter_breath_interval": ibi, "rate": rate, "tidal_volume": tidal, "minute_ventilation": rate * tidal,
        "duty_cycle_inhale": mean["duration"][0] / pos, "duty_cycle_exhale": mean["duration"][1] / pos,
        "cov_inhaledutycycle": over(sd["duration"][0], mean["duration"][0]), "cov_exhaledutycycle": over(sd["duration"][1], mean["duration"][1]),
        "cov_breathingrate": ibi_sd / pos, "cov_inhalevolume": over(sd["volume"][0], mean["volume"][0]), "cov_exhalevolume": over(sd["volume"][1], mean["volume"][1]),
        "post_inhale_pause_mean": pause[0][0], "post_inhale_pause_std": pause[0][1], "post_exhale_pause_mean": pause[1][0], "post_exhale_pause_std": pause[1][1],
        "pause_dutycycle_inhale": pause[0][0] / pos, "pause_dutycycle_exhale": pause[1][0] / pos,
    }
    count = {
        "multiphasic_count": multi_in + multi_ex, "multiphasic_ratio": over(multi_in + multi_ex, n_in + n_ex), "multiphasic_inhale_count": multi_in, "multiphasic_exhale_count": multi_ex,
        "multiphasic_inhale_ratio": over(multi_in, n_in), "multiphasic_exhale_ratio": over(multi_ex, n_ex), "peaksperbreath_mean": peaks_mean, "peaksperbreath_max": peaks_max,
        "interpeakinterval_mean": interval, "interpeakinterval_std": interval_sd, "secondarypeakratio_mean": ratio, "secondarypeakratio_std": ratio_sd,
    }
    return {c: np.where(both, v, np.nan) for c, v in real.items()} | {c: np.where(both & (v == v), v, 0) for c, v in count.items()}


_KIND = {c: "int" if c == "peaksperbreath_max" else "bigint" if c in COUNTS else "double" for c in METRICS}


def window_metrics(windows: DataFrame, rules: PeakRules = PeakRules()) -> DataFrame:
    """``window_id, recording_id, window_index`` of each row and the 35 metrics of its window.

    Gaps are bridged by straight lines first. A window without readings or a
    positive rate has no breaths. No shuffle.
    """
    index = windows.schema["window_index"].dataType.simpleString()
    w = windows.selectExpr("cast(window_id as bigint) window_id", "cast(recording_id as bigint) recording_id", "window_index", "cast(sampling_rate as double) rate", "cast(window_data as array<double>) d")
    arrow = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            rate = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            offset, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(float)
            size = np.diff(offset)
            known = np.isfinite(values)
            here = np.concatenate([[0], np.cumsum(known)])
            seen = here[offset[1:]] - here[offset[:-1]]
            ok = (rate > 0) & (seen > 0) & (size >= 3) & lists.is_valid().to_numpy(zero_copy_only=False)
            out = {c: np.full(len(size), np.nan if c in METRICS[:23] else 0.0) for c in METRICS}
            for n in np.unique(size[ok]):
                every = np.flatnonzero(ok & (size == n))
                part = max(1, CHUNK // int(n))
                for at in np.split(every, range(part, len(every), part)):
                    x = values[offset[at][:, None] + np.arange(n)]
                    for i in np.flatnonzero(seen[at] < n):
                        good = np.isfinite(x[i])
                        x[i] = np.interp(np.arange(n), np.flatnonzero(good), x[i][good])
                    for c, v in metrics_of_many(breaths_of_many(x, rate[at], rules), len(at)).items():
                        out[c][at] = v
            cols = [pa.array(out[c].astype(int), arrow[t]) if t != "double" else pa.array(out[c], mask=np.isnan(out[c])) for c, t in _KIND.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["window_id", "recording_id", "window_index", *METRICS])

    return w.mapInArrow(run, f"window_id bigint, recording_id bigint, window_index {index}, " + ", ".join(f"{c} {t}" for c, t in _KIND.items()))


# --- windows of a recording ----------------------------------------------------------------

#: Functions of ``recordings_of``.
FUNCTIONS = ("mean", "std", "min", "max", "median")
#: Windows of the largest recording up to which one task may hold them.
MOST_WINDOWS = 100_000


def functions_of_many(v: np.ndarray, start: np.ndarray, functions: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Each of ``FUNCTIONS`` of the values of each group, NaN values left out; groups begin at ``start``, one after the other."""
    size = np.diff(np.r_[start, len(v)])
    g = np.repeat(np.arange(len(start)), size)
    v = v[np.lexsort((v, g))]  # NaN last
    known = ~np.isnan(v)
    n = np.add.reduceat(known.astype(int), start)
    low = v[start]  # sums count from the smallest
    d = np.where(known, v - low[g], 0.0)
    count = np.where(n > 0, n, np.nan)
    mean = np.add.reduceat(d, start) / count
    e = np.where(known, d - mean[g], 0.0)
    last = np.maximum(n - 1, 0)
    all_ = {
        "mean": lambda: low + mean, "std": lambda: np.sqrt(np.add.reduceat(e * e, start) / count), "min": lambda: low, "max": lambda: v[start + last],
        "median": lambda: 0.5 * v[start + last // 2] + 0.5 * v[start + (last + 1) // 2],
    }
    return {f: all_[f]() for f in functions}


def recordings_of(metrics: DataFrame, features: list[str], functions: tuple[str, ...]) -> DataFrame:
    """``features.aggregate_windows`` by recording, a recording's windows in one task."""
    names = [f"{c}_{f}" for c in features for f in functions]
    kinds = {c: t if t in ("int", "bigint") else "double" for c, t in metrics.select(*features).dtypes}
    kind = {f"{c}_{f}": kinds[c] if f in ("min", "max") else "double" for c in features for f in functions}
    arrow = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
    w = metrics.select("recording_id", *features).repartition("recording_id").sortWithinPartitions("recording_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last recording, which may go on in the next batch

        def rows(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            rec = table.column(0)
            start = np.flatnonzero(np.r_[True, _changes(rec)])
            out = {}
            for c in features:
                v = table.column(c).to_numpy().astype(float)
                for f, x in functions_of_many(v, start, functions).items():
                    out[f"{c}_{f}"] = x
            ids = rec.take(pa.array(start)).combine_chunks()
            n = pa.array(np.diff(np.r_[start, table.num_rows]))
            cols = [pa.array(np.where(np.isnan(out[c]), 0, out[c]).astype(float if kind[c] == "double" else int), arrow[kind[c]], mask=np.isnan(out[c])) for c in names]
            return pa.RecordBatch.from_arrays([ids, n, *cols], names=["recording_id", "n_windows", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and not _same(held[-1].column(0)[-1], batch.column(0)[0]):
                yield rows(pa.Table.from_batches(held))
                held = []
            change = np.flatnonzero(_changes(batch.column(0)))
            if not len(change):
                held.append(batch)
                continue
            last = int(change[-1]) + 1
            yield rows(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield rows(pa.Table.from_batches(held))

    return w.mapInArrow(run, ", ".join(["recording_id bigint", "n_windows bigint", *[f"`{c}` {kind[c]}" for c in names]]))


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _changes(rec: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whether each row's recording, which may be NULL, differs from the one before, from the second row on."""
    null = rec.is_null().to_numpy() if isinstance(rec, pa.ChunkedArray) else rec.is_null().to_numpy(zero_copy_only=False)
    r = rec.fill_null(0)
    r = r.to_numpy() if isinstance(r, pa.ChunkedArray) else r.to_numpy(zero_copy_only=False)
    return (r[1:] != r[:-1]) | (null[1:] != null[:-1])
