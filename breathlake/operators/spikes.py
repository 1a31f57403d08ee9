"""Implausible readings: robust control charts, run lengths, physical limits.

A source (one recording, or one phase of one recording's breaths) is judged
against its own ordinary behaviour. Its baseline is the median and the median
distance from it. A robust exponentially weighted chart starts there, clips
each value that it suspects before it updates mean and scale, and follows the
source from then on; run-length counters and physical limits add frozen and
impossible values. Only what the chart suspects goes on to an exact check
against the baseline, so a chart that follows the spikes themselves finds
fewer of them.

Sources are cut into blocks of bounded length with context on both sides, so
one source may hold any share of the rows. A source of one block takes its
baseline inside the block; one of several blocks gets it from exact quantiles
that are counted over all its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathlake.operators.quantiles import group_quantiles
from breathlake.session import cut

#: Samples of a block's core.
BLOCK = 8192
#: Seconds of a block of breaths.
BREATH_BLOCK_S = 3600.0


@dataclass(frozen=True)
class Chart:
    """Parameters of the control chart.

    ``weight`` is that of a new value, ``limit`` the control limit in scales,
    ``clip`` the distance in scales to which a suspected value is pulled in
    before it updates the state. At ``clip`` 1 suspected values leave the scale
    as it is. The scale never falls below ``floor`` of the baseline's, so a
    frozen stretch does not make all that follows suspect.
    """

    weight: float = 0.02
    clip: float = 1.0
    limit: float = 3.0
    floor: float = 0.5
    warmup: int = 256


@dataclass(frozen=True)
class Limits:
    """Exact rules: distance in scales, physical limit, frozen seconds and band."""

    far: float = 8.0
    physical: float = 100.0
    flat_seconds: float = 5.0
    flat_band: float = 0.02
    breath_far: float = 4.0
    breath_run: int = 6


def chart_suspects(x: np.ndarray, center: np.ndarray, scale: np.ndarray, p: Chart) -> np.ndarray:
    """Suspected values of many series at once: rows are series, NaN is no reading."""
    xt = np.ascontiguousarray(x.T)
    ok = np.isfinite(xt)
    xt = np.where(ok, xt, 0.0)
    out = np.zeros(xt.shape, bool)
    m, s, least = center.copy(), scale.copy(), p.floor * scale
    for t in range(len(xt)):
        r = (xt[t] - m) * ok[t]
        a = np.abs(r)
        far = np.greater(a, p.limit * s, out=out[t])
        bound = np.where(far, p.clip * s, a)
        m += p.weight * np.copysign(bound, r)
        s = np.maximum(s + p.weight * ok[t] * (bound - s), least)
    return out.T


def charted(series: list[np.ndarray], center: np.ndarray, scale: np.ndarray, p: Chart, cells: int = 1 << 20) -> list[np.ndarray]:
    """Charts over series of unequal length, in groups of similar length."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(series)
    order = sorted(range(len(series)), key=lambda i: len(series[i]))
    while order:
        width = max(1, len(series[order[-1]]))
        take, order = order[-max(1, cells // width):], order[: -max(1, cells // width)]
        x = np.full((len(take), width), np.nan)
        for k, i in enumerate(take):
            x[k, : len(series[i])] = series[i]
        flags = chart_suspects(x, center[take], scale[take], p)
        for k, i in enumerate(take):
            out[i] = flags[k, : len(series[i])]
    return out


def flat_mask(x: np.ndarray, length: int, band: float) -> np.ndarray:
    """Samples in some run of ``length`` readings whose range is at most ``band``."""
    out = np.zeros(len(x), bool)
    if len(x) < length or length < 1:
        return out
    with np.errstate(invalid="ignore"):
        near = np.abs(np.diff(x)) <= band
    edges = np.flatnonzero(np.diff(np.r_[False, near, False]))
    for a, b in zip(edges[::2], edges[1::2] + 1):  # only where neighbours differ by little
        if b - a < length:
            continue
        hi, lo, width = x[a:b], x[a:b], 1
        while width * 2 <= length:
            hi, lo = np.maximum(hi[:-width], hi[width:]), np.minimum(lo[:-width], lo[width:])
            width *= 2
        if rest := length - width:
            hi, lo = np.maximum(hi[:-rest], hi[rest:]), np.minimum(lo[:-rest], lo[rest:])
        starts = np.flatnonzero(hi - lo <= band) + a
        cover = np.zeros(b - a + 1, int)
        np.add.at(cover, starts - a, 1)
        np.add.at(cover, starts - a + length, -1)
        out[a:b] |= np.cumsum(cover)[:-1] > 0
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    e = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return list(zip(e[::2].tolist(), e[1::2].tolist()))


_BLOCK_SCHEMA = (
    "recording_id bigint, block bigint, center double, scale double, readings bigint, suspected bigint, "
    "windows array<struct<window_id: bigint, sample_pos: array<int>>>, runs array<struct<start_idx: bigint, end_idx: bigint>>"
)
_BLOCK_ARROW = pa.schema(
    [("recording_id", pa.int64()), ("block", pa.int64()), ("center", pa.float64()), ("scale", pa.float64()), ("readings", pa.int64()), ("suspected", pa.int64()),
     ("windows", pa.list_(pa.struct([("window_id", pa.int64()), ("sample_pos", pa.list_(pa.int32()))]))), ("runs", pa.list_(pa.struct([("start_idx", pa.int64()), ("end_idx", pa.int64())])))]
)


def _slices(col: pa.Array) -> list[list[tuple[int, int, np.ndarray, int]]]:
    """Per row: (window_id, start_idx, samples, start_idx of the whole window), in order of window_id."""
    flat = col.flatten()
    outer = col.offsets.to_numpy() - col.offsets[0].as_py()
    ids, starts, data, origins = (flat.field(i) for i in range(4))
    ids, starts, origins = (v.to_numpy(zero_copy_only=False) for v in (ids, starts, origins))
    inner = data.offsets.to_numpy()
    values = data.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    rows = []
    for a, b in zip(outer[:-1], outer[1:]):
        rows.append(sorted(((int(ids[k]), int(starts[k]), values[inner[k]: inner[k + 1]], int(origins[k])) for k in range(a, b)), key=lambda s: s[:2]))
    return rows


def _assembled(slices: list[tuple[int, int, np.ndarray, int]]) -> tuple[int, np.ndarray]:
    """First index and samples, each once; a null in one window yields to a reading in another."""
    lo = min(s[1] for s in slices)
    x = np.full(max(s[1] + len(s[2]) for s in slices) - lo, np.nan)
    for _, s, d, _ in slices:
        part = x[s - lo: s - lo + len(d)]
        np.copyto(part, d, where=np.isnan(part))
    return lo, x


def _scan_blocks(block: int, p: Chart, rules: Limits, given: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            rec, blk, rate = (rows[c].to_numpy(zero_copy_only=False) for c in ("recording_id", "block", "rate"))
            slices = _slices(rows["slices"])
            at, series, core, center, scale = [], [], [], np.zeros(len(rec)), np.ones(len(rec))
            for i, own in enumerate(slices):
                lo, x = _assembled(own)
                a, b = max(0, int(blk[i]) * block - lo), max(0, min(len(x), (int(blk[i]) + 1) * block - lo))
                at.append(lo), series.append(x), core.append((a, b))
                if given:
                    center[i], scale[i] = rows["center"][i].as_py(), rows["scale"][i].as_py()
                else:
                    fin = x[a:b][np.isfinite(x[a:b])]
                    if len(fin):
                        center[i] = np.median(fin)
                        scale[i] = np.median(np.abs(fin - center[i]))
            suspects = charted(series, center, scale, p)
            windows, runs, readings, suspected = [], [], [], []
            for i, x in enumerate(series):
                a, b = core[i]
                with np.errstate(invalid="ignore"):
                    away = np.abs(x - center[i])
                    limit = np.abs(x) > rules.physical
                    flat = flat_mask(x, max(1, int(np.ceil(rules.flat_seconds * rate[i] - 1e-9))), rules.flat_band * scale[i])
                    bad = (suspects[i] & (away > rules.far * scale[i])) | limit | flat
                bad[:a] = False
                bad[b:] = False
                readings.append(int(np.isfinite(x[a:b]).sum()))
                suspected.append(int((suspects[i] | limit | flat)[a:b].sum()))
                runs.append([{"start_idx": s + at[i], "end_idx": e + at[i]} for s, e in _runs(bad)])
                hit = []
                if bad.any():
                    first = {}
                    for w, s, d, origin in slices[i]:
                        k = np.flatnonzero(bad[s - at[i]: s - at[i] + len(d)])
                        if len(k):
                            first.setdefault(w, []).append(k + s - origin)
                    hit = [{"window_id": w, "sample_pos": np.unique(np.concatenate(v)).astype(np.int32).tolist()} for w, v in first.items()]
                windows.append(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip((rec, blk, center, scale, readings, suspected, windows, runs), _BLOCK_ARROW)], schema=_BLOCK_ARROW
            )

    return scan


def signal_blocks(windows: DataFrame, p: Chart, rules: Limits, block: int = BLOCK) -> DataFrame:
    """One row per recording and block: the window slices that touch it or its context.

    Copies of a window fold in the partial aggregate. Rows without recording,
    window, start, samples or a positive rate hold no placed sample and drop out.
    """
    w = windows.select("recording_id", "window_id", "start_idx", F.col("sampling_rate").alias("rate"), F.col("window_data").cast("array<double>").alias("data"))
    w = w.dropna().filter((F.size("data") > 0) & (F.col("rate") > 0))
    halo = F.ceil(F.col("rate") * rules.flat_seconds).cast("bigint") + p.warmup
    end = F.col("start_idx") + F.size("data")
    w = w.select("*", halo.alias("halo"), end.alias("end"))
    w = w.select("*", F.explode(F.sequence(F.floor((F.col("start_idx") - F.col("halo")) / block), F.floor((F.col("end") - 1 + F.col("halo")) / block))).alias("block"))
    a = F.greatest(F.col("start_idx"), F.col("block") * block - F.col("halo"))
    b = F.least(F.col("end"), (F.col("block") + 1) * block + F.col("halo"))
    core = (F.col("start_idx") < (F.col("block") + 1) * block) & (F.col("end") > F.col("block") * block)
    part = F.slice("data", (a - F.col("start_idx") + 1).cast("int"), (b - a).cast("int"))
    w = w.filter(b > a).select("recording_id", "block", "rate", core.alias("core"), F.struct("window_id", a.alias("start_idx"), part.alias("data"), F.col("start_idx").alias("origin")).alias("slice"))
    return (
        w.groupBy("recording_id", "block")
        .agg(F.max("rate").alias("rate"), F.max("core").alias("core"), F.collect_set("slice").alias("slices"))
        .filter("core")
        .select("recording_id", "block", "rate", "slices")
    )


def _core_samples(block: int):
    schema = pa.schema([("recording_id", pa.int64()), ("x", pa.float64())])

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec, blk = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("recording_id", "block"))
            for i, own in enumerate(_slices(batch.column(batch.schema.get_field_index("slices")))):
                lo, x = _assembled(own)
                x = x[max(0, int(blk[i]) * block - lo): max(0, (int(blk[i]) + 1) * block - lo)]
                x = x[np.isfinite(x)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), rec[i])), pa.array(x)], schema=schema)

    return samples


def _exact_baseline(samples: DataFrame, by: list[str]) -> DataFrame:
    """Median and median distance from it, exact for sources of any length."""
    center = group_quantiles(samples, by, "x", [0.5]).select(*by, F.get("q", F.lit(0)).alias("center"))
    away = samples.join(center, by).select(*by, F.abs(F.col("x") - F.col("center")).alias("x"))
    return center.join(group_quantiles(away, by, "x", [0.5]).select(*by, F.get("q", F.lit(0)).alias("scale")), by)


def _long_recordings(windows: DataFrame, block: int) -> DataFrame:
    """Recordings whose samples lie in several blocks, from starts and lengths alone."""
    n = F.size(F.col("window_data"))
    w = windows.filter("window_id is not null and start_idx is not null and sampling_rate > 0").filter(n > 0)
    a, b = F.floor(F.col("start_idx") / block), F.floor((F.col("start_idx") + n - 1) / block)
    return w.groupBy("recording_id").agg(F.min(a).alias("a"), F.max(b).alias("b")).filter("recording_id is not null and a < b").select("recording_id")


def signal_spikes(windows: DataFrame, chart: Chart = Chart(), rules: Limits = Limits(), block: int = BLOCK) -> DataFrame:
    """Bad samples of each recording, by block.

    Overlapping windows are put together first, each sample once. Null and NaN
    are no reading. A sample is bad where the chart suspects it and it lies
    beyond ``rules.far`` scales of the baseline, where it is beyond the
    physical limit, or in a frozen run. Result: ``recording_id, block, center,
    scale, readings, suspected, windows, runs``: the bad positions in each
    window and the bad runs in samples of the recording. Materialised; empty
    input gives no rows.
    """
    several = cut(_long_recordings(windows, block))
    scan = lambda blocks, given: cut(blocks.mapInArrow(_scan_blocks(block, chart, rules, given), _BLOCK_SCHEMA))
    if several.isEmpty():
        return scan(signal_blocks(windows, chart, rules, block), False)
    short = signal_blocks(windows.join(several, "recording_id", "left_anti"), chart, rules, block)
    long = signal_blocks(windows.join(several, "recording_id", "left_semi"), chart, rules, block)
    base = _exact_baseline(long.mapInArrow(_core_samples(block), "recording_id bigint, x double"), ["recording_id"])
    filled = long.join(base, "recording_id", "left").fillna({"center": 0.0, "scale": 1.0})
    return scan(short, False).unionByName(scan(filled, True))


_BREATH_SCHEMA = "recording_id bigint, phase string, bucket bigint, center double, breaths bigint, suspected bigint, bad array<bigint>"
_BREATH_ARROW = pa.schema([("recording_id", pa.int64()), ("phase", pa.string()), ("bucket", pa.int64()), ("center", pa.float64()), ("breaths", pa.int64()), ("suspected", pa.int64()), ("bad", pa.list_(pa.int64()))])
#: Breath sizes are judged on absolute values, whose median distance never exceeds their median.
BREATH_CHART = Chart(weight=0.05, limit=2.0, warmup=0)
#: Ids of breaths without start time that are ordered at a time.
UNTIMED_IDS = 4096


def run_mask(v: np.ndarray, length: int) -> np.ndarray:
    """Values in a run of ``length`` or more equal values."""
    if not len(v):
        return np.zeros(0, bool)
    new = np.r_[True, v[1:] != v[:-1]]
    k = np.cumsum(new) - 1
    return np.bincount(k)[k] >= length


def _scan_breaths(p: Chart, rules: Limits, given: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            flat, offs = col["breaths"].flatten(), col["breaths"].offsets.to_numpy()
            offs = offs - offs[0]
            start, ids, val = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            order = np.lexsort((ids, start, row))
            ids, val = ids[order], val[order]
            size = np.abs(val)
            n = len(offs) - 1
            center, scale = np.ones(n), np.ones(n)
            cuts = list(zip(offs[:-1].tolist(), offs[1:].tolist()))
            for i, (a, b) in enumerate(cuts):
                s = size[a:b][np.isfinite(size[a:b])]
                if given:
                    center[i], scale[i] = col["center"][i].as_py(), col["scale"][i].as_py()
                elif len(s):
                    center[i] = np.median(s)
                    scale[i] = np.median(np.abs(s - center[i]))
            suspects = charted([size[a:b] for a, b in cuts], center, scale, p)
            bad, suspected = [], []
            for i, (a, b) in enumerate(cuts):
                runs, limit = run_mask(val[a:b], rules.breath_run), size[a:b] > rules.physical
                suspected.append(int((suspects[i] | runs | limit).sum()))
                bad.append(ids[a:b][(suspects[i] & (size[a:b] > rules.breath_far * center[i])) | limit | runs].tolist())
            data = (col["recording_id"], col["phase"], col["bucket"], center, np.diff(offs), suspected, bad)
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(data, _BREATH_ARROW)], schema=_BREATH_ARROW)

    return scan


def breath_spikes(breaths: DataFrame, rules: Limits = Limits(), bucket_s: float = BREATH_BLOCK_S, chart: Chart = BREATH_CHART) -> DataFrame:
    """Bad peak values of each recording and phase: ``breath_id, recording_id, phase``.

    Null and NaN values and breaths without recording are left out, a null
    phase counts as the phase ``""``; then breaths run in order of start time
    (equal times by ``breath_id``). A source longer than one time bucket takes
    its median from an exact percentile over all buckets, and runs of equal
    values are joined across the buckets' edges. Breaths without start time
    come before all others, in order and buckets of their ids.
    """
    by = ["recording_id", "phase"]
    rows = breaths.select("recording_id", F.coalesce("phase", F.lit("")).alias("phase"), "breath_id", "start_time", "peak_value")
    rows = rows.dropna(subset=["recording_id", "breath_id", "peak_value"])  # NaN too
    bucket = F.coalesce(F.floor(F.col("start_time") / bucket_s), F.floor(F.col("breath_id") / UNTIMED_IDS) - F.lit(1 << 60))
    rows = rows.select(*by, bucket.alias("bucket"), F.struct(F.coalesce("start_time", F.lit(0.0)).alias("start_time"), "breath_id", "peak_value").alias("breath"))
    sets = rows.groupBy(*by, "bucket").agg(F.collect_set("breath").alias("breaths"))
    once = cut(sets.mapInArrow(_scan_breaths(chart, rules, given=False), _BREATH_SCHEMA))
    bad = once.select(*by, F.explode("bad").alias("breath_id"))
    several = cut(once.groupBy(*by).count().filter("count > 1").select(*by))
    if several.isEmpty():
        return bad
    long = sets.join(several, by, "left_semi")
    samples = long.select(*by, F.explode("breaths").alias("b")).select(*by, F.abs("b.peak_value").alias("x"))
    keyed = long.join(_exact_baseline(samples, by), by)
    again = keyed.mapInArrow(_scan_breaths(chart, rules, given=True), _BREATH_SCHEMA).select(*by, F.explode("bad").alias("breath_id"))
    edge_runs = _runs_over_edges(long, by, rules.breath_run)
    rest = bad.join(several, by, "left_anti")
    return rest.unionByName(again.unionByName(edge_runs).distinct())


def _runs_over_edges(long: DataFrame, by: list[str], length: int) -> DataFrame:
    """Breaths in runs of equal values that cross a bucket's edge."""
    b = long.select(*by, "bucket", F.explode("breaths").alias("b")).select(*by, "bucket", "b.*")
    inside = Window.partitionBy(*by, "bucket").orderBy("start_time", "breath_id")
    new = F.when(F.col("peak_value") == F.lag("peak_value").over(inside), 0).otherwise(1)
    b = b.withColumn("new", new).withColumn("run", F.sum("new").over(inside))
    runs = b.groupBy(*by, "bucket", "run").agg(F.first("peak_value").alias("v"), F.count("*").alias("n"))
    last = F.max("run").over(Window.partitionBy(*by, "bucket"))
    runs = runs.withColumn("last", last).filter((F.col("run") == 1) | (F.col("run") == F.col("last")))  # at most two a bucket
    w = Window.partitionBy(*by).orderBy("bucket", "run")
    joined = (F.lag("v").over(w) == F.col("v")) & (F.lag("bucket").over(w) != F.col("bucket"))
    runs = runs.withColumn("chain", F.sum(F.when(joined, 0).otherwise(1)).over(w))
    total = F.sum("n").over(Window.partitionBy(*by, "chain"))
    parts = F.count("*").over(Window.partitionBy(*by, "chain"))
    runs = runs.select(*by, "bucket", "run", total.alias("total"), parts.alias("parts")).filter((F.col("total") >= length) & (F.col("parts") > 1))
    return b.join(runs, [*by, "bucket", "run"], "left_semi").select(*by, "breath_id")


def confirmed_issues(issues: DataFrame, spikes: DataFrame, types: tuple[str, ...] = ("outlier", "flat", "corruption"), block: int = BLOCK) -> DataFrame:
    """``issue_id`` of logged issues of the given types that hold a bad sample.

    Types are compared regardless of case and outer blanks. Issues and bad runs
    meet by recording and block, so a recording with many of both stays cheap.
    """
    runs = spikes.select("recording_id", "block", F.explode("runs").alias("r")).select("recording_id", "block", F.col("r.start_idx").alias("rs"), F.col("r.end_idx").alias("re"))
    span = spikes.groupBy("recording_id").agg(F.max("block").alias("last_block"), F.min("block").alias("first_block"))
    i = issues.select("issue_id", "recording_id", "start_idx", "end_idx", "issue_type").filter(F.lower(F.trim("issue_type")).isin(*types) & (F.col("end_idx") > F.col("start_idx")))
    i = i.dropDuplicates(["issue_id", "recording_id", "start_idx", "end_idx"]).join(span, "recording_id")
    a = F.greatest(F.floor(F.col("start_idx") / block), F.col("first_block"))
    b = F.least(F.floor((F.col("end_idx") - 1) / block), F.col("last_block"))
    i = i.withColumn("a", a).withColumn("b", b).filter("a <= b").withColumn("block", F.explode(F.sequence("a", "b")))
    return i.join(runs, ["recording_id", "block"]).filter((F.col("rs") < F.col("end_idx")) & (F.col("re") > F.col("start_idx"))).select("issue_id").distinct()
