"""Signals as relations: islands, quality, repair, detrending and sliding windows.

The canonical form is ``samples(recording_id, idx, x, rate)``, one row per
sample, NULL for no reading. Ordered work is done in blocks of consecutive
indices, so a recording of any length is spread over many tasks; what crosses
a block's edge is joined from one or two rows a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breathlake.operators.breaths import Cutoff, filter_samples
from breathlake.operators.quantiles import group_quantiles
from breathlake.session import cut

#: Consecutive samples that one task orders at a time.
BLOCK = 1 << 16
KEY = "recording_id"


def finite(c: Column | str) -> Column:
    """NULL in place of NaN and infinities; NULL is the only missing value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def samples_from_windows(windows: DataFrame) -> DataFrame:
    """Each sample of each recording once, from its overlapping windows.

    Copies of a window count once. Where windows disagree the larger reading
    stands; a reading stands before a null.
    """
    w = windows.select(KEY, "window_id", "start_idx", F.col("sampling_rate").alias("rate"), F.col("window_data").cast("array<double>").alias("d")).dropna()
    s = w.select(KEY, "rate", "start_idx", F.posexplode("d").alias("k", "x"))
    return s.groupBy(KEY, (F.col("start_idx") + F.col("k")).alias("idx")).agg(F.max(finite("x")).alias("x"), F.max("rate").alias("rate"))


def _with_recording(samples: DataFrame, per: DataFrame) -> DataFrame:
    """Samples with the row that ``per`` has of their recording.

    Spark sizes samples by the file their windows are packed in, a tenth of them
    and less, so it may take them for the side to broadcast.
    """
    return samples.join(per.hint("shuffle_hash"), KEY)


def recording_shape(samples: DataFrame) -> DataFrame:
    """Duration and sample count: ``n / rate``."""
    return samples.groupBy(KEY).agg(F.count("*").alias("n_samples"), F.max("rate").alias("rate"), F.count("x").alias("n_valid")).withColumn("duration_s", F.try_divide("n_samples", "rate"))


def time_segment(samples: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Samples of ``[start_s, end_s)``; both ends are cut to whole samples towards zero."""
    a, b = (F.floor(F.lit(float(t)) * F.col("rate")) for t in (start_s, end_s))
    return samples.filter((F.col("idx") >= a) & (F.col("idx") < b))


def index_segment(samples: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Samples of ``[start, end)`` by index; negative bounds count from each recording's end, as in a slice."""
    if start >= 0 and (end is None or end >= 0):
        return samples.filter((F.col("idx") >= start) & (F.lit(True) if end is None else F.col("idx") < end))
    s = samples.join(samples.groupBy(KEY).agg((F.max("idx") + 1).alias("_n")), KEY)
    at = lambda v: F.lit(v) if v >= 0 else F.greatest(F.lit(0), F.col("_n") + v)
    s = s.filter(F.col("idx") >= at(start))
    return (s if end is None else s.filter(F.col("idx") < at(end))).drop("_n")


def islands(flagged: DataFrame, by: list[str], idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """Half-open runs ``[start_idx, end_idx)`` of consecutive indices, from the flagged rows alone.

    Runs are found within blocks; those that touch a block's edge, at most two
    a block, are then joined across edges.
    """
    b = flagged.select(*by, F.col(idx).alias("_i"), F.floor(F.col(idx) / block).alias("_b"))
    w = Window.partitionBy(*by, "_b").orderBy("_i")
    b = b.withColumn("_g", F.col("_i") - F.row_number().over(w))
    runs = b.groupBy(*by, "_b", "_g").agg(F.min("_i").alias("start_idx"), (F.max("_i") + 1).alias("end_idx"))
    edge = (F.col("start_idx") % block == 0) | (F.col("end_idx") % block == 0)
    across = Window.partitionBy(*by).orderBy("start_idx")
    e = runs.filter(edge).withColumn("_n", F.when(F.lag("end_idx").over(across) == F.col("start_idx"), 0).otherwise(1))
    e = e.withColumn("_k", F.sum("_n").over(across)).groupBy(*by, "_k").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"))
    return runs.filter(~edge).select(*by, "start_idx", "end_idx").unionByName(e.select(*by, "start_idx", "end_idx"))


def gap_runs(samples: DataFrame, min_s: float = 1.0) -> DataFrame:
    """Runs of missing samples, and of zeros, that last at least ``min_s`` seconds."""
    kinds = [("missing", F.col("x").isNull()), ("zero", F.abs("x") < 1e-10)]
    flagged = samples.select(KEY, "rate", "idx", F.when(kinds[0][1], "missing").when(kinds[1][1], "zero").alias("kind")).filter("kind is not null")
    return islands(flagged, [KEY, "rate", "kind"]).filter((F.col("end_idx") - F.col("start_idx")) / F.col("rate") >= min_s)


def robust_threshold(samples: DataFrame, k: float = 10.0) -> DataFrame:
    """Per recording: centre and largest distance that is no outlier.

    Median and ``k`` unscaled median distances; mean and ``k`` standard
    deviations where that distance is nearly 0.
    """
    m = samples.groupBy(KEY).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    m = m.join(group_quantiles(samples, [KEY], "x", [0.5]).select(KEY, F.get("q", F.lit(0)).alias("median")), KEY)
    away = _with_recording(samples.select(KEY, "x").dropna(), m).select(KEY, F.abs(F.col("x") - F.col("median")).alias("away"))
    d = group_quantiles(away, [KEY], "away", [0.5]).select(KEY, F.get("q", F.lit(0)).alias("mad"))
    flat = F.col("mad") < 1e-10
    return m.join(d, KEY).select(KEY, "mad", F.when(flat, F.col("mean")).otherwise(F.col("median")).alias("center"), (F.when(flat, F.col("sd")).otherwise(F.col("mad")) * k).alias("reach"))


def outlier_runs(samples: DataFrame, k: float = 10.0) -> DataFrame:
    s = _with_recording(samples, robust_threshold(samples, k)).filter(F.abs(F.col("x") - F.col("center")) > F.col("reach"))
    return islands(s, [KEY])


def physical_runs(samples: DataFrame, low: float = -100.0, high: float = 100.0) -> DataFrame:
    return islands(samples.filter((F.col("x") < low) | (F.col("x") > high)), [KEY])


def _with_context(samples: DataFrame, after: Column, block: int) -> DataFrame:
    """Samples by block, those within ``after`` of a block's start also in the block before it."""
    b = F.floor(F.col("idx") / block)
    near = F.col("idx") - b * block < after
    return samples.withColumn("_b", F.explode(F.when(near, F.array(b, b - 1)).otherwise(F.array(b))))


def flat_runs(samples: DataFrame, min_s: float = 5.0, below: float = 0.001, block: int = BLOCK) -> DataFrame:
    """Runs covered by stretches of ``int(min_s * rate)`` samples whose deviation is under ``below``.

    A stretch with a missing sample is none. Longer runs join from overlapping
    stretches, where a sequential scan would extend one stretch at a time.
    """
    n = F.floor(F.lit(min_s) * F.col("rate") + 1e-9).cast("bigint")
    s = _with_context(samples.withColumn("w", n).filter("w >= 2"), F.col("w"), block)
    # a stretch of w samples is the difference of two running sums; values count from the block's mean, which keeps squares small
    level = F.avg("x").over(Window.partitionBy(KEY, "_b"))
    s = s.withColumn("y", F.col("x") - level)
    run = Window.partitionBy(KEY, "_b").orderBy("idx")
    sums = [F.sum(F.coalesce(e, F.lit(0.0))).over(run).alias(n) for n, e in (("s1", F.col("y")), ("s2", F.col("y") * F.col("y")))]
    # no step within a flat stretch exceeds twice its largest distance from the mean; few samples end a stretch without one
    step = F.coalesce(F.abs(F.col("y") - F.lag("y").over(run)) > 2 * below * F.sqrt("w"), F.lit(True))
    s = s.withColumn("big", step).select(KEY, "_b", "idx", "w", "y", F.max(F.when(F.col("big"), F.col("idx"))).over(run).alias("since"), F.count("y").over(run).alias("c"), F.row_number().over(run).alias("n"), *sums)
    # the last sample of a stretch meets its first by index
    last = s.filter(F.col("idx") - F.col("since") >= F.col("w") - 1)
    last = last.select(KEY, "_b", (F.col("idx") - F.col("w") + 1).alias("idx"), "w", F.struct("c", "n", "s1", "s2").alias("e"))
    s = s.join(last.hint("merge"), [KEY, "_b", "w", "idx"]).filter((F.col("e.n") - F.col("n") == F.col("w") - 1) & F.col("y").isNotNull() & (F.col("e.c") - F.col("c") == F.col("w") - 1))
    y = F.col("y")
    mean = (F.col("e.s1") - F.col("s1") + y) / F.col("w")
    var = (F.col("e.s2") - F.col("s2") + y * y) / F.col("w") - mean * mean
    loss = 1e-12 * F.col("e.s2")  # differences of sums lose digits
    s = s.filter(F.floor(F.col("idx") / block) == F.col("_b")).select(KEY, "idx", "w", var.alias("var"), loss.alias("loss")).filter(F.col("var") < below**2 + F.col("loss"))
    sure = F.col("var") < below**2 - F.col("loss")
    # stretches too close to the limit are measured again from their samples
    held = s.filter(~sure).select(KEY, F.col("idx").alias("at"), "w", F.explode(F.sequence("idx", F.col("idx") + F.col("w") - 1)).alias("idx"))
    again = held.join(samples.select(KEY, "idx", "x").hint("merge"), [KEY, "idx"]).groupBy(KEY, "at", "w").agg(F.stddev_pop("x").alias("sd")).filter(F.col("sd") < below)
    out = s.filter(sure).select(KEY, "idx", "w").unionByName(again.select(KEY, F.col("at").alias("idx"), "w"))
    starts = islands(out, [KEY, "w"], "idx", block)  # runs of stretch starts cover w - 1 samples more
    ends = starts.select(KEY, "start_idx", (F.col("end_idx") + F.col("w") - 1).alias("end_idx"))
    return merge_runs(ends)


def merge_runs(runs: DataFrame, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Union of half-open intervals that overlap or touch."""
    w = Window.partitionBy(*by).orderBy("start_idx", "end_idx")
    reach = F.max("end_idx").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = runs.withColumn("_n", F.when(F.col("start_idx") <= reach, 0).otherwise(1)).withColumn("_k", F.sum("_n").over(w))
    return r.groupBy(*by, "_k").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("_k")


def all_issues(samples: DataFrame) -> DataFrame:
    """``recording_id, issue_type, start_idx, end_idx, severity`` of every detector."""
    parts = [("gap", "high", gap_runs(samples)), ("flat", "medium", flat_runs(samples)), ("outlier", "medium", outlier_runs(samples)), ("corruption", "high", physical_runs(samples))]
    out = None
    for kind, severity, df in parts:
        df = df.select(KEY, F.lit(kind).alias("issue_type"), "start_idx", "end_idx", F.lit(severity).alias("severity"))
        out = df if out is None else out.unionByName(df)
    return out


def quality_report(samples: DataFrame, issues: DataFrame, reject: float = 50.0, clean: float = 80.0) -> DataFrame:
    """Share of samples in no issue, and what to do: reject, clean or accept."""
    bad = merge_runs(issues.select(KEY, "start_idx", "end_idx")).groupBy(KEY).agg(F.sum(F.col("end_idx") - F.col("start_idx")).alias("bad"))
    n = issues.groupBy(KEY).agg(F.count("*").alias("n_issues"))
    r = samples.groupBy(KEY).agg(F.count("*").alias("total_samples")).join(bad, KEY, "left").join(n, KEY, "left")
    r = r.select(KEY, "total_samples", (F.col("total_samples") - F.coalesce("bad", F.lit(0))).alias("valid_samples"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))
    p = F.col("valid_samples") / F.col("total_samples") * 100
    return r.withColumn("percent_valid", p).withColumn("recommendation", F.when(p < reject, "reject").when(p < clean, "clean").otherwise("accept"))


def repair(samples: DataFrame, runs: DataFrame, max_s: float = 10.0) -> DataFrame:
    """Short runs are bridged by a straight line, long ones become missing, short ones at an end stay.

    ``runs`` are merged first. Each run looks up its two neighbours by index and
    is then joined back, so nothing is ordered.
    """
    rate = samples.groupBy(KEY).agg(F.max("rate").alias("rate"))
    r = merge_runs(runs).join(rate, KEY)
    at = samples.select(KEY, F.col("idx").alias("_i"), F.col("x").alias("_x"))
    left = at.select(KEY, (F.col("_i") + 1).alias("start_idx"), F.col("_x").alias("a"), F.lit(True).alias("has_a"))
    right = at.select(KEY, F.col("_i").alias("end_idx"), F.col("_x").alias("b"), F.lit(True).alias("has_b"))
    # merges, as Spark underrates the samples and would broadcast them
    r = r.join(left.hint("merge"), [KEY, "start_idx"], "left").join(right.hint("merge"), [KEY, "end_idx"], "left")
    n = F.col("end_idx") - F.col("start_idx")
    short = n <= F.floor(F.lit(max_s) * F.col("rate"))
    mode = F.when(~short, "drop").when(F.col("has_a") & F.col("has_b"), "line")
    r = r.withColumn("mode", mode).filter("mode is not null").withColumn("n", n)
    r = r.select(KEY, "mode", "start_idx", "a", "b", "n", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)).alias("idx"))
    line = F.col("a") + (F.col("b") - F.col("a")) * (F.col("idx") - F.col("start_idx") + 1) / (F.col("n") + 1)
    new = r.select(KEY, "idx", F.when(F.col("mode") == "line", line).alias("new_x"), F.lit(True).alias("changed"))
    s = samples.join(new.hint("merge"), [KEY, "idx"], "left")
    return s.select(KEY, "idx", "rate", F.when(F.col("changed"), F.col("new_x")).otherwise(F.col("x")).alias("x"), F.coalesce("changed", F.lit(False)).alias("repaired"))


def neighbours(points: DataFrame, ask: DataFrame, by: list[str], pos: str, block: int = BLOCK) -> DataFrame:
    """For each asked position the two nearest points before and after it.

    ``points(by, pos, x)``, ``ask(by, pos)``. Both lie on one timeline in
    blocks; what a block lacks comes from the blocks before and after it, of
    which only the first and last two points are kept.
    """
    p = points.select(*by, F.col(pos).alias("_p"), F.struct(F.col(pos).alias("p"), F.col("x").alias("x")).alias("s"))
    q = ask.select(*by, F.col(pos).alias("_p"), F.lit(None).cast(p.schema["s"].dataType).alias("s"))
    both = p.unionByName(q).withColumn("_b", F.floor(F.col("_p") / block))
    up, down = (Window.partitionBy(*by, "_b").orderBy(o) for o in (F.col("_p").asc(), F.col("_p").desc()))

    def two(w: Window, name: str) -> list[Column]:
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return [F.last("s", True).over(before).alias(f"{name}1"), F.last(F.col(f"_{name}"), True).over(before).alias(f"{name}2")]

    # the point before each point, so that two of them can be carried along
    both = both.withColumn("_l", F.when(F.col("s").isNotNull(), F.last("s", True).over(up.rowsBetween(Window.unboundedPreceding, -1))))
    both = both.withColumn("_r", F.when(F.col("s").isNotNull(), F.last("s", True).over(down.rowsBetween(Window.unboundedPreceding, -1))))
    here = both.select(*by, "_p", "_b", "s", *two(up, "l"), *two(down, "r")).filter("s is null")
    ends = p.withColumn("_b", F.floor(F.col("_p") / block))
    rank_l = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(F.desc("_p")))
    rank_r = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_p"))
    ends = ends.withColumn("nl", rank_l).withColumn("nr", rank_r).filter("nl <= 2 or nr <= 2")
    ends = ends.groupBy(*by, "_b").agg(F.sort_array(F.collect_list(F.when(F.col("nl") <= 2, F.col("s")))).alias("last"), F.sort_array(F.collect_list(F.when(F.col("nr") <= 2, F.col("s")))).alias("first"))
    blocks = ends.select(*by, "_b", "last", "first").unionByName(here.select(*by, "_b").distinct(), allowMissingColumns=True)
    blocks = blocks.groupBy(*by, "_b").agg(F.first("last", True).alias("last"), F.first("first", True).alias("first"))
    wb, wf = Window.partitionBy(*by).orderBy("_b"), Window.partitionBy(*by).orderBy(F.desc("_b"))
    # two blocks with points suffice, each has at least one
    prev1 = F.last("last", True).over(wb.rowsBetween(Window.unboundedPreceding, -1))
    next1 = F.last("first", True).over(wf.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("p1", prev1).withColumn("n1", next1)
    blocks = blocks.withColumn("_pl", F.when(F.col("last").isNotNull(), F.col("p1"))).withColumn("_nf", F.when(F.col("first").isNotNull(), F.col("n1")))
    prev2 = F.last("_pl", True).over(wb.rowsBetween(Window.unboundedPreceding, -1))
    next2 = F.last("_nf", True).over(wf.rowsBetween(Window.unboundedPreceding, -1))
    none = F.array().cast(ends.schema["last"].dataType)
    side = blocks.select(*by, "_b", F.concat(F.coalesce(prev2, none), F.coalesce("p1", none)).alias("pl"), F.concat(F.coalesce("n1", none), F.coalesce(next2, none)).alias("nr"))
    h = here.join(side.hint("shuffle_hash"), [*by, "_b"])  # few rows a block against any number asked
    near_l = F.reverse(F.concat(F.col("pl"), F.array_compact(F.array("l2", "l1"))))
    near_r = F.concat(F.array_compact(F.array("r1", "r2")), F.col("nr"))
    h = h.withColumn("L", near_l).withColumn("R", near_r)
    pick = lambda a, i: F.get(a, F.lit(i))
    return h.select(*by, F.col("_p").alias(pos), pick("L", 0).alias("l1"), pick("L", 1).alias("l2"), pick("R", 0).alias("r1"), pick("R", 1).alias("r2"))


def interpolate(samples: DataFrame, bad: Column, block: int = BLOCK) -> DataFrame:
    """Bad samples replaced on the line through their neighbours, extrapolated at the ends.

    Neighbours are the nearest readings that are not bad; beyond the first or
    last of them the line through the nearest two goes on. Fewer than two
    readings leave the sample as it is.
    """
    s = samples.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    good = s.filter("not _bad and x is not null")
    ask = s.filter("_bad")
    near = neighbours(good.select(KEY, "idx", "x"), ask.select(KEY, "idx"), [KEY], "idx", block)
    a = F.coalesce(F.when(F.col("l1").isNotNull() & F.col("r1").isNotNull(), F.col("l1")), F.when(F.col("l1").isNotNull(), F.col("l2")), F.col("r1"))
    b = F.coalesce(F.when(F.col("l1").isNotNull() & F.col("r1").isNotNull(), F.col("r1")), F.when(F.col("l1").isNotNull(), F.col("l1")), F.col("r2"))
    near = near.select(KEY, "idx", a.alias("a"), b.alias("b")).filter("a is not null and b is not null")
    y = F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("idx") - F.col("a.p")) / (F.col("b.p") - F.col("a.p"))
    new = near.select(KEY, "idx", y.alias("new_x"))
    out = s.join(new.hint("merge"), [KEY, "idx"], "left")
    return out.select(KEY, "idx", "rate", F.coalesce("new_x", "x").alias("x"), F.col("new_x").isNotNull().alias("replaced"))


def remove_outliers(samples: DataFrame, k: float = 5.0) -> DataFrame:
    """Samples beyond ``k`` population deviations from the mean, interpolated."""
    m = samples.groupBy(KEY).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return interpolate(_with_recording(samples, m), F.abs(F.col("x") - F.col("m")) > k * F.col("sd"))


def fill_missing(samples: DataFrame) -> DataFrame:
    return interpolate(samples, F.col("x").isNull())


def detrend(samples: DataFrame, method: str = "linear") -> DataFrame:
    """Least-squares line on the index, or the mean, taken off each recording; other methods are an error."""
    if method not in ("linear", "constant"):
        raise ValueError(f"unknown method {method}")
    # sums about the first index keep the squares small
    fit = samples.groupBy(KEY).agg(F.regr_slope("x", F.col("idx").cast("double")).alias("slope"), F.regr_intercept("x", F.col("idx").cast("double")).alias("base"), F.avg("x").alias("m"))
    trend = F.col("base") + F.col("slope") * F.col("idx") if method == "linear" else F.col("m")
    return _with_recording(samples, fit).select(KEY, "idx", "rate", (F.col("x") - F.coalesce(trend, F.col("m"))).alias("x"))


def sliding_windows(samples: DataFrame, size_s: float, overlap_s: float) -> DataFrame:
    """Each sample once for every complete window that holds it.

    ``W = int(size * rate)``, step ``W - int(overlap * rate)``; a last window
    that is not full is dropped. Rows are expanded by arithmetic on the index
    and counted per window, so recordings need not be ordered or collected.
    """
    if not size_s > 0 or not 0 <= overlap_s < size_s:
        raise ValueError("size must be positive and overlap in [0, size)")
    w = F.floor(F.lit(float(size_s)) * F.col("rate")).cast("bigint")
    step = w - F.floor(F.lit(float(overlap_s)) * F.col("rate")).cast("bigint")
    s = samples.withColumn("w", w).withColumn("step", step).filter("w > 0 and step > 0")
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - F.col("w") + 1) / F.col("step")).cast("bigint"))
    last = F.floor(F.col("idx") / F.col("step")).cast("bigint")
    return s.filter(first <= last).select(KEY, "idx", "x", "rate", "w", "step", F.explode(F.sequence(first, last)).alias("window_index"))


def window_stats(samples: DataFrame, size_s: float, overlap_s: float) -> DataFrame:
    """Moments of each complete window."""
    e = sliding_windows(samples, size_s, overlap_s)
    g = e.groupBy(KEY, "window_index").agg(F.max("w").alias("w"), F.max("step").alias("step"), F.max("rate").alias("rate"), F.count("*").alias("n"), F.count("x").alias("n_valid"), F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("sd_x"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    g = g.filter("n = w").withColumn("start_idx", F.col("window_index") * F.col("step"))
    return g.select(KEY, "window_index", "start_idx", (F.col("start_idx") / F.col("rate")).alias("start_time"), ((F.col("start_idx") + F.col("w")) / F.col("rate")).alias("end_time"), "n_valid", "mean_x", "sd_x", "min_x", "max_x")


def window_count(shape: DataFrame, size_s: float, overlap_s: float) -> DataFrame:
    """How many windows a recording of ``n_samples`` gives; 0 where it is too short."""
    w = F.floor(F.lit(float(size_s)) * F.col("rate"))
    step = w - F.floor(F.lit(float(overlap_s)) * F.col("rate"))
    n = F.floor((F.col("n_samples") - w) / step) + 1
    return shape.withColumn("n_windows", F.when((F.col("n_samples") >= w) & (step > 0), n).otherwise(0).cast("bigint"))


def sign_segments(samples: DataFrame, threshold: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Runs above and below the threshold, with trapezoid volume, duration, main peak and latency."""
    side = F.when(F.col("x") > threshold, 1).when(F.col("x") < -threshold, -1)
    s = samples.withColumn("side", side).filter("side is not null")
    runs = islands(s, [KEY, "side"], "idx", block)
    # samples meet their run by block: a run spans few blocks, a block holds bounded runs
    r = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_idx") / 256), F.floor((F.col("end_idx") - 1) / 256))))
    s = s.withColumn("_b", F.floor(F.col("idx") / 256))
    j = s.join(r, [KEY, "side", "_b"]).filter((F.col("idx") >= F.col("start_idx")) & (F.col("idx") < F.col("end_idx")))
    edge = F.when((F.col("idx") == F.col("start_idx")) | (F.col("idx") == F.col("end_idx") - 1), 0.5).otherwise(1.0)
    single = F.col("end_idx") - F.col("start_idx") == 1
    main = F.struct(F.abs("x").alias("size"), (-F.col("idx")).alias("first"))
    g = j.groupBy(KEY, "side", "start_idx", "end_idx").agg(
        F.max("rate").alias("rate"), F.sum(F.when(single, 0.0).otherwise(F.col("x") * edge)).alias("area"), F.max_by("x", main).alias("peak_value"), F.max_by("idx", main).alias("peak_idx"))
    return g.select(KEY, "side", "start_idx", "end_idx", (F.col("area") / F.col("rate")).alias("volume"), ((F.col("end_idx") - 1 - F.col("start_idx")) / F.col("rate")).alias("duration"), "peak_value", "peak_idx", ((F.col("peak_idx") - F.col("start_idx")) / F.col("rate")).alias("latency"))


def clean(samples: DataFrame, method: str | None = "linear", k: float = 5.0, cutoff: Cutoff | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned samples and the quality report with what was done to each recording.

    Materialises its stages. Recordings to reject drop out of the samples; those to clean have their
    issues repaired; then outliers are interpolated and, for detrending, gaps
    filled. ``method`` None leaves trend and gaps. ``cutoff`` filters what remains, last of all.
    """
    samples = cut(samples)  # each stage reads the one before several times
    issues = cut(all_issues(samples))
    report = cut(quality_report(samples, issues))
    mend = report.filter("recommendation = 'clean'").select(KEY)
    repaired = repair(samples.join(mend, KEY, "left_semi"), issues.join(mend, KEY, "left_semi")).select(KEY, "idx", "x", "rate")
    fine = samples.join(report.filter("recommendation = 'accept'").select(KEY), KEY, "left_semi").select(KEY, "idx", "x", "rate")
    out = cut(remove_outliers(cut(fine.unionByName(repaired)), k).select(KEY, "idx", "x", "rate"))
    if method:
        out = detrend(cut(fill_missing(out).select(KEY, "idx", "x", "rate")), method)
    if cutoff:
        out = filter_samples(cut(out.select(KEY, "idx", "x", "rate")), cutoff)
    status = F.when(F.col("recommendation") == "reject", "rejected").when(F.col("recommendation") == "clean", "repaired").otherwise("ok")
    return out, report.withColumn("status", status)
