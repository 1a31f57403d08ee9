"""Group comparison, effect sizes, corrections and correlations as aggregations.

Everything runs over the long form ``(feature, label, value)`` at once, one job
for all features. Ranks are exact and need no single ordered partition: values
are counted first, put into ranges of about equal size and ranked within them.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breathlake.functions import distributions as dist
from breathlake.operators.quantiles import group_quantiles
from breathlake.session import cut

#: Most ranges of a group within which ranks are counted.
RANGES = 1024
#: Rows of a wide table up to which one task may hold a feature.
WHOLE_ROWS = 1_000_000
#: Distinct values of a range where a group is to have several.
PER_RANGE = 50_000


def ranks(long: DataFrame, by: list[str], value: str = "value", ranges: int = RANGES, weight: str | None = None, per_range: int = PER_RANGE) -> DataFrame:
    """``by, value, n, rank``: each distinct value with its count (or sum of ``weight``) and its tie-averaged rank.

    A group has a range for each ``per_range`` distinct values, at most ``ranges``; their number changes no rank.
    """
    vc = long.dropna(subset=[value]).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    large = vc.groupBy(*by).agg(F.count("*").alias("_d")).filter(F.col("_d") >= 2 * per_range)  # most groups need no cuts
    every = F.ceil(F.lit(ranges) / F.floor(F.col("_d") / per_range)).cast("int")
    cuts = vc.join(large, by).groupBy(*by, "_d").agg(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10 * ranges)).alias("_c"))
    cuts = cuts.select(*by, F.array_distinct(F.filter("_c", lambda c, i: (i + 1) % every == 0)).alias("_cuts"))
    vc = vc.join(cuts, by, "left").withColumn("_r", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))).drop("_cuts")
    offsets = vc.groupBy(*by, "_r").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    offsets = offsets.select(*by, "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_r").orderBy(value)
    below = F.sum("n").over(inside) - F.col("n")
    return vc.join(offsets, [*by, "_r"]).select(*by, value, "n", (F.col("_off") + below + (F.col("n") + 1) / 2).alias("rank"))


def moments(long: DataFrame, median: bool = False) -> DataFrame:
    """Per feature and label: n, mean, deviations and variance, and on request the median."""
    d = long.filter("value is not null and label is not null")
    m = d.groupBy("feature", "label").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.var_samp("value").alias("var"))
    if not median:
        return m
    return m.join(group_quantiles(d, ["feature", "label"], "value", [0.5]).select("feature", "label", F.get("q", F.lit(0)).alias("median")), ["feature", "label"])


def _two(m: DataFrame, a, b, cols: tuple[str, ...]) -> DataFrame:
    return m.groupBy("feature").agg(*[F.max(F.when(F.col("label") == g, F.col(c))).alias(f"{c}{i}") for i, g in ((1, a), (2, b)) for c in cols])


def welch_t(long: DataFrame, a, b, equal_var: bool = False) -> DataFrame:
    """Statistic, degrees of freedom and p; NULL where a group has fewer than two values."""
    t = _two(moments(long), a, b, ("n", "mean", "var"))
    n1, n2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "var1", "var2"))
    if equal_var:
        df = n1 + n2 - 2
        se2 = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, df) * (1 / n1 + 1 / n2)
    else:
        se2 = v1 / n1 + v2 / n2
        df = F.try_divide(se2 * se2, (v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1))
    enough = (n1 >= 2) & (n2 >= 2)
    t = t.select("feature", "n1", "n2", F.when(enough, F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(se2))).alias("statistic"), F.when(enough, df).alias("df"))
    return t.withColumn("p_value", _p("t", "statistic", "df"))


def _p(kind: str, *args: str) -> Column:
    """A tail probability of result rows, by pure Python."""
    f = {"t": dist.t_two_sided, "f": dist.f_tail, "chi2": dist.chi2_tail, "z": lambda z: min(1.0, 2 * dist.normal_tail(abs(z)))}[kind]

    def run(*x):
        return None if any(v is None or v != v for v in x) else float(f(*x))

    return F.udf(run, "double")(*[F.col(a).cast("double") for a in args])


def _mann_whitney_p(u, z, n1, n2, ties, alternative: str = "two-sided") -> float | None:
    if u is None:
        return None
    if alternative != "two-sided":
        return 1.0 if z is None else dist.normal_tail(z)
    if ties == 0 and min(n1, n2) <= 8 and max(n1, n2) < 100:
        return dist.mann_whitney_exact(u, n1, n2)
    return 1.0 if z is None else min(1.0, 2 * dist.normal_tail(z))


def mann_whitney(long: DataFrame, a, b, alternative: str = "two-sided") -> DataFrame:
    """U of group ``a``, its z with tie and continuity correction, the p and rank-biserial effect.

    ``alternative`` ``greater`` or ``less`` is about group ``a``; their p is the normal one.

    p is exact without ties where a group has at most 8 values (and both fewer
    than 100), else normal. All values equal give p = 1.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"unknown alternative {alternative}")
    two = long.filter(F.col("label").isin([a, b]))
    r = ranks(two, ["feature"])
    counts = two.dropna(subset=["value"]).groupBy("feature", "value").agg(F.count(F.when(F.col("label") == a, 1)).alias("c1"), F.count(F.when(F.col("label") == b, 1)).alias("c2"))
    g = r.join(counts, ["feature", "value"]).groupBy("feature").agg(
        F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.sum(F.col("rank") * F.col("c1")).alias("r1"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    g = g.withColumn("statistic", F.when((n1 > 0) & (n2 > 0), F.col("r1") - n1 * (n1 + 1) / 2))
    var = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    off = F.col("statistic") - n1 * n2 / 2
    dev = {"two-sided": F.greatest(F.abs(off) - 0.5, F.lit(0.0)), "greater": off - 0.5, "less": -off - 0.5}[alternative]
    g = g.withColumn("z", F.when(var > 0, dev / F.sqrt(F.when(var > 0, var))))
    g = g.withColumn("effect_size", 1 - F.try_divide(2 * F.col("statistic"), n1 * n2))

    def p(u, z, n1, n2, ties):
        return _mann_whitney_p(u, z, n1, n2, ties, alternative)

    return g.select("feature", "n1", "n2", "statistic", "z", "effect_size", F.udf(p, "double")("statistic", "z", "n1", "n2", "ties").alias("p_value"))


def kruskal(long: DataFrame) -> DataFrame:
    """Tie-corrected H over all labels; NULL with fewer than two groups."""
    long = long.filter("label is not null")
    r = ranks(long, ["feature"])
    ties = r.groupBy("feature").agg(F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    per = long.dropna(subset=["value"]).groupBy("feature", "label", "value").agg(F.count("*").alias("c")).join(r.select("feature", "value", "rank"), ["feature", "value"])
    g = per.groupBy("feature", "label").agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("c")).alias("r"))
    s = g.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")).join(ties, "feature")
    n = F.col("n")
    h = F.try_divide(12 * F.col("q"), n * (n + 1)) - 3 * (n + 1)
    h = F.try_divide(h, 1 - F.try_divide(F.col("ties"), n * n * n - n))
    s = s.select("feature", "k", F.when(F.col("k") >= 2, h).alias("statistic"), (F.col("k") - 1).alias("df"))
    return s.withColumn("p_value", F.coalesce(_p("chi2", "statistic", "df"), F.when(F.col("k") >= 2, F.lit(1.0))))


def anova(long: DataFrame) -> DataFrame:
    """F and eta squared from group moments; groups of one value are left out of F, not of eta squared."""
    m = moments(long)

    def between(m: DataFrame) -> DataFrame:
        t = m.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.coalesce(F.col("var"), F.lit(0.0)) * (F.col("n") - 1)).alias("ssw"))
        grand = m.join(t.select("feature", (F.col("s") / F.col("n")).alias("grand")), "feature")
        ssb = grand.groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"))
        return t.join(ssb, "feature")

    f = between(m.filter("n >= 2"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = f.select("feature", "k", F.when(d1 >= 1, F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2))).alias("statistic"), d1.alias("df1"), d2.alias("df2"))
    e = between(m).select("feature", F.coalesce(F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")), F.lit(0.0)).alias("eta_squared"))
    return f.join(e, "feature").withColumn("p_value", _p("f", "statistic", "df1", "df2"))


def effect_sizes(long: DataFrame, a, b) -> DataFrame:
    """Cohen's d (pooled), Hedges' g and Glass's delta (deviation of ``b``); 0 where the deviation is 0."""
    t = _two(moments(long), a, b, ("n", "mean", "var"))
    n = F.col("n1") + F.col("n2")
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), n - 2))
    diff = F.col("mean1") - F.col("mean2")
    d = F.coalesce(F.try_divide(diff, pooled), F.when(pooled == 0, 0.0))
    sd2 = F.sqrt("var2")
    return t.select("feature", d.alias("cohens_d"), (d * (1 - F.try_divide(F.lit(3.0), 4 * n - 9))).alias("hedges_g"), F.coalesce(F.try_divide(diff, sd2), F.when(sd2 == 0, 0.0)).alias("glass_delta"))


def adjust_p(df: DataFrame, p: str = "p_value", method: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """``p_adjusted`` and ``significant`` over all rows with a p; rows without one stay NULL.

    The rows are test results, one per feature, so one ordered window holds them.
    """
    m = F.count(p).over(Window.partitionBy())
    up = Window.partitionBy(F.col(p).isNull()).orderBy(p, *[c for c in ("feature",) if c in df.columns])
    rank = F.row_number().over(up)
    x = F.col(p)
    if method == "bonferroni":
        out = df.withColumn("p_adjusted", F.least(x * m, F.lit(1.0)))
    elif method == "sidak":
        out = df.withColumn("p_adjusted", 1 - F.pow(1 - x, m))
    elif method == "holm":
        out = df.withColumn("_s", x * (m - rank + 1)).withColumn("p_adjusted", F.least(F.max("_s").over(up), F.lit(1.0))).drop("_s")
    elif method in ("fdr_bh", "fdr_by"):
        down = Window.partitionBy(F.col(p).isNull()).orderBy(F.desc("_r"))
        out = df.withColumn("_r", rank).withColumn("_m", m)
        if method == "fdr_by":
            out = out.withColumn("_c", F.sum(1 / F.col("_r")).over(Window.partitionBy(F.col(p).isNull())))
        else:
            out = out.withColumn("_c", F.lit(1.0))
        out = out.withColumn("_s", x * F.col("_m") * F.col("_c") / F.col("_r")).withColumn("p_adjusted", F.least(F.min("_s").over(down), F.lit(1.0))).drop("_r", "_m", "_c", "_s")
    else:
        raise ValueError(f"unknown method {method}")
    out = out.withColumn("p_adjusted", F.when(x.isNotNull(), F.col("p_adjusted")))
    return out.withColumn("significant", F.col("p_adjusted") < alpha)


def compare_binary(long: DataFrame, a, b, test: str = "mannwhitney", correction: str | None = "fdr_bh") -> DataFrame:
    """One row per feature: both groups' moments, statistic, p, effect size and correction."""
    t = _two(moments(long, True), a, b, ("n", "mean", "std", "median"))
    if test == "mannwhitney":
        r = mann_whitney(long, a, b).select("feature", "statistic", "p_value", "effect_size")
    elif test == "ttest":
        r = welch_t(long, a, b).select("feature", "statistic", "p_value").join(effect_sizes(long, a, b).select("feature", F.col("cohens_d").alias("effect_size")), "feature")
    else:
        raise ValueError(f"unknown test {test}")
    out = t.join(r, "feature").withColumn("test_used", F.lit(test))
    return adjust_p(out, method=correction) if correction else out


def _two_whole(x: np.ndarray, y: np.ndarray) -> dict:
    """``compare_binary`` by Mann-Whitney of one feature's values in both groups."""
    out: dict = {}
    for i, v in ((1, x), (2, y)):
        real = v[~np.isnan(v)]  # moments take NaN as Spark does, quantiles and ranks leave it out
        d = v - v[:1]
        some = len(v) > 0
        out |= {f"n{i}": len(v) if some else None, f"mean{i}": float(v[0] + d.mean()) if some else None, f"std{i}": float(d.std()) if some else None, f"median{i}": float(np.median(real)) if len(real) else None}
    x, y = x[~np.isnan(x)], y[~np.isnan(y)]
    n1, n2 = float(len(x)), float(len(y))
    n = n1 + n2
    _, at, count = np.unique(np.concatenate([x, y]), return_inverse=True, return_counts=True)
    count = count.astype(float)
    rank = np.cumsum(count) - (count - 1) / 2
    ties = float((count**3 - count).sum())
    u = float(rank[at[: len(x)]].sum()) - n1 * (n1 + 1) / 2 if n1 and n2 else None
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))) if n > 1 else 0.0
    z = max(abs(u - n1 * n2 / 2) - 0.5, 0.0) / var**0.5 if u is not None and var > 0 else None
    return out | {"statistic": u, "p_value": _mann_whitney_p(u, z, len(x), len(y), ties), "effect_size": None if u is None else 1 - 2 * u / (n1 * n2)}


_TWO = "feature string, " + ", ".join(f"n{i} bigint, mean{i} double, std{i} double, median{i} double" for i in (1, 2)) + ", statistic double, p_value double, effect_size double"


def compare_binary_whole(rows: DataFrame, names: list[str], label: str, a, b, correction: str | None = "fdr_bh") -> DataFrame:
    """``compare_binary`` by Mann-Whitney from the wide form, all values of a feature in one task.

    For tables of few rows: values travel in arrays, a feature's of one batch
    together, in place of a row each.
    """
    d = rows.filter(F.col(label).isin([a, b])).select((F.col(label) == F.lit(a)).alias("_a"), *[F.col(c).cast("double").alias(c) for c in names])
    packed = pa.schema([("feature", pa.string()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            parts: tuple[list, list] = ([], [])
            for j in range(len(names)):
                c = batch.column(j + 1)
                known = c.is_valid().to_numpy(zero_copy_only=False)
                v = c.to_numpy(zero_copy_only=False)
                for side, k in zip(parts, (first & known, ~first & known)):
                    side.append(v[k])
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, s)]), pa.int32()), pa.array(np.concatenate(s))) for s in parts]
            yield pa.RecordBatch.from_arrays([pa.array(names), *lists], schema=packed)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            x, y = (np.concatenate([h.column(i).flatten().to_numpy(zero_copy_only=False) for h in held]) for i in (1, 2))
            one = {"feature": held[0].column(0)[0].as_py()} | _two_whole(x, y)
            return pa.RecordBatch.from_pylist([one] if len(x) + len(y) else [], schema=result)

        for batch in batches:
            for i in range(batch.num_rows):
                if held and held[0].column(0)[0] != batch.column(0)[i]:
                    yield row()
                    held = []
                held.append(batch.slice(i, 1))
        if held:
            yield row()

    result = pa.schema([(c, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[t]) for c, t in (e.split() for e in _TWO.split(", "))])
    p = d.mapInArrow(pack, "feature string, x array<double>, y array<double>").repartition("feature").sortWithinPartitions("feature")
    out = p.mapInArrow(test, _TWO).withColumn("test_used", F.lit("mannwhitney"))
    return adjust_p(out, method=correction) if correction else out


def compare_multi(long: DataFrame, parametric: bool = False, correction: str | None = "fdr_bh") -> DataFrame:
    """One row per feature over all labels; per-group moments as an array in label order."""
    an = anova(long)
    r = an.select("feature", "statistic", "p_value") if parametric else kruskal(long).select("feature", "statistic", "p_value")
    g = moments(long).groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("label", "mean", "std", "n"))).alias("groups"), F.count("*").alias("n_groups"))
    out = r.join(an.select("feature", F.col("eta_squared").alias("effect_size")), "feature").join(g, "feature").withColumn("test_used", F.lit("anova" if parametric else "kruskal"))
    return adjust_p(out, method=correction) if correction else out


# --- correlations -----------------------------------------------------------------------


def correlation_matrix(df: DataFrame, features: list[str], method: str = "pearson") -> DataFrame:
    """``feature_a, feature_b, r`` of all pairs a < b, complete by pair; ``pearson`` in one aggregation, ``spearman``, ``kendall``."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    if method != "pearson":
        num = lambda c: F.col(c).cast("double")
        each = F.array(*[F.struct(F.lit(k).alias("feature"), num(a).alias("value"), num(b).alias("y")) for k, (a, b) in enumerate(pairs)])
        r = _correlate(df.select(F.inline(each)).dropna(), method, least=2)
        names = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "feature int, feature_a string, feature_b string")
        return names.join(r, "feature", "left").select("feature_a", "feature_b", F.col("correlation").alias("r"))
    # values count from their column's mean, which keeps squares small; matrix products give the sums of all pairs at once
    mean = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()  # one row
    x = df.select(F.array(*[F.coalesce(F.col(c).cast("double") - F.lit(mean[c] or 0.0), F.lit(float("nan"))) for c in features]).alias("x"))
    k = len(features)
    names = ["n", "x", "y", "xx", "yy", "xy"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, k, k))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            m = np.isfinite(v).astype(float)
            v = np.where(m > 0, v, 0.0)
            total += np.stack([m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v])
        a, b = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.array(t[a, b]) for t in total]], names=["a", "b", *names])

    g = x.mapInArrow(sums, "a long, b long, " + ", ".join(f"{c} double" for c in names)).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names])
    cov = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n"))
    vx, vy = (F.col(2 * c) - F.try_divide(F.col(c) * F.col(c), F.col("n")) for c in "xy")
    r = F.try_divide(cov, F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy)))
    name = lambda c: F.get(F.array(*[F.lit(f) for f in features]), F.col(c).cast("int"))
    return g.select(name("a").alias("feature_a"), name("b").alias("feature_b"), r.alias("r"))


def ranked(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Each feature replaced by its tie-averaged rank."""
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in features]).unpivot([key], features, "feature", "value")
    r = long.join(ranks(long, ["feature"]).drop("n"), ["feature", "value"])
    return r.groupBy(key).pivot("feature", features).agg(F.first("rank"))


def outcome_correlation(df: DataFrame, features: list[str], outcome: str, method: str = "pearson", key: str | None = None) -> DataFrame:
    """Each feature against the outcome, complete by pair: r, |r|, n, and p by t with n - 2 degrees (Kendall's by its own law).

    Fewer than 3 pairs give NULL. Spearman ranks within the complete pairs.
    """
    long = df.filter(F.col(outcome).isNotNull()).select(F.col(outcome).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["y"], features, "feature", "value").dropna()
    return _correlate(long, method)


def _correlate(long: DataFrame, method: str, least: int = 3) -> DataFrame:
    """``outcome_correlation`` of complete ``feature, value, y``."""
    if method == "kendall":
        k = kendall(long)
        enough = F.col("n") >= least
        return k.select("feature", "n", F.when(enough, F.col("tau")).alias("correlation"), F.when(enough, F.abs("tau")).alias("abs_correlation"), F.when(enough, F.col("p_value")).alias("p_value"))
    if method == "spearman":
        rx = ranks(long, ["feature"]).select("feature", "value", F.col("rank").alias("rx"))
        ry = ranks(long, ["feature"], "y").select("feature", "y", F.col("rank").alias("ry"))
        c = long.groupBy("feature", "value", "y").agg(F.count("*").alias("w")).join(rx, ["feature", "value"]).join(ry, ["feature", "y"])
        w, x, y = F.col("w"), F.col("rx"), F.col("ry")
    elif method == "pearson":
        c, w, x, y = long, F.lit(1), F.col("value"), F.col("y")
    else:
        raise ValueError(f"unknown method {method}")
    mean = c.groupBy("feature").agg((F.sum(w * x) / F.sum(w)).alias("mx"), (F.sum(w * y) / F.sum(w)).alias("my"))
    c = c.join(mean, "feature")
    dx, dy = x - F.col("mx"), y - F.col("my")
    g = c.groupBy("feature").agg(F.sum(w).alias("n"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dx * dx).alias("sxx"), F.sum(w * dy * dy).alias("syy"))
    r = F.when(F.col("n") >= least, F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy"))))
    g = g.select("feature", "n", r.alias("correlation")).withColumn("abs_correlation", F.abs("correlation"))
    g = g.withColumn("_df", F.col("n") - 2).withColumn("_t", F.col("correlation") * F.sqrt(F.try_divide(F.col("_df"), F.greatest(1 - F.col("correlation") * F.col("correlation"), F.lit(1e-300)))))
    return g.withColumn("p_value", _p("t", "_t", "_df")).drop("_t", "_df")


def kendall(long: DataFrame) -> DataFrame:
    """Exact Kendall's tau-b of ``value`` and ``y`` by feature: ``feature, n, tau, p_value``.

    Two values differ first at some bit of their positions in order. For each bit,
    rows that agree above it fall into a lower and an upper half, and the rank sum
    of the upper half by ``y`` says how many more of its pairs are concordant than
    discordant. So each row counts once a bit and no pairs are built.
    """
    c = long.select("feature", F.col("value").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().groupBy("feature", "x", "y").agg(F.count("*").alias("c"))
    c = cut(c)
    at = ranks(c.select("feature", "x").distinct(), ["feature"], "x").select("feature", "x", F.col("rank").cast("bigint").alias("_at"))
    bits = int(c.select("feature", "x").distinct().groupBy("feature").count().agg(F.max("count")).first()[0] or 1).bit_length()  # one number
    d = c.join(at, ["feature", "x"]).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    up = F.expr("shiftright(_at, _bit) & 1")
    g = d.groupBy("feature", "_bit", F.expr("shiftright(_at, _bit + 1)").alias("_above"), "y").agg(F.sum("c").alias("_w"), F.sum(F.col("c") * up).alias("_up"))
    by = ["feature", "_bit", "_above"]
    sides = g.groupBy(*by).agg(F.sum("_w").alias("_all"), F.sum("_up").alias("_ups")).filter("_ups > 0 and _ups < _all").select(*by)
    g = cut(g.join(sides, by))  # halves without a counterpart have no pairs
    r = g.join(ranks(g, by, "y", weight="_w").select(*by, "y", "rank"), [*by, "y"]).groupBy(*by).agg(F.sum(F.col("_up") * F.col("rank")).alias("s"), F.sum("_up").cast("double").alias("u"), F.sum("_w").cast("double").alias("w"))
    u, w = F.col("u"), F.col("w")
    num = r.groupBy("feature").agg(F.sum(2 * F.col("s") - u * (u + 1) - (w - u) * u).alias("num"))

    def ties(k: str) -> DataFrame:
        t = F.col("t")
        sums = (t * (t - 1) / 2, t * (t - 1) * (t - 2), t * (t - 1) * (2 * t + 5))
        return c.groupBy("feature", k).agg(F.sum("c").cast("double").alias("t")).groupBy("feature").agg(*[F.sum(e).alias(f"{k}{i}") for i, e in enumerate(sums)])

    all_ = c.groupBy("feature").agg(F.sum("c").alias("n")).join(ties("x"), "feature").join(ties("y"), "feature").join(num, "feature", "left").withColumn("num", F.coalesce("num", F.lit(0.0)))
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    all_ = all_.withColumn("tau", F.try_divide("num", F.sqrt((n0 - F.col("x0")) * (n0 - F.col("y0")))))
    return all_.select("feature", "n", "tau", F.udf(dist.kendall_two_sided, "double")("n", "num", "x0", "x1", "x2", "y0", "y1", "y2").alias("p_value"))


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two columns and its p: one row."""
    return kendall(df.select(F.lit("").alias("feature"), F.col(x).alias("value"), F.col(y).alias("y"))).select("tau", "p_value")


def correlated_pairs(matrix: DataFrame, threshold: float) -> DataFrame:
    return matrix.filter(F.abs("r") >= threshold).withColumn("abs_r", F.abs("r"))


def drop_correlated(matrix: DataFrame, threshold: float) -> DataFrame:
    """Second members of every pair beyond the threshold, whether or not the first is dropped too."""
    return matrix.filter(F.abs("r") > threshold).select(F.col("feature_b").alias("feature")).distinct()


def greedy_uncorrelated(matrix: DataFrame, features: list[str], threshold: float = 0.95) -> list[str]:
    """In column order, features not correlated with one already kept; runs over k x k results."""
    near = {(r["feature_a"], r["feature_b"]) for r in matrix.filter(F.abs("r") >= threshold).collect()}
    kept: list[str] = []
    for f in features:
        if not any((k, f) in near or (f, k) in near for k in kept):
            kept.append(f)
    return kept
