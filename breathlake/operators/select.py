"""Feature selection over result rows, and reduction of wide tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathlake.operators import stats


def variances(df: DataFrame, features: list[str], threshold: float = 0.01) -> DataFrame:
    """``feature, variance, passed``: population variance of what is there."""
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in features])
    return row.unpivot([], features, "feature", "variance").withColumn("passed", F.coalesce(F.col("variance") >= threshold, F.lit(False)))


def top_n(scores: DataFrame, n: int, score: str = "score", ascending: bool = False) -> DataFrame:
    """The n best features; equal scores in order of name, missing scores last."""
    o = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return scores.orderBy(o, "feature").limit(n)


def select_statistical(long: DataFrame, wide: DataFrame, features: list[str], alpha: float = 0.05, n: int | None = None, variance: float = 0.01) -> DataFrame:
    """``feature, p_value, variance_passed, selected``: uncorrected p below alpha and enough variance.

    With ``n`` the best of them; where none passes, the ``n`` smallest p (all, without ``n``) stand in.
    """
    labels = [r[0] for r in long.select("label").dropna().distinct().orderBy("label").limit(3).collect()]
    if len(labels) < 2:
        raise ValueError("two groups are needed")
    p = stats.mann_whitney(long, *labels) if len(labels) == 2 else stats.kruskal(long)
    t = p.select("feature", "p_value").join(variances(wide, features, variance).select("feature", F.col("passed").alias("variance_passed")), "feature")
    fit = F.coalesce((F.col("p_value") < alpha) & F.col("variance_passed"), F.lit(False))
    w = Window.orderBy(F.desc("_fit"), F.col("p_value").asc_nulls_last(), "feature")  # one row a feature
    t = t.withColumn("_fit", fit).withColumn("_rank", F.row_number().over(w)).withColumn("_any", F.max("_fit").over(Window.partitionBy()))
    cap = F.lit(True) if n is None else F.col("_rank") <= n
    return t.withColumn("selected", cap & (F.col("_fit") | ~F.col("_any"))).drop("_fit", "_rank", "_any")


def select_from_results(results: DataFrame, alpha: float = 0.05, n: int | None = None, p: str | None = None, effect: float = 0.0) -> DataFrame:
    """The features of a result table that are significant, the smallest p first, at most ``n``.

    ``p`` names the column; by default the corrected ``p_adjusted`` where the
    table has it, else ``p_value``. ``effect`` is the least absolute effect size.
    Equal p go in order of name; a NULL p is never significant.
    """
    p = p or ("p_adjusted" if "p_adjusted" in results.columns else "p_value")
    r = results.filter(F.col(p) < alpha)
    if effect > 0:
        r = r.filter(F.abs("effect_size") >= effect)
    r = r.orderBy(p, "feature")
    return r if n is None else r.limit(n)


def select_combined(long: DataFrame, wide: DataFrame, features: list[str], alpha: float = 0.05, variance: float = 0.01, threshold: float = 0.95) -> DataFrame:
    """Enough variance, then not correlated with a feature kept before, then significant: ``feature, step, selected``.

    ``step`` names the filter that dropped a feature. Only one verdict a feature
    and pair comes to the driver.
    """
    passed = {r["feature"] for r in variances(wide, features, variance).filter("passed").collect()}
    left = [f for f in features if f in passed]
    kept = set(stats.greedy_uncorrelated(stats.correlation_matrix(wide, left), left, threshold)) if len(left) > 1 else set(left)
    fate = [(f, "variance" if f not in passed else "correlation" if f not in kept else None) for f in features]
    early = wide.sparkSession.createDataFrame(fate, "feature string, step string")
    p = select_statistical(long.filter(F.col("feature").isin(sorted(kept))), wide, sorted(kept) or features, alpha, None, variance).select("feature", "p_value")
    out = early.join(p, "feature", "left").withColumn("step", F.coalesce("step", F.when(F.coalesce(F.col("p_value") >= alpha, F.lit(True)), "significance")))
    return out.withColumn("selected", F.col("step").isNull())


def binned_mutual_information(long: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information in nats between each feature, in ``bins`` of equal rank, and the label."""
    long = long.dropna()
    r = stats.ranks(long, ["feature"])
    n = long.groupBy("feature").agg(F.count("*").cast("double").alias("total"))
    r = r.join(n, "feature").withColumn("bin", F.least(F.floor((F.col("rank") - 0.5) / F.col("total") * bins), F.lit(bins - 1)))
    cell = long.groupBy("feature", "value", "label").agg(F.count("*").alias("c")).join(r.select("feature", "value", "bin", "total"), ["feature", "value"])
    cell = cell.groupBy("feature", "bin", "label").agg(F.sum("c").alias("c"), F.max("total").alias("total"))
    bx, by = (cell.groupBy("feature", k).agg(F.sum("c").alias(f"n_{k}")) for k in ("bin", "label"))
    m = cell.join(bx, ["feature", "bin"]).join(by, ["feature", "label"])
    mi = F.sum(F.col("c") / F.col("total") * F.log(F.col("c") * F.col("total") / (F.col("n_bin") * F.col("n_label"))))
    return m.groupBy("feature").agg(mi.alias("score"))


def recursive_elimination(df: DataFrame, features: list[str], label: str, importance: Callable[[DataFrame, list[str], str], dict[str, float]], keep: int = 1, step: int = 1) -> list[tuple[str, int]]:
    """``(feature, rank)``: the ``step`` least important features leave each round; rank 1 stayed.

    ``importance`` fits a model in Spark and returns one number a feature; only
    those come to the driver. Missing values count as 0.
    """
    df = df.select(label, *features).fillna(0.0, features)
    left, out, rank = list(features), [], 1 + -(-max(0, len(features) - keep) // step)
    while len(left) > keep:
        score = importance(df, left, label)
        worst = sorted(left, key=lambda c: (score[c], c))[: min(step, len(left) - keep)]
        out += [(c, rank) for c in worst]
        left, rank = [c for c in left if c not in worst], rank - 1
    return sorted([(c, 1) for c in left] + out, key=lambda x: (x[1], x[0]))


# --- reduction -----------------------------------------------------------------------


def prepare(df: DataFrame, features: list[str]) -> DataFrame:
    """``scaled``: complete rows, standardised with population deviations; constant columns become 0."""
    rows = df.dropna(subset=features)
    n = rows.count()
    parts = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="scaled")]
    out = Pipeline(stages=parts).fit(rows).transform(rows).drop("_raw")
    return out.withColumn("_shrink", F.lit(np.sqrt(n / max(1, n - 1)))) if n else out.withColumn("_shrink", F.lit(1.0))


def pca(df: DataFrame, features: list[str], k: int, whiten: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores, loadings and explained variance of standardised features.

    The largest loading of each component is made positive. Scores follow the
    population convention; whitened ones have unit variance.
    """
    ready = prepare(df, features)
    model = PCA(k=k, inputCol="scaled", outputCol="_pc").fit(ready)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)])
    load = load * sign
    ratio = model.explainedVariance.toArray()
    spread = np.sqrt(ratio * len(features))
    spark = df.sparkSession
    s = model.transform(ready).withColumn("_s", vector_to_array("_pc"))
    factor = [float(sign[j] / (spread[j] if whiten and spread[j] > 0 else 1.0)) for j in range(k)]
    keep = [c for c in df.columns if c not in features]
    scores = s.select(*keep, *[(F.get("_s", F.lit(j)) * F.col("_shrink") * factor[j]).alias(f"pc{j + 1}") for j in range(k)])
    loadings = spark.createDataFrame([(f, j + 1, float(load[i, j])) for i, f in enumerate(features) for j in range(k)], "feature string, component int, loading double")
    variance = spark.createDataFrame([(j + 1, float(ratio[j]), float(ratio[: j + 1].sum())) for j in range(k)], "component int, ratio double, cumulative double")
    return scores, loadings, variance


def top_loadings(loadings: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature")
    return loadings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def intrinsic_dimension(ratios: list[float], method: str = "kaiser", share: float = 0.95) -> int:
    """From explained variance ratios: ``kaiser`` (alias ``mle``), ``variance`` or ``elbow``."""
    r = np.asarray(ratios)
    if method in ("kaiser", "mle"):
        return max(1, int((r > r.mean()).sum()))
    if method == "variance":
        return min(len(r), int(np.searchsorted(np.cumsum(r), share) + 1))
    if method == "elbow":
        return len(r) if len(r) < 3 else int(np.argmax(np.diff(r, 2)) + 2)
    raise ValueError(f"unknown method {method}")
