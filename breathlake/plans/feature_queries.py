"""Queries on feature tables, labels, statistics, selection and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathlake.functions.compare import nudged, rounded
from breathlake.functions.keys import subject_key
from breathlake.functions.metrics import METRICS
from breathlake.operators import features as ft
from breathlake.operators import ml, select, stats
from breathlake.operators.quantiles import group_quantiles
from breathlake.sources.names import date_from_name, subject_from_name
from breathlake.session import cut, table

ALL = list(METRICS)
FUNCTIONS = list(ft.AGGREGATES)


def _features(s: SparkSession, d: str, names: list[str] = ALL) -> DataFrame:
    """Window features once each, missing and negative values as NULL."""
    w = table(s, d, "window_features").dropDuplicates(["feature_id"])
    w = w.select("feature_id", "recording_id", subject_key("subject_id").alias("subject"), "window_index", "posture", "sensor", *names)
    return ft.missing_as_null(w, names, non_negative=True)


def _labels(s: SparkSession, d: str) -> DataFrame:
    """The latest assessment of each subject."""
    c = table(s, d, "clinical_labels").select(subject_key("subject_id").alias("subject"), "label_id", "assessed_at", "recovery", "current_consciousness", "survival").filter("subject is not null")
    at = F.struct("assessed_at", "label_id")
    return c.groupBy("subject").agg(*[F.max_by(x, at).alias(x) for x in ("recovery", "current_consciousness", "survival")])


def aggregate_windows(s, d):
    return rounded(ft.aggregate_windows(_features(s, d, ALL), ["recording_id"], ALL, FUNCTIONS))


def aggregate_min_valid(s, d):
    return rounded(ft.aggregate_windows(_features(s, d, ALL), ["recording_id"], ALL, ["mean", "std"], min_windows=3, min_valid=4))


def aggregate_propagate(s, d):
    return rounded(ft.aggregate_windows(_features(s, d, ALL), ["recording_id"], ALL, ["mean"], nan_policy="propagate"))


def aggregate_custom(s, d):
    geo = {"geomean": lambda c: F.exp(F.avg(F.log(F.when(F.col(c) > 0, F.col(c)))))}
    return rounded(ft.aggregate_windows(_features(s, d, ALL), ["recording_id"], ALL, ["geomean"], custom=geo))


def valid_counts(s, d):
    return ft.valid_counts(_features(s, d, ALL), ["recording_id"], ALL)


def feature_statistics(s, d):
    return rounded(ft.feature_statistics(_features(s, d), ALL))


def _keyed(df: DataFrame) -> DataFrame:
    return rounded(df.select("feature_id", *ALL))


def normalize_zscore(s, d):
    return _keyed(ft.normalize(_features(s, d, ALL), ALL, "zscore"))


def normalize_minmax(s, d):
    return _keyed(ft.normalize(_features(s, d, ALL), ALL, "minmax"))


def normalize_robust(s, d):
    return _keyed(ft.normalize(_features(s, d, ALL), ALL, "robust"))


def fill_mean(s, d):
    return _keyed(ft.fill_missing(_features(s, d, ALL), ALL, "mean"))


def fill_median(s, d):
    return _keyed(ft.fill_missing(_features(s, d, ALL), ALL, "median"))


def fill_zero(s, d):
    return _keyed(ft.fill_missing(_features(s, d, ALL), ALL, "zero"))


def fill_drop(s, d):
    return _keyed(ft.fill_missing(_features(s, d, ALL), ALL, "drop"))


def melt(s, d):
    return ft.melt(_features(s, d, ALL), ["feature_id"], ALL)


def concat_union(s, d):
    f = _features(s, d, ALL)
    return ft.concat([f.filter("sensor = 'belt'").select("feature_id", "rate", "tidal_volume"), f.filter("sensor = 'mask'").select("feature_id", "rate", "inhale_volume")])


def _split(s, d):
    subjects = table(s, d, "subjects").filter("site = 'north'").select(subject_key("subject_id").alias("subject")).dropna()
    return ft.split_by_subject(_features(s, d, ALL).select("feature_id", "subject"), subjects, "subject")


def split_train(s, d):
    return _split(s, d)[0]


def split_test(s, d):
    return _split(s, d)[1]


def feature_matrix(s, d):
    return ft.feature_matrix(_features(s, d, ["rate"]), ["recording_id"], "rate", "window_index")


def feature_matrix_summary(s, d):
    """The matrix by numbers that every entry and its place change; arrays of structs do not compare across engines."""
    m = feature_matrix(s, d)
    each = m.select("recording_id", F.explode_outer("windows").alias("w")).select("recording_id", "w.window", "w.value")
    return rounded(each.groupBy("recording_id").agg(F.count("window").alias("n"), F.min("window").alias("first_window"), F.max("window").alias("last_window"), F.sum((F.col("window") + 1) * F.col("value")).alias("weighted")))


def label_distribution(s, d):
    return ft.label_distribution(_labels(s, d), "recovery").withColumn("recovery", F.col("recovery").cast("double"))


def remap_labels(s, d):
    return ft.remap(_labels(s, d), "current_consciousness", {0: 10, 1: 11, 2: 12}).select("subject", F.col("current_consciousness").cast("double").alias("current_consciousness"))


def exclude_labels(s, d):
    return ft.exclude(_labels(s, d), "current_consciousness", [2, 3]).select("subject", F.col("current_consciousness").cast("double").alias("current_consciousness"))


def cohort_filter(s, d):
    return _labels(s, d).filter("current_consciousness = 0 and recovery is not null").select("subject", "recovery")


def merge_labels_inner(s, d):
    return ft.merge_labels(_features(s, d, ALL), _labels(s, d), "subject", "recovery").select("feature_id", "subject", "recovery")


def lookup_left_outer(s, d):
    return ft.merge_labels(_features(s, d, ALL), _labels(s, d), "subject", "survival", "left").select("feature_id", "subject", F.col("survival").cast("double").alias("survival"))


def subject_from_filename(s, d):
    return table(s, d, "recordings").select("recording_id", "file_name").distinct().withColumn("subject", subject_from_name("file_name"))


def date_from_filename(s, d):
    return table(s, d, "recordings").select("recording_id", "file_name").distinct().withColumn("file_date", date_from_name("file_name"))


def sampling_rate_infer(s, d):
    from breathlake.operators.breaths import with_previous

    e = table(s, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    dt = with_previous(e, ["user_id"], "t", "event_id", bucket_s=86400.0).select("user_id", (F.col("t") - F.col("prev")).alias("dt"))
    g = group_quantiles(dt, ["user_id"], "dt", [0.5]).select("user_id", F.get("q", F.lit(0)).alias("m"))
    return rounded(g.filter("m > 0").select("user_id", (1 / F.col("m")).alias("sampling_rate")), 12)


# --- statistics ------------------------------------------------------------------------


def _long(s, d, label: str, names: list[str] = ALL) -> DataFrame:
    f = _features(s, d, names).filter(F.col("sensor").isin("belt", "mask", "cannula"))
    return ft.melt(f.withColumnRenamed(label, "label"), ["label"], names)


def welch_t(s, d):
    return rounded(stats.welch_t(_long(s, d, "sensor"), "belt", "mask").select("feature", "n1", "n2", "statistic", "df"))


def mann_whitney_u(s, d):
    return rounded(stats.mann_whitney(_long(s, d, "sensor"), "belt", "mask").select("feature", "n1", "n2", "statistic", "z", "effect_size"))


def kruskal_h(s, d):
    return rounded(stats.kruskal(_long(s, d, "sensor")).select("feature", "k", "statistic", "p_value"))


def anova_f(s, d):
    return rounded(stats.anova(_long(s, d, "sensor")).select("feature", "k", "statistic", "eta_squared"))


def effect_sizes(s, d):
    return rounded(stats.effect_sizes(_long(s, d, "sensor"), "belt", "mask"))


def compare_groups_binary(s, d):
    return rounded(stats.compare_binary(_long(s, d, "sensor"), "belt", "mask"))


def compare_groups_multi(s, d):
    return stats.compare_multi(_long(s, d, "sensor"))


def compare_groups_flat(s, d):
    """The comparison of all sensors with one row for each feature and group."""
    c = compare_groups_multi(s, d).withColumn("g", F.explode("groups"))
    return rounded(c.select("feature", F.col("g.label").alias("label"), F.col("g.mean").alias("mean"), F.col("g.std").alias("std"), F.col("g.n").alias("n"), "statistic", "p_value", "effect_size", "n_groups", "p_adjusted", "significant"))


def _pvalues(s, d) -> DataFrame:
    """One p for each metric, from the comparison of all sensors."""
    return stats.kruskal(_long(s, d, "sensor")).select("feature", "p_value")


def _adjusted(method: str):
    def query(s, d):
        return rounded(stats.adjust_p(_pvalues(s, d), method=method))

    query.__name__ = f"p_adjust_{method}"
    return query


def corr_pearson_matrix(s, d):
    return rounded(stats.correlation_matrix(_features(s, d), ALL))


def corr_spearman_matrix(s, d):
    return rounded(stats.correlation_matrix(_features(s, d), ALL, "spearman"))


def corr_pairs(s, d):
    return rounded(stats.correlated_pairs(stats.correlation_matrix(_features(s, d), ALL), 0.5))


def remove_correlated(s, d):
    return stats.drop_correlated(stats.correlation_matrix(_features(s, d), ALL), 0.5)


def _outcome(s, d, method):
    f = ft.merge_labels(_features(s, d), _labels(s, d), "subject", "recovery")
    return rounded(stats.outcome_correlation(f, ALL, "recovery", method).select("feature", "n", "correlation", "abs_correlation"))


def outcome_pearson(s, d):
    return _outcome(s, d, "pearson")


def outcome_spearman(s, d):
    return _outcome(s, d, "spearman")


def outcome_kendall(s, d):
    return _outcome(s, d, "kendall")


def kendall(s, d):
    f = ft.merge_labels(_features(s, d, ALL), _labels(s, d), "subject", "survival")
    return rounded(stats.kendall_tau(f, "rate", "survival").select("tau"))


def variance_filter(s, d):
    return rounded(select.variances(_features(s, d), ALL))


def select_top_n(s, d):
    h = stats.kruskal(_long(s, d, "sensor")).select("feature", F.col("statistic").alias("score"))
    return rounded(select.top_n(h, 5))


def select_statistical(s, d):
    f = _features(s, d).filter(F.col("sensor").isin("belt", "mask"))
    return rounded(select.select_statistical(ft.melt(f.withColumnRenamed("sensor", "label"), ["label"], ALL), f, ALL, n=5))


def binned_mutual_information(s, d):
    return rounded(select.binned_mutual_information(_long(s, d, "sensor"), 8))


def select_combined(s, d):
    f = _features(s, d).filter(F.col("sensor").isin("belt", "mask"))
    return rounded(select.select_combined(ft.melt(f.withColumnRenamed("sensor", "label"), ["label"], ALL), f, ALL))


def violin_data(s, d):
    """The shape of each feature in each group, by quantiles."""
    long = _long(s, d, "sensor").filter("value is not null")
    q = group_quantiles(long, ["feature", "label"], "value", [0.05, 0.25, 0.5, 0.75, 0.95])
    g = long.groupBy("feature", "label").agg(F.count("*").alias("n")).join(q, ["feature", "label"])
    return rounded(g.select("feature", "label", "n", *[F.get("q", F.lit(i)).alias(f"q{n}") for i, n in enumerate(("05", "25", "50", "75", "95"))]))


def label_summary(s, d):
    from breathlake.sources.sinks import label_summary as summary

    return rounded(summary(_labels(s, d), ["recovery", "current_consciousness", "survival"]))


def safe_names(s, d):
    from breathlake.sources.names import safe_name

    return table(s, d, "recordings").select("recording_id", safe_name("file_name").alias("safe")).distinct()


# --- models ----------------------------------------------------------------------------


def _neighbors(s, d) -> DataFrame:
    e = table(s, d, "embeddings").dropDuplicates(["vec_id"])
    return ml.nearest(e, e.filter("vec_id % 100 = 0"), 5)


def knn_neighbors(s, d):
    return rounded(_neighbors(s, d).select("query_id", "neighbor_id", "rank", "distance"))


def knn_predict(s, d):
    return ml.vote(_neighbors(s, d))


def _scored(s, d) -> DataFrame:
    """Windows with an outcome and a score: the lower the rate, the more it speaks for recovery."""
    f = ft.merge_labels(_features(s, d, ["rate"]), _labels(s, d), "subject", "recovery").dropna(subset=["rate"])
    return f.select("feature_id", F.col("recovery").alias("label"), F.round(1 - F.col("rate"), 4).alias("score"), (F.col("rate") < 0.25).cast("int").alias("prediction"))


def confusion_matrix(s, d):
    return ml.confusion(_scored(s, d))


def class_scores(s, d):
    return rounded(ml.class_scores(ml.confusion(_scored(s, d))))


def roc_points(s, d):
    return rounded(ml.roc(_scored(s, d)))


def auc(s, d):
    return rounded(ml.auc(_scored(s, d)))


def outcome_rates(s, d):
    return rounded(ml.binary_rates(ml.confusion(_scored(s, d))))


def auc_by_class(s, d):
    """The nearer the rate to a tenth of the class, the more it speaks for it."""
    f = ft.merge_labels(_features(s, d, ["rate"]), _labels(s, d), "subject", "current_consciousness").dropna(subset=["rate"])
    f = f.select(F.col("current_consciousness").alias("label"), F.array(*[F.round(1 - F.abs(F.col("rate") - k / 10), 4) for k in range(4)]).alias("scores"))
    return rounded(ml.auc_by_class(f))


def stratified_folds(s, d):
    f = ml.stratified_folds(_features(s, d, ["rate"]).select("feature_id", "sensor"), "feature_id", "sensor", 5)
    return f.groupBy("sensor").agg(F.max("fold").alias("last_fold"), F.count("*").alias("n"), F.count_distinct("fold").alias("folds"))


def _table(s, d) -> DataFrame:
    f = ft.merge_labels(_features(s, d), _labels(s, d), "subject", "recovery")
    return cut(ft.fill_missing(f, ALL, "median").select("feature_id", *ALL, F.col("recovery").cast("double").alias("label")))


def _predictions(kind: str, params: dict):
    """Fitted without the subjects of one site, applied to all rows."""

    def query(s, d):
        north = split_test(s, d).select("feature_id", F.lit(True).alias("held_out"))
        t = cut(_table(s, d).join(north, "feature_id", "left").fillna(False, ["held_out"]))
        c = ml.Classifier(kind, ALL, params=params).fit(t.filter("not held_out"))
        return c.predict(t).select("feature_id", "label", "held_out", "prediction", "score")

    query.__name__ = f"{kind}_predict"
    return query


def pca_scores(s, d):
    return select.pca(_table(s, d).drop("label"), ALL, 3)[0]


def pca_loadings(s, d):
    return select.top_loadings(select.pca(_table(s, d).drop("label"), ALL, 3)[1], 4)


def pca_variance(s, d):
    return select.pca(_table(s, d).drop("label"), ALL, 5)[2]


def grid_search(s, d):
    return ml.grid_search(_table(s, d), ml.Classifier("logistic", ALL), [{"C": 0.1}, {"C": 10.0}], "feature_id", 3)[1]


def bootstrap_intervals(s, d):
    return ml.bootstrap(_table(s, d), ml.Classifier("logistic", ALL), "feature_id")


def ablation(s, d):
    return ml.ablation(_table(s, d), ml.Classifier("logistic", ALL), {"all": ALL, "without_rate": [c for c in ALL if c != "rate"]}, "feature_id")


def experiments(s, d):
    t = _table(s, d)
    p = stats.mann_whitney(ft.melt(t, ["label"], ALL), 1.0, 0.0)
    best = [r["feature"] for r in select.select_from_results(p, n=3).collect()]  # names only
    return ml.experiments(t, ml.Classifier("logistic", ALL), best, [{"C": 0.1}, {"C": 10.0}], "feature_id", 3)[0]


def elimination_cv(s, d):
    return ml.elimination_cv(_table(s, d), ALL, "label", "feature_id", keep=3, step=4)[0]


def recursive_elimination(s, d):
    def importance(df, names, label):
        return ml.Classifier("logistic", names, label).fit(df).importances()

    rows = select.recursive_elimination(_table(s, d), ALL, "label", importance, keep=3, step=4)
    return s.createDataFrame(rows, "feature string, rank int")


_ALL = (
    aggregate_windows, aggregate_min_valid, aggregate_propagate, aggregate_custom, valid_counts, feature_statistics, normalize_zscore, normalize_minmax, normalize_robust, fill_mean, fill_median, fill_zero, fill_drop,
    melt, concat_union, split_train, split_test, feature_matrix, feature_matrix_summary, label_distribution, remap_labels, exclude_labels, cohort_filter, merge_labels_inner, lookup_left_outer, subject_from_filename, date_from_filename,
    sampling_rate_infer, welch_t, mann_whitney_u, kruskal_h, anova_f, effect_sizes, compare_groups_binary, compare_groups_multi, compare_groups_flat, *(_adjusted(m) for m in ("bonferroni", "sidak", "holm", "fdr_bh", "fdr_by")),
    corr_pearson_matrix, corr_spearman_matrix, corr_pairs, remove_correlated, outcome_pearson, outcome_spearman, outcome_kendall, kendall, variance_filter, select_top_n, select_statistical, select_combined, violin_data, label_summary, safe_names, binned_mutual_information, knn_neighbors, knn_predict,
    confusion_matrix, class_scores, outcome_rates, roc_points, auc, auc_by_class, stratified_folds, pca_scores, pca_loadings, pca_variance, grid_search, bootstrap_intervals, ablation, experiments, recursive_elimination, elimination_cv,
    _predictions("logistic", {}), _predictions("forest", {}), _predictions("boosting", {}), _predictions("svm", {"kernel": "rbf", "components": 100}), _predictions("network", {}),
)
QUERIES = {f.__name__: f for f in _ALL}

# --- SQL -------------------------------------------------------------------------------

_KEY = "nullif(nullif(regexp_replace(upper({}), '[^A-Z0-9]', '', 'g'), ''), 'UNKNOWN')"
_OK = "case when not isnan(cast({0} as double)) and not isinf(cast({0} as double)) and {0} >= 0 then {0} end {0}"


def _wf(names) -> str:
    cols = ", ".join(_OK.format(n) for n in names)
    return f"wf as (select distinct on (feature_id) feature_id, recording_id, {_KEY.format('subject_id')} subject, window_index, posture, sensor, {cols} from window_features)"


_LAB = f"""lab0 as (select {_KEY.format('subject_id')} subject, label_id, assessed_at, recovery, current_consciousness, survival from clinical_labels),
    lab as (select distinct on (subject) subject, recovery, current_consciousness, survival from lab0 where subject is not null order by subject, assessed_at desc, label_id desc)"""
_SQL_AGG = {"mean": "avg({0})", "std": "stddev_pop({0})", "min": "min({0})", "max": "max({0})", "median": "median({0})", "sum": "sum({0})", "q25": "quantile_cont({0}, 0.25)", "q75": "quantile_cont({0}, 0.75)", "iqr": "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)", "range": "max({0}) - min({0})", "cv": "stddev_pop({0}) / nullif(avg({0}), 0)"}


def _cols(pattern: str) -> str:
    return ", ".join(pattern.format(c) for c in ALL)


def _melted(names, label: str = "sensor") -> str:
    return f"long as (select {label} label, feature, value from (select {label}, {', '.join(f'cast({n} as double) {n}' for n in names)} from wf where sensor in ('belt', 'mask', 'cannula')) unpivot include nulls (value for feature in ({', '.join(names)})))"


_RANKED = "rk as (select feature, label, value, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 r, count(*) over (partition by feature, value) t from long where value is not null {})"
_MOM = "mom as (select feature, label, count(value) n, avg(value) m, var_samp(value) v from long where value is not null group by 1, 2), two as (select a.feature, a.n n1, b.n n2, a.m m1, b.m m2, a.v v1, b.v v2 from mom a join mom b on a.feature = b.feature and a.label = 'belt' and b.label = 'mask')"
_MANN = f"""{_RANKED.format("and label in ('belt', 'mask')")},
        mg as (select feature, count(*) filter (label = 'belt') n1, count(*) filter (label = 'mask') n2, sum(r) filter (label = 'belt') r1, sum(t * t - 1.0) ties from rk group by 1),
        mu as (select *, r1 - n1 * (n1 + 1) / 2 statistic, n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) var from mg),
        u as (select *, greatest(abs(statistic - n1 * n2 / 2) - 0.5, 0) / sqrt(var) z from mu)"""
# twice the normal tail, by Simpson's rule from 0 to z
_MANN_P = """si as (select i, case when i in (0, 800) then 1 when i % 2 = 1 then 4 else 2 end w from range(801) t(i)),
    mp as (select feature, z, greatest(1 - sum(w * exp(-pow(least(z, 8) * i / 800, 2) / 2)) * least(z, 8) / 1200 / sqrt(2 * pi()), 0) p_value from u, si group by feature, z)"""
_BELT_MASK_VAR = "va as (select feature, coalesce(var_pop(value), 0) v from long where label in ('belt', 'mask') group by 1)"
# the sensors are three, and the tail of chi-square with two degrees of freedom is exp(-x / 2)
_KRUSKAL = f"""{_RANKED.format('')}, ti as (select feature, sum(t * t - 1.0) ties from rk group by 1), rg as (select feature, label, count(*) n, sum(r) s from rk group by 1, 2),
    rh as (select feature, count(*) k, sum(n)::double n, sum(s * s / n) q from rg group by 1),
    kw as (select feature, k, (12 * q / (n * (n + 1)) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) statistic, exp(-statistic / 2) p_value from rh join ti using (feature)), pv as (select *, count(*) over () m, row_number() over (order by p_value, feature) r from kw)"""
_ANOVA = """ag as (select feature, label, count(value) n, avg(value) m, stddev_pop(value) sd, var_samp(value) * (count(value) - 1) w from long where value is not null group by 1, 2),
    agm as (select feature, sum(n * m) / sum(n) gm from ag group by 1), af as (select feature, count(*) k, sum(n) n, sum(n * pow(m - gm, 2)) b, sum(w) w from ag join agm using (feature) group by 1)"""


def _padj(expr: str, extra: str = "") -> str:
    return f"with {_wf(ALL)}, {_melted(ALL)}, {_KRUSKAL}, a as (select feature, p_value, {expr} p_adjusted from pv {extra}) select feature, round(p_value, 6) p_value, round(p_adjusted, 6) p_adjusted, p_adjusted < 0.05 significant from a"


_PAIRS = [(a, b) for i, a in enumerate(ALL) for b in ALL[i + 1:]]


def _pairs(source: str) -> str:
    return " union all ".join(f"select '{a}' feature_a, '{b}' feature_b, corr({a}, {b}) r from {source} where {a} is not null and {b} is not null" for a, b in _PAIRS)


_MATRIX = f"with {_wf(ALL)}, mx as ({_pairs('wf')})"
_SCORED = f"with {_wf(['rate'])}, {_LAB}, sc as (select feature_id, recovery label, round(1 - rate, 4) score, cast(rate < 0.25 as integer) prediction from wf join lab using (subject) where recovery is not null and rate is not null)"
_KNN = """with e as (select distinct on (vec_id) vec_id, cast(embedding as double[]) v, label from embeddings),
    p as (select q.vec_id query_id, b.vec_id neighbor_id, b.label, list_distance(q.v, b.v) distance from e q join e b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0),
    nn as (select *, row_number() over (partition by query_id order by distance, neighbor_id) rank from p qualify rank <= 5)"""
_OUTC = f"with {_wf(ALL)}, {_LAB}, j as (select wf.*, cast(recovery as double) y from wf join lab using (subject) where recovery is not null), long as (select feature, value, y from (select y, {', '.join(f'cast({n} as double) {n}' for n in ALL)} from j) unpivot (value for feature in ({', '.join(ALL)})))"

ORACLE = {
    "aggregate_windows": f"with {_wf(ALL)} select recording_id, count(*) n_windows, " + ", ".join(f"round({x.format(c)}, 6) {c}_{f}" for c in ALL for f, x in _SQL_AGG.items()) + " from wf group by 1",
    "aggregate_min_valid": f"with {_wf(ALL)} select recording_id, count(*) n_windows, " + ", ".join(f"case when count({c}) >= 4 then round({_SQL_AGG[f].format(c)}, 6) end {c}_{f}" for c in ALL for f in ("mean", "std")) + " from wf group by 1 having count(*) >= 3",
    "aggregate_propagate": f"with {_wf(ALL)} select recording_id, count(*) n_windows, {_cols('case when count({0}) = count(*) then round(avg({0}), 6) end {0}_mean')} from wf group by 1",
    "aggregate_custom": f"with {_wf(ALL)} select recording_id, count(*) n_windows, {_cols('round(exp(avg(ln(case when {0} > 0 then {0} end))), 6) {0}_geomean')} from wf group by 1",
    "valid_counts": f"with {_wf(ALL)} select recording_id, {_cols('count({0}) {0}_valid')} from wf group by 1",
    "feature_statistics": f"with {_wf(ALL)} " + " union all ".join(f"select '{c}' feature, round(avg({c}), 6) mean, round(stddev_samp({c}), 6) std, round(min({c}), 6) min, round(max({c}), 6) max, round(median({c}), 6) median, round(quantile_cont({c}, 0.25), 6) q25, round(quantile_cont({c}, 0.75), 6) q75 from wf" for c in ALL),
    "normalize_zscore": f"with {_wf(ALL)} select feature_id, {_cols('round(({0} - avg({0}) over ()) / nullif(stddev_samp({0}) over (), 0), 6) {0}')} from wf",
    "normalize_minmax": f"with {_wf(ALL)} select feature_id, {_cols('round(({0} - min({0}) over ()) / nullif(max({0}) over () - min({0}) over (), 0), 6) {0}')} from wf",
    "normalize_robust": f"with {_wf(ALL)}, q as (select {_cols('median({0}) {0}_m, quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) {0}_i')} from wf) select feature_id, {_cols('round(({0} - {0}_m) / ({0}_i + 1e-8), 6) {0}')} from wf, q",
    "fill_mean": f"with {_wf(ALL)} select feature_id, {_cols('round(coalesce({0}, avg({0}) over ()), 6) {0}')} from wf",
    "fill_median": f"with {_wf(ALL)}, q as (select {_cols('median({0}) {0}_m')} from wf) select feature_id, {_cols('round(coalesce({0}, {0}_m), 6) {0}')} from wf, q",
    "fill_zero": f"with {_wf(ALL)} select feature_id, {_cols('round(coalesce({0}, 0), 6) {0}')} from wf",
    "fill_drop": f"with {_wf(ALL)} select feature_id, {_cols('round({0}, 6) {0}')} from wf where " + " and ".join(f"{c} is not null" for c in ALL),
    "melt": f"with {_wf(ALL)} select feature_id, feature, value from (select feature_id, {_cols('{0}')} from wf) unpivot include nulls (value for feature in ({_cols('{0}')}))",
    "concat_union": f"with {_wf(ALL)} select feature_id, rate, tidal_volume, null::double inhale_volume from wf where sensor = 'belt' union all select feature_id, rate, null, inhale_volume from wf where sensor = 'mask'",
    "split_train": f"with {_wf(ALL)}, t as (select {_KEY.format('subject_id')} k from subjects where site = 'north') select feature_id, subject from wf where subject is null or not exists (select 1 from t where k = subject)",
    "split_test": f"with {_wf(ALL)}, t as (select {_KEY.format('subject_id')} k from subjects where site = 'north') select feature_id, subject from wf where exists (select 1 from t where k = subject)",
    "feature_matrix_summary": f"with {_wf(['rate'])}, c as (select recording_id, window_index w, max(rate) v from wf group by 1, 2) select recording_id, count(w) n, min(w) first_window, max(w) last_window, round(sum((w + 1) * v), 6) weighted from c group by 1",
    "label_distribution": f"with {_LAB} select cast(recovery as double) recovery, count(*) n from lab group by 1",
    "remap_labels": f"with {_LAB} select subject, cast(case current_consciousness when 0 then 10 when 1 then 11 when 2 then 12 else current_consciousness end as double) current_consciousness from lab",
    "exclude_labels": f"with {_LAB} select subject, cast(case when current_consciousness in (2, 3) then null else current_consciousness end as double) current_consciousness from lab",
    "cohort_filter": f"with {_LAB} select subject, recovery from lab where current_consciousness = 0 and recovery is not null",
    "merge_labels_inner": f"with {_wf(ALL)}, {_LAB} select feature_id, subject, recovery from wf join lab using (subject) where recovery is not null",
    "lookup_left_outer": f"with {_wf(ALL)}, {_LAB} select feature_id, subject, cast(survival as double) survival from wf left join lab using (subject)",
    "subject_from_filename": "select distinct recording_id, file_name, case when length(st) < 4 then st else upper(st[1:4]) end subject from (select *, regexp_replace(split_part(file_name, '/', -1), '(.)\\.[^.]*$', '\\1') st from recordings)",
    "date_from_filename": """with r as (select distinct recording_id, file_name, regexp_extract_all(regexp_replace(split_part(file_name, '/', -1), '(.)\\.[^.]*$', '\\1'), '\\d+') g from recordings)
        select recording_id, file_name, case when len(g) >= 3 then case when length(g[-1]) <= 2 then case when cast(g[-1] as integer) <= 30 then '20' else '19' end || lpad(g[-1], 2, '0') else g[-1] end
            || case when length(g[-2]) < 2 then lpad(g[-2], 2, '0') else g[-2] end || case when length(g[-3]) < 2 then lpad(g[-3], 2, '0') else g[-3] end else 'UNKNOWN' end file_date from r""",
    "sampling_rate_infer": "with e as (select user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) dt from events), g as (select user_id, median(dt) m from e group by 1) select user_id, round(1 / m, 12) sampling_rate from g where m > 0",
    "welch_t": f"""with {_wf(ALL)}, {_melted(ALL)}, {_MOM} select feature, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) statistic,
        round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 6) df from two""",
    "mann_whitney_u": f"""with {_wf(ALL)}, {_melted(ALL)}, {_MANN}
        select feature, n1, n2, round(statistic, 6) statistic, round(z, 6) z, round(1 - 2 * statistic / (n1 * n2), 6) effect_size from u""",
    "compare_groups_binary": f"""with {_wf(ALL)}, {_melted(ALL)}, {_MANN}, {_MANN_P}, mo as (select feature, label, count(*) n, avg(value) m, stddev_pop(value) sd, median(value) md from long where value is not null group by 1, 2),
        pv as (select feature, p_value, count(*) over () m, row_number() over (order by p_value, z desc, feature) r from mp), pa as (select *, least(min(p_value * m / r) over (order by r desc), 1) p_adjusted from pv)
        select feature, a.n n1, round(a.m, 6) mean1, round(a.sd, 6) std1, round(a.md, 6) median1, b.n n2, round(b.m, 6) mean2, round(b.sd, 6) std2, round(b.md, 6) median2, round(statistic, 6) statistic, round(pa.p_value, 6) p_value,
            round(1 - 2 * statistic / (u.n1 * u.n2), 6) effect_size, 'mannwhitney' test_used, round(p_adjusted, 6) p_adjusted, p_adjusted < 0.05 significant
        from u join pa using (feature) join mo a using (feature) join mo b using (feature) where a.label = 'belt' and b.label = 'mask'""",
    "select_statistical": f"""with {_wf(ALL)}, {_melted(ALL)}, {_MANN}, {_MANN_P}, {_BELT_MASK_VAR}, ft as (select feature, p_value, z, v >= 0.01 ok, coalesce(p_value < 0.05, false) and v >= 0.01 fit from mp join va using (feature)),
        rf as (select *, row_number() over (order by fit desc, z desc, feature) r, bool_or(fit) over () hits from ft)
        select feature, round(p_value, 6) p_value, ok variance_passed, r <= 5 and (fit or not hits) selected from rf""",
    "select_combined": f"""with recursive {_wf(ALL)}, {_melted(ALL)}, {_MANN}, {_MANN_P}, {_BELT_MASK_VAR}, bm as materialized (select * from wf where sensor in ('belt', 'mask')),
        mx as materialized ({_pairs("bm")}), po as (select unnest([{", ".join(f"'{c}'" for c in ALL)}]) feature, generate_subscripts([{", ".join(f"'{c}'" for c in ALL)}], 1) at0),
        vp as (select feature, row_number() over (order by at0) i from po join va using (feature) where v >= 0.01), nr as (select feature_b feature, list(feature_a) near from mx where abs(r) >= 0.95 group by 1),
        st as materialized (select feature, i, coalesce(near, []) near from vp left join nr using (feature)),
        gr as (select 0::bigint i, []::varchar[] kept union all select st.i, case when list_has_any(gr.kept, st.near) then gr.kept else list_append(gr.kept, st.feature) end from gr join st on st.i = gr.i + 1),
        kp as (select unnest(kept) feature from gr where i = (select max(i) from gr))
        select feature, step, round(case when kp.feature is not null then p_value end, 6) p_value, step is null selected from (select po.feature, mp.p_value, case when vp.feature is null then 'variance' when kp.feature is null then 'correlation' when coalesce(mp.p_value >= 0.05, true) then 'significance' end step
            from po left join vp using (feature) left join kp using (feature) left join mp using (feature)) left join kp using (feature)""",
    "kruskal_h": f"with {_wf(ALL)}, {_melted(ALL)}, {_KRUSKAL} select feature, k, round(statistic, 6) statistic, round(p_value, 6) p_value from kw",
    "compare_groups_flat": f"""with {_wf(ALL)}, {_melted(ALL)}, {_KRUSKAL}, {_ANOVA}, pa as (select *, least(min(p_value * m / r) over (order by r desc), 1) p_adjusted from pv)
        select feature, label, round(ag.m, 6) mean, round(sd, 6) std, ag.n, round(statistic, 6) statistic, round(p_value, 6) p_value, round(b / (b + af.w), 6) effect_size, af.k n_groups, round(p_adjusted, 6) p_adjusted, p_adjusted < 0.05 significant
        from ag join pa using (feature) join af using (feature)""",
    "anova_f": f"with {_wf(ALL)}, {_melted(ALL)}, {_ANOVA} select feature, k, round((b / (k - 1)) / (w / (n - k)), 6) statistic, round(b / (b + w), 6) eta_squared from af",
    "effect_sizes": f"""with {_wf(ALL)}, {_melted(ALL)}, {_MOM}, d as (select feature, n1 + n2 n, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) d, (m1 - m2) / sqrt(v2) g from two)
        select feature, round(d, 6) cohens_d, round(d * (1 - 3 / (4 * n - 9)), 6) hedges_g, round(g, 6) glass_delta from d""",
    "p_adjust_bonferroni": _padj("least(p_value * m, 1)"),
    "p_adjust_sidak": _padj("1 - pow(1 - p_value, m)"),
    "p_adjust_holm": _padj("least(max(p_value * (m - r + 1)) over (order by r), 1)"),
    "p_adjust_fdr_bh": _padj("least(min(p_value * m / r) over (order by r desc), 1)"),
    "p_adjust_fdr_by": _padj("least(min(p_value * m * h / r) over (order by r desc), 1)", "join (select sum(1 / r) h from pv) on true"),
    "corr_pearson_matrix": f"{_MATRIX} select feature_a, feature_b, round(r, 6) r from mx",
    "corr_spearman_matrix": f"""with {_wf(ALL)}, lg as (select feature_id, feature, value from (select feature_id, {', '.join(f'cast({n} as double) {n}' for n in ALL)} from wf) unpivot (value for feature in ({', '.join(ALL)}))),
        po as (select unnest([{", ".join(f"'{c}'" for c in ALL)}]) feature, generate_subscripts([{", ".join(f"'{c}'" for c in ALL)}], 1) at0), lp as (select * from lg join po using (feature)),
        pr as (select a.feature feature_a, b.feature feature_b, a.value x, b.value y from lp a join lp b on a.feature_id = b.feature_id and a.at0 < b.at0),
        rr as (select feature_a, feature_b, rank() over (partition by feature_a, feature_b order by x) + (count(*) over (partition by feature_a, feature_b, x) - 1) / 2 a, rank() over (partition by feature_a, feature_b order by y) + (count(*) over (partition by feature_a, feature_b, y) - 1) / 2 b from pr)
        select feature_a, feature_b, round(corr(a, b), 6) r from rr group by 1, 2""",
    "corr_pairs": f"{_MATRIX} select feature_a, feature_b, round(r, 6) r, round(abs(r), 6) abs_r from mx where abs(r) >= 0.5",
    "remove_correlated": f"{_MATRIX} select distinct feature_b feature from mx where abs(r) > 0.5",
    "outcome_pearson": f"{_OUTC} select feature, count(*) n, round(corr(value, y), 6) correlation, round(abs(corr(value, y)), 6) abs_correlation from long group by 1",
    "outcome_spearman": f"""{_OUTC}, r as (select feature, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 a, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2 b from long)
        select feature, count(*) n, round(corr(a, b), 6) correlation, round(abs(corr(a, b)), 6) abs_correlation from r group by 1""",
    "outcome_kendall": f"""{_OUTC}, c as (select feature, value x, y, count(*)::double c from long group by 1, 2, 3), k as (select a.feature, sum(sign(b.x - a.x) * sign(b.y - a.y) * a.c * b.c) num from c a join c b on a.feature = b.feature and b.x > a.x group by 1),
        n as (select feature, sum(c) n from c group by 1), tx as (select feature, sum(t * (t - 1) / 2) tx from (select feature, sum(c) t from c group by feature, x) group by 1), ty as (select feature, sum(t * (t - 1) / 2) ty from (select feature, sum(c) t from c group by feature, y) group by 1),
        ta as (select feature, cast(n as bigint) n, num / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) tau from n join tx using (feature) join ty using (feature) join k using (feature))
        select feature, n, round(tau, 6) correlation, round(abs(tau), 6) abs_correlation from ta""",
    "kendall": f"""with {_wf(ALL)}, {_LAB}, c as (select rate x, survival y, count(*) c from wf join lab using (subject) where survival is not null and rate is not null group by 1, 2),
        k as (select sum(sign(b.x - a.x) * sign(b.y - a.y) * a.c * b.c) num from c a join c b on b.x > a.x), n as (select sum(c)::double n from c),
        tx as (select sum(t * (t - 1) / 2) tx from (select sum(c)::double t from c group by x)), ty as (select sum(t * (t - 1) / 2) ty from (select sum(c)::double t from c group by y))
        select round(num / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) tau from k, n, tx, ty""",
    "variance_filter": f"with {_wf(ALL)} " + " union all ".join(f"select '{c}' feature, round(var_pop({c}), 6) variance, var_pop({c}) >= 0.01 passed from wf" for c in ALL),
    "select_top_n": "",
    "binned_mutual_information": f"""with {_wf(ALL)}, {_melted(ALL)}, {_RANKED.format('')}, n as (select feature, count(*)::double total from rk group by 1),
        b as (select feature, label, least(floor((r - 0.5) / total * 8), 7) bin, total from rk join n using (feature)), c as (select feature, bin, label, count(*) c, any_value(total) total from b group by 1, 2, 3),
        m as (select *, sum(c) over (partition by feature, bin) nb, sum(c) over (partition by feature, label) nl from c) select feature, round(sum(c / total * ln(c * total / (nb * nl))), 6) score from m group by 1""",
    "violin_data": f"with {_wf(ALL)}, {_melted(ALL)} select feature, label, count(*) n, " + ", ".join(f"round(quantile_cont(value, 0.{q}), 6) q{q}" for q in ("05", "25", "50", "75", "95")) + " from long where value is not null group by 1, 2",
    "label_summary": f"with {_LAB} " + " union all ".join(f"select '{c}' outcome, count({c}) valid, count(*) - count({c}) missing, round(100.0 * count({c}) / count(*), 6) percent_valid from lab" for c in ("recovery", "current_consciousness", "survival")),
    "safe_names": "select distinct recording_id, regexp_replace(file_name, '[^A-Za-z0-9_-]', '', 'g') safe from recordings",
    "knn_neighbors": f"{_KNN} select query_id, neighbor_id, rank, round(distance, 6) distance from nn",
    "knn_predict": f"{_KNN}, v as (select query_id, label, count(*) v from nn group by 1, 2) select distinct on (query_id) query_id, label prediction from v order by query_id, v desc, label",
    "confusion_matrix": f"{_SCORED} select label, prediction, count(*) n from sc group by 1, 2",
    "class_scores": f"""{_SCORED}, c as (select c class, count(*) filter (label = c) support, count(*) filter (label = c and prediction = c) hit, count(*) filter (prediction = c) predicted from sc, (select unnest([0, 1]) c) group by 1),
        p as (select class, support, coalesce(hit / nullif(predicted, 0), 0) pr, coalesce(hit / nullif(support, 0), 0) rc from c) select class, support, round(pr, 6) as "precision", round(rc, 6) as recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) f1 from p""",
    "roc_points": f"""{_SCORED}, g as (select score, sum(label) p, count(*) - sum(label) q from sc group by 1)
        select score threshold, round(sum(q) over (order by score desc) / sum(q) over (), 6) fpr, round(sum(p) over (order by score desc) / sum(p) over (), 6) tpr from g""",
    "auc": f"{_SCORED}, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 r from sc) select round((sum(r) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2) / (count(*) filter (label = 1) * count(*) filter (label = 0)), 6) auc from r",
    "outcome_rates": f"{_SCORED} select round(avg(cast(label = prediction as integer)), 6) accuracy, round(avg(cast(prediction = 1 as integer)) filter (label = 1), 6) sensitivity, round(avg(cast(prediction <> 1 as integer)) filter (label <> 1), 6) specificity from sc",
    "auc_by_class": f"""with {_wf(['rate'])}, {_LAB}, sc as (select current_consciousness y, c, round(1 - abs(rate - c / 10), 4) v from wf join lab using (subject), (select unnest([0, 1, 2, 3]) c) where current_consciousness is not null and rate is not null),
        r as (select c, y = c hit, rank() over (partition by c order by v) + (count(*) over (partition by c, v) - 1) / 2 r from sc), g as (select c, count(*) filter (hit) n1, count(*) filter (not hit) n2, sum(r) filter (hit) r1 from r group by 1)
        select c as class, n1 n, round((r1 - n1 * (n1 + 1) / 2) / nullif(n1 * n2, 0), 6) auc from g""",
    "stratified_folds": f"with {_wf(['rate'])} select sensor, cast(least(count(*), 5) - 1 as integer) last_fold, count(*) n, least(count(*), 5) folds from wf group by 1",
}
ORACLE["select_top_n"] = f"with {_wf(ALL)}, {_melted(ALL)}, {_KRUSKAL} select feature, round(statistic, 6) score from kw order by score desc, feature limit 5"
ORACLE = {k: nudged(v) for k, v in ORACLE.items()}
