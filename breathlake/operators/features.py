"""Feature tables: aggregation to recordings, labels, scaling, filling, reshaping."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breathlake.operators import quantiles as qt

#: Key and bookkeeping columns that are never features, whatever their type.
METADATA = ("subject_id", "recording_id", "recording_date", "window_index", "window_id", "feature_id", "time", "time_s", "label", "n_windows", "n_valid_windows")


def numeric_columns(df: DataFrame, skip: Iterable[str] = METADATA) -> list[str]:
    skip = {s.lower() for s in skip}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name.lower() not in skip]


def missing_as_null(df: DataFrame, columns: Iterable[str], non_negative: bool = False) -> DataFrame:
    """NaN and infinities (and negatives) become NULL, the only missing value."""
    def clean(c: str) -> Column:
        x = F.col(c).cast("double")
        ok = ~F.isnan(x) & (F.abs(x) != float("inf"))
        return F.when(ok & (x >= 0) if non_negative else ok, F.col(c)).alias(c)

    columns = set(columns)
    return df.select(*[clean(c) if c in columns else F.col(c) for c in df.columns])


QUARTILES = (0.25, 0.5, 0.75)


def _quantile(c: str, i: int) -> Column:
    return F.get(F.percentile(c, F.array(*[F.lit(p) for p in QUARTILES])), F.lit(i))


#: The eleven built-in aggregations; quantiles are exact, with linear interpolation.
AGGREGATES: dict[str, Callable[[str], Column]] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "median": lambda c: _quantile(c, 1),
    "sum": F.sum,
    "q25": lambda c: _quantile(c, 0),
    "q75": lambda c: _quantile(c, 2),
    "iqr": lambda c: _quantile(c, 2) - _quantile(c, 0),
    "range": lambda c: F.max(c) - F.min(c),
    "cv": lambda c: F.try_divide(F.stddev_pop(c), F.avg(c)),
}


def aggregate_windows(
    df: DataFrame, by: list[str], features: list[str], functions: list[str] | None = None, custom: dict[str, Callable[[str], Column]] | None = None,
    min_windows: int = 1, min_valid: int = 1, nan_policy: str = "omit",
) -> DataFrame:
    """One row per group: ``{feature}_{function}`` and ``n_windows``.

    A feature with fewer than ``min_valid`` values gives NULL. ``nan_policy``:
    ``omit`` skips missing values, ``propagate`` makes the result NULL where one
    is missing, ``raise`` fails. Groups with fewer than ``min_windows`` rows
    drop out. ``custom`` adds functions from a column name to an aggregate.
    """
    if nan_policy not in ("omit", "propagate", "raise"):
        raise ValueError(f"unknown policy {nan_policy}")
    known = AGGREGATES | (custom or {})
    functions = functions or ["mean", "std", "min", "max", "median"]
    if set(functions) & {"median", "q25", "q75", "iqr"} and (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > qt.SMALL:
        # a large group: quartiles by feature from counts, then as if they were columns of the group
        q = qt.group_quantiles(melt(df, by, features), [*by, "feature"], "value", list(QUARTILES))
        q = q.groupBy(*by).pivot("feature", features).agg(F.first("q"))
        q = q.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[F.col(f"`{c}`").alias(f"_q_{c}") for c in features])
        df = df.join(q, [df[c].eqNullSafe(q[f"_by{i}"]) for i, c in enumerate(by)], "left")
        at = lambda c, i: F.get(F.first(f"_q_{c}"), F.lit(i))
        known = known | {"median": lambda c: at(c, 1), "q25": lambda c: at(c, 0), "q75": lambda c: at(c, 2), "iqr": lambda c: at(c, 2) - at(c, 0)}
    out = [F.count("*").alias("n_windows")]
    for c in features:
        ok = F.count(c) >= min_valid
        if nan_policy == "propagate":
            ok = ok & (F.count(c) == F.count("*"))
        for f in functions:
            v = F.when(ok, known[f](c))
            if nan_policy == "raise":
                v = F.when(F.count(c) < F.count("*"), F.raise_error(F.lit(f"missing values in {c}")).cast("double")).otherwise(v)
            out.append(v.alias(f"{c}_{f}"))
    return df.groupBy(*by).agg(*out).filter(F.col("n_windows") >= min_windows)


def valid_counts(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """How many values each feature has in each group."""
    return df.groupBy(*by).agg(*[F.count(c).alias(f"{c}_valid") for c in features])


def feature_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature: mean, sample deviation, extremes, median and quartiles."""
    long = melt(df, [], features)
    m = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = qt.group_quantiles(long, ["feature"], "value", list(QUARTILES))
    return m.join(q, "feature", "left").select("feature", "mean", "std", "min", "max", *[F.get("q", F.lit(i)).alias(n) for i, n in ((1, "median"), (0, "q25"), (2, "q75"))])


def melt(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Wide to long: ``ids, feature, value``."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(ids, features, "feature", "value")


def concat(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _one_row(df: DataFrame, aggs: list[Column]) -> dict:
    """One row of column statistics, as many as there are columns."""
    return df.agg(*aggs).first().asDict()


def normalize(df: DataFrame, features: list[str], method: str = "zscore") -> DataFrame:
    """Scaled columns: ``zscore`` (sample deviation), ``minmax`` or ``robust`` (quartile range + 1e-8).

    A constant column gives NULL for the first two.
    """
    stats = {
        "zscore": lambda c: (F.avg(c), F.stddev_samp(c)),
        "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
        "robust": None,
    }
    if method not in stats:
        raise ValueError(f"unknown method {method}")
    if method == "robust":
        q = qt.column_quantiles(df, features, list(QUARTILES))
        s = {f"{n}{i}": x for i, c in enumerate(features) for n, x in zip("ab", (q[c][1], q[c][2] - q[c][0] + 1e-8) if c in q else (None, None))}
    else:
        s = _one_row(df, [x.alias(f"{n}{i}") for i, c in enumerate(features) for n, x in zip("ab", stats[method](c))])
    lit = lambda v: F.lit(v).cast("double")
    new = {c: F.try_divide(F.col(c) - lit(s[f"a{i}"]), lit(s[f"b{i}"])) for i, c in enumerate(features)}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def fill_missing(df: DataFrame, features: list[str], method: str = "mean") -> DataFrame:
    """``mean`` or exact ``median`` of the column, ``zero``, or ``drop`` rows with any gap."""
    if method == "drop":
        return df.dropna(subset=features)
    if method == "zero":
        return df.fillna(0, features)
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method {method}")
    if method == "mean":
        s = _one_row(df, [F.avg(c).alias(c) for c in features])
    else:
        s = dict.fromkeys(features) | {c: q[0] for c, q in qt.column_quantiles(df, features, [0.5]).items()}
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(s[c]).cast("double")).alias(c) if c in s else F.col(c) for c in df.columns])


def select_features(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise KeyError(f"no such features: {missing}")
    return df.select(*keys, *names)


def split_by_subject(df: DataFrame, test_subjects: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, by membership of the key in ``test_subjects``."""
    t = test_subjects.select(key).distinct()
    return df.join(t, key, "left_anti"), df.join(t, key, "left_semi")


def feature_matrix(df: DataFrame, by: list[str], feature: str, window: str) -> DataFrame:
    """One row per group: ``windows``, an array of all its ``(window, value)`` in window order.

    The value is NULL where a window lacks the feature. There is no fixed width: a
    group has as many entries as windows. Several rows of one window give the
    largest value; a row without a window has no place.
    """
    cells = df.groupBy(*by, F.col(window).alias("_w")).agg(F.max(feature).alias("_v"))
    entry = F.when(F.col("_w").isNotNull(), F.struct(F.col("_w").alias("window"), F.col("_v").alias("value")))
    return cells.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("windows"))


# --- labels ---------------------------------------------------------------------------


def label_distribution(labels: DataFrame, outcome: str) -> DataFrame:
    """Rows by value; NULL is a value."""
    return labels.groupBy(outcome).agg(F.count("*").alias("n"))


def labels_for(labels: DataFrame, key: str, outcome: str, ids: list) -> DataFrame:
    """``position, key, outcome`` of the listed ids in their order; NULL for an id without label, repeated ids again."""
    kind = labels.schema[key].dataType.simpleString()
    wanted = labels.sparkSession.createDataFrame(list(enumerate(ids)), f"position int, `{key}` {kind}")
    one = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(outcome).alias(outcome))
    return wanted.join(one, key, "left").select("position", key, outcome).orderBy("position")


def remap(labels: DataFrame, outcome: str, mapping: dict) -> DataFrame:
    """Values not in the mapping stay."""
    c = F.col(outcome)
    out = c
    for a, b in mapping.items():
        out = F.when(c == a, F.lit(b)).otherwise(out)
    return labels.withColumn(outcome, out)


def exclude(labels: DataFrame, outcome: str, values: list) -> DataFrame:
    """Listed values become missing."""
    return labels.withColumn(outcome, F.when(F.col(outcome).isin(values), None).otherwise(F.col(outcome)))


def merge_labels(features: DataFrame, labels: DataFrame, key: str, outcome: str, how: str = "inner") -> DataFrame:
    """Features with their outcome; rows without one drop out of an inner merge.

    ``labels`` must hold one row per key, else features would multiply: that is
    checked while the join runs and fails there.
    """
    one = labels.groupBy(key).agg(F.count("*").alias("_n"), F.first(outcome, True).alias(outcome))
    one = one.select(key, F.when(F.col("_n") > 1, F.raise_error(F.lit("several labels for one key")).cast(labels.schema[outcome].dataType)).otherwise(F.col(outcome)).alias(outcome))
    if how == "inner":
        one = one.filter(F.col(outcome).isNotNull())
    return features.join(one, key, how)
