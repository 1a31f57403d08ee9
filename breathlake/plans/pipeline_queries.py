"""The whole way from signal windows to features, comparison and a model, as queries on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathlake.functions.keys import subject_key
from breathlake.functions.metrics import METRICS
from breathlake.operators import features as ft
from breathlake.operators import ml, select
from breathlake.plans import pipeline as pl
from breathlake.plans.feature_queries import _labels
from breathlake.session import cut, table

CONFIG = pl.Config()
NAMES = [f"{c}_{f}" for c in METRICS for f in CONFIG.functions]
#: Features of the model: those with the smallest p.
BEST = 5


def pipeline_recordings(s: SparkSession, d: str) -> DataFrame:
    """Windows to samples, cleaning, windows anew, breaths, metrics: one row for each recording."""
    return pl.recording_features(pl.clean_windows(table(s, d, "signal_windows"), CONFIG), CONFIG, unique=True)


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Features of recordings with their subject and its latest outcome."""
    owner = table(s, d, "recordings").groupBy("recording_id").agg(F.max(subject_key("subject_id")).alias("subject"))
    labelled = ft.merge_labels(owner, _labels(s, d), "subject", "recovery")  # narrow rows meet first
    return cut(pipeline_recordings(s, d).join(labelled, "recording_id"))


def pipeline_comparison(s: SparkSession, d: str) -> DataFrame:
    """All features of recordings between the outcomes."""
    return pl.compare_outcome(_labelled(s, d), "recovery", NAMES, CONFIG)


def pipeline_predictions(s: SparkSession, d: str) -> DataFrame:
    """A logistic model on the best of the comparison, fitted without the subjects of one site and applied to all recordings."""
    rows = _labelled(s, d)
    scores = pl.compare_outcome(rows, "recovery", NAMES, CONFIG).select("feature", F.col("p_value").alias("score"))
    best = [r["feature"] for r in select.top_n(scores, BEST, ascending=True).collect()]  # names only
    north = table(s, d, "subjects").filter("site = 'north'").select(subject_key("subject_id").alias("subject")).dropna().distinct()
    rows = rows.select("recording_id", "subject", *best, F.col("recovery").cast("double").alias("label"))
    rows = cut(ft.fill_missing(rows, best, "median").join(north.withColumn("held_out", F.lit(True)), "subject", "left").fillna(False, ["held_out"]))
    model = ml.Classifier("logistic", best).fit(rows.filter("not held_out"))
    return model.predict(rows).select("recording_id", "label", "held_out", "prediction", "score")


QUERIES = {f.__name__: f for f in (pipeline_recordings, pipeline_comparison, pipeline_predictions)}
#: Peak rules have no SQL; their parts are tested one by one.
ORACLE: dict[str, str] = {}
