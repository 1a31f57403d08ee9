"""Queries of the general problems 1, 2 and 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathlake.functions.keys import subject_key
from breathlake.functions.metrics import COUNTS, METRICS, POSTURES, SENSORS
from breathlake.operators.impute import ImputeSpec, filled_cells, impute, impute_matrices
from breathlake.operators.orphans import Entity, ForeignKey, cascade_orphans, orphan_report
from breathlake.operators.spikes import breath_spikes, confirmed_issues, signal_spikes
from breathlake.session import table


def _subjects(spark: SparkSession, d: str) -> Entity:
    s = table(spark, d, "subjects").select(subject_key("subject_id").alias("subject"), "registered_at", "deleted_at").distinct()
    s = s.filter("subject is not null and registered_at is not null").withColumn("id", F.xxhash64("subject", "registered_at", "deleted_at"))
    return Entity(s, "id", None, "registered_at", "deleted_at")


def _windows(spark: SparkSession, d: str) -> Entity:
    """A window sent more than once counts as it first arrived."""
    w = table(spark, d, "signal_windows").select("window_id", "recording_id", "window_index", "arrived_at", subject_key("subject_id").alias("subject"))
    first = F.struct(F.col("arrived_at").isNull(), F.col("arrived_at"), F.col("subject").isNull(), F.col("subject"))
    w = w.groupBy("window_id").agg(F.min("arrived_at").alias("arrived_at"), *[F.min_by(c, first).alias(c) for c in ("subject", "recording_id", "window_index")])
    return Entity(w, "window_id", "arrived_at")


def _labels(spark: SparkSession, d: str) -> Entity:
    c = table(spark, d, "clinical_labels").select("label_id", "arrived_at", subject_key("subject_id").alias("subject"))
    first = F.struct(F.col("arrived_at").isNull(), F.col("arrived_at"), F.col("subject").isNull(), F.col("subject"))
    return Entity(c.groupBy("label_id").agg(F.min("arrived_at").alias("arrived_at"), F.min_by("subject", first).alias("subject")), "label_id", "arrived_at")


def _recordings(spark: SparkSession, d: str) -> Entity:
    r = table(spark, d, "recordings").select("recording_id", "uploaded_at", subject_key("subject_id").alias("subject"))
    first = F.struct(F.col("uploaded_at").isNull(), F.col("uploaded_at"), F.col("subject").isNull(), F.col("subject"))
    return Entity(r.groupBy("recording_id").agg(F.min("uploaded_at").alias("uploaded_at"), F.min_by("subject", first).alias("subject")), "recording_id", "uploaded_at", "uploaded_at")


def _cascade(spark: SparkSession, d: str, whole: bool) -> DataFrame:
    entities = {"subjects": _subjects(spark, d), "recordings": _recordings(spark, d), "signal_windows": _windows(spark, d), "clinical_labels": _labels(spark, d)}
    one, rec = ("subject",), ("recording_id",)
    keys = [ForeignKey("recordings", one, "subjects", one), ForeignKey("signal_windows", one, "subjects", one), ForeignKey("signal_windows", rec, "recordings", rec), ForeignKey("clinical_labels", one, "subjects", one)]
    if whole:
        came = entities["recordings"].df.select("recording_id", "uploaded_at")
        for name, key, time in (("breath_peaks", "breath_id", None), ("quality_issues", "issue_id", "logged_at"), ("window_features", "feature_id", None), ("feature_matrices", "matrix_id", None)):
            extra = ["window_index"] if name == "window_features" else []
            df = table(spark, d, name).select(key, "recording_id", *extra, *([time] if time else [])).dropDuplicates([key])
            if not time:  # what is derived from a recording counts by the month the recording came
                df = df.join(came, "recording_id", "left")
            entities[name] = Entity(df, key, time or "uploaded_at")
            keys.append(ForeignKey(name, rec, "recordings", rec))
        keys.append(ForeignKey("window_features", ("recording_id", "window_index"), "signal_windows", ("recording_id", "window_index")))
    return cascade_orphans(entities, keys)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Windows and labels that name a subject which did not live when they arrived."""
    o = _cascade(spark, d, whole=False)
    return o.filter("kind = 'direct' and missing_in = 'subjects' and ref_table in ('signal_windows', 'clinical_labels')").select("ref_table", "ref_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans of the whole graph, by table and month."""
    return orphan_report(_cascade(spark, d, whole=True))


_FEATURES = ImputeSpec(id=("feature_id",), numeric=METRICS, categories={"posture": POSTURES, "sensor": SENSORS}, integers=COUNTS, group="recording_id", order="window_index")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells that the imputation filled."""
    a = filled_cells(impute(table(spark, d, "window_features"), _FEATURES), "window_features", "feature_id")
    b = filled_cells(impute_matrices(table(spark, d, "feature_matrices")), "feature_matrices", "matrix_id", F.col("win_pos"))
    return a.unionByName(b)


def p2_window_features(spark: SparkSession, d: str) -> DataFrame:
    """``window_features`` with its gaps filled and marked."""
    return impute(table(spark, d, "window_features"), _FEATURES)


def p2_feature_matrices(spark: SparkSession, d: str) -> DataFrame:
    """``feature_matrices`` as filled records of one window each."""
    return impute_matrices(table(spark, d, "feature_matrices"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Bad samples of windows, bad breaths, and issues that the samples bear out."""
    s = signal_spikes(table(spark, d, "signal_windows"))
    w = s.select(F.explode("windows").alias("w")).select(F.col("w.window_id").alias("row_id"), F.explode("w.sample_pos").alias("sample_pos"))
    b = breath_spikes(table(spark, d, "breath_peaks")).select(F.col("breath_id").alias("row_id")).distinct()
    i = confirmed_issues(table(spark, d, "quality_issues"), s).select(F.col("issue_id").alias("row_id"))
    rows = [("signal_windows", w), ("breath_peaks", b.withColumn("sample_pos", F.lit(-1))), ("quality_issues", i.withColumn("sample_pos", F.lit(-1)))]
    out = None
    for name, df in rows:
        df = df.select(F.lit(name).alias("src_table"), "row_id", F.col("sample_pos").cast("int").alias("sample_pos"))
        out = df if out is None else out.unionByName(df)
    return out


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Baseline, suspected and bad samples of each recording's blocks."""
    s = signal_spikes(table(spark, d, "signal_windows"))
    bad = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["end_idx"] - r["start_idx"])
    return s.select("recording_id", "block", "center", "scale", "readings", "suspected", bad.alias("bad"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p2_window_features": p2_window_features, "p2_feature_matrices": p2_feature_matrices, "p4_found": p4_found, "p4_blocks": p4_blocks}

_KEY = "nullif(nullif(regexp_replace(upper({}), '[^A-Z0-9]', '', 'g'), ''), 'UNKNOWN')"


def _p2_sql() -> str:
    bad = "({0} is null or isnan(cast({0} as double)) or isinf(cast({0} as double)) or {0} < 0)"
    parts = [f"select 'window_features' src_table, feature_id row_id, '{m}' field_name, -1 win_pos from window_features where {bad.format(m)}" for m in METRICS]
    for c, values in (("posture", POSTURES), ("sensor", SENSORS)):
        listed = ", ".join(f"'{v}'" for v in values)
        parts.append(f"select 'window_features', feature_id, '{c}', -1 from window_features where {c} is null or {c} not in ({listed})")
    parts.append(
        "select 'feature_matrices', matrix_id, f, k from (select matrix_id, f, unnest(v) x, generate_subscripts(v, 1) - 1 k from "
        "(select matrix_id, unnest(feature_names) f, unnest(feature_values) v from feature_matrices)) where x is null or isnan(x) or isinf(x) or x < 0"
    )
    return "select distinct src_table, row_id, field_name, cast(win_pos as integer) win_pos from (" + " union all ".join(parts) + ")"


ORACLE = {
    "p1_found": f"""
        with s as (select distinct {_KEY.format('subject_id')} k, registered_at r, deleted_at x from subjects),
        w as (select 'signal_windows' ref_table, window_id ref_id, min(arrived_at) a, arg_min({_KEY.format('subject_id')}, arrived_at) k from signal_windows group by window_id
              union all select 'clinical_labels', label_id, min(arrived_at), arg_min({_KEY.format('subject_id')}, arrived_at) from clinical_labels group by label_id)
        select ref_table, ref_id from w where k is not null
        and not exists (select 1 from s where s.k = w.k and s.r <= w.a and (s.x is null or s.x > w.a))""",
    "p1_report": f"""
        with s as (select distinct {_KEY.format('subject_id')} k, registered_at r, deleted_at x from subjects where registered_at is not null),
        rec as (select recording_id id, min(uploaded_at) t, arg_min({_KEY.format('subject_id')}, uploaded_at) k from recordings group by 1),
        win as (select window_id id, min(arrived_at) t, arg_min({_KEY.format('subject_id')}, arrived_at) k, arg_min(recording_id, arrived_at) rid, arg_min(window_index, arrived_at) wi from signal_windows group by 1),
        lab as (select label_id id, min(arrived_at) t, arg_min({_KEY.format('subject_id')}, arrived_at) k from clinical_labels group by 1),
        bp as (select distinct breath_id id, recording_id rid from breath_peaks), qi as (select issue_id id, any_value(recording_id) rid, any_value(logged_at) t from quality_issues group by 1),
        wf as (select feature_id id, any_value(recording_id) rid, any_value(window_index) wi from window_features group by 1), fm as (select matrix_id id, any_value(recording_id) rid from feature_matrices group by 1),
        named as (select 'recordings' ref_table, id, t, k from rec union all select 'signal_windows', id, t, k from win union all select 'clinical_labels', id, t, k from lab),
        placed as (select 'signal_windows' ref_table, id, t, rid from win union all select 'quality_issues', id, t, rid from qi union all select 'breath_peaks', bp.id, rec.t, rid from bp left join rec on rec.id = rid
                   union all select 'window_features', wf.id, rec.t, rid from wf left join rec on rec.id = rid union all select 'feature_matrices', fm.id, rec.t, rid from fm left join rec on rec.id = rid),
        direct as (select ref_table, id, t from named where k is not null and not exists (select 1 from s where s.k = named.k and s.r <= named.t and (s.x is null or s.x > named.t))
                   union select ref_table, id, t from placed where rid is not null and not exists (select 1 from rec where rec.id = placed.rid and rec.t <= placed.t)
                   union select 'window_features', wf.id, rec.t from wf left join rec on rec.id = wf.rid where wf.rid is not null and wi is not null and not exists (select 1 from win where win.rid = wf.rid and win.wi = wf.wi)),
        one as (select ref_table, id, t from placed where rid in (select id from direct where ref_table = 'recordings')),
        lost as (select id from direct where ref_table = 'signal_windows' union select id from one where ref_table = 'signal_windows'),
        two as (select * from one union select 'window_features', wf.id, rec.t from wf join win on win.rid = wf.rid and win.wi = wf.wi left join rec on rec.id = wf.rid where win.id in (select id from lost)),
        inherited as (select * from two where not exists (select 1 from direct d where d.ref_table = two.ref_table and d.id = two.id)),
        rows_ as (select *, 1 d from direct union all select *, 0 from inherited)
        select ref_table, strftime(t, '%Y-%m') period, count(distinct case when d = 1 then id end) direct, count(distinct case when d = 0 then id end) inherited, count(distinct id) orphans from rows_ group by 1, 2""",
    "p2_found": _p2_sql(),
    "p4_found": """
        with w as (select distinct window_id, recording_id, start_idx, sampling_rate rate, window_data from signal_windows),
        s as (select window_id, recording_id, start_idx, rate, unnest(window_data) x, generate_subscripts(window_data, 1) - 1 k from w),
        d as (select recording_id, start_idx + k idx, max(x) x, max(rate) rate from s group by 1, 2),
        m as (select recording_id, median(x) m from d where isfinite(x) group by 1),
        e as (select recording_id, any_value(m) m, median(abs(x - m)) sd from d join m using (recording_id) where isfinite(x) group by 1),
        f as (select d.*, m, sd, cast(ceil(5 * rate - 1e-9) as bigint) l from d join e using (recording_id)),
        g as (select *, max(x) over v hi, min(x) over v lo, count(x) over v n, max(idx) over v - idx span from f
              window v as (partition by recording_id order by idx rows between current row and l - 1 following)),
        h as (select *, case when n = l and span = l - 1 and isfinite(hi) and isfinite(lo) and hi - lo <= 0.02 * sd then 1 else 0 end flat from g),
        b as (select *, max(flat) over (partition by recording_id order by idx range between l - 1 preceding and current row) inflat from h),
        bad as (select recording_id, idx from b where x is not null and (abs(x - m) > 8 * sd or abs(x) > 100 or inflat = 1)),
        p as (select distinct breath_id, recording_id, phase, start_time, peak_value v from breath_peaks where peak_value is not null),
        p2 as (select *, median(abs(v)) over (partition by recording_id, phase) md, case when v = lag(v) over o then 0 else 1 end new from p window o as (partition by recording_id, phase order by start_time, breath_id)),
        p3 as (select *, sum(new) over (partition by recording_id, phase order by start_time, breath_id) run from p2),
        p4 as (select *, count(*) over (partition by recording_id, phase, run) n from p3)
        select 'signal_windows' src_table, s.window_id row_id, cast(s.k as integer) sample_pos from s join bad on bad.recording_id = s.recording_id and bad.idx = s.start_idx + s.k
        union all select 'breath_peaks', breath_id, -1 from p4 where abs(v) > 4 * md or abs(v) > 100 or n >= 6
        union all select distinct 'quality_issues', issue_id, -1 from quality_issues q join bad on bad.recording_id = q.recording_id and idx >= q.start_idx and idx < q.end_idx
        where lower(trim(issue_type)) in ('outlier', 'flat', 'corruption')""",
}
