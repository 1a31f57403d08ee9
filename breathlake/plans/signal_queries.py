"""Queries of the signal and breath operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathlake.functions.compare import nudged, rounded
from breathlake.operators import breaths as br
from breathlake.operators import signal as sg
from breathlake.session import cut, table
from breathlake.streaming.windows import stream_windows

SIZE_S, OVERLAP_S = 30.0, 6.0


def _samples(s: SparkSession, d: str) -> DataFrame:
    return sg.samples_from_windows(table(s, d, "signal_windows"))


def sliding_windows(s: SparkSession, d: str) -> DataFrame:
    return rounded(sg.window_stats(_samples(s, d), SIZE_S, OVERLAP_S))


def recording_shape(s: SparkSession, d: str) -> DataFrame:
    return rounded(sg.recording_shape(_samples(s, d)))


def window_count(s: SparkSession, d: str) -> DataFrame:
    return sg.window_count(sg.recording_shape(_samples(s, d)), SIZE_S, OVERLAP_S).select("recording_id", "n_windows")


def time_segment(s: SparkSession, d: str) -> DataFrame:
    seg = sg.time_segment(_samples(s, d), 10.0, 25.5)
    return rounded(seg.groupBy("recording_id").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.avg("x").alias("mean_x")))


def gap_runs(s: SparkSession, d: str) -> DataFrame:
    return sg.gap_runs(_samples(s, d)).select("recording_id", "kind", "start_idx", "end_idx")


def outlier_runs(s: SparkSession, d: str) -> DataFrame:
    return sg.outlier_runs(cut(_samples(s, d)))


def physical_runs(s: SparkSession, d: str) -> DataFrame:
    return sg.physical_runs(_samples(s, d))


def flat_runs(s: SparkSession, d: str) -> DataFrame:
    return sg.flat_runs(cut(_samples(s, d)))


def quality_report(s: SparkSession, d: str) -> DataFrame:
    x = cut(_samples(s, d))  # read several times
    return rounded(sg.quality_report(x, sg.all_issues(x)))


def gap_repair(s: SparkSession, d: str) -> DataFrame:
    x = cut(_samples(s, d))  # read several times
    return rounded(sg.repair(x, sg.outlier_runs(x)).filter("repaired").select("recording_id", "idx", "x"), 8)


def outlier_interpolate(s: SparkSession, d: str) -> DataFrame:
    return rounded(sg.remove_outliers(cut(_samples(s, d))).filter("replaced").select("recording_id", "idx", "x"), 7)


def fill_gaps(s: SparkSession, d: str) -> DataFrame:
    return rounded(sg.fill_missing(cut(_samples(s, d))).filter("replaced").select("recording_id", "idx", "x"), 7)


def detrend_linear(s: SparkSession, d: str) -> DataFrame:
    return rounded(sg.detrend(_samples(s, d)).select("recording_id", "idx", "x"), 4)


def detrend_constant(s: SparkSession, d: str) -> DataFrame:
    return rounded(sg.detrend(_samples(s, d), "constant").select("recording_id", "idx", "x"), 4)


def sign_segments(s: SparkSession, d: str) -> DataFrame:
    return rounded(sg.sign_segments(_samples(s, d)))


def _breaths(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "breath_peaks").dropDuplicates(["breath_id"])
    return b.select("breath_id", "recording_id", "phase", "peak_value", "volume", "duration", "start_time", "number_of_peaks")


def breath_metrics(s: SparkSession, d: str) -> DataFrame:
    return rounded(br.metrics(cut(_breaths(s, d)), ["recording_id"], "breath_id"))


def phase_pauses(s: SparkSession, d: str) -> DataFrame:
    p = br.pauses(cut(_breaths(s, d)), ["recording_id"])
    return rounded(p.groupBy("recording_id", "phase").agg(F.count("*").alias("n"), F.avg("pause").alias("mean_pause"), F.max("pause").alias("max_pause")))


def inter_breath_intervals(s: SparkSession, d: str) -> DataFrame:
    b = br.with_previous(_breaths(s, d).filter("phase = 'inhale'"), ["recording_id"], "start_time", "breath_id")
    return rounded(b.select("breath_id", "recording_id", (F.col("start_time") - F.col("prev")).alias("ibi")).filter("ibi is not null"))


def window_breaths(s: SparkSession, d: str) -> DataFrame:
    return br.window_breaths(table(s, d, "signal_windows"))


def window_metrics(s: SparkSession, d: str) -> DataFrame:
    b = cut(br.window_breaths(table(s, d, "signal_windows")))
    return br.metrics(b, ["window_id"], "peak_location")


def bandpass_windows(s: SparkSession, d: str) -> DataFrame:
    return br.filter_windows(table(s, d, "signal_windows"))


def clean_signal(s: SparkSession, d: str) -> DataFrame:
    return sg.clean(_samples(s, d))[0].select("recording_id", "idx", "x")


def clean_filtered(s: SparkSession, d: str) -> DataFrame:
    """The whole chain with a band of breathing at its end."""
    return sg.clean(_samples(s, d), cutoff=br.Cutoff())[0].select("recording_id", "idx", "x")


def signal_traces(s: SparkSession, d: str) -> DataFrame:
    """Raw and cleaned signal side by side, one point for each 10 s."""
    x = cut(_samples(s, d))  # read several times
    both = x.select("recording_id", "idx", "rate", F.col("x").alias("raw")).join(sg.detrend(x, "constant").select("recording_id", "idx", F.col("x").alias("level")), ["recording_id", "idx"])
    return rounded(both.groupBy("recording_id", F.floor(F.col("idx") / F.col("rate") / 10).alias("step")).agg(F.avg("raw").alias("raw"), F.avg("level").alias("level")), 5)


def event_windows(s: SparkSession, d: str) -> DataFrame:
    """The streaming operator on the whole table of events."""
    w = stream_windows(table(s, d, "events"), "user_id", "ts", "value", "6 hours", "3 hours")
    return rounded(w.select("user_id", F.unix_seconds("start").alias("start_s"), "n", "mean_x", "min_x", "max_x"))


QUERIES = {
    f.__name__: f
    for f in (sliding_windows, recording_shape, window_count, time_segment, gap_runs, outlier_runs, physical_runs, flat_runs, quality_report, gap_repair, outlier_interpolate, fill_gaps,
              detrend_linear, detrend_constant, sign_segments, breath_metrics, phase_pauses, inter_breath_intervals, window_breaths, window_metrics, bandpass_windows, clean_signal, clean_filtered, signal_traces, event_windows)
}

_S = """w0 as (select distinct window_id, recording_id, start_idx, sampling_rate rate, window_data from signal_windows),
    s0 as (select recording_id, rate, start_idx, unnest(window_data) x, generate_subscripts(window_data, 1) - 1 k from w0),
    samples as (select recording_id, start_idx + k idx, max(case when isfinite(x) then x end) x, max(rate) rate from s0 group by 1, 2)"""


def _runs(name: str, source: str, by: str = "recording_id") -> str:
    """Half-open runs of consecutive idx among the rows of ``source``."""
    return f"""{name} as (select {by}, min(idx) start_idx, max(idx) + 1 end_idx
        from (select {by}, idx, idx - row_number() over (partition by {by} order by idx) g from {source}) group by {by}, g)"""


_OUT = """m1 as (select recording_id, median(x) med, avg(x) mean, stddev_pop(x) sd from samples group by 1),
    m2 as (select recording_id, any_value(med) med, any_value(mean) mean, any_value(sd) sd, median(abs(x - med)) mad from samples join m1 using (recording_id) where x is not null group by 1),
    outs as (select s.recording_id, idx from samples s join m2 using (recording_id) where case when mad < 1e-10 then abs(x - mean) > 10 * sd else abs(x - med) > 10 * mad end)"""
_GAP = f"""g0 as (select recording_id, rate, idx, case when x is null then 'missing' when abs(x) < 1e-10 then 'zero' end kind from samples where x is null or abs(x) < 1e-10),
    {_runs('g1', 'g0', 'recording_id, rate, kind')},
    gaps as (select recording_id, kind, start_idx, end_idx from g1 where (end_idx - start_idx) / rate >= 1.0)"""
_FLAT = f"""f0 as (select *, cast(floor(5.0 * rate + 1e-9) as bigint) w from samples),
    f1 as (select recording_id, idx, w, count(x) over v n, max(idx) over v - idx span, stddev_pop(x) over v sd from f0 window v as (partition by recording_id order by idx rows between current row and w - 1 following)),
    f2 as (select recording_id, w, idx from f1 where w >= 2 and n = w and span = w - 1 and sd < 0.001),
    {_runs('f3', 'f2', 'recording_id, w')},
    f4 as (select recording_id, unnest(generate_series(start_idx, end_idx + w - 2)) idx from f3),
    f5 as (select distinct recording_id, idx from f4),
    {_runs('flats', 'f5')}"""
_PHYS = f"ph0 as (select recording_id, idx from samples where x < -100 or x > 100), {_runs('phys', 'ph0')}"


def _interpolated(bad: str, extra: str = "") -> str:
    return f"""with {_S}{extra},
        t as (select *, ({bad}) bad from samples {'join q using (recording_id)' if extra else ''}),
        good as (select recording_id, list(struct_pack(i := idx, x := x) order by idx) g from t where not coalesce(bad, false) and x is not null group by 1),
        u as (select recording_id, idx, coalesce(bad, false) bad,
                last_value(case when not coalesce(bad, false) and x is not null then struct_pack(i := idx, x := x) end ignore nulls) over (partition by recording_id order by idx rows between unbounded preceding and 1 preceding) l,
                first_value(case when not coalesce(bad, false) and x is not null then struct_pack(i := idx, x := x) end ignore nulls) over (partition by recording_id order by idx rows between 1 following and unbounded following) r from t),
        v as (select recording_id, idx, case when l is not null and r is not null then l when l is not null then g[-2] else r end a, case when l is not null and r is not null then r when l is not null then g[-1] else g[2] end b
              from u join good using (recording_id) where bad and len(g) >= 2)
        select recording_id, idx, round(a.x + (b.x - a.x) * (idx - a.i) / (b.i - a.i), 7) x from v"""


def _metrics_sql() -> str:
    k = "({v} is not null and ({s} = 0 or abs({v} - {m}) <= 3 * {s}))"
    keep = {f: k.format(v=f, m=f"m_{f}", s=f"s_{f}") for f in ("vol", "dur", "val")}
    agg = []
    for p in ("inhale", "exhale"):
        for f in ("vol", "dur", "val"):
            agg.append(f"avg({f}) filter (phase = '{p}' and {keep[f]}) {p}_{f}")
        for f in ("vol", "dur"):
            agg.append(f"stddev_pop({f}) filter (phase = '{p}' and {keep[f]}) {p}_{f}_sd")
        agg += [f"count(*) filter (phase = '{p}') n_{p}", f"count(*) filter (phase = '{p}' and number_of_peaks > 1) multi_{p}"]
    real = {
        "inhale_volume": "inhale_vol", "exhale_volume": "exhale_vol", "inhale_duration": "inhale_dur", "exhale_duration": "exhale_dur", "inhale_value": "inhale_val", "exhale_value": "exhale_val",
        "inter_breath_interval": "ibi", "rate": "1 / pos", "tidal_volume": "inhale_vol + exhale_vol", "minute_ventilation": "(inhale_vol + exhale_vol) / pos",
        "duty_cycle_inhale": "inhale_dur / pos", "duty_cycle_exhale": "exhale_dur / pos", "cov_inhaledutycycle": "inhale_dur_sd / nullif(inhale_dur, 0)", "cov_exhaledutycycle": "exhale_dur_sd / nullif(exhale_dur, 0)",
        "cov_breathingrate": "ibi_sd / pos", "cov_inhalevolume": "inhale_vol_sd / nullif(inhale_vol, 0)", "cov_exhalevolume": "exhale_vol_sd / nullif(exhale_vol, 0)",
        "post_inhale_pause_mean": "pi_m", "post_inhale_pause_std": "pi_s", "post_exhale_pause_mean": "pe_m", "post_exhale_pause_std": "pe_s", "pause_dutycycle_inhale": "pi_m / pos", "pause_dutycycle_exhale": "pe_m / pos",
    }
    count = {"multiphasic_count": "multi_inhale + multi_exhale", "multiphasic_inhale_count": "multi_inhale", "multiphasic_exhale_count": "multi_exhale", "peaksperbreath_max": "pk_max"}
    ratio = {"multiphasic_ratio": "(multi_inhale + multi_exhale) / (n_inhale + n_exhale)", "multiphasic_inhale_ratio": "multi_inhale / n_inhale", "multiphasic_exhale_ratio": "multi_exhale / n_exhale", "peaksperbreath_mean": "pk_mean"}
    both = "n_inhale > 0 and n_exhale > 0"
    cols = [f"case when {both} then round({v}, 6) end {n}" for n, v in real.items()] + [f"case when {both} then {v} else 0 end {n}" for n, v in count.items()] + [f"round(case when {both} then {v} else 0 end, 6) {n}" for n, v in ratio.items()]
    return f"""with b as (select distinct breath_id, recording_id, phase, case when phase = 'exhale' then abs(peak_value) else peak_value end val, case when phase = 'exhale' then abs(volume) else volume end vol, duration dur, start_time, number_of_peaks from breath_peaks where phase in ('inhale', 'exhale')),
        m as (select recording_id, phase, avg(vol) m_vol, stddev_pop(vol) s_vol, avg(dur) m_dur, stddev_pop(dur) s_dur, avg(val) m_val, stddev_pop(val) s_val from b group by 1, 2),
        g as (select recording_id, {', '.join(agg)}, avg(number_of_peaks) pk_mean, max(number_of_peaks) pk_max from b join m using (recording_id, phase) group by 1),
        i0 as (select recording_id, start_time - lag(start_time) over (partition by recording_id order by start_time, breath_id) v from b where phase = 'inhale'),
        i1 as (select *, avg(v) over (partition by recording_id) m, stddev_pop(v) over (partition by recording_id) s from i0 where v is not null),
        i as (select recording_id, avg(v) ibi, stddev_pop(v) ibi_sd from i1 where s = 0 or abs(v - m) <= 3 * s group by 1),
        {_PAUSE},
        p1 as (select *, avg(pause) over (partition by recording_id, phase) m, stddev_pop(pause) over (partition by recording_id, phase) s from p0),
        p as (select recording_id, avg(pause) filter (phase = 'inhale') pi_m, stddev_pop(pause) filter (phase = 'inhale') pi_s, avg(pause) filter (phase = 'exhale') pe_m, stddev_pop(pause) filter (phase = 'exhale') pe_s from p1 where s = 0 or abs(pause - m) <= 3 * s group by 1),
        z as (select *, case when ibi > 0 then ibi end pos from g left join i using (recording_id) left join p using (recording_id))
        select recording_id, {', '.join(cols)} from z"""


_PAUSE = """p0 as (select x.recording_id, x.phase, min(y.start_time) - any_value(x.start_time + x.dur) pause from b x join b y on x.recording_id = y.recording_id and x.phase <> y.phase and y.start_time > x.start_time + x.dur
            group by x.recording_id, x.phase, x.breath_id having min(y.start_time) - any_value(x.start_time + x.dur) >= 0.05)"""

ORACLE = {
    "sliding_windows": f"""with {_S}, e0 as (select *, cast(floor({SIZE_S} * rate) as bigint) w, cast(floor({SIZE_S} * rate) as bigint) - cast(floor({OVERLAP_S} * rate) as bigint) step from samples),
        e as (select *, unnest(generate_series(greatest(0, cast(ceil((idx - w + 1) / step) as bigint)), cast(floor(idx / step) as bigint))) window_index from e0)
        select recording_id, window_index, window_index * any_value(step) start_idx, round(window_index * any_value(step) / any_value(rate), 6) start_time, round((window_index * any_value(step) + any_value(w)) / any_value(rate), 6) end_time,
        count(x) n_valid, round(avg(x), 6) mean_x, round(stddev_pop(x), 6) sd_x, min(x) min_x, max(x) max_x from e group by 1, 2 having count(*) = any_value(w)""",
    "recording_shape": f"with {_S} select recording_id, count(*) n_samples, max(rate) rate, count(x) n_valid, round(count(*) / max(rate), 6) duration_s from samples group by 1",
    "window_count": f"""with {_S}, n as (select recording_id, count(*) n, floor({SIZE_S} * max(rate)) w, floor({SIZE_S} * max(rate)) - floor({OVERLAP_S} * max(rate)) st from samples group by 1)
        select recording_id, cast(case when n >= w then floor((n - w) / st) + 1 else 0 end as bigint) n_windows from n""",
    "time_segment": f"with {_S} select recording_id, count(*) n, min(idx) first_idx, max(idx) last_idx, round(avg(x), 6) mean_x from samples where idx >= floor(10.0 * rate) and idx < floor(25.5 * rate) group by 1",
    "gap_runs": f"with {_S}, {_GAP} select * from gaps",
    "outlier_runs": f"with {_S}, {_OUT}, {_runs('r', 'outs')} select * from r",
    "physical_runs": f"with {_S}, {_PHYS} select * from phys",
    "flat_runs": f"with {_S}, {_FLAT} select * from flats",
    "quality_report": f"""with {_S}, {_GAP}, {_OUT}, {_runs('o', 'outs')}, {_PHYS}, {_FLAT},
        i as (select recording_id, start_idx, end_idx from gaps union all select recording_id, start_idx, end_idx from flats union all select recording_id, start_idx, end_idx from o union all select recording_id, start_idx, end_idx from phys),
        bad as (select recording_id, count(distinct j) bad from (select recording_id, unnest(generate_series(start_idx, end_idx - 1)) j from i) group by 1),
        n as (select recording_id, count(*) c from i group by 1),
        t as (select recording_id, count(*) total_samples from samples group by 1),
        v as (select recording_id, total_samples, total_samples - coalesce(bad, 0) valid_samples, coalesce(c, 0) n_issues from t left join bad using (recording_id) left join n using (recording_id))
        select *, round(valid_samples / total_samples * 100, 6) percent_valid, case when valid_samples / total_samples * 100 < 50 then 'reject' when valid_samples / total_samples * 100 < 80 then 'clean' else 'accept' end recommendation from v""",
    "gap_repair": f"""with {_S}, {_OUT}, {_runs('r', 'outs')},
        k as (select r.*, a.x ax, b.x bx, a.idx is not null and b.idx is not null two, (select max(rate) from samples s where s.recording_id = r.recording_id) rate from r
              left join samples a on a.recording_id = r.recording_id and a.idx = r.start_idx - 1 left join samples b on b.recording_id = r.recording_id and b.idx = r.end_idx),
        e as (select *, unnest(generate_series(start_idx, end_idx - 1)) idx from k where two or end_idx - start_idx > floor(10.0 * rate))
        select recording_id, idx, case when end_idx - start_idx <= floor(10.0 * rate) then round(ax + (bx - ax) * (idx - start_idx + 1) / (end_idx - start_idx + 1), 8) end x from e""",
    "outlier_interpolate": _interpolated("abs(x - m) > 5.0 * sd", ", q as (select recording_id, avg(x) m, stddev_pop(x) sd from samples group by 1)"),
    "fill_gaps": _interpolated("x is null"),
    "detrend_linear": f"with {_S}, f as (select recording_id, regr_slope(x, idx) b, regr_intercept(x, idx) a from samples group by 1) select recording_id, idx, round(x - (a + b * idx), 4) x from samples join f using (recording_id)",
    "detrend_constant": f"with {_S}, f as (select recording_id, avg(x) m from samples group by 1) select recording_id, idx, round(x - m, 4) x from samples join f using (recording_id)",
    "sign_segments": f"""with {_S}, q as (select *, case when x > 0 then 1 when x < 0 then -1 end side from samples where x <> 0),
        r as (select *, idx - row_number() over (partition by recording_id, side order by idx) g from q),
        a as (select recording_id, side, min(idx) start_idx, max(idx) + 1 end_idx, max(rate) rate, sum(x) sx, arg_min(x, idx) x0, arg_max(x, idx) x1,
              (list(struct_pack(k := -abs(x), i := idx, v := x) order by abs(x) desc, idx))[1] pk from r group by recording_id, side, g)
        select recording_id, side, start_idx, end_idx, round(case when end_idx - start_idx = 1 then 0 else (sx - x0 / 2 - x1 / 2) / rate end, 6) volume, round((end_idx - 1 - start_idx) / rate, 6) duration, pk.v peak_value, pk.i peak_idx, round((pk.i - start_idx) / rate, 6) latency from a""",
    "breath_metrics": _metrics_sql(),
    "phase_pauses": f"""with b as (select distinct breath_id, recording_id, phase, duration dur, start_time from breath_peaks where phase in ('inhale', 'exhale')), {_PAUSE}
        select recording_id, phase, count(*) n, round(avg(pause), 6) mean_pause, round(max(pause), 6) max_pause from p0 group by 1, 2""",
    "signal_traces": f"""with {_S}, f as (select recording_id, avg(x) m from samples group by 1)
        select recording_id, cast(floor(idx / rate / 10) as bigint) step, round(avg(x), 5) raw, round(avg(x - m), 5) level from samples join f using (recording_id) group by 1, 2""",
    "event_windows": """with e as (select user_id, value, cast(floor(epoch_us(ts) / 10800e6) as bigint) * 10800 - unnest([0, 10800]) start_s from events)
        select user_id, start_s, count(value) n, round(avg(value), 6) mean_x, round(min(value), 6) min_x, round(max(value), 6) max_x from e group by 1, 2""",
    "inter_breath_intervals": """with b as (select distinct breath_id, recording_id, start_time from breath_peaks where phase = 'inhale'),
        i as (select breath_id, recording_id, start_time - lag(start_time) over (partition by recording_id order by start_time, breath_id) ibi from b) select breath_id, recording_id, round(ibi, 6) ibi from i where ibi is not null""",
}
ORACLE = {k: nudged(v) for k, v in ORACLE.items()}
