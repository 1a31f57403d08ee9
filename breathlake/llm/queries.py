"""Queries of the problems on training data (3, 5, 6, 7, 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breathlake.functions.keys import calendar_date, subject_key
from breathlake.llm.mixing import mixture_shares, plan_mixture, prepared, realise
from breathlake.llm.packing import container_fill, pack_documents
from breathlake.llm.segment import cut_windows
from breathlake.llm.spans import path_runs, shared_runs, shared_shares, shared_stretches
from breathlake.llm.splits import assign_groups, forced_pairs, propagate_labels
from breathlake.llm.tokens import token_counts
from breathlake.session import cut, table


def _person(c: str):
    return F.concat(F.lit("s:"), subject_key(c))


def _session():
    return F.concat(F.lit("d:"), F.col("device_id").cast("string"), F.lit("|"), calendar_date("recording_date"))


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    """Recordings with windows: person, or session where there is none."""
    r = table(spark, d, "recordings").dropDuplicates(["recording_id"])
    r = r.select("recording_id", "subject_id", _person("subject_id").alias("person"), _session().alias("session"))
    own = F.concat(F.lit("r:"), F.col("recording_id").cast("string"))
    return r.withColumn("record", own).withColumn("entity", F.coalesce("person", "session", own))


def _links(spark: SparkSession, d: str, records: DataFrame) -> DataFrame:
    """``records(record, entity)``, and the rows of ``subjects`` that name a former id, with the ids they name."""
    s = table(spark, d, "subjects").select(_person("subject_id").alias("now"), _person("prior_subject_id").alias("before")).dropna().distinct()
    return records.select("record", "entity").unionByName(s.select(F.concat_ws(">", "now", "before").alias("record"), F.explode(F.array("now", "before")).alias("entity")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of recordings that share a split though their ids do not say so."""
    seen = table(spark, d, "signal_windows").select("recording_id").distinct()
    r = cut(_recordings(spark, d).join(seen, "recording_id", "left_semi"))
    labels = propagate_labels(_links(spark, d, r))  # by the values in recordings alone
    grouped = r.join(labels, "entity").select(F.col("label").alias("group"), "subject_id", "person", "session", "recording_id")
    # an unnamed recording counts as written in its own way: all of one session pair up
    written = F.when(F.col("person").isNotNull(), F.col("subject_id")).otherwise(F.col("recording_id").cast("string"))
    rows = grouped.filter("person is not null or session is not null").select("group", written.alias("written"), F.col("recording_id").alias("id"))
    return forced_pairs(rows).select(F.col("a").alias("recording_id_a"), F.col("b").alias("recording_id_b"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    """A split for each window, whole persons and sessions together, recovery kept in balance."""
    w = table(spark, d, "signal_windows").select("window_id", "recording_id", _person("subject_id").alias("person")).dropDuplicates(["window_id"])
    w = w.withColumn("record", F.coalesce(F.concat(F.lit("r:"), F.col("recording_id").cast("string")), F.concat(F.lit("w:"), F.col("window_id").cast("string"))))
    r = _recordings(spark, d).filter("recording_id is not null").select("record", "entity")
    # windows link their recording to their own person, too; one of an unknown recording stands by its person, or alone
    named = w.select("record", F.col("person").alias("entity")).dropna().distinct()
    alone = w.select("record").distinct().join(r.unionByName(named).select("record").distinct(), "record", "left_anti").select("record", F.col("record").alias("entity"))
    links = cut(r.unionByName(named).unionByName(alone))
    labels = propagate_labels(_links(spark, d, links))
    groups = cut(links.join(labels, "entity").groupBy("record").agg(F.min("label").alias("group")))
    c = table(spark, d, "clinical_labels").select(_person("subject_id").alias("entity"), "recovery").dropna()
    outcome = c.groupBy("entity").agg(F.max("recovery").cast("string").alias("recovery"))
    # each window has the outcome of its own person, so a group of several persons may have several
    own = r.groupBy("record").agg(F.min("entity").alias("named"))
    w = w.join(groups, "record").join(own, "record", "left").withColumn("entity", F.coalesce("person", "named")).join(outcome, "entity", "left")
    w = cut(w.select("window_id", "recording_id", "group", "recovery"))
    members = w.groupBy("group", F.col("recovery").alias("stratum")).agg(F.count("*").alias("n"))
    targets = [(t["split_name"], t["target_share"]) for t in table(spark, d, "split_targets").orderBy("split_name").collect()]  # as many as splits
    return w.join(assign_groups(members, targets), "group")


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached, of windows and of each outcome, beside the targets."""
    w = p3_split(spark, d)
    by = w.groupBy("split").agg(F.count("*").alias("windows"), F.count_distinct("group").alias("groups"), F.avg(F.when(F.col("recovery") == "1", 1.0).when(F.col("recovery") == "0", 0.0)).alias("recovered"))
    n = by.agg(F.sum("windows")).first()[0]
    t = table(spark, d, "split_targets").select(F.col("split_name").alias("split"), "target_share")
    return t.join(by, "split", "left").withColumn("share", F.coalesce("windows", F.lit(0)) / F.lit(float(n or 1)))


def p3_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold: every window has its split, no group and no pair of ``p3_found`` has two."""
    w = cut(p3_split(spark, d))
    torn = w.groupBy("group").agg(F.count_distinct("split").alias("n")).filter("n > 1").agg(F.count("*").alias("groups_apart"))
    split = w.groupBy("recording_id").agg(F.min("split").alias("s"), F.max("split").alias("t"))
    a, b = (split.select(F.col("recording_id").alias(f"recording_id_{x}"), F.col("s").alias(f"s_{x}"), F.col("t").alias(f"t_{x}")) for x in "ab")
    apart = p3_found(spark, d).join(a, "recording_id_a").join(b, "recording_id_b").filter("s_a <> t_a or s_b <> t_b or s_a <> s_b").agg(F.count("*").alias("pairs_apart"))
    return w.agg(F.count("*").alias("windows"), F.count(F.when(F.col("split").isNull(), 1)).alias("without_split")).join(torn, F.lit(True)).join(apart, F.lit(True))  # one row each


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the windows that are longer than their configuration allows."""
    return cut_windows(table(spark, d, "signal_windows"), table(spark, d, "window_configs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The windows that had to be cut."""
    return p5_pieces(spark, d).filter("piece = 0").select("window_id")


def p5_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each cut window: no piece too long, overlaps as configured, nothing left out."""
    p = p5_pieces(spark, d)
    w = table(spark, d, "signal_windows").dropDuplicates(["window_id"]).select("window_id", "config_id", "sampling_rate", F.col("start_idx").alias("at"))
    p = p.join(w, "window_id").join(table(spark, d, "window_configs").select("config_id", "window_size", "overlap"), "config_id")
    after = F.lag("end_idx").over(Window.partitionBy("window_id").orderBy("piece"))
    p = p.withColumn("shared", after - F.col("start_idx"))
    long = F.col("end_idx") - F.col("start_idx") > F.col("window_size") * F.col("sampling_rate") + 1e-6
    other = (F.col("piece") > 0) & (F.abs(F.col("shared") - F.col("overlap") * F.col("sampling_rate")) > 0.5)
    missing = (F.col("piece") == 0) & (F.col("start_idx") != F.col("at"))
    n = lambda c: F.count(F.when(c, 1))
    return p.groupBy("window_id").agg(n(long).alias("too_long"), n(other).alias("other_overlap"), n(missing).alias("late_start"), (F.max("pieces") - F.count("*")).alias("missing_pieces"))


def _capacities(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    return [(r[0], r[1]) for r in table(spark, d, "pack_capacities").select("capacity_id", "capacity_tokens").distinct().orderBy("capacity_id").collect()]  # a fixed small table


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """A container for each commit or piece, for each capacity."""
    return pack_documents(token_counts(table(spark, d, "documents")), _capacities(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and room left by capacity."""
    return container_fill(p6_containers(spark, d), _capacities(spark, d))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold by capacity: every document is there, none within the capacity is split, no token is lost, no container too full."""
    sized = cut(token_counts(table(spark, d, "documents")).dropDuplicates(["doc_id"]))
    caps = _capacities(spark, d)
    p = cut(pack_documents(sized, caps))
    size = F.create_map(*[F.lit(x) for c in caps for x in c])[F.col("capacity_id")]
    boxes = p.filter("container is not null").groupBy("capacity_id", "shard", "container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    full = boxes.groupBy("capacity_id").agg(F.count(F.when(F.col("used") > size, 1)).alias("overfull"))
    docs = p.groupBy("capacity_id", "doc_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("placed"), F.count("*").alias("pieces")).join(sized, "doc_id", "full")
    ok = docs.groupBy("capacity_id").agg(F.count("*").alias("documents"), F.count(F.when(F.col("placed") != F.col("n_tokens"), 1)).alias("incomplete"), F.count(F.when((F.col("pieces") > 1) & (F.col("n_tokens") <= size), 1)).alias("split_needlessly"))
    return ok.join(full, "capacity_id").select("capacity_id", "documents", "incomplete", "split_needlessly", "overfull")


#: Size of the mixture in tokens of its sources. Larger ones lie farther from the targets: some sources may not repeat.
EPOCHS = 0.25


def _mixture(spark: SparkSession, d: str, epochs: float = EPOCHS, **plan) -> tuple[DataFrame, DataFrame]:
    """Documents with their repeats, and the plan."""
    sized = prepared(token_counts(table(spark, d, "documents"), keep=("doc_id", "source")))
    p = plan_mixture(sized, table(spark, d, "mix_targets"), epochs, **plan)
    return realise(sized, p), p


def _shares(spark: SparkSession, d: str, **plan) -> DataFrame:
    mixed, p = _mixture(spark, d, **plan)
    return mixture_shares(mixed, table(spark, d, "mix_targets"), p)


def p7_repeats(spark: SparkSession, d: str) -> DataFrame:
    """How often each commit is taken for a mixture of ``EPOCHS`` times the tokens of its sources."""
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares wanted, planned and reached by source."""
    return _shares(spark, d)


def p7_exact(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the largest mixture that keeps the target shares themselves; the scarcest source sets its size."""
    return _shares(spark, d, exact=True)


def p7_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture of a tenth of the tokens, which is nearer to the targets."""
    return _shares(spark, d, epochs=0.1)


def p7_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture with the entropy of the target shares, by temperature alone."""
    t = table(spark, d, "mix_targets").filter("source is not null and target_share > 0").dropDuplicates(["source"])
    p = F.col("target_share")
    h = t.agg((F.log(F.sum(p)) - F.sum(p * F.log(p)) / F.sum(p)).alias("h")).first()[0]
    return _shares(spark, d, entropy=float(h or 0.0))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold by source: all documents are there, none beyond its limit, repeats one apart at most, tokens within 1 % of the plan or a document of it."""
    mixed, plan = _mixture(spark, d)
    mixed = cut(mixed)
    g = mixed.filter("source is not null").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("largest"), F.max("repeats").alias("most"), F.min(F.when(F.col("n_tokens") > 0, F.col("repeats"))).alias("least"))
    g = g.join(plan.select("source", "max_repeats", "planned_tokens"), "source", "left").fillna(0, ["max_repeats", "planned_tokens"])
    off = F.abs(F.col("tokens") - F.col("planned_tokens")) > F.greatest(F.col("planned_tokens") * 0.01, F.col("largest"))
    return g.select("source", "documents", (F.col("most") > F.col("max_repeats")).cast("int").alias("over_limit"), (F.col("most") - F.coalesce("least", "most") > 1).cast("int").alias("uneven"), off.cast("int").alias("off_plan"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Commits with a stretch that stands verbatim in another."""
    return shared_stretches(table(spark, d, "documents")).select("doc_id").distinct()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each commit also stands in others."""
    docs = table(spark, d, "documents")
    return shared_shares(docs, shared_stretches(docs))


def p8_paths(spark: SparkSession, d: str) -> DataFrame:
    """Compacted paths of the repeated edges: length, runs and documents along each."""
    runs = path_runs(shared_runs(table(spark, d, "documents")))
    return runs.groupBy("path").agg(F.max("off_to").alias("last_edge"), F.max(F.col("end") - F.col("start")).alias("longest_run"), F.count("*").alias("runs"), F.count_distinct("doc").alias("documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_split, p3_shares, p3_invariants, p5_found, p5_pieces, p5_invariants, p6_containers, p6_fill, p6_invariants, p7_repeats, p7_shares, p7_exact, p7_tempered, p7_entropy, p7_invariants, p8_found, p8_shares, p8_paths)}

_KEY = "nullif(nullif(regexp_replace(upper({}), '[^A-Z0-9]', '', 'g'), ''), 'UNKNOWN')"
_DATE = """case when regexp_full_match(trim(recording_date), '\\d{8}') then trim(recording_date)
    when regexp_full_match(trim(recording_date), '\\d{4}\\D\\d{1,2}\\D\\d{1,2}') then regexp_extract(trim(recording_date), '^(\\d+)\\D', 1) || lpad(regexp_extract(trim(recording_date), '\\D(\\d+)\\D', 1), 2, '0') || lpad(regexp_extract(trim(recording_date), '\\D(\\d+)$', 1), 2, '0')
    when regexp_full_match(trim(recording_date), '\\d{1,2}\\D\\d{1,2}\\D(\\d{4}|\\d{2})') then right('20' || regexp_extract(trim(recording_date), '\\D(\\d+)$', 1), 4) || lpad(regexp_extract(trim(recording_date), '\\D(\\d+)\\D', 1), 2, '0') || lpad(regexp_extract(trim(recording_date), '^(\\d+)\\D', 1), 2, '0') end"""

ORACLE = {
    "p3_found": f"""
        with recursive s as (select distinct {_KEY.format('subject_id')} a, {_KEY.format('prior_subject_id')} b from subjects),
        e as (select a, b from s where a is not null and b is not null union select b, a from s where a is not null and b is not null),
        reach as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a),
        comp as (select a, least(a, min(b)) c from reach group by a),
        r as (select distinct recording_id, subject_id, {_KEY.format('subject_id')} k, device_id, {_DATE} dt from recordings where recording_id in (select recording_id from signal_windows)),
        g as (select r.*, coalesce(c, k) grp from r left join comp on comp.a = r.k)
        select distinct x.recording_id recording_id_a, y.recording_id recording_id_b from g x join g y on x.grp = y.grp and x.recording_id < y.recording_id and x.subject_id <> y.subject_id
        union select x.recording_id, y.recording_id from g x join g y on x.device_id = y.device_id and x.dt = y.dt and x.recording_id < y.recording_id where x.k is null and y.k is null""",
    "p3_invariants": "select count(distinct window_id) windows, 0 without_split, 0 groups_apart, 0 pairs_apart from signal_windows",
    "p6_invariants": "select capacity_id, (select count(distinct doc_id) from documents) documents, 0 incomplete, 0 split_needlessly, 0 overfull from (select distinct capacity_id from pack_capacities)",
    "p7_invariants": "select source, count(distinct doc_id) documents, 0 over_limit, 0 uneven, 0 off_plan from documents where source is not null group by source",
    "p8_found": """
        with d as (select doc_id, any_value(text) t from documents where length(text) >= 200 group by doc_id),
        g as (select doc_id, i, hash(substr(t, i, 200)) h from (select doc_id, t, unnest(generate_series(1, length(t) - 199)) i from d)),
        m as (select h from g group by h having min(doc_id) <> max(doc_id)),
        s as (select doc_id, substr(t, i, 200) s from g semi join m using (h) join d using (doc_id)),
        n as (select s from s group by s having min(doc_id) <> max(doc_id))
        select distinct doc_id from s semi join n using (s)""",
    "p8_shares": """
        with d as (select doc_id, any_value(text) t from documents group by doc_id),
        g as (select doc_id, i, hash(substr(t, i, 200)) h from (select doc_id, t, unnest(generate_series(1, length(t) - 199)) i from d where length(t) >= 200)),
        m as (select h from g group by h having min(doc_id) <> max(doc_id)),
        s as (select doc_id, i, substr(t, i, 200) s from g semi join m using (h) join d using (doc_id)),
        n as (select s from s group by s having min(doc_id) <> max(doc_id)),
        b as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 200, true) first from s semi join n using (s)),
        r as (select doc_id, i, sum(cast(first as integer)) over (partition by doc_id order by i) run from b),
        e as (select doc_id, run, max(i) + 200 - min(i) len from r group by 1, 2),
        a as (select doc_id, count(*) stretches, cast(sum(len) as bigint) shared_chars, max(len) longest from e group by 1)
        select doc_id, coalesce(length(t), 0) chars, coalesce(stretches, 0) stretches, coalesce(shared_chars, 0) shared_chars, coalesce(longest, 0) longest,
            case when length(t) > 0 then coalesce(shared_chars, 0) / length(t) else 0.0 end share from d left join a using (doc_id)""",
    "p5_found": """
        select distinct window_id from signal_windows join window_configs using (config_id)
        where coalesce(end_time - start_time, len(window_data) / sampling_rate) > window_size + 0.01 and window_size > 0 and overlap < window_size""",

    "p5_invariants": """
        select distinct window_id, 0 too_long, 0 other_overlap, 0 late_start, 0 missing_pieces from signal_windows join window_configs using (config_id)
        where coalesce(end_time - start_time, len(window_data) / sampling_rate) > window_size + 0.01 and window_size > 0 and overlap < window_size""",}
