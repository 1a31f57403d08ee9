"""Filling missing values from similar records by low-rank factors.

A record's cells are its standardised numbers and its categories one-hot. Each
cell is a weighted sum of its averages over the record's group and over the
part of the group near it in time, without the record itself, and of the
product of a record's and a cell's factor. Alternating least squares fits the
cells' factors and weights (small and of fixed size) and one factor per record.
Records lie by group and time, so a pass finds both averages in the rows next
to a record: each round broadcasts the cells' factors, solves the records by
themselves and sums the cells' normal equations by Spark aggregation. Records
are shuffled once, before the first round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breathlake.session import cut


#: Standardised numbers count as no farther than this from the middle.
CLIP = 6.0
#: Records of a group that lie together in one task; a group with more is spread by time and its sums are broadcast.
GROUP_ROWS = 100_000
#: Records solved at once.
CHUNK_ROWS = 8192


@dataclass(frozen=True)
class ImputeSpec:
    """What to fill and from what.

    ``numeric`` cells are missing when null, not finite or negative (unless
    ``allow_negative``); ``categories`` maps a column to its valid values, all
    else is missing. ``group`` and ``order`` name the group and its time order;
    ``near`` is the width of a time neighbourhood in units of ``order``. Rounds
    end when one lowers the squared error by less than ``least_gain`` of it, or
    after ``rounds``.
    """

    id: tuple[str, ...]
    numeric: tuple[str, ...]
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    integers: tuple[str, ...] = ()
    group: str | None = None
    order: str | None = None
    near: float = 4.0
    rank: int = 2
    rounds: int = 6
    least_gain: float = 0.01
    ridge: float = 2.0
    shrink: float = 1.0
    allow_negative: bool = False


# Tens of columns times several expressions: SQL text is built here, since each
# call of the Column API is a call to the JVM.


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(c: str, spec: ImputeSpec) -> str:
    """True where a number counts, false or NULL where it is missing."""
    x = f"cast({_name(c)} as double)"
    ok = f"{x} is not null and not isnan({x}) and abs({x}) <> double('infinity')"
    return ok if spec.allow_negative else f"{ok} and {x} >= 0"


def _listed(c: str, spec: ImputeSpec) -> str:
    return f"coalesce({_name(c)} in ({', '.join(_text(v) for v in spec.categories[c])}), false)"


def _solve(z: np.ndarray, known: np.ndarray, v: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the records of a batch from what ``known`` leaves of their cells, and the mask of observed cells."""
    mask = np.isfinite(z)
    r = v.shape[1]
    a = (mask @ (v[:, :, None] * v[:, None, :]).reshape(len(v), r * r)).reshape(-1, r, r) + ridge * np.eye(r)
    b = np.where(mask, z - known, 0.0) @ v
    return np.linalg.solve(a, b[:, :, None])[:, :, 0], mask


def _fit(cells: DataFrame, width: int, spec: ImputeSpec, hot: dict[str, np.ndarray]) -> np.ndarray:
    """Per cell: its factor, and its weights on the group's and the near average.

    What comes to the driver each round is cells x ((rank + 2) x (rank + 3) + 1) sums.
    """
    rng = np.random.default_rng(7)
    r = min(spec.rank, width)
    k = r + 2
    theta = np.concatenate([rng.normal(scale=0.3, size=(width, r)), np.tile([0.2, 0.6], (width, 1))], axis=1)
    schema = pa.schema([("cell", pa.int32()), ("k", pa.int32()), ("total", pa.float64())])
    before = np.inf
    for _ in range(spec.rounds):
        shared = cells.sparkSession.sparkContext.broadcast((theta, hot))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t, hot = shared.value
            gram, rhs, rss = np.zeros((width, k, k)), np.zeros((width, k)), np.zeros((width, 1))
            for rows in _by_group(batches):
                z, g, b = _cells(rows, width, spec.shrink, hot)
                known = t[:, r] * g + t[:, r + 1] * b
                u, mask = _solve(z, known, t[:, :r], spec.ridge)
                z, sides = np.where(mask, z, 0.0), [np.where(mask, x, 0.0) for x in (g, b)]
                gram[:, :r, :r] += (mask.T @ (u[:, :, None] * u[:, None, :]).reshape(len(u), r * r)).reshape(width, r, r)
                rhs[:, :r] += z.T @ u
                rss[:, 0] += (mask * (z - known - u @ t[:, :r].T) ** 2).sum(axis=0)
                for i, x in enumerate(sides):
                    gram[:, r + i, :r] += x.T @ u
                    rhs[:, r + i] += (x * z).sum(axis=0)
                    for j, y in enumerate(sides):
                        gram[:, r + i, r + j] += (x * y).sum(axis=0)
            gram[:, :r, r:] = gram[:, r:, :r].transpose(0, 2, 1)
            both = np.concatenate([gram.reshape(width, k * k), rhs, rss], axis=1)
            cell, at = np.indices(both.shape)
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel().astype(d)) for x, d in ((cell, "i4"), (at, "i4"), (both, "f8"))], schema=schema)

        total = np.zeros((width, k * k + k + 1))
        rows = cells.mapInArrow(sums, "cell int, k int, total double").groupBy("cell", "k").agg(F.sum("total").alias("total"))
        for cell, at, x in rows.collect():  # as many rows whatever the input
            total[cell, at] = x
        gram = total[:, : k * k].reshape(width, k, k)
        theta = np.linalg.solve(gram + spec.ridge * np.eye(k), total[:, k * k: k * k + k, None])[:, :, 0]
        shared.unpersist()
        loss = total[:, -1].sum()
        if before - loss < spec.least_gain * before:
            break
        before = loss
    return theta


def impute(df: DataFrame, spec: ImputeSpec) -> DataFrame:
    """The same records with gaps filled and filled fields marked.

    One row per ``spec.id``; repeated rows count once. Other columns pass
    through. Filled numbers lie within the column's observed range, integers
    are rounded, categories are decoded to the best-scoring valid value. The
    array column ``filled_fields`` names what was filled, in column order. A
    column without any observed value stays null and is not marked; a record
    without any observed cell gets what its group and time suggest, else about the
    column's median. A record without group or order is near to no other. Empty
    input gives no rows.
    Fits eagerly: quantiles, then at most ``spec.rounds`` passes over the cells.
    """
    columns = [c for c in df.columns if c != "filled_fields"]
    df = _laid_out(df.drop("filled_fields"), spec)
    num, cats = list(spec.numeric), spec.categories
    slots = [(c, None) for c in num] + [(c, v) for c in cats for v in cats[c]]
    width = len(slots)
    stat = {}
    if num:
        number = [f"case when {_valid(c, spec)} then cast({_name(c)} as double) end" for c in num]
        stat = df.selectExpr(*[f"{f}({x}) as {n}{i}" for i, x in enumerate(number) for n, f in (("s", "stddev_pop"), ("a", "min"), ("b", "max"))], *[f"percentile_approx({x}, array(0.16D, 0.5D, 0.84D), 1000) as q{i}" for i, x in enumerate(number)]).first()
    # the middle two thirds set centre and scale, so wild values do not
    mean = [stat[f"q{i}"][1] if stat[f"q{i}"] else 0.0 for i in range(len(num))]
    sd = [(stat[f"q{i}"][2] - stat[f"q{i}"][0]) / 2 if stat[f"q{i}"] and stat[f"q{i}"][2] > stat[f"q{i}"][0] else stat[f"s{i}"] or 1.0 for i in range(len(num))]
    z = []
    for i, (c, v) in enumerate(slots):
        if v is None:
            z.append(f"case when {_valid(c, spec)} then float(greatest(least((cast({_name(c)} as double) - {mean[i]!r}D) / {sd[i]!r}D, {CLIP}D), -{CLIP}D)) else float('nan') end")
        else:
            off = -1.0 / max(1, len(cats[c]) - 1)
            z.append(f"case when {_listed(c, spec)} then (case when {_name(c)} = {_text(v)} then 1.0F else {off!r}F end) else float('nan') end")
    rows = df.select("*", F.expr(f"array({', '.join(z)})").alias("__own"))
    hot = _hot_sums(rows, width)
    theta = _fit(rows.select("__group", "__near", "__own"), width, spec, hot)
    fields = [f for f in df.schema.fields if not f.name.startswith("__")]
    filled = rows.drop("__sub").mapInArrow(_decode(theta, width, spec, hot), T.StructType([*fields, T.StructField("__x", T.ArrayType(T.DoubleType())), T.StructField("__c", T.ArrayType(T.IntegerType()))]))
    out, marks = {}, []
    for i, c in enumerate(num):
        kind = df.schema[c].dataType
        lo, hi = stat[f"a{i}"], stat[f"b{i}"]
        guess = f"least(greatest(__x[{i}] * {sd[i]!r}D + {mean[i]!r}D, {lo!r}D), {hi!r}D)" if lo is not None else "null"
        if c in spec.integers or isinstance(kind, T.IntegralType):
            guess = f"round({guess})"
        out[c] = f"case when {_valid(c, spec)} then {_name(c)} else cast({guess} as {kind.simpleString()}) end"
        marks.append(f"case when coalesce({_valid(c, spec)}, false) then null else {_text(c)} end" if lo is not None else "cast(null as string)")
    for j, c in enumerate(cats):
        out[c] = f"case when {_listed(c, spec)} then {_name(c)} else array({', '.join(_text(v) for v in cats[c])})[__c[{j}]] end"
        marks.append(f"case when {_listed(c, spec)} then null else {_text(c)} end")
    keep = [f"{out.get(c, _name(c))} as {_name(c)}" for c in columns]
    return filled.selectExpr(*keep, f"array_compact(array({', '.join(marks)})) as filled_fields")


def _laid_out(df: DataFrame, spec: ImputeSpec) -> DataFrame:
    """Each record once, with ``__group, __sub, __near``, lying by them within partitions; kept.

    A group of more than ``GROUP_ROWS`` rows is spread over parts by its time
    neighbourhoods. Records without group lie by themselves.
    """
    group = F.col(f"`{spec.group}`").cast("string") if spec.group else F.lit(None).cast("string")
    own = F.xxhash64(*spec.id)
    near = F.coalesce(F.floor(F.col(f"`{spec.order}`").cast("double") / spec.near), own) if spec.order else F.lit(0).cast("bigint")
    rows = df.select("*", group.alias("__group"), F.when(group.isNull(), own).otherwise(near).alias("__near"))
    hot = cut(rows.filter("__group is not null").groupBy("__group").agg(F.count("*").alias("__n")).filter(F.col("__n") > GROUP_ROWS))
    rows = rows.dropDuplicates(list(spec.id))
    if hot.isEmpty():
        rows = rows.withColumn("__sub", F.when(F.col("__group").isNull(), F.col("__near")).otherwise(-1))
    else:
        parts = F.ceil(F.col("__n") / GROUP_ROWS)
        rows = rows.join(hot, "__group", "left").withColumn("__sub", F.when(F.col("__group").isNull(), F.col("__near")).when(F.col("__n").isNull(), -1).otherwise(F.pmod(F.xxhash64("__near"), parts))).drop("__n")
    return cut(rows.repartition("__group", "__sub").sortWithinPartitions("__group", "__sub", "__near"))


def _hot_sums(rows: DataFrame, width: int) -> dict[str, np.ndarray]:
    """Sums and counts of the cells of groups that lie in several parts; at most one such group for ``GROUP_ROWS`` rows."""
    if rows.filter("__group is not null and __sub >= 0").isEmpty():
        return {}
    both = F.concat(F.transform("__own", lambda x: F.nanvl(x, F.lit(0.0)).cast("double")), F.transform("__own", lambda x: F.when(F.isnan(x), 0.0).otherwise(1.0)))
    v = rows.filter("__group is not null and __sub >= 0").select("__group", array_to_vector(both).alias("v"))
    return {g: np.array(x) for g, x in v.groupBy("__group").agg(vector_to_array(Summarizer.sum(F.col("v")))).collect()}


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole groups, some thousand at a time; what lies in one task of a large group, or of one time, is cut at ``GROUP_ROWS``."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows < CHUNK_ROWS:
            continue
        code = _codes(held.column("__group"))
        change = np.flatnonzero((code[1:] != code[:-1]) | (code[1:] < 0))
        at = held.num_rows if held.num_rows > GROUP_ROWS else int(change[-1]) + 1 if len(change) else 0
        if at:
            yield held.slice(0, at)
            held = held.slice(at)
    if held is not None and held.num_rows:
        yield held


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each key, -1 for null."""
    keys = column.combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    return keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _cells(rows: pa.Table, width: int, shrink: float, hot: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cells (NaN where missing), and the group's and the near average of each without the record itself.

    The group's average is shrunk to the overall mean 0, the near one to the group's.
    """
    own = rows.column("__own").combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    z = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
    mask = np.isfinite(z)
    both = np.concatenate([np.where(mask, z, 0.0), mask], axis=1)
    code = _codes(rows.column("__group"))
    near = rows.column("__near").to_numpy()
    new_group = np.r_[True, (code[1:] != code[:-1]) | (code[1:] < 0)]
    new_near = new_group | np.r_[True, near[1:] != near[:-1]]
    means, prior = [], np.zeros(z.shape)
    for new in (new_group, new_near):
        run = np.cumsum(new) - 1
        sums = np.add.reduceat(both, np.flatnonzero(new))[run]
        if new is new_group and hot:
            for at in np.flatnonzero(new):
                if (known := hot.get(rows.column("__group")[int(at)].as_py())) is not None:
                    sums[run == run[at]] = known
        sums = sums - both
        prior = (sums[:, :width] + shrink * prior) / (sums[:, width:] + shrink)
        means.append(prior)
    return z, means[0], means[1]


def _decode(theta: np.ndarray, width: int, spec: ImputeSpec, hot: dict[str, np.ndarray]):
    r = theta.shape[1] - 2
    cats = [len(x) for x in spec.categories.values()]
    k = len(spec.numeric)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            z, g, b = _cells(rows, width, spec.shrink, hot)
            known = theta[:, r] * g + theta[:, r + 1] * b
            u, _ = _solve(z, known, theta[:, :r], spec.ridge)
            guess = known + u @ theta[:, :r].T
            best, at = [], k
            for n in cats:
                best.append(guess[:, at: at + n].argmax(axis=1))
                at += n
            x = pa.ListArray.from_arrays(np.arange(0, k * len(u) + 1, max(k, 1), dtype=np.int32)[: len(u) + 1] if k else np.zeros(len(u) + 1, np.int32), pa.array(guess[:, :k].ravel()))
            c = pa.array(np.stack(best, axis=1).astype(np.int32).tolist() if best else [[]] * len(u), type=pa.list_(pa.int32()))
            done = rows.select([n for n in rows.schema.names if not n.startswith("__")]).append_column("__x", x).append_column("__c", c)
            yield from done.combine_chunks().to_batches()

    return decode


def filled_cells(imputed: DataFrame, src_table: str, id_col: str, pos: Column | None = None) -> DataFrame:
    """``src_table, row_id, field_name, win_pos`` of each filled cell."""
    return imputed.select(
        F.lit(src_table).alias("src_table"), F.col(id_col).alias("row_id"), F.explode("filled_fields").alias("field_name"), (pos if pos is not None else F.lit(-1)).cast("int").alias("win_pos")
    )


def matrix_records(matrices: DataFrame, names: list[str]) -> DataFrame:
    """One record per matrix and window: its features as columns, absent ones null.

    ``has`` lists the features the matrix has, so absent ones can be told from
    missing ones. Repeated matrices count once.
    """
    m = matrices.dropDuplicates(["matrix_id"]).filter("feature_names is not null and feature_values is not null")
    width = F.array_max(F.transform("feature_values", lambda v: F.coalesce(F.size(v), F.lit(0))))
    m = m.withColumn("win_pos", F.explode(F.when(width > 0, F.sequence(F.lit(0), width - 1))))
    at = lambda c: F.array_position("feature_names", c)
    cols = [F.when(at(c) > 0, F.get(F.get("feature_values", (at(c) - 1).cast("int")), F.col("win_pos"))).alias(c) for c in names]
    # a feature is a cell of this window only where its inner array reaches so far
    has = F.filter(F.col("feature_names"), lambda c: F.coalesce(F.size(F.get("feature_values", (F.array_position("feature_names", c) - 1).cast("int"))), F.lit(0)) > F.col("win_pos"))
    return m.select("matrix_id", "recording_id", "win_pos", has.alias("has"), *cols)


def impute_matrices(matrices: DataFrame, max_names: int = 1000, **settings) -> DataFrame:
    """``feature_matrices`` as records, filled; features a matrix lacks are not filled.

    The feature names are the columns of the cell matrix; more than
    ``max_names`` different ones are an error.
    """
    names = sorted(r[0] for r in matrices.select(F.explode("feature_names").alias("f")).filter("f is not null").distinct().limit(max_names + 1).collect())
    if len(names) > max_names:
        raise ValueError(f"more than {max_names} feature names")
    spec = ImputeSpec(id=("matrix_id", "win_pos"), numeric=tuple(names), group="recording_id", order="win_pos", **settings)
    done = impute(matrix_records(matrices, names), spec)
    keep = [F.when(F.array_contains("has", c), F.col(f"`{c}`")).alias(c) for c in names]
    return done.select("matrix_id", "recording_id", "win_pos", "has", *keep, F.array_intersect("filled_fields", "has").alias("filled_fields"))
