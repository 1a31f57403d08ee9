"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one final task, which
is right while groups are small. Where one is large, quantiles take two passes:
a sketch brackets each quantile between two values, then values outside the
brackets are only counted and those inside are kept and counted one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the largest group up to which ``percentile`` may hold them in one task.
SMALL = 1_000_000
#: Accuracy of the sketch: ranks are right to within one part in so many.
ACCURACY = 10_000
#: Groups up to which their brackets are broadcast.
BROADCAST_GROUPS = 10_000


def group_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], small: int | None = None) -> DataFrame:
    """``by, q``: the array of quantiles of ``value`` (linear between neighbours) in each group.

    NULL and NaN values do not count; a group without values has no row. A null
    key is a key. Both ways give the same numbers; the size of the largest group decides.
    """
    d = df.select(*by, F.col(value).cast("double").alias("_v")).dropna(subset=["_v"])
    counts = d.groupBy(*by).agg(F.count("*").alias("_n"))
    largest, groups = counts.agg(F.coalesce(F.max("_n"), F.lit(0)), F.count("*")).first()
    if largest <= (SMALL if small is None else small):
        return d.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    return bracketed_quantiles(d, by, probs, groups=groups)


def bracketed_quantiles(d: DataFrame, by: list[str], probs: list[float], accuracy: int = ACCURACY, groups: int | None = None) -> DataFrame:
    """As ``group_quantiles``, of the column ``_v``, by sketch and exact counts.

    ``groups``: how many there are, if known. Few have their brackets broadcast;
    otherwise a merge keeps Spark, which may underrate the values, from broadcasting those.

    A window orders only what lies in the brackets: about 6 values in
    ``accuracy`` of a group for each quantile, and all of a group of at most
    twice ``accuracy``.
    """
    slack = 3.0 / accuracy
    grid = [min(1.0, max(0.0, p + s)) for p in probs for s in (-slack, slack)]
    cuts = d.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(g) for g in grid]), F.lit(accuracy)).alias("_cuts"))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    cuts = cuts.select(*keys, "_n", "_cuts")
    if by:
        cuts = F.broadcast(cuts) if groups is not None and groups <= BROADCAST_GROUPS else cuts.hint("merge")
        j = d.join(cuts, reduce(lambda a, b: a & b, [d[c].eqNullSafe(cuts[f"_k{i}"]) for i, c in enumerate(by)])).drop(*[f"_k{i}" for i in range(len(by))])
    else:
        r = cuts.first()  # one row
        j = d.select("*", F.lit(r["_n"]).alias("_n"), F.array(*[F.lit(x) for x in r["_cuts"]]).alias("_cuts"))
    inside = reduce(lambda a, b: a | b, [(F.col("_v") >= F.get("_cuts", F.lit(2 * i))) & (F.col("_v") <= F.get("_cuts", F.lit(2 * i + 1))) for i in range(len(probs))])
    j = j.withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).withColumn("_in", F.when((F.col("_n") <= 2 * accuracy) | inside, F.col("_v")))
    c = j.groupBy(*by, "_n", "_r", "_in").agg(F.count("*").alias("_c"))
    c = c.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy("_r", "_in")))
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.struct("_r", "_in")))["_in"]
    rank = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    aggs = [x.alias(f"_{n}{i}") for i, r in enumerate(rank) for n, x in (("a", at(F.floor(r))), ("b", at(F.ceil(r))))]
    g = c.groupBy(*by, "_n").agg(*aggs)
    sure = lambda x: F.when(x.isNull(), F.raise_error(F.lit("quantile outside its bracket")).cast("double")).otherwise(x)
    q = [sure(F.col(f"_a{i}")) + (sure(F.col(f"_b{i}")) - F.col(f"_a{i}")) * (r - F.floor(r)) for i, r in enumerate(rank)]
    return g.select(*by, F.array(*q).alias("q"))


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], small: int | None = None) -> dict[str, list[float]]:
    """Quantiles of whole columns: ``{column: [..]}``; a column without values has none."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "_column", "_x")
    return {r["_column"]: list(r["q"]) for r in group_quantiles(long, ["_column"], "_x", probs, small).collect()}  # one row a column
