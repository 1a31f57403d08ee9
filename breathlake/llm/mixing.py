"""Mixing sources to target weights under a limit on repetition.

Temperature mixing: the weight of a source is its target share times
(own share / target share) ** (1 - a), normalised; a = 1 gives the targets,
a = 0 the sources as they are. The exponent a is the largest whose weights need
no more repeats than allowed for the wanted size; or, for a target entropy,
own shares to the power 1 - a, which a = 1 makes equal. It is found by
sections, each one Spark aggregation over the sources, so there may be any
number of them. Weights are then realised as whole passes over a source and one
partial pass, taken from a permutation in blocks up to the token budget.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathlake.session import cut

#: Documents in a block of the permutation.
BLOCK_DOCS = 1024
#: Blocks that one prefix sum runs over; a second one runs over these groups.
GROUP_BLOCKS = 4096
#: Sources up to which the plan is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Sections of the interval of the exponent in one aggregation, and aggregations.
SECTIONS, PASSES = 64, 5


def _evaluate(sources: DataFrame, grid: list[float]) -> list[tuple[float, float, float]]:
    """At each exponent: sum of the weights, largest need of a source, and entropy of the normalised weights."""
    d = sources.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    a = F.get(F.array(*[F.lit(x) for x in grid]), F.col("k"))
    u = a * F.col("x") + (1 - a) * F.col("y")
    d = d.select("k", "cap", u.alias("u"), F.exp(u).alias("w"))
    rows = d.groupBy("k").agg(F.sum("w").alias("z"), F.max(F.col("w") / F.col("cap")).alias("need"), F.sum(F.col("w") * F.col("u")).alias("s")).collect()  # one row an exponent
    out = [(0.0, 0.0, 0.0)] * len(grid)
    for r in rows:
        out[r["k"]] = (r["z"], r["need"], math.log(r["z"]) - r["s"] / r["z"])
    return out


def _section(sources: DataFrame, lo: float, hi: float, fits) -> float:
    """Last exponent from ``lo`` towards ``hi`` that ``fits(z, need, entropy)``, by repeated sections; ``lo`` itself is taken to fit."""
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
        ok = [i for i, v in enumerate(_evaluate(sources, grid)) if i and fits(*v)]
        k = ok[-1] if ok else 0
        if k == SECTIONS:
            return hi
        lo, hi = grid[k], grid[k + 1]
    return lo


def plan_mixture(sized: DataFrame, targets: DataFrame, epochs: float = 1.0, size: float | None = None, exact: bool = False, entropy: float | None = None) -> DataFrame:
    """One row per source that can be taken: its weight and how to realise it.

    ``sized(doc_id, source, n_tokens)``, ``targets(source, target_share,
    max_repeats)``. The mixture has ``size`` tokens, or ``epochs`` times the
    tokens of its sources, or with ``exact`` as many as the limits allow at the
    targets themselves (then a = 1). A size beyond ``least max_repeats x
    tokens`` is lowered to that, since no exponent allows more. ``entropy`` (in
    nats) asks for weights of that entropy instead of target shares, as near to
    it as the limits allow. A source without target, tokens or repeats is left
    out and the other shares are normalised. Result: ``source, target_share,
    max_repeats, tokens, docs, exponent, weight, planned_tokens, passes, rest``.
    """
    wanted = targets.filter("source is not null and target_share > 0 and max_repeats > 0").dropDuplicates(["source"]).select("source", "target_share", "max_repeats")
    totals = sized.filter("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    src = cut(totals.join(wanted, "source").filter("tokens > 0"))
    t = src.agg(F.sum("tokens").alias("tokens"), F.sum("target_share").alias("share"), F.min("max_repeats").alias("least"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("exact")).first()
    all_tokens, share = float(t["tokens"] or 1), t["share"] or 1.0
    own, aim = F.col("tokens") / F.lit(all_tokens), F.col("target_share") / F.lit(share)
    x = F.log(aim) if entropy is None else F.lit(0.0)
    cap = F.col("max_repeats").cast("double") * F.col("tokens")
    src = src.select("*", x.alias("x"), F.log(own).alias("y"), cap.alias("cap"))
    if exact:
        size = (t["exact"] or 0.0) * share
    size = min(epochs * all_tokens if size is None else float(size), float(t["least"] or 0) * all_tokens)
    keep = lambda z, need, h: size * need <= z * (1 + 1e-9)
    a, z = 0.0, 1.0
    if t["tokens"]:
        if entropy is None:
            a = _section(src, 0.0, 1.0, keep)
        else:
            spread = _evaluate(src, [0.0])[0][2] < entropy
            a = _section(src, 0.0, 1.0 if spread else -63.0, (lambda z, n, h: h <= entropy) if spread else (lambda z, n, h: h >= entropy))
            a = _section(src, 0.0, a, keep)
        z = _evaluate(src, [a])[0][0]
    src = src.withColumn("exponent", F.lit(a)).withColumn("weight", F.exp(F.lit(a) * F.col("x") + F.lit(1 - a) * F.col("y")) / F.lit(z))
    src = src.withColumn("planned_tokens", F.col("weight") * F.lit(size))
    src = src.withColumn("passes", F.least(F.col("max_repeats").cast("bigint"), F.floor(F.col("planned_tokens") / F.col("tokens") * (1 + 1e-9))))
    rest = F.when(F.col("passes") < F.col("max_repeats"), F.greatest(F.lit(0.0), F.col("planned_tokens") - F.col("passes") * F.col("tokens"))).otherwise(F.lit(0.0))
    return cut(src.withColumn("rest", rest).select("source", "target_share", "max_repeats", "tokens", "docs", "exponent", "weight", "planned_tokens", "passes", "rest"))


def _fill(docs: pd.DataFrame) -> pd.DataFrame:
    docs = docs.sort_values(["h", "doc_id"])
    room, taken = float(docs["room"].iloc[0]), []
    for doc, n in zip(docs["doc_id"], docs["n_tokens"]):
        if 0 < n <= room:
            taken.append(doc)
            room -= n
    rest = docs[~docs["doc_id"].isin(taken) & (docs["n_tokens"] > 0)]
    if len(rest) and rest["n_tokens"].min() - room < room:  # overshooting by less than what is missing
        taken.append(rest.loc[rest["n_tokens"].idxmin(), "doc_id"])
    return pd.DataFrame({"doc_id": np.array(taken, dtype="int64")})


def prepared(sized: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens``, each document once, kept; null sizes are 0 and rows without ``doc_id`` left out."""
    return cut(sized.select("doc_id", "source", F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens")).dropna(subset=["doc_id"]).dropDuplicates(["doc_id"]))


def realise(sized: DataFrame, plan: DataFrame, seed: int = 11, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``doc_id, source, n_tokens, repeats`` for every document of ``prepared`` rows, by a plan.

    Documents of a null source or one the plan lacks get 0 repeats. Within a
    source repeats differ by one at most and never exceed ``max_repeats``; the
    tokens taken miss the plan by less than the smallest document left over in
    the last block.
    """
    n = plan.count()
    small = lambda df: F.broadcast(df) if n <= BROADCAST_ROWS else df
    planned = plan.select("source", "passes", "rest", F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("docs") / block_docs)).alias("blocks"))
    d = sized.join(small(planned), "source", "left").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    d = d.withColumn("block", F.pmod(F.shiftright("h", 20), F.col("blocks")))
    sums = cut(d.filter("rest > 0").groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.floor(F.col("block") / GROUP_BLOCKS)))
    ahead = lambda by, at: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy("source", "part").agg(F.sum("n").alias("n")).withColumn("ahead", ahead(["source"], "part")).drop("n")
    sums = sums.withColumn("before", ahead(["source", "part"], "block")).join(parts, ["source", "part"]).withColumn("before", F.col("before") + F.col("ahead"))
    whole = sums.select("source", "block", (F.col("before") + F.col("n") <= F.col("rest")).alias("whole"), (F.col("rest") - F.col("before")).alias("room"))
    whole = whole.filter("whole or room > 0")
    edge = whole.filter("not whole").select("source", "block", "room")  # one block a source
    # one block a source, of about block_docs documents: filled in the permutation's order, leaving out what no longer fits
    edges = d.filter("rest > 0").join(small(edge), ["source", "block"]).select("source", "doc_id", "h", "n_tokens", "room")
    extra = edges.groupBy("source").applyInPandas(_fill, "doc_id bigint").withColumn("more", F.lit(1))
    blocks = whole.filter("whole").select("source", "block", F.lit(1).alias("full"))
    d = d.join(blocks, ["source", "block"], "left").join(extra, "doc_id", "left")
    n = F.coalesce("passes", F.lit(0)) + F.coalesce("full", F.lit(0)) + F.coalesce("more", F.lit(0))
    return d.select("doc_id", "source", "n_tokens", n.cast("int").alias("repeats"))


def mix_sources(sized: DataFrame, targets: DataFrame, seed: int = 11, block_docs: int = BLOCK_DOCS, **plan) -> DataFrame:
    """``doc_id, source, n_tokens, repeats`` for every document: ``plan_mixture`` and ``realise``.

    A row given again counts once, one without ``doc_id`` not at all.
    """
    sized = prepared(sized)
    return realise(sized, plan_mixture(sized, targets, **plan), seed, block_docs)


def mixture_shares(mixed: DataFrame, targets: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: shares wanted, planned and reached, tokens planned and reached, and repeats; a target without documents has 0."""
    got = mixed.filter("source is not null").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("documents"))
    got = cut(got)
    total = got.agg(F.sum("tokens")).first()[0] or 0
    rows = targets.filter("source is not null").dropDuplicates(["source"]).select("source", "target_share", "max_repeats").join(got, "source", "full").join(plan.select("source", F.col("weight").alias("planned_share"), "planned_tokens", "exponent"), "source", "left")
    rows = rows.fillna(0, ["tokens", "source_tokens", "most_repeats", "documents", "planned_share", "planned_tokens"])
    return rows.withColumn("share", F.col("tokens") / F.lit(float(total) or 1.0))
