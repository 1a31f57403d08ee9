from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathlake.llm import mixing
from breathlake.llm.mixing import mix_sources, mixture_shares, plan_mixture, prepared, realise
from breathlake.llm.packing import container_fill, match_large, pack, pack_documents
from breathlake.llm.tokens import TOKENIZERS, VOCABULARY, token_counts


def test_large_items_pair_at_most_twice_and_fit():
    s = np.array([90, 60, 40, 35, 34, 10])
    groups = match_large(s[:5], 100)
    assert sorted(i for g in groups for i in g) == [0, 1, 2, 3, 4]
    assert all(len(g) <= 2 and s[g].sum() <= 100 for g in groups) and [1, 2] in groups


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_valid_and_tight(seed):
    g = np.random.default_rng(seed)
    cap = 1000
    s = np.clip(g.lognormal(5, 1, 4000).astype(int), 1, cap)
    box = pack(s, cap)
    used = np.bincount(box, weights=s)
    assert (used > 0).all() and used.max() <= cap
    assert len(used) <= 1.03 * max(s.sum() / cap, (s > cap / 2).sum()) + 1
    assert len(pack(np.zeros(0, int), cap)) == 0 and len(set(pack(np.full(7, cap), cap))) == 7


def test_documents_are_whole_or_in_full_pieces(spark):
    rows = [(i, n) for i, n in enumerate([0, 1, 99, 100, 101, 250, 300, None, 50, 50, 33, 33])] + [(None, 5)]
    sized = spark.createDataFrame(rows + rows[:3], "doc_id long, n_tokens long").withColumn("shard", F.lit("x"))
    caps = [(1, 100), (2, 1000)]
    out = pack_documents(sized, caps, shard_docs=5).collect()
    for cid, cap in caps:
        boxes = {}
        for r in (r for r in out if r.capacity_id == cid and r.container is not None):
            boxes[r.shard, r.container] = boxes.get((r.shard, r.container), 0) + r.token_end - r.token_start
        assert max(boxes.values()) <= cap
        for i, n in rows[:-1]:
            mine = sorted((r for r in out if r.capacity_id == cid and r.doc_id == i), key=lambda r: r.piece)
            n = n or 0
            assert len(mine) == max(1, math.ceil(n / cap)) and mine[-1].token_end == n and all(a.token_end == b.token_start for a, b in zip(mine, mine[1:]))
            assert (mine[0].container is None) == (n == 0)
    fill = {r.capacity_id: r for r in container_fill(pack_documents(sized, caps), caps).collect()}
    assert fill[1].tokens == sum(n or 0 for _, n in rows[:-1]) and fill[1].fullest <= 100
    assert pack_documents(sized.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        pack_documents(sized, [(1, 0)])


def weights(rows):
    return {r.source: r for r in rows.collect()}


def test_exponent_meets_the_limits(spark):
    t = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 4), ("c", 0.3, 2)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame([(1, "a", 1000), (2, "b", 100), (3, "c", 10)], "doc_id long, source string, n_tokens long")
    exact = weights(plan_mixture(d, t, exact=True))
    assert exact["a"].exponent == 1.0 and sum(r.planned_tokens for r in exact.values()) == pytest.approx(20 / 0.3)
    p = weights(plan_mixture(d, t, size=600))
    assert 0 < p["a"].exponent < 1 and sum(r.weight for r in p.values()) == pytest.approx(1)
    assert max(r.planned_tokens / (r.max_repeats * r.tokens) for r in p.values()) == pytest.approx(1, rel=1e-6)
    assert sum(r.planned_tokens for r in plan_mixture(d, t, size=1e9).collect()) == pytest.approx(1110)  # all that the limits allow
    assert plan_mixture(d, t, epochs=1.0).agg(F.sum("planned_tokens")).first()[0] == pytest.approx(1110)


def test_entropy_is_met_by_temperature(spark):
    t = spark.createDataFrame([(c, 0.25, 50) for c in "abcd"], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(zip("abcd", (8000, 1500, 400, 100)))], "doc_id long, source string, n_tokens long")
    for h in (0.3, 1.0, 1.3):
        p = weights(plan_mixture(d, t, entropy=h, size=2000))
        w = np.array([p[c].weight for c in "abcd"])
        assert -(w * np.log(w)).sum() == pytest.approx(h, abs=1e-5)
        own = np.array([0.8, 0.15, 0.04, 0.01]) ** (1 - p["a"].exponent)
        assert w == pytest.approx(own / own.sum())
    tight = t.withColumn("max_repeats", F.lit(1))
    p = weights(plan_mixture(d, tight, entropy=1.3, size=2000))
    assert max(r.planned_tokens / r.tokens for r in p.values()) == pytest.approx(1, rel=1e-5)  # the limits come first


def docs(spark, n=9000):
    g = np.random.default_rng(0)
    rows = [(i, ["hot", "hot", "mid", "rare", None, "none"][int(g.choice(6, p=[0.3, 0.2, 0.2, 0.02, 0.08, 0.2]))], int(g.integers(0, 60))) for i in range(n)]
    return spark.createDataFrame(rows + [(None, "hot", 5)], "doc_id long, source string, n_tokens long").withColumn("block", F.lit(1))


@pytest.mark.parametrize("block", [64, 100_000])
def test_mixture_meets_its_targets(spark, block):
    t = spark.createDataFrame([("hot", 0.5, 1), ("mid", 0.3, 3), ("rare", 0.2, 4), ("gone", 0.1, 2), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    d = docs(spark)
    m = mix_sources(d, t, block_docs=block, exact=True)
    assert m.count() == d.count() - 1 and m.select("doc_id").distinct().count() == d.count() - 1
    assert mix_sources(d.unionByName(d), t, block_docs=block, exact=True).exceptAll(m).isEmpty()
    s = weights(mixture_shares(m, t, plan_mixture(d, t, exact=True)))
    for k, share in (("hot", 0.5), ("mid", 0.3), ("rare", 0.2)):
        assert s[k].share == pytest.approx(share, rel=0.01) and s[k].most_repeats <= s[k].max_repeats and s[k].planned_share == pytest.approx(share)
    assert s["gone"].share == 0 and s["none"].tokens == 0
    by = {r.source: r.spread for r in m.groupBy("source").agg((F.max("repeats") - F.min("repeats")).alias("spread")).collect()}
    assert max(by.values()) <= 1
    plan = plan_mixture(d, t)
    big = weights(mixture_shares(mix_sources(d, t, block_docs=block), t, plan))
    assert sum(r.tokens for r in big.values()) > 1.4 * sum(r.tokens for r in s.values()) and all(r.most_repeats <= (r.max_repeats or 0) for r in big.values())
    assert all(abs(r.tokens - r.planned_tokens) <= max(60, 0.01 * r.planned_tokens) for r in big.values())
    assert mix_sources(d.limit(0), t).count() == 0 and mix_sources(d, t.limit(0)).filter("repeats > 0").count() == 0


def test_prefix_sums_run_over_groups_of_blocks(spark, monkeypatch):
    t = spark.createDataFrame([("hot", 0.5, 1), ("mid", 0.3, 3), ("rare", 0.2, 4)], "source string, target_share double, max_repeats int")
    d = prepared(docs(spark))
    plan = plan_mixture(d, t)
    whole = realise(d, plan, block_docs=16)
    monkeypatch.setattr(mixing, "GROUP_BLOCKS", 3)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    assert realise(d, plan, block_docs=16).exceptAll(whole).isEmpty()


def test_shards_are_packed_apart(spark):
    sized = spark.range(4000).selectExpr("id as doc_id", "id % 90 as n_tokens")
    p = pack_documents(sized, [(1, 100)], shard_docs=100)
    assert p.rdd.getNumPartitions() > 40 and p.select("shard").distinct().count() == 40


@pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZERS, VOCABULARY)), reason="no vocabulary")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "word " * 50_000)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 50_000
