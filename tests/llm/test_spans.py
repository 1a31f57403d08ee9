from __future__ import annotations

import random

import numpy as np
import pytest

from breathlake.llm import spans
from breathlake.llm.spans import SpanRules, compact, shared_shares, shared_stretches


def brute(docs, n):
    first, shared = {}, set()
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            if first.setdefault(t[i: i + n], d) != d:
                shared.add(t[i: i + n])
    out = {}
    for d, t in docs:
        hit = [i for i in range(len(t or "") - n + 1) if t[i: i + n] in shared]
        runs = []
        for i in hit:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = i + n
            else:
                runs.append([i, i + n])
        if runs:
            out[d] = [tuple(r) for r in runs]
    return out


def corpus(seed, n=60, alphabet="abcdefgh \né\U0001f600"):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    docs = [word(r.randint(0, 900)) for _ in range(n)]
    boiler = word(150)
    for _ in range(n):
        a, b = r.randrange(n), r.randrange(n)
        k = r.choice([60, 95, 98, 99, 100, 101, 102, 130, 180, 300])
        s = r.randint(0, max(0, len(docs[a]) - k))
        at = r.randint(0, len(docs[b]))
        docs[b] = docs[b][:at] + docs[a][s: s + k] + docs[b][at:]
    docs = [d + boiler[: r.randint(80, 150)] if i % 3 == 0 else d for i, d in enumerate(docs)]  # a third shares a passage
    docs += [docs[0], "x" * 500, "x" * 450, "xy" * 300, "yx" * 200, "", None, "short"]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,broadcast", [(1, True), (2, False), (3, True)])
def test_stretches_match_brute_force(spark, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr(spans, "BROADCAST_ROWS", -1)
    docs = corpus(seed)
    df = spark.createDataFrame(docs + docs[:9], "doc_id long, text string")
    got = {}
    for r in shared_stretches(df, SpanRules(span=100, gram=12)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    want = brute(docs, 100)
    assert {d: sorted(v) for d, v in got.items()} == want


@pytest.mark.parametrize("bits", [6, 13])
def test_texts_decide_where_hashes_collide(spark, bits):
    docs = corpus(5, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in shared_stretches(df, SpanRules(span=100, gram=12, bits=bits)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {d: sorted(v) for d, v in got.items()} == brute(docs, 100)


def test_stretches_come_from_paths(spark, monkeypatch):
    r = random.Random(11)
    word = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    passage = word(4000)
    docs = [(i, word(300) + passage[i * 50: 3000 + i * 50] + word(300)) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rules = SpanRules(span=100, gram=12)
    asked = []
    grams = spans._grams
    monkeypatch.setattr(spans, "_grams", lambda d, ranges, rules: asked.append(ranges.selectExpr("coalesce(sum(hi - lo + 1), 0)").first()[0]) or grams(d, ranges, rules))
    whole = sorted(map(tuple, shared_stretches(df, rules).collect()))
    assert {d: [(a, b)] for d, a, b, _ in whole} == brute(docs, 100)
    assert asked[0] < 9 * 3000 * 0.2  # what lies along the path is not looked up by hash
    # without paths nothing but what they leave open is found
    monkeypatch.setattr(spans, "overlaps", lambda occ, runs: overlaps_none(occ))
    monkeypatch.setattr(spans, "_grams", lambda d, ranges, rules: grams(d, ranges.limit(0), rules))
    assert shared_stretches(df, rules).count() == 0


def overlaps_none(occ):
    return occ.limit(0).selectExpr("doc", "start", "end", "doc as wdoc", "start as wstart")


def test_long_texts_in_blocks(spark, monkeypatch):
    r = random.Random(7)
    text = "".join(r.choice("abcdefg ") for _ in range(9000))
    docs = [(1, text), (2, "z" * 50 + text[3000:7500]), (3, text[1000:1099] + "q" + text[2000:2100])]
    rules = SpanRules(span=100, gram=12)
    whole = list(spans._whole_edges([t for _, t in docs], rules))
    monkeypatch.setattr(spans, "BLOCK", 1500)
    spans._tables.cache_clear()
    parts = list(spans._whole_edges([t for _, t in docs], rules))
    spans._tables.cache_clear()
    for k in ("row", "edge", "start", "end", "from_", "to_", "next_to"):
        assert np.array_equal(np.concatenate([e[k] for e in whole]), np.concatenate([e[k] for e in parts])), k


def test_paths_of_a_chain_a_fork_and_a_ring(spark):
    chain = [(i - 1, i, 6 + i % 3) for i in range(1, 40)]
    fork = [(50, 51, 9), (50, 52, 9), (53, 54, 9), (55, 54, 9)]
    ring = [(60, 61, 5), (61, 62, 5), (62, 60, 5)]
    loop = [(70, 70, 5)]
    pairs = chain + chain[:5] + fork + ring + loop
    edges = spark.createDataFrame([(e,) for p in pairs for e in p[:2]], "edge long")
    got = {r.edge: (r.path, r.off, r.pos) for r in compact(edges, spark.createDataFrame(pairs, "prev long, edge long, step long")).collect()}
    assert all(got[i] == (0, i, sum(6 + k % 3 for k in range(1, i + 1))) for i in range(40))
    assert all(got[i] == (i, 0, 0) for i in (50, 51, 52, 53, 54, 55, 60, 61, 62, 70))


def test_shares_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab" * 200, 9), (2, "ab" * 200, 9), (3, None, 9), (4, "", 9), (4, "", 9)], "doc_id long, text string, start int")
    got = {r.doc_id: (r.shared_chars, r.share) for r in shared_shares(df, shared_stretches(df)).collect()}
    assert got == {1: (400, 1.0), 2: (400, 1.0), 3: (0, 0.0), 4: (0, 0.0)}
    assert shared_stretches(df.limit(0)).count() == 0


def test_driver_holds_no_more_for_more_repeats(spark, monkeypatch):
    r = random.Random(13)
    word = lambda k: "".join(r.choices("abcdefgh ", k=k))
    passage = word(600_000)
    docs = [(1, passage), (2, word(300) + passage)] + [(i, word(40) + passage[i * 120: i * 120 + 130] + word(40)) for i in range(3, 4_003)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert spans.BROADCAST_ROWS * 32 + spans.SIEVE_BITS // 8 <= 16 << 20
    monkeypatch.setattr(spans, "BROADCAST_ROWS", 10_000)
    sent, broadcast = [], spans.F.broadcast
    monkeypatch.setattr(spans.F, "broadcast", lambda d: sent.append(d.count()) or broadcast(d))
    got = {(x.doc_id, x.start, x.end) for x in shared_stretches(df, SpanRules(span=100, gram=12)).collect()}
    assert max([0, *sent]) <= 10_000  # of about 24,000 repeated edges
    assert {(1, 0, 600_000), (2, 300, 600_300)} <= got and {d for d, _, _ in got} == set(range(1, 4_003))


@pytest.mark.parametrize("most", [64, 1 << 26])
def test_sieve_is_bounded_and_loses_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(spans, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(spans, "SIEVE_BITS", most)
    keys = spark.range(-500, 2_500).toDF("edge")
    words = spans._sieve(keys, 3_000).value
    assert len(words) * 64 == min(most, 1 << 16)
    assert spans._held(np.arange(-500, 2_500), words).all()
    assert spans._held(np.arange(10_000, 20_000), words).mean() < 0.05 or most == 64
    docs = corpus(9, 30)
    got = {}
    for r in shared_stretches(spark.createDataFrame(docs, "doc_id long, text string"), SpanRules(span=100, gram=12)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {d: sorted(v) for d, v in got.items()} == brute(docs, 100)
