from __future__ import annotations

import random

from breathlake.llm.splits import assign_groups, forced_pairs, propagate_labels


def components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r, e in links:
        if r is not None and e is not None:
            a, b = find(("r", r)), find(("e", e))
            parent[a] = b
    out = {}
    for r, e in links:
        if r is not None and e is not None:
            out.setdefault(find(("e", e)), set()).add(e)
    return {frozenset(v) for v in out.values()}


def test_labels_are_the_components(spark):
    r = random.Random(4)
    links = [(f"r{r.randrange(80)}", f"e{r.randrange(100):03d}") for _ in range(110)]
    links += [(f"c{i}", f"x{i + j:03d}") for i in range(60) for j in (0, 1)]  # a long chain
    links += [(f"h{i}", "e000") for i in range(200)] + [(None, "e001"), ("r1", None)] + links[:9]
    got = {}
    for x in propagate_labels(spark.createDataFrame(links, "record string, entity string")).collect():
        got.setdefault(x.label, set()).add(x.entity)
        assert x.label <= x.entity
    assert {frozenset(v) for v in got.values()} == components(links)
    parted = propagate_labels(spark.createDataFrame(links, "record string, entity string"), part_links=16)
    assert {(x.entity, x.label) for x in parted.collect()} == {(e, k) for k, v in got.items() for e in v}
    assert propagate_labels(spark.createDataFrame([], "record string, entity string")).count() == 0


def test_shares_and_strata_are_met_and_groups_stay_whole(spark):
    r = random.Random(1)
    rows = [(f"g{i}", r.choice(["0", "1", "1", None]), r.randint(1, 9)) for i in range(6000)]
    rows += [("big", "0", 2500), ("big", "1", 1500), ("mid", "1", 400)]
    members = spark.createDataFrame(rows, "group string, stratum string, n long")
    targets = [("train", 0.7), ("validation", 0.15), ("test", 0.15)]
    got = {}
    for x in assign_groups(members, targets).collect():
        assert x.group not in got
        got[x.group] = x.split
    assert set(got) == {g for g, _, _ in rows}
    total = sum(n for _, _, n in rows)
    for name, share in targets:
        assert abs(sum(n for g, _, n in rows if got[g] == name) / total - share) < 0.01
        for s in ("0", "1", None):
            all_s = sum(n for _, t, n in rows if t == s)
            assert abs(sum(n for g, t, n in rows if t == s and got[g] == name) / all_s - share) < 0.03
    assert assign_groups(members.limit(0), targets).count() == 0
    assert {x.split for x in assign_groups(members, [("all", 1.0), ("none", 0.0)]).collect()} == {"all"}


def test_every_group_is_placed_by_deviation_and_many_labels_are_pooled(spark):
    rows = [(f"g{i}", str(i % 600), 1 + i % 5) for i in range(3000)] + [("hot", None, 4000), ("hot", "7", 10)]
    members = spark.createDataFrame(rows, "group string, stratum string, n long")
    for bundles in (7, 4096):
        got = {x.group: x.split for x in assign_groups(members, [("train", 0.6), ("test", 0.4)], bundles=bundles).collect()}
        assert len(got) == 3001
        share = sum(n for g, _, n in rows if got[g] == "train") / sum(n for _, _, n in rows)
        assert abs(share - 0.6) < (0.1 if bundles == 7 else 0.01)


def test_pairs_by_written_form(spark):
    rows = [("p", "A", 1), ("p", "A", 2), ("p", "a", 3), ("q", "B", 4), ("q", "b ", 2), ("q", "B", 4)]
    got = {(r.a, r.b) for r in forced_pairs(spark.createDataFrame(rows, "group string, written string, id long")).collect()}
    assert got == {(1, 3), (2, 3), (2, 4)}


def test_windows_of_one_person_or_session_share_a_split(spark, tmp_path):
    from breathlake.llm.queries import p3_found, p3_split

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    save("subjects", [("A1", None), ("B2", "a-1"), ("C3", "B2 "), ("D4", None), (None, "A1")], "subject_id string, prior_subject_id string")
    save("recordings", [(1, "A1", "20240101", 1), (2, "c3", "20240101", 1), (3, None, "1.2.2024", 7), (4, "unknown", "2024-02-01", 7), (5, "D4", "UNKNOWN", 1), (6, " ", "UNKNOWN", 7), (7, "A1", None, None), (8, "A1", "20240101", 1), (1, "A1", "20240101", 1)], "recording_id long, subject_id string, recording_date string, device_id int")
    save("signal_windows", [(10 * r + k, r, s) for r, s in ((1, "A1"), (2, None), (3, None), (4, None), (5, "D4"), (6, None), (7, "A1"), (99, "B2"), (98, None)) for k in range(2)] + [(10, 1, "A1"), (1000, None, None)], "window_id long, recording_id long, subject_id string")
    save("clinical_labels", [("A1", 1), ("D4", None), (None, 0)], "subject_id string, recovery int")
    save("split_targets", [("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    d = str(tmp_path)
    assert {tuple(r) for r in p3_found(spark, d).select("recording_id_a", "recording_id_b").collect()} == {(1, 2), (2, 7), (3, 4)}
    got = {r.window_id: (r.group, r.split) for r in p3_split(spark, d).collect()}
    assert len(got) == 19
    same = lambda *w: len({got[x] for x in w}) == 1
    assert same(10, 11, 20, 21, 70, 71, 990, 991) and same(30, 31, 40, 41) and same(60, 61)
    assert len({got[w][0] for w in (10, 30, 50, 60, 980, 1000)}) == 6
