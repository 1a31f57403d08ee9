from __future__ import annotations

from breathlake.operators.orphans import Entity, ForeignKey, cascade_orphans, orphan_report

TS = "timestamp_ntz"


def _graph(spark, subjects, windows, parts):
    s = spark.createDataFrame(subjects, f"id long, subject string, a string, b string").selectExpr("id", "subject", f"cast(a as {TS}) a", f"cast(b as {TS}) b")
    w = spark.createDataFrame(windows, "id long, subject string, parent long, t string").selectExpr("id", "subject", "parent", f"cast(t as {TS}) t")
    p = spark.createDataFrame(parts, "id long, window long, above long")
    return {"s": Entity(s, "id", None, "a", "b"), "w": Entity(w, "id", "t"), "p": Entity(p, "id")}


KEYS = [ForeignKey("w", ("subject",), "s", ("subject",)), ForeignKey("p", ("window",), "w", ("id",)), ForeignKey("p", ("above",), "p", ("id",))]


def test_direct_lifetime_and_cascade(spark):
    subjects = [(1, "A", "2024-01-01", None), (2, "B", "2024-01-01", "2024-02-01"), (3, "B", "2024-03-01", None)]
    windows = [(1, "A", None, "2024-01-05"), (2, "A", None, "2023-12-31"), (3, "B", None, "2024-02-01"), (4, "B", None, "2024-03-02"), (5, None, None, "2024-01-01"), (6, "C", None, None)]
    parts = [(10, 2, None), (11, 1, None), (12, None, 10), (13, None, 12), (14, 99, None), (15, None, 15)]
    o = cascade_orphans(_graph(spark, subjects, windows, parts), KEYS)
    got = {(r.ref_table, r.ref_id, r.kind, r.depth) for r in o.collect()}
    assert got == {("w", 2, "direct", 0), ("w", 3, "direct", 0), ("w", 6, "direct", 0), ("p", 14, "direct", 0), ("p", 10, "inherited", 1), ("p", 12, "inherited", 2), ("p", 13, "inherited", 3)}
    r = {(x.ref_table, x.period): (x.direct, x.inherited) for x in orphan_report(o).collect()}
    assert r[("w", "2023-12")] == (1, 0) and r[("p", None)] == (1, 3)


def test_empty_tables_and_missing_parents(spark):
    assert cascade_orphans(_graph(spark, [], [], []), KEYS).count() == 0
    o = cascade_orphans(_graph(spark, [], [(1, "A", None, "2024-01-01")], []), KEYS)
    assert [(r.ref_table, r.ref_id) for r in o.collect()] == [("w", 1)]


def test_hot_key_and_repeated_parents(spark):
    subjects = [(i, "A", "2024-01-01", None) for i in range(3)]
    windows = [(i, "A" if i % 3 else "Z", None, "2024-01-02") for i in range(300)]
    assert cascade_orphans(_graph(spark, subjects, windows, []), KEYS).count() == 100


def test_hot_keys_are_salted_by_their_size(spark, monkeypatch):
    from breathlake.operators import orphans

    subjects = [(i, "A", "2024-01-01", None) for i in range(3)]
    windows = [(i, "A" if i % 3 else "Z", None, "2024-01-02") for i in range(300)]
    parts = [(1000 + i, i % 7, None) for i in range(400)]
    rows = lambda: sorted(map(tuple, cascade_orphans(_graph(spark, subjects, windows, parts), KEYS).collect()))
    whole = rows()
    c, p = orphans._salted(spark.range(90).selectExpr("id as ref_id", "if(id < 70, 'x', 'y') as _k0"), spark.createDataFrame([("x",), ("y",)], "_k0 string"), ["_k0"], rows=20)
    assert {(r._k0, r._salt) for r in p.collect()} == {("x", i) for i in range(4)} | {("y", 0)} and c.select("_salt").distinct().count() == 4
    monkeypatch.setattr(orphans, "SALT_ROWS", 20)
    assert rows() == whole and len(whole) > 100
