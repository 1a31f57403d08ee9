from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from breathlake.operators.impute import ImputeSpec, filled_cells, impute, impute_matrices


def planted(seed=1, groups=60, each=12):
    """Rank-2 numbers and a category that follows them, by group."""
    g = np.random.default_rng(seed)
    load = g.normal(size=(2, 6))
    rows = []
    for r in range(groups):
        base = g.normal(size=2)
        for k in range(each):
            u = base + 0.2 * g.normal(size=2)
            x = 20 + u @ load * 3 + g.normal(0, 0.1, 6)
            rows.append((r * each + k, r, k, *map(float, x), "ab"[int(u[0] > 0)]))
    return rows


SCHEMA = "id long, grp long, k int, " + ", ".join(f"x{i} double" for i in range(6)) + ", c string"
SPEC = ImputeSpec(id=("id",), numeric=tuple(f"x{i}" for i in range(6)), categories={"c": ("a", "b")}, group="grp", order="k", rank=4)


def test_held_out_cells_are_nearer_than_the_mean(spark):
    rows, g = planted(), np.random.default_rng(2)
    hidden = {}
    holed = []
    for r in rows:
        r = list(r)
        for j in range(3, 10):
            if g.random() < 0.1:
                hidden[(r[0], j)] = r[j]
                r[j] = (None if j == 9 else [None, float("nan"), float("inf"), -1.0][int(g.integers(4))])
        holed.append(tuple(r))
    out = impute(spark.createDataFrame(holed + holed[:5], SCHEMA), SPEC)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    names = SCHEMA.replace(" long", "").replace(" int", "").replace(" double", "").replace(" string", "").split(", ")
    assert {(i, f) for i, r in got.items() for f in r["filled_fields"]} == {(i, names[j]) for i, j in hidden}
    num = [(got[i][names[j]], v, np.mean([r[j] for r in rows])) for (i, j), v in hidden.items() if j < 9]
    a, v, m = map(np.array, zip(*num))
    assert np.sqrt(np.mean((a - v) ** 2)) < 0.35 * np.sqrt(np.mean((m - v) ** 2))
    cat = [got[i]["c"] == v for (i, j), v in hidden.items() if j == 9]
    assert np.mean(cat) > 0.85 and all(r["c"] in ("a", "b") for r in got.values())
    kept = {r[0]: r for r in holed}
    assert all(got[i][names[j]] == kept[i][j] for i in got for j in range(3, 10) if (i, j) not in hidden)


def test_edges(spark):
    empty = impute(spark.createDataFrame([], SCHEMA), SPEC)
    assert empty.count() == 0 and "filled_fields" in empty.columns
    rows = [(1, 1, 0, *[None] * 6, None), (2, None, None, *[1.0] * 5, None, "zzz")]
    got = {r["id"]: r for r in impute(spark.createDataFrame(rows, SCHEMA), SPEC).collect()}
    assert got[1]["x0"] == 1.0 and got[1]["x5"] is None and len(got[1]["filled_fields"]) == 6
    assert got[2]["filled_fields"] == ["c"] and got[2]["c"] in ("a", "b")  # x5 has no value anywhere, so it is not filled


def test_large_groups_in_parts_and_small_chunks(spark, monkeypatch):
    from breathlake.operators import impute as im

    rows = [(*r[:3], *[None if (r[0] + j) % 9 == 0 else v for j, v in enumerate(r[3:9])], r[9]) for r in planted(3, 6, 40)]
    rows = [(r[0], r[1] if r[0] % 50 else None, r[2] if r[0] % 31 else None, *r[3:]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r["id"]: r for r in impute(df, SPEC).collect()}
    monkeypatch.setattr(im, "GROUP_ROWS", 25)
    monkeypatch.setattr(im, "CHUNK_ROWS", 7)
    two = {r["id"]: r for r in impute(df, SPEC).collect()}
    assert set(one) == set(two) and all(one[i]["filled_fields"] == two[i]["filled_fields"] for i in one)
    assert max(abs(one[i][f"x{j}"] - two[i][f"x{j}"]) for i in one for j in range(6)) < 1e-6


def test_integers_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, i % 3, 2 * (i % 3) if i % 5 else None, "q") for i in range(40)], "id long, g int, n int, filled_fields string")
    df = df.withColumnRenamed("filled_fields", "note")
    out = impute(df, ImputeSpec(id=("id",), numeric=("n",), group="g"))
    assert dict(out.dtypes)["n"] == "int" and out.filter("n is null or n < 0 or n > 4").count() == 0 and out.filter("note <> 'q'").count() == 0


def test_matrices_fill_only_what_they_have(spark):
    rows = [(i, i % 4, ["a", "b"] if i % 2 else ["a"], [[1.0, None, 3.0], [2.0, 2.0, float("nan")]] if i % 2 else [[1.0, -2.0]]) for i in range(12)]
    m = spark.createDataFrame(rows + rows[:2], "matrix_id long, recording_id long, feature_names array<string>, feature_values array<array<double>>")
    cells = filled_cells(impute_matrices(m, rank=2), "m", "matrix_id", F.col("win_pos")).collect()
    want = {(i, "a", 1) for i in range(12)} | {(i, "b", 2) for i in range(12) if i % 2}
    assert sorted((c.row_id, c.field_name, c.win_pos) for c in cells) == sorted(want)
