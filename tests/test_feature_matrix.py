from __future__ import annotations

import os

import duckdb
import pytest

from breathlake.operators import features as ft
from breathlake.plans import feature_queries as fq

DATA = "/root/testdata/sf0.01"


def test_matrix_has_every_window(spark):
    rows = [(1, w, None if w == 3 else w / 10) for w in range(30)] + [(2, 500, 1.5), (2, 0, 0.5), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "recording_id long, window_index int, rate double")
    got = {r.recording_id: [tuple(w) for w in r.windows] for r in ft.feature_matrix(df, ["recording_id"], "rate", "window_index").collect()}
    assert got == {1: [(w, v) for _, w, v in rows[:30]], 2: [(0, 0.5), (500, 1.5)], 3: []}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_has_every_window_of_the_table(spark):
    got = {(r.recording_id, w.window, w.value) for r in fq.feature_matrix(spark, DATA).collect() for w in r.windows}
    sql = f"with {fq._wf(['rate'])} select recording_id, window_index, max(rate) from wf group by 1, 2"
    con = duckdb.connect()
    con.execute(f"create view window_features as select * from '{DATA}/window_features.parquet'")
    want = set(con.execute(sql).fetchall())
    assert got == want and max(w for _, w, _ in want) > 11
