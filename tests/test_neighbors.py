from __future__ import annotations

import numpy as np
import pytest

from breathlake.operators import ml


@pytest.mark.parametrize("block", [64, 2048])
def test_copies_go_by_id_however_many_there_are(spark, block):
    g = np.random.default_rng(3)
    v = g.normal(size=(600, 8)) + 50
    v[g.permutation(600)[:200]] = v[7]  # a third of all rows are copies of one vector
    df = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(600)], "vec_id long, embedding array<double>, label int")
    copies = [i for i in range(600) if (v[i] == v[7]).all()]
    near = spark.createDataFrame([(1000, (v[7] + 0.001).tolist())], "vec_id long, embedding array<double>")
    found = ml.nearest(df, df.filter("vec_id % 50 in (0, 7)").select("vec_id", "embedding").union(near), 5, block=block).collect()
    got = {(r.query_id, r["rank"]): (r.neighbor_id, r.label) for r in found}
    for q in [i for i in range(600) if i % 50 in (0, 7)]:
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:5].tolist()
        assert [got[q, k] for k in range(1, 6)] == [(i, i % 3) for i in want]
    assert [got[1000, k][0] for k in range(1, 6)] == copies[:5]
