"""Neighbours found in groups of bounded size, against all distances at hand."""

import numpy as np
import pytest

from tidewind.operators import knn


@pytest.mark.parametrize(("name", "p"), [("l1", None), ("l2", None), ("chebyshev", None), ("cosine", None), ("angular", None), ("lp", 3.0), ("lp", 1.5)])
def test_blocks_and_parts_find_what_all_distances_do(spark, monkeypatch, name, p):
    monkeypatch.setattr(knn, "BLOCK", 7)
    monkeypatch.setattr(knn, "PART", 11)
    rng = np.random.default_rng(3)
    z = np.round(rng.normal(size=(90, 5)), 1)
    z[40:60] = z[:20]  # copies: ties go to the smaller identifier
    rows = [(k, x.tolist()) for k, x in enumerate(z)] + [(90, None), (91, [1.0]), (92, [None] * 5)]
    df = spark.createDataFrame(rows, "id long, z array<double>")
    plan = knn.neighbours(df.where("id % 3 = 0"), df, 4, name, p)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString()  # no join of each query with each row
    got = plan.orderBy("q", "rank").collect()
    dist = knn._pair_distances(name, p or 2.0)
    for q in range(0, 90, 3):
        d = dist(np.repeat(z[[q]], 90, 0), z)
        order = [k for k in np.lexsort((np.arange(90), d)) if k != q][:4]
        assert [(r.id, r.dist) for r in got if r.q == q] == [(k, d[k]) for k in order]
    assert all(r.dist is None for r in got if r.q == 90)
