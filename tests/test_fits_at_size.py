"""What fits over all pairs leave behind and how many products they take."""

import os

import numpy as np

from tidewind.operators import blocks, spectra


def test_a_rounds_table_goes_when_the_next_is_there(spark):
    kept = blocks.Kept(spark)
    one = kept(spark.range(3).toDF("id"))
    two = kept(one.selectExpr("id + 1 AS id"), one)
    assert [r.id for r in two.orderBy("id").collect()] == [1, 2, 3]
    assert sorted(os.listdir(kept.folder)) == ["round_2"]


def test_close_eigenvalues_get_long_filters():
    assert spectra._degree(1.001, 1.001) > 10  # ten products enlarge such vectors by a tenth
    assert spectra._degree(50.0, 50.0) <= 10


def test_what_a_block_keeps_is_not_sent(spark):
    rows = spark.createDataFrame([(b, b"y", b"p") for b in range(3)], "block int, y binary, p binary")
    for r in blocks.paired(rows, 3, "p").collect():
        assert (r.p is None) == (r.i != r.j) and r.y is not None


def test_a_graph_with_a_hub_has_its_smallest_eigenvalues(spark):
    n = 60
    a = np.zeros((n, n))
    a[0, 1:], a[1:, 0] = 1, 1
    for i in range(1, n - 1):
        a[i, i + 1] = a[i + 1, i] = -0.5
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "id long, other long, w double")
    degree = np.abs(a).sum(1)
    top = max(degree + (np.abs(a) @ degree) / degree)
    want = np.linalg.eigvalsh(np.diag(degree) - a)
    assert want[-1] <= top < 2 * degree.max()
    rows = spark.createDataFrame([(k, [0.0]) for k in range(n)], "id long, z array<double>")
    turned = edges.unionByName(spark.createDataFrame([(k, k, float(top - degree[k])) for k in range(n)], "id long, other long, w double"))
    kept = blocks.Kept(spark)
    held = kept(blocks.blocked(rows, 3))
    graph = spectra.Graph(turned, held, 3, 4)
    _, _, theta = spectra.leading(graph, kept(spectra._started(held, 9, 0, False)), 2, 0.0, kept)
    graph.close()
    np.testing.assert_allclose(top - theta, want[:2], atol=1e-6)
