"""Fits that compare all rows, by groups of blocks, against those of one matrix."""

import numpy as np
import pytest

from tidewind.operators import blocks, cluster, spectra, ward
from tidewind.plans import backtest


def frame(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, z array<double>")


@pytest.mark.parametrize("name", ["spectral_rbf", "spectral_knn", "signed_knn_spectral", "agglomerative_ward"])
def test_blocks_find_the_groups_of_one_matrix(spark, monkeypatch, name):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 6)) * 0.3 + np.repeat(np.eye(6)[:4] * 4, 60, 0)
    options = {"gamma": 0.1} if name == "spectral_rbf" else {}
    whole = cluster.clusterer(name, 4, **options).fit(x)
    monkeypatch.setattr(backtest, "DENSE_ROWS", 100)
    monkeypatch.setattr(blocks, "LEAST", 50)
    monkeypatch.setattr(blocks, "CHUNK", 32)
    monkeypatch.setattr(ward, "CHUNK", 32)
    monkeypatch.setattr(spectra, "CHUNK", 32)
    monkeypatch.setattr(spectra, "GRAPH", 100)
    monkeypatch.setattr(ward, "FEW", 30)
    got = {r.id: r.p for r in backtest.fitted(frame(spark, x), name, 4, options).collect()}
    mine = np.array([got[k] for k in range(240)])
    by = [np.lexsort(np.round(p, 6).T[::-1]) for p in (mine.T, whole.T)]
    np.testing.assert_allclose(mine[:, by[0]], whole[:, by[1]], atol=1e-8)  # labels are equal, so means are


@pytest.mark.parametrize("k", [1, 3, 40])
def test_ward_in_rounds_cuts_the_tree_of_single_merges(spark, monkeypatch, k):
    x = np.random.default_rng(8).normal(size=(150, 3))  # no groups stand apart, and merges of rounds are taken back
    monkeypatch.setattr(ward, "FEW", 20)
    monkeypatch.setattr(blocks, "LEAST", 40)
    got = {r.id: r.label for r in ward.ward(frame(spark, x), 150, 3, k).collect()}
    label = cluster.Ward(k).labels(x)
    assert len({(got[i], label[i]) for i in range(150)}) == len(set(label)) == len(set(got.values())) == k


def test_eigenvectors_are_those_of_the_matrix(spark):
    x = np.random.default_rng(2).normal(size=(120, 4))
    kept, df = blocks.Kept(spark), frame(spark, x)
    rows = kept(blocks.blocked(df, 3))
    kernel = spectra.Kernel(0.3, 3)
    state = kept(spectra._started(rows, 10, 0, True))
    _, _, theta = spectra.leading(kernel, state, 3, 0.0, kept)
    want = np.linalg.eigvalsh(np.exp(-0.3 * cluster.squared(x, x)))[::-1][:3]
    np.testing.assert_allclose(theta, want, rtol=1e-9)
