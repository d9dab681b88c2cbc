"""Fits in rounds, and exact quantiles, against numpy with all rows at hand."""

import numpy as np
import pytest

from tidewind.operators import cluster, fits, selection
from tidewind.plans import backtest


def blobs(n=400, d=5, k=4, apart=8.0, seed=0):
    rng = np.random.default_rng(seed)
    label = rng.integers(k, size=n)
    return rng.normal(size=(n, d)) + apart * rng.normal(size=(k, d))[label], label


def frame(spark, x):
    return spark.createDataFrame([(k, z.tolist()) for k, z in enumerate(x)], "id long, z array<double>")


@pytest.fixture
def many_tasks(monkeypatch):
    """A few rows for each task, and more tasks than send their sums straight to the driver."""
    monkeypatch.setattr(fits, "TASK_ROWS", 100)
    monkeypatch.setattr(fits, "DIRECT", 3)


def partition(labels):
    return sorted(map(tuple, (np.flatnonzero(labels == g).tolist() for g in set(labels))))


@pytest.mark.parametrize("name", ["kmeans_soft", "fuzzy_cmeans", "gmm"])
def test_rounds_find_the_groups(spark, many_tasks, name):
    x, label = blobs()
    got = {r.id: r.p for r in backtest.fitted(frame(spark, x), name, 4, {"n_init": 5} if name == "gmm" else {}).collect()}
    p = np.array([got[k] for k in range(len(x))])
    assert np.allclose(p.sum(1), 1) and partition(p.argmax(1)) == partition(label)


def test_kmeans_is_as_good_as_with_all_rows_at_hand(spark, many_tasks):
    x, _ = blobs(apart=1.5, seed=3)
    v = fits.Vectors(frame(spark, x))
    cost = lambda c: cluster.squared(x, c).min(1).sum()
    c = fits.kmeans(v, 4)
    assert cost(c) <= 1.02 * cost(cluster.kmeans(x, 4)[0])
    label = cluster.squared(x, c).argmin(1)
    assert np.allclose(c, [x[label == j].mean(0) for j in range(4)])  # a fixed point of its own step
    assert np.allclose(fits.label_means(v, lambda y: cluster.squared(y, c).argmin(1), 5)[4], x.mean(0))  # an empty label


def test_fuzzy_memberships_are_those_of_their_centres(spark, many_tasks, m=1.3):
    x, _ = blobs(apart=3.0, seed=4)
    v = fits.Vectors(frame(spark, x))
    p = fits.fuzzy_cmeans(v, 4, m=m, error=1e-6).predict(x)
    w = p**m
    c = w.T @ x / w.sum(0)[:, None]
    u = np.sqrt(cluster.squared(x, c)) ** (-2 / (m - 1))
    assert np.allclose(u / u.sum(1, keepdims=True), p, atol=1e-4)


@pytest.mark.parametrize("init", ["kmeans", "random", "random_from_data"])
def test_mixtures_are_as_likely_as_with_all_rows_at_hand(spark, many_tasks, init):
    x, _ = blobs(apart=3.0, seed=5)
    v = fits.Vectors(frame(spark, x))
    p = fits.gmm(v, 4, init=init, n_init=4, tol=1e-4).predict(x)
    n = p.sum(0)
    w, mu = n / n.sum(), p.T @ x / n[:, None]
    var = np.maximum(p.T @ (x * x) / n[:, None] - mu**2, 0) + 1e-3
    local = cluster.DiagonalGmm(4, init="kmeans", n_init=4, tol=1e-4)
    local.fit(x)
    log = local._log(x, w, mu, var)
    bound = np.log(np.exp(log - log.max(1, keepdims=True)).sum(1)).mean() + log.max(1).mean()
    assert bound >= local.bound - (0.05 if init == "kmeans" else 0.5)
    again = cluster.DiagonalGmm(4)
    again.w, again.mu, again.var = w, mu, var
    assert np.allclose(again.predict(x), p, atol=0.05)  # a fixed point of its own step


def test_two_stages(spark, many_tasks):
    x, label = blobs(apart=6.0, seed=6)
    x[:30] *= 10
    far = ((x - x.mean(0)) ** 2).sum(1)
    got = {r.id: r.label for r in backtest.fitted_labels(frame(spark, x), "modified_two_stage", 5, quantile=0.95).collect()}
    out = np.array([got[k] for k in range(len(x))])
    assert ((out == 0) == (far >= np.quantile(far, 0.95))).all() and set(out) == {0, 1, 2, 3, 4}
    with pytest.raises(ValueError):
        fits.two_stage(fits.Vectors(frame(spark, x)), 1)
    # too few inner rows: nothing is an outlier
    assert 0 not in {r.label for r in backtest.fitted_labels(frame(spark, x[:6]), "modified_two_stage", 6, quantile=0.0).collect()}


def test_starts_depend_on_no_order(spark):
    x, _ = blobs(apart=2.0, seed=7)
    df = frame(spark, x)
    one = {r.id: r.p for r in backtest.fitted(df, "fuzzy_cmeans", 3, {}).collect()}
    two = {r.id: r.p for r in backtest.fitted(df.orderBy("id", ascending=False).repartition(7), "fuzzy_cmeans", 3, {}).collect()}
    assert all(np.allclose(one[k], two[k]) for k in one)
    u = fits.uniform(np.arange(20_000), 3, 2)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u.T)[0, 1]) < 0.03
    with pytest.raises(ValueError):
        backtest.fitted(df.limit(2), "kmeans_soft", 3, {})


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "one", "huge"])
def test_quantiles_are_numpys(spark, kind):
    rng = np.random.default_rng(8)
    x = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 3000) * 0.1, "heavy": rng.pareto(0.4, 3000), "one": np.array([2.5]), "huge": rng.choice([-1.7e308, 1.7e308, 0.0, 1e-300], 500)}[kind]
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(5)
    for limits in ({}, {"gathered": 10, "accuracy": 20}):
        with np.errstate(over="ignore", invalid="ignore"):
            want = [float(v) for v in np.quantile(x, shares)]
        got = selection.quantiles(df, shares, **limits)
        assert all(g == pytest.approx(w, rel=1e-12, abs=1e-300) for g, w in zip(got, want, strict=True) if np.isfinite(w))
    assert selection.quantiles(df.limit(0), [0.5]) == [None]


def test_kmeans_ends_when_no_row_changes_its_group(spark, many_tasks):
    x = np.random.default_rng(11).normal(size=(3000, 3))
    v = fits.Vectors(frame(spark, x))
    c = fits.kmeans(v, 4, n_init=2, iterations=3)  # the starts are far from still
    label = cluster.squared(x, c).argmin(1)
    means = np.array([x[label == j].mean(0) for j in range(4)])
    assert np.allclose(means, c, rtol=0, atol=1e-12) and (cluster.squared(x, means).argmin(1) == label).all()


def test_sums_of_a_round_dont_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fits, "TASK_ROWS", 10)
    v = fits.Vectors(spark.range(4000).selectExpr("id", "array(double(id), 1.0) AS z"))
    assert v.tasks <= spark.sparkContext.defaultParallelism
    sent = []
    added = fits._added
    monkeypatch.setattr(fits, "_added", lambda rows: added(sent.append(r) or r for r in rows))
    monkeypatch.setattr(fits, "BYTES", 8)
    assert v.summed(lambda ids, x: [x.sum(0)])[0].tolist() == [4000 * 3999 / 2, 4000.0] and len(sent) == fits.GROUPS
