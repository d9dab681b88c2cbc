"""Invariants of the numpy operators, and of the backtest."""

import dataclasses
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewind.functions import stats
from tidewind.functions.vectors import lp, metric
from tidewind.operators import embed, linalg
from tidewind.operators.cluster import CLUSTERERS, UNSUPPORTED, clusterer, kmeans
from tidewind.plans import backtest, walkforward
from tidewind.sources import config


def spd(rng, n=5):
    a = rng.normal(size=(n, n + 3))
    return a @ a.T / n


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 7))
def test_spectral_identities(seed, n):
    rng = np.random.default_rng(seed)
    a, b = spd(rng, n), spd(rng, n)
    assert np.allclose(linalg.expm(linalg.logm(a)), a) and np.linalg.eigvalsh(linalg.project_spd(a - 10 * np.eye(n))).min() >= 1e-8 * (1 - 1e-6)
    assert np.isclose(linalg.stein(a, b), 2 * linalg.kl(a, b)) and linalg.kl(a, b) >= -1e-9 and abs(linalg.kl(a, a)) < 1e-6
    w = linalg.gmvp(a)
    assert np.isclose(w.sum(), 1)
    lo = linalg.gmvp_long_only(a)
    assert lo.min() >= 0 and np.isclose(lo.sum(), 1) and lo @ a @ lo >= w @ a @ w - 1e-9
    for _ in range(10):
        other = rng.dirichlet(np.ones(n))
        assert lo @ a @ lo <= other @ a @ other + 1e-6
    order = rng.permutation(n)
    assert np.allclose(linalg.gmvp(a[np.ix_(order, order)]), w[order])
    assert np.allclose(linalg.log_euclidean_mean(np.stack([a, a]), np.array([0.3, 0.7])), a)


def test_simplex_projection():
    rng = np.random.default_rng(0)
    for _ in range(50):
        p = linalg.simplex(rng.normal(size=6))
        assert p.min() >= 0 and np.isclose(p.sum(), 1)
    assert np.allclose(linalg.simplex(np.array([0.2, 0.8])), [0.2, 0.8])


def test_covariance_with_gaps():
    rng = np.random.default_rng(42)
    x = rng.normal(size=(100, 5)) * 0.01
    x[rng.random(x.shape) < 0.2] = np.nan
    s = embed.covariance(x)
    assert s.shape == (5, 5) and np.isfinite(s).all() and np.allclose(s, s.T) and np.linalg.eigvalsh(s).min() > 0
    x = rng.normal(size=(60, 100))
    tenth, half, assets = x.copy(), x.copy(), x.copy()
    tenth[rng.random(x.shape) < 0.1] = np.nan
    half[rng.random(x.shape) < 0.5] = np.nan
    assets[:, :30] = np.nan
    assert embed.valid(tenth) and not embed.valid(half) and not embed.valid(assets) and not embed.valid(np.empty((0, 3)))


@pytest.mark.parametrize("name", CLUSTERERS)
def test_clusterers_tell_groups_apart(name):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.3, size=(40, 3)) for c in ((0, 0, 9), (9, 0, 0), (0, 9, 0))])
    options = {"spectral_rbf": {"gamma": 0.1}}.get(name, {})
    c = clusterer(name, 3, **options)
    p = c.fit(x)
    assert np.allclose(p.sum(1), 1) and p.min() > 0 and np.allclose(c.predict(x), p)
    if name not in ("modified_two_stage", "signed_knn_spectral"):
        label = p.argmax(1)
        assert all(len(set(label[k : k + 40])) == 1 for k in (0, 40, 80)) and len(set(label)) == 3
    assert np.allclose(clusterer(name, 3, **options).fit(x), p)


def test_clusterer_errors():
    for name in UNSUPPORTED:
        with pytest.raises(NotImplementedError):
            clusterer(name, 3)
    with pytest.raises(ValueError):
        clusterer("nothing", 3)
    with pytest.raises(ValueError):
        clusterer("modified_two_stage", 1)
    with pytest.raises(ValueError):
        clusterer("agglomerative_ward", 5).fit(np.zeros((3, 2)))
    assert len(kmeans(np.zeros((4, 2)), 2)[0]) == 2


def test_embedders():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) * 0.01
    x[3, 2] = np.nan
    assert embed.VolStats().embed(x).shape == (10,) and embed.CorrEigen(4).embed(x).shape == (4,) and not embed.CorrEigen(9).embed(x).any()
    assert embed.HybridState(5).embed(x).shape == (23,) and np.isfinite(embed.HybridState(8).embed(x)).all()
    windows = rng.normal(size=(30, 40, 6))
    e = embed.PcaWindow(4).fit(windows)
    assert e.embed(windows[0]).shape == (20,) and np.allclose(e.axes.T @ e.axes, np.eye(4), atol=1e-8)
    tall = embed.PcaWindow(3).fit(rng.normal(size=(200, 5, 3)))
    assert np.allclose(tall.axes.T @ tall.axes, np.eye(3), atol=1e-8)


def test_p_values():
    assert math.isclose(stats.t_pvalue(2.228138852, 10), 0.05, rel_tol=1e-6) and math.isclose(stats.t_pvalue(0.0, 5), 1.0)
    assert math.isclose(stats.t_pvalue(1.812461123, 10, "greater"), 0.05, rel_tol=1e-6) and math.isclose(stats.t_pvalue(-1.812461123, 10, "less"), 0.05, rel_tol=1e-6)
    assert stats.wilcoxon_pvalue(0, 5) == 2 / 32 and stats.wilcoxon_pvalue(8, 10) == pytest.approx(0.048828125) and stats.wilcoxon_pvalue(0, 0) == 1
    assert stats.wilcoxon_pvalue(800, 60) == pytest.approx(0.396, abs=5e-3)


def test_metric_names():
    with pytest.raises(ValueError):
        metric("nothing")
    with pytest.raises(ValueError):
        lp(0)
    assert metric("Manhattan") is metric("l1") and metric("l_inf") is metric("chebyshev")
    assert walkforward.distances(np.array([[0.0, 3.0], [4.0, 0.0]]), np.zeros(2), "l2").tolist() == [3, 4]
    assert walkforward.distances(np.array([[0.0, 1.0]]), np.array([1.0, 0.0]), "angular")[0] == pytest.approx(math.pi / 2)


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("a: {b: 1, c: 2}\nd: [1]\n")
    tree = config.merged(config.load(str(tmp_path / "a.yaml")), config.overrides(["a.b=3", "x.y=none", "z=[1, 2]", f"q=@{tmp_path}/a.yaml"]))
    assert tree["a"] == {"b": 3, "c": 2} and tree["x"] == {"y": None} and tree["z"] == [1, 2] and tree["q"]["d"] == [1] and config.get(tree, "a.e", 7) == 7
    with pytest.raises(ValueError):
        config.overrides(["nothing"])


SMALL = backtest.Config(lookback=20, horizon=5, embedder="vol_stats", embed_options={}, n_regimes=2, k_neighbors=4, gap=2, sample_stride=2, refit=30, burn_in=60, min_samples=10, stride=10)


def prices(seed=0, n=220, assets=4):
    return np.random.default_rng(seed).normal(size=(n, assets)) * 0.01


@pytest.mark.parametrize("target", ["cov", "precision", "corr", "vol"])
def test_forecasts_look_back_only(target):
    c = dataclasses.replace(SMALL, target=target)
    r = prices()
    one, alpha = backtest.Forecaster(c).fit(r[:151]).predict(r[:181], 180)
    changed = r.copy()
    changed[181:] = 9
    two, _ = backtest.Forecaster(c).fit(changed[:151]).predict(changed, 180)
    assert np.allclose(one, two) and np.isclose(alpha.sum(), 1)
    if target != "vol":
        assert np.linalg.eigvalsh(one).min() > 0


def test_schedule_and_grid():
    plan = backtest.schedule(220, SMALL)
    assert plan[0] == (85, 85) and all(a - f < SMALL.refit and f <= a for a, f in plan) and plan[-1][0] <= 214
    assert len(backtest.grid(SMALL, {"tau": [1.0, 2.0], "x": [{"metric": "l1"}, {"metric": "l2", "k_neighbors": 3}]})) == 4
    assert len(backtest.one_at_a_time(SMALL, {"tau": [1.0, 2.0], "metric": ["l1"]})) == 3
    first, step, number = walkforward.starts(SMALL, 220)
    assert sorted({f for _, f in plan}) == [first + step * k for k in range(number)] and walkforward.starts(SMALL, 60)[2] == 0
