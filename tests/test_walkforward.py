"""The walk-forward tables against a plain loop over refit dates and anchors."""

import dataclasses
import math

import numpy as np
import pytest
from test_numerics import SMALL, prices
from test_operators import panel_of

from tidewind.operators import embed
from tidewind.plans import backtest, walkforward


def looped(r, c):
    """(anchor, method, metric): value, with a fit for each refit date."""
    out, fits = {}, {}
    ok = lambda x: embed.valid(x, c.max_na, c.min_assets, c.min_dates)
    for a, refit in backtest.schedule(len(r), c):
        if refit not in fits:
            try:
                fits[refit] = backtest.Forecaster(c).fit(r[: refit + 1])
            except ValueError:
                fits[refit] = None
        past, ahead = r[a - c.lookback + 1 : a + 1], r[a + 1 : a + 1 + c.horizon]
        if fits[refit] is None or not ok(past) or not ok(ahead):
            continue
        try:
            model, alpha = fits[refit].predict(r, a)
        except ValueError:
            continue
        rows = walkforward.model_rows(c, model, alpha, past, ahead) + walkforward.baseline_rows(c, past, ahead)
        out |= {(a, method, metric): v for method, metric, v in rows if not metric.startswith("w_")}
    return out


def gapped(seed=0, n=220, assets=4):
    r = prices(seed, n, assets)
    r[np.random.default_rng(9).random(r.shape) < 0.1] = np.nan
    r[100:112] = np.nan  # no window that holds these dates is valid
    return r


CONFIGS = {
    "pca": dataclasses.replace(SMALL, embedder="pca", embed_options={"k": 3}, clusterer="fuzzy_cmeans"),
    "vol": dataclasses.replace(SMALL, target="vol", clusterer="gmm", metric="l2"),
    "mean": dataclasses.replace(SMALL, aggregator="mean", transition="hard", alpha_source="pi", metric="cosine", strict=True),
    "precision": dataclasses.replace(SMALL, target="precision", embedder="corr_eigen", embed_options={"k": 3}, gmvp_shrink_blend=0.5, long_only=True),
}


@pytest.mark.parametrize("name", list(CONFIGS))
def test_runs_are_the_loop(spark, name):
    r, c = gapped(), CONFIGS[name]
    got = {(x.anchor, x.method, x.metric): x.value for x in backtest.run(panel_of(spark, r), c).collect() if x.metric != "gmvp_turnover"}
    want = looped(r, c)
    assert set(got) == set(want) and len({a for a, _, _ in got}) > 3
    for key, v in want.items():
        assert math.isnan(v) and got[key] is None or got[key] == pytest.approx(v, rel=1e-6, abs=1e-9), key


def test_runs_share_their_fits(spark):
    grid = backtest.grid(SMALL, {"metric": ["l1", "l2"], "tau": [1.0, 2.0]})
    assert len(walkforward.by(grid, walkforward.fit_key)) == 1 and len(walkforward.by(grid | {"k": dataclasses.replace(SMALL, n_regimes=3)}, walkforward.fit_key)) == 2
    r = prices()
    rows = backtest.runs(panel_of(spark, r), grid | {"k": dataclasses.replace(SMALL, n_regimes=3), "shrunk": dataclasses.replace(SMALL, shrink_gamma=0.9)}).collect()
    for name, c in {"metric=l2,tau=1.0": dataclasses.replace(SMALL, metric="l2", tau=1.0), "k": dataclasses.replace(SMALL, n_regimes=3), "shrunk": dataclasses.replace(SMALL, shrink_gamma=0.9)}.items():
        got = {(x.anchor, x.method, x.metric): x.value for x in rows if x.run == name and x.metric != "gmvp_turnover"}
        want = looped(r, c)
        assert set(got) == set(want) and all(got[k] == pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in want.items())


def test_backtest_has_the_whole_bundle(spark):
    got = {(x.method, x.metric): x.value for x in backtest.runs(panel_of(spark, prices()), {"a": SMALL}).collect() if x.anchor == 105}
    for method in ("model", "mix", "roll", "pers", "shrink"):
        assert {"fro", "kl", "stein", "logeuc", "eig_mse", "cond_ratio", "corr_offdiag", "corr_spearman", "nll", "gmvp_sharpe", "gmvp_var"} <= {k for m, k in got if m == method}
    r = prices()
    c = dataclasses.replace(SMALL, gmvp_shrink_blend=1.0, diag_shrink=0.0)
    rows = {(m, k): v for m, k, v in walkforward.model_rows(c, np.cov(r[:50].T), np.array([0.5, 0.5]), r[60:80], r[80:85]) + walkforward.baseline_rows(c, r[60:80], r[80:85])}
    assert rows["model", "fro"] != rows["shrink", "fro"] and rows["model", "w_0"] == pytest.approx(rows["shrink", "w_0"])


def test_panels_with_holes_are_refused(spark):
    panel = panel_of(spark, prices(n=60))
    with pytest.raises(ValueError, match="not dense"):
        walkforward.days(panel.where("t <> 7"))
    with pytest.raises(ValueError, match="not dense"):
        walkforward.days(panel.where("t <> 7 OR asset <> 'a1'"))
    assert backtest.run(panel_of(spark, prices(n=40)), SMALL).count() == 0


def test_axes_of_a_view_are_those_of_the_stack():
    """The smaller Gram matrix is taken part by part; against the decomposition of all windows at once."""
    rng = np.random.default_rng(0)
    for dates, assets, length in ((700, 3, 5), (40, 7, 9)):
        r = rng.normal(size=(dates, assets))
        every = np.moveaxis(np.lib.stride_tricks.sliding_window_view(r, length, axis=0), 2, 1)
        rows = np.arange(0, len(every), 2)
        made = embed.PcaWindow(4).fit(every, rows)
        flat = embed.PcaWindow._flat(every[rows])
        z = (flat - flat.mean(0)) / flat.std(0)
        _, _, vt = np.linalg.svd(z, full_matrices=False)
        assert np.allclose(np.abs(np.sum(vt[:4] * made.axes.T, axis=1)), 1, atol=1e-8)
        assert np.allclose(np.abs(made.coordinates(every, rows)), np.abs(z @ vt[:4].T), atol=1e-8)
