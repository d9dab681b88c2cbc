"""Scans in blocks against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewind.operators import regime, scan


def looped(p, a, alpha0=None):
    out = []
    for x in p:
        if not out:
            now = np.asarray(x if alpha0 is None else np.asarray(alpha0) / sum(alpha0), float)
        else:
            q = (out[-1] @ a) * x
            now = q / q.sum() if q.sum() > 1e-12 else x
        out.append(now)
    return out


def series_rows(spark, series):
    rows = [(name, int(t), p.tolist()) for name, own in series.items() for t, p in own]
    return spark.createDataFrame(rows, "series string, anchor int, p array<double>").repartition(5)


@pytest.mark.parametrize("alpha0", [None, [0.7, 0.2, 0.1]])
def test_filter_in_blocks_of_seven(spark, alpha0):
    rng = np.random.default_rng(1)
    a = rng.dirichlet(np.ones(3), 3)
    series = {"long": [(t, p) for t, p in enumerate(rng.dirichlet(np.full(3, 0.05), 400))], "sparse": [(t * 31, p) for t, p in enumerate(rng.dirichlet(np.ones(3), 50))], "one": [(5, np.array([0.2, 0.3, 0.5]))]}
    got = {(r.series, r.anchor): r.alpha for r in regime.forward_filter(series_rows(spark, series), a.tolist(), alpha0, size=7).collect()}
    for name, own in series.items():
        for (t, _), alpha in zip(own, looped([p for _, p in own], a, alpha0), strict=True):
            assert np.allclose(got.pop((name, t)), alpha, atol=1e-12)
    assert not got


def test_filter_starts_anew_where_the_mass_is_lost(spark):
    """Regimes that can't follow each other: whether a step loses the mass depends on what came blocks before."""
    rng = np.random.default_rng(3)
    a = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.5, 0.5]])
    rows = [(t, np.eye(3)[rng.integers(3)] if rng.random() < 0.15 else rng.dirichlet(np.ones(3))) for t in range(200)]
    got = {r.anchor: r.alpha for r in regime.forward_filter(series_rows(spark, {"x": rows}).drop("series"), a.tolist(), size=7).collect()}
    want = looped([p for _, p in rows], a)
    assert sum((x == p).all() for x, (_, p) in zip(want[1:], rows[1:], strict=True)) > 3
    assert all(np.allclose(got[t], want[t], atol=1e-12) for t in range(200))


def test_latest_before_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(s, int(t), float(t) if rng.random() < 0.03 else None) for s in "ab" for t in sorted(rng.choice(2000, 300, replace=False))]
    df = spark.createDataFrame(rows, "series string, anchor int, v double").repartition(3)
    got = {(r.series, r.anchor): r.last for r in scan.latest_before(df, "v", "last", ["series"], size=7).collect()}
    for s in "ab":
        last = None
        for _, t, v in (r for r in rows if r[0] == s):
            assert got[s, t] == last
            last = v if v is not None else last
    assert [c for c in scan.latest_before(df, "v", "last", [], F.col("series"), size=7).columns] == ["series", "anchor", "v", "last"]


def test_steps_and_as_of_cross_blocks(spark):
    states = spark.createDataFrame([(t, t % 2) for t in range(50)], "anchor int, state int")
    assert sorted(tuple(r) for r in regime.steps(states, "state", size=7).groupBy("b", "a").count().collect()) == [(0, 1, 25), (1, 0, 24)]
    alpha = spark.createDataFrame([(t, [float(t)]) for t in range(0, 100, 40)], "anchor int, alpha array<double>")
    asked = spark.createDataFrame([(t,) for t in range(100)], "anchor int")
    got = {r.anchor: r.alpha for r in regime.as_of(asked, alpha, size=7).collect()}
    assert got == {t: None if t == 0 else [float((t - 1) // 40 * 40)] for t in range(100)}
