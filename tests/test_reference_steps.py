"""Steps of the reference against plain formulas: embeddings, clusterers, hold statistics, series, sources."""

import datetime as dt
import itertools
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_numerics import spd
from test_operators import panel_of

from tidewind.functions.vectors import canonical
from tidewind.operators import analytics, cluster, embed, linalg, portfolio, regime, windows
from tidewind.plans import backtest, walkforward
from tidewind.sources import archives, panels, paths


def test_hybrid_embedding_by_its_formulas():
    x = np.random.default_rng(4).normal(size=(30, 4)) * 0.02
    k, eps = 3, 1e-12
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    share = s**2 / (s**2).sum()
    vol = x.std(0, ddof=1)
    auto = np.array([np.corrcoef(x[:-1, j], x[1:, j])[0, 1] for j in range(4)])
    c = np.corrcoef(x.T)
    w = np.linalg.eigvalsh(c)
    expected = [*np.log(s[:k] + eps), *share[:k], -(share * np.log(share)).sum(), vol.mean(), vol.std(ddof=1), *np.quantile(vol, [0.25, 0.5, 0.75]), auto.mean(), auto.std(ddof=1), (c.sum() - 4) / 12, w[-1], w[-1] - w[-2], np.abs(x).mean(), np.abs(x).std(ddof=1)]
    assert np.allclose(embed.HybridState(k).embed(x), expected, atol=1e-8)


def test_pca_window_scores_over_time():
    rng = np.random.default_rng(5)
    e = embed.PcaWindow(3).fit(rng.normal(size=(40, 20, 5)))
    x = rng.normal(size=(20, 5))
    got = e.embed(x)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    scores = (u * s)[:, :3]
    assert np.allclose(got[9:12], 0, atol=1e-12) and np.allclose(got[12:], scores.std(0, ddof=1)) and np.allclose(got[3:6], (s**2 / (s**2).sum())[:3])
    flat = lambda w: (w - w.mean(-2, keepdims=True)).reshape(len(w), -1)
    # principal coordinates, up to their signs, by a decomposition of the standardised windows
    rows = flat(rng.normal(size=(25, 20, 5)))
    e = embed.PcaWindow(3).fit(rows.reshape(25, 20, 5))
    z = (rows - rows.mean(0)) / rows.std(0)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(e.embed(rows[0].reshape(20, 5))[:3]), np.abs(z[0] @ v[:3].T))


def test_ward_joins_what_grows_the_variance_least():
    rng = np.random.default_rng(3)
    for _ in range(5):
        x = rng.normal(size=(12, 2))
        groups = [[i] for i in range(12)]
        spread = lambda g: ((x[g] - x[g].mean(0)) ** 2).sum()
        while len(groups) > 3:
            a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: spread(groups[p[0]] + groups[p[1]]) - spread(groups[p[0]]) - spread(groups[p[1]]))
            groups[a] += groups.pop(b)
        label = cluster.Ward(3).labels(x)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(label == k).tolist()) for k in range(3)}


def test_signed_graph_takes_the_largest_cosines(monkeypatch):
    x = np.random.default_rng(6).normal(size=(12, 3))
    seen = []
    monkeypatch.setattr(cluster, "_embedded", lambda lap, k: seen.append((lap, k)) or np.linalg.eigh(lap)[1][:, :k])
    cluster.SignedKnnSpectral(3, n=4).labels(x)
    cos = np.array([[a @ b / np.linalg.norm(a) / np.linalg.norm(b) for b in x] for a in x])
    s = np.zeros((12, 12))
    for i in range(12):
        for j in sorted((j for j in range(12) if j != i), key=lambda j: -cos[i, j])[:4]:
            s[i, j] += cos[i, j] / 2
            s[j, i] += cos[i, j] / 2
    assert np.allclose(seen[0][0], np.diag(np.abs(s).sum(1)) - s) and seen[0][1] == 3
    cluster.SignedKnnSpectral(2, n=1).labels(x[:4])
    assert (np.abs(seen[1][0] - np.diag(np.diag(seen[1][0]))) > 0).sum(1).min() >= 2  # two neighbours at least


def test_hold_stats_of_few_days(spark):
    ahead = spark.createDataFrame([(1, t, a, r) for t, rs in enumerate(((0.1, None), (0.2, 0.1))) for a, r in zip("xy", rs, strict=True)] + [(2, t, a, 0.1) for t in (0, 1) for a in "xy"] + [(3, 0, a, None) for a in "xy"], "anchor int, t int, asset string, r double")
    w = spark.createDataFrame([(k, "m", a, 0.5) for k in (1, 2, 3) for a in "xy"], "anchor int, method string, asset string, w double")
    got = {r.anchor: r for r in portfolio.hold_stats(w, ahead, 2).collect()}
    assert got[1].days == 1 and got[1]["var"] == 0 and got[1].sharpe is None and got[1].cumret == pytest.approx(0.15)
    assert got[2].days == 2 and got[2].vol == 0 and got[2].sharpe is None and got[3].days == 0 and got[3].cumret is None and got[3]["var"] is None


def test_series_are_not_chained(spark):
    rows = [("a", 0, 0), ("a", 1, 0), ("b", 0, 1), ("b", 1, 1)]
    states = spark.createDataFrame(rows, "series string, anchor int, state int")
    got = {(r.i, r.j): r.a for r in regime.transition_hard(states, 2, 0.0).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 1.0}
    alpha = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [2.0])], "series string, anchor int, alpha array<double>")
    asked = spark.createDataFrame([("a", 3), ("b", 2)], "series string, anchor int")
    assert {(r.series, r.anchor): r.alpha for r in regime.as_of(asked, alpha).collect()} == {("a", 3): [1.0], ("b", 2): None}


def test_three_windows_in_one_pass(spark):
    r = np.random.default_rng(0).normal(size=(50, 3))
    r[np.random.default_rng(1).random(r.shape) < 0.15] = np.nan
    p = panel_of(spark, r)
    got = {(x.anchor, x.i, x.j): (x.roll, x.pers, x.truth) for x in windows.kind_covariances(p, 20, 5, 7, 44).collect()}
    vols = {(x.anchor, x.asset): (x.roll, x.pers, x.truth) for x in windows.kind_log_vols(p, 20, 5, 7, 44).collect()}
    assert {a for a, _, _ in got} == set(range(19, 45, 7))
    for a in range(19, 45, 7):
        parts = [embed.covariance(x) for x in (r[a - 19 : a + 1], r[a - 4 : a + 1], r[a + 1 : a + 6])]
        for i, j in itertools.product(range(3), repeat=2):
            assert np.allclose(got[a, f"a{i}", f"a{j}"], [s[i, j] for s in parts])
        assert all(np.allclose(vols[a, f"a{i}"], [0.5 * math.log(s[i, i]) for s in parts]) for i in range(3))


def test_correlation_losses():
    rng = np.random.default_rng(2)
    a, b = spd(rng, 5), spd(rng, 5)
    ca, cb = (s / np.sqrt(np.outer(np.diag(s), np.diag(s))) for s in (a, b))
    off = ~np.eye(5, dtype=bool)
    x, y = (pd.Series(c[np.triu_indices(5, 1)]).rank() for c in (ca, cb))
    assert linalg.correlation_distance(a, b) == pytest.approx(np.linalg.norm((ca - cb)[off])) and linalg.correlation_spearman(a, b) == pytest.approx(x.corr(y))
    assert linalg.mean_ranks(np.array([3.0, 1.0, 3.0, 2.0])).tolist() == [3.5, 1, 3.5, 2] and math.isnan(linalg.correlation_spearman(np.eye(3), a[:3, :3]))


def test_regime_model():
    z = np.vstack([np.random.default_rng(0).normal(c, 0.1, size=(20, 2)) for c in (0, 5)])
    model = backtest.RegimeModel("gmm", 2)
    with pytest.raises(RuntimeError):
        model.predict(z)
    assert np.allclose(model.fit(z).pi, model.predict(z)) and model.predict(z[0]).shape == (1, 2)
    with pytest.raises(ValueError):
        canonical("nothing")
    assert canonical(" L_inf ") == "chebyshev" and canonical("euclidean") == "l2" and canonical("LP") == "lp"
    assert walkforward.distances(np.array([[0.0, 3.0]]), np.zeros(2), "infinity").tolist() == [3]


def test_columns_of_archives(spark, tmp_path):
    assert archives.close_column(["time", "adj close"]) == "adj close" and archives.close_column(["x", "my_last_price"]) == "my_last_price" and archives.close_column(["price"]) is None
    assert archives.quote_column(["bidsize_1", "best bid"], "bid_1", "bid") == "best bid" and archives.time_column(["stamp", "x"]) == "stamp" and archives.time_column([]) is None
    with zipfile.ZipFile(tmp_path / "ABC__x.zip", "w") as z:
        z.writestr("ABC/2020-01-02.csv", "Stamp, Adj Close\n1,5\n2,6.5\n")
        z.writestr("ABC/2020-01-03.csv", "t,Ask Price,Ask Size,Bid Price\n1,7,100,5\n")
        z.writestr("ABC/2020-01-06.csv", "t,ask,bid\n1,-7,5\n")
        z.writestr("ABC/2020-01-07.csv", "t,cl\n1,nan\n")
    got = archives.daily_closes(spark, str(tmp_path / "*.zip")).orderBy("date").collect()
    assert [(str(r.date), r.close) for r in got] == [("2020-01-02", 6.5), ("2020-01-03", 6.0)]
    seen = {r.column: (r.kind, r.role, r.first) for r in archives.sample_columns(spark, str(tmp_path / "*.zip")).collect()}
    assert seen == {"stamp": ("long", "time", ["1", "2"]), "adj close": ("double", "close", ["5", "6.5"])}


def test_synthetic_panel_has_outliers(spark):
    rows = archives.synthetic_panel(spark, 400, 30, latest=100).cache()
    out = rows.where("abs(r) = 6").count()
    assert rows.count() == 12_000 and 60 <= out <= 120 and rows.where("abs(r) > 0.2 AND abs(r) <> 6").count() == 0
    assert rows.where("r IS NULL").count() > 0.1 * 12_000 and rows.select("date").distinct().where("weekday(date) > 4").count() == 0


def test_first_matrix_that_loads(spark, tmp_path):
    wide = pd.DataFrame({"2020-01-02": [0.1, np.nan], "2020-01-03": [0.2, 0.3]}, index=pd.Index([" A ", "B"], name="ticker"))
    wide.to_parquet(tmp_path / "m.parquet")
    with zipfile.ZipFile(tmp_path / "m.parquet.zip", "w") as z:
        z.write(tmp_path / "m.parquet", "m.parquet")
    with zipfile.ZipFile(tmp_path / "m.csv.zip", "w") as z:
        z.writestr("m.csv", wide.to_csv())
    (tmp_path / "bad.zip").write_bytes(b"PKnothing")
    expected = {("2020-01-02", "A", 0.1), ("2020-01-02", "B", None), ("2020-01-03", "A", 0.2), ("2020-01-03", "B", 0.3)}
    for names in (["none.zip", "bad.zip", "m.parquet.zip"], ["m.csv.zip", "m.parquet.zip"]):
        got = panels.read_first_matrix(spark, [str(tmp_path / n) for n in names])
        assert {(str(r.date), r.asset, r.value) for r in got.collect()} == expected
    with pytest.raises(FileNotFoundError, match="none.zip"):
        panels.read_first_matrix(spark, [str(tmp_path / "none.zip")])


def test_files_in_and_out(spark, tmp_path):
    wide = [("2020-01-01", 0.1, 2.0), ("2020-01-02", 0.1, -0.2)]
    spark.createDataFrame(wide, "date string, a double, b double").write.parquet(str(tmp_path / "wide"))
    panel = panels.clean_file(spark, str(tmp_path / "wide"), str(tmp_path / "out"), str(tmp_path / "log"))
    assert {(r.asset, r.r) for r in panel.where("t = 0").collect()} == {("a", None), ("b", None)}
    assert [tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("date").collect()] == [(None, None), (0.1, -0.2)]
    assert [r.action for r in spark.read.option("header", True).csv(str(tmp_path / "log")).orderBy("date").collect()] == ["drop_date", "keep"]
    corner = panels.preview(panel, 1, 1)
    assert corner.columns == ["date", "a"] and corner.count() == 1
    chosen = spark.createDataFrame([("x", 2), ("y", 1), ("z", 3)], "asset string, place int")
    panels.write_universe(spark, chosen, str(tmp_path / "u"), 2, {"files": 3})
    assert [r.ticker for r in spark.read.option("header", True).csv(str(tmp_path / "u" / "universe_2")).collect()] == ["y", "x"] and "files: 3" in panels.read_text(spark, str(tmp_path / "u" / "universe_summary"))
    rows = spark.createDataFrame([(dt.date(2020, 1, 1), "m", 1.0)], "date date, method string, value double")
    panels.write_backtest(rows, rows, str(tmp_path / "b"), {"target": "cov", "mix": {"model": 0.5}}, {"n": 1})
    import yaml

    assert yaml.safe_load(panels.read_text(spark, str(tmp_path / "b" / "config_used.yaml"))) == {"target": "cov", "mix": {"model": 0.5}}
    assert panels.read_backtest(spark, str(tmp_path / "b" / "backtest.parquet")).count() == 1
    (tmp_path / "c").mkdir()
    rows.write.option("header", True).csv(str(tmp_path / "c" / "backtest_csv"))
    assert panels.read_backtest(spark, str(tmp_path / "c" / "backtest.parquet")).count() == 1
    (tmp_path / "d.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        panels.read_backtest(spark, str(tmp_path / "d.parquet")).count()
    assert panels.row_of(rows, method="m").count() == 1
    with pytest.raises(LookupError):
        panels.row_of(rows, method="n")


def test_places_of_results(spark, tmp_path):
    root = str(tmp_path)
    assert paths.data_dir(root=root, env={}) == tmp_path / "data/raw/data_by_stocks"
    (tmp_path / "given").mkdir()
    assert paths.data_dir(str(tmp_path / "given"), root, {}) == tmp_path / "given" and paths.data_dir("nowhere", root, {paths.ENV: str(tmp_path / "given")}) == tmp_path / "given"
    assert paths.backtest_path(spark, root, "regime_covariance") == f"{root}/regime_covariance/backtest.parquet" and paths.report_path(spark, root, "x") == f"{root}/x_report.csv"
    (tmp_path / "regime_similarity_backtest.csv").write_text("a\n1\n")
    (tmp_path / "regime_similarity_report.csv").write_text("b\n")
    (tmp_path / "figs_regime_similarity").mkdir()
    (tmp_path / "figs_regime_similarity" / "f.csv").write_text("c\n")
    assert paths.backtest_path(spark, root, "regime_covariance").endswith("regime_similarity_backtest.csv") and paths.figures_dir(spark, root, "regime_covariance").endswith("figs_regime_similarity")
    copied = paths.migrate(spark, root, "regime_covariance")
    assert {p.removeprefix(root) for p in copied} == {"/regime_covariance/backtest.csv", "/regime_covariance/report.csv", "/regime_covariance/figs"}
    assert (tmp_path / "regime_covariance/figs/f.csv").read_text() == "c\n" and paths.migrate(spark, root, "regime_covariance") == []


def test_density_and_blend_are_counted(spark):
    from tidewind.operators import analytics

    rows = spark.createDataFrame([(0.5, 0.2), (1.0, 0.9)], "lambda double, confidence double")
    assert tuple(analytics.blend_stats(rows).first()) == (50.0, 0.75, 0.5, pytest.approx(0.55), 2)
    assert {tuple(r) for r in analytics.reason_counts(spark.createDataFrame([("ratio",), (None,), ("ratio",)], "reason string")).collect()} == {("ratio", 2), ("", 1)}
    assert analytics.density(spark.createDataFrame([("m", float(k)) for k in range(20)], "method string, value double"), 11).count() == 11


def test_more_queries_than_one_block(spark, monkeypatch):
    from tidewind.operators import knn

    z = np.random.default_rng(0).normal(size=(40, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "id long, z array<double>")
    whole = {(r.q, r.id, r["rank"]) for r in knn.neighbours(df, df, 3).collect()}
    monkeypatch.setattr(knn, "BLOCK", 9)
    assert {(r.q, r.id, r["rank"]) for r in knn.neighbours(df, df, 3).collect()} == whole and len(whole) == 120


@pytest.mark.parametrize(("lookback", "horizon", "stride"), [(20, 5, 7), (20, 10, 5), (12, 4, 8), (7, 3, 2)])
def test_panes_make_the_covariances_of_all_windows(spark, lookback, horizon, stride):
    r = np.random.default_rng(lookback).normal(size=(60, 4)) + 5
    r[np.random.default_rng(1).random(r.shape) < 0.3] = np.nan
    r[:, 3] = np.nan  # an asset that has nothing
    p = panel_of(spark, r)
    got = {(x.anchor, x.i, x.j): (x.roll, x.pers, x.truth) for x in windows.kind_covariances(p, lookback, horizon, stride, 59 - horizon).collect()}
    one = {(x.anchor, x.i, x.j): x.v for x in windows.rolling_covariance(p, lookback, stride, 59 - horizon).collect()}
    anchors = range(lookback - 1, 60 - horizon, stride)
    assert len(got) == len(one) == 16 * len(anchors)
    for a in anchors:
        parts = [embed.covariance(x) for x in (r[a - lookback + 1 : a + 1], r[a - horizon + 1 : a + 1], r[a + 1 : a + 1 + horizon])]
        for i, j in itertools.product(range(4), repeat=2):
            assert np.allclose(got[a, f"a{i}", f"a{j}"], [s[i, j] for s in parts]) and np.allclose(one[a, f"a{i}", f"a{j}"], parts[0][i, j])


def test_dates_are_paired_once(spark):
    p = panel_of(spark, np.ones((30, 2)))
    plan = windows.rolling_covariance(p, 10, 1, 29)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan  # no row is repeated for the windows that it is in


def test_long_only_weights_take_the_stated_steps():
    """One matrix at a time, by the projection's definition: the level at which what is above it sums to 1."""

    def projected(v):
        low, high = v.min() - 1, v.max()
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.maximum(v - mid, 0).sum() > 1 else (low, mid)
        return np.maximum(v - high, 0)

    rng = np.random.default_rng(5)
    stack = np.stack([spd(rng, 6) * s for s in (1e-4, 1e-2, 1.0, 30.0)] * 3)
    got = linalg.gmvp_long_only(stack)
    for a, w in zip(stack, got, strict=True):
        s, x, last, step = a + 1e-8 * np.eye(6), np.full(6, 1 / 6), np.inf, 0.5
        for _ in range(500):
            new = projected(x - step * 2 * s @ x)
            value = new @ s @ new
            if abs(last - value) < 1e-10:
                x = new
                break
            if value > last:
                step /= 2
                if step < 1e-12:
                    break
            else:
                x, last = new, value
        assert np.allclose(w, x, atol=1e-7) and np.allclose(linalg.gmvp_long_only(a), w)
    # at daily variances the steps end before the optimum
    best = min((w for w in rng.dirichlet(np.ones(6), 20_000)), key=lambda w: w @ stack[0] @ w)
    assert got[0] @ stack[0] @ got[0] > best @ stack[0] @ best


def test_names_of_regimes(spark):
    rows = [(31.0, 2.0, 0.1, 0.0, 0.0), (30.0, 1.6, 0.4, 0.0, 0.06), (0.0, 0.4, 0.4, 0.03, 0.05), (0.0, 1.0, 0.9, 0.03, None), (0.0, 1.6, 0.9, 0.02, 0.0), (0.0, 1.0, 0.6, 0.02, 0.0), (0.0, None, None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, crisis_overlap double, mean_gmvp_sharpe double, mean_turnover double, mean_fro double, mean_vol_mse double")
    got = {r.k: (r.a, r.b) for r in df.select("k", analytics.regime_name().alias("a"), analytics.regime_name(vol=True).alias("b")).collect()}
    other = "Normal/Transition"
    assert [got[k][0] for k in range(7)] == ["Crisis/High Stress", "Calm Bull", "Stress/Low Sharpe", "High Uncertainty", "Volatile/Choppy", other, other]
    assert [got[k][1] for k in range(7)] == ["Crisis/High Stress", "High Vol MSE", other, other, other, other, other]
