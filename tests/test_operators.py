"""DataFrame operators on small tables."""

import datetime as dt
import gzip
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewind.operators import analytics, clean, knn, panel, regime, windows
from tidewind.plans import backtest, walkforward
from tidewind.sources import archives, panels
from tidewind.streaming.regimes import filter_stream, panel_stream


def panel_of(spark, r):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(t), t, f"a{j}", None if np.isnan(x) else float(x)) for t, row in enumerate(r) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "date date, t int, asset string, r double")


def test_windows_against_numpy(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(size=(60, 3))
    r[rng.random(r.shape) < 0.2] = np.nan
    from tidewind.operators import embed

    past = windows.past(panel_of(spark, r), 20, 7, 54)
    got = {(x.anchor, x.i, x.j): x.v for x in windows.covariance(past).collect()}
    assert sorted({a for a, _, _ in got}) == list(range(19, 55, 7))
    for a in range(19, 55, 7):
        s = embed.covariance(r[a - 19 : a + 1])
        assert all(abs(got[a, f"a{i}", f"a{j}"] - s[i, j]) < 1e-12 for i in range(3) for j in range(3))
    stats = {x.anchor: x for x in windows.vol_statistics(past).collect()}
    assert np.allclose(list(stats[26])[1:], embed.VolStats().embed(r[7:27]))
    ahead = windows.future(panel_of(spark, r), 20, 5, 7, 54)
    assert {(x.anchor, x.t) for x in ahead.select("anchor", "t").collect()} == {(a, a + k) for a in range(19, 55, 7) for k in range(1, 6)}


def test_cleaning_policies(spark):
    p = panel_of(spark, np.array([[0.1, 2.0], [np.nan, 0.2], [0.4, -0.4]]))
    flags = clean.date_flags(p)
    assert {x.date.day for x in flags.where("flagged").collect()} == {1}
    values = lambda policy: [x.r for x in clean.apply_policy(p, flags, policy).orderBy("t", "asset").collect()]
    assert values("drop_date")[:2] == [None, None] and values("winsorize_date")[:2] == [0.1, 0.3] and values("drop_ticker_values")[:2] == [0.1, None] and values("drop_date")[2:] == [None, 0.2, 0.4, -0.4]
    with pytest.raises(ValueError):
        clean.apply_policy(p, flags, "nothing")


def test_neighbours_are_all_of_brute_force(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(60, 5))
    z[7] = z[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "id long, z array<double>")
    for name in ("l1", "l2", "chebyshev", "cosine", "angular"):
        got = knn.neighbours(df.where("id % 10 = 0"), df, 4, name).orderBy("q", "rank").collect()
        for q in range(0, 60, 10):
            d = walkforward.distances(z, z[q], name)
            order = [i for i in np.lexsort((np.arange(60), np.round(d, 12))) if i != q][:4]
            assert [x.id for x in got if x.q == q] == order
    assert knn.eligible(knn.neighbours(df.where("id = 5"), df, 20), 4, 20, 10).count() == 0


def test_filter_and_stream_agree(spark, tmp_path):
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(3), 40)
    a = [[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.3, 0.4]]
    rows = spark.createDataFrame([(0, t, x.tolist()) for t, x in enumerate(p)], "series int, anchor int, p array<double>")
    whole = {x.anchor: x.alpha for x in regime.forward_filter(rows, a).collect()}
    now = p[0]
    for t in range(1, 40):
        now = now @ np.array(a) * p[t]
        now = now / now.sum()
        assert np.allclose(whole[t], now)
    for k in (0, 20):
        rows.where(f"anchor >= {k} AND anchor < {k + 20}").coalesce(1).write.parquet(str(tmp_path / f"in/{k:02d}"))
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = filter_stream(feed, a).writeStream.format("memory").queryName("filtered").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {x.anchor: x.alpha for x in spark.table("filtered").collect()}
    assert len(got) == 40 and all(np.allclose(got[t], whole[t]) for t in got)


def test_panel_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    feed = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = panel_stream(feed).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hours").count() == events.select(F.date_trunc("hour", "ts"), "event_type").distinct().count()


def test_as_of_is_strictly_before(spark):
    alpha = spark.createDataFrame([(2, [1.0]), (5, [2.0])], "anchor int, alpha array<double>")
    got = {x.anchor: x.alpha for x in regime.as_of(spark.createDataFrame([(2,), (3,), (5,), (6,)], "anchor int"), alpha).collect()}
    assert got == {2: None, 3: [1.0], 5: [1.0], 6: [2.0]}


def test_pareto_keeps_equal_runs(spark):
    runs = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 0.5, 2.0), ("d", 2.0, 3.0)], "run string, up double, down double")
    assert {x.run for x in analytics.pareto(runs, ["up"], ["down"]).collect()} == {"a", "b", "d"}


def test_backtest_rows(spark):
    from test_numerics import SMALL, prices

    rows = backtest.run(panel_of(spark, prices()), SMALL)
    got = {(x.anchor, x.method, x.metric): x.value for x in rows.collect()}
    assert {m for _, m, _ in got} == {"model", "mix", "roll", "pers", "shrink"} and {a for a, _, _ in got} == {a for a, _ in backtest.schedule(220, SMALL)}
    assert all(abs(got[a, m, "stein"] - 2 * got[a, m, "kl"]) < 1e-6 for a, m, k in got if k == "kl") and (85, "roll", "gmvp_turnover") not in got and (95, "roll", "gmvp_turnover") in got
    assert backtest.run(panel_of(spark, prices(n=40)), SMALL).count() == 0


def test_readers(spark, tmp_path):
    x = spark.createDataFrame([("X20200102",), ("2020-01-03",), ("20200104",), ("no",)], "x string")
    assert [r[0] for r in x.select(panels.parse_date(F.col("x")).cast("string")).collect()] == ["2020-01-02", "2020-01-03", "2020-01-04", None]
    e = spark.createDataFrame([(1577836800,), (1577836800000,), (1577836800000000,), (5,)], "x long")
    assert [r[0] for r in e.select(panels.epoch_date(F.col("x")).cast("string")).collect()] == ["2020-01-01"] * 3 + [None]
    spark.createDataFrame([("2020-01-01", 0.1, float("nan")), ("2020-01-02", float("inf"), 0.2)], "date string, a double, b double").write.parquet(str(tmp_path / "wide"))
    got = {(r.t, r.asset): r.r for r in panels.read_wide(spark, str(tmp_path / "wide")).collect()}
    assert got == {(0, "a"): 0.1, (0, "b"): None, (1, "a"): None, (1, "b"): 0.2}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    with zipfile.ZipFile(tmp_path / "m" / "y.zip", "w") as z:
        z.writestr("in.csv", "a,b\n3,4\n")
    assert sorted(tuple(r.fields) for r in panels.read_matrix(spark, str(tmp_path / "m" / "*")).where("line = 1").collect()) == [("1", "2"), ("3", "4")]


def test_daily_files(spark, tmp_path):
    (tmp_path / "20200102.csv").write_text("ticker,pvCLCL\n A ,0.1\nA,0.2\nB,x\n,5\n")
    got = panels.read_daily_csv(spark, str(tmp_path / "*.csv")).collect()
    assert [(str(r.date), r.asset, r.value) for r in got] == [("2020-01-02", "A", 0.2)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "ABC__minutes.zip", "w") as z:
        z.writestr("ABC/2020-01-02.csv", "timestamp,close\n1,5\n2,6\n")
        z.writestr("ABC/20200103.csv", "timestamp,bid_1,ask_1\n1,5,7\n")
        z.writestr("ABC/notes.txt", "x")
    got = archives.daily_closes(spark, str(tmp_path / "*.zip")).orderBy("date").collect()
    assert [(str(r.date), r.asset, r.close) for r in got] == [("2020-01-02", "ABC", 6.0), ("2020-01-03", "ABC", 6.0)]
    assert archives.inventory(spark, str(tmp_path / "*")).first().n == 1 and archives.synthetic_panel(spark, 50, 3).count() == 150
    with pytest.raises(RuntimeError, match="7z"):
        list(archives.members("x.7z", b"7z\xbc\xaf\x27\x1c"))


def test_missing_report(spark):
    p = panel_of(spark, np.array([[0.1, np.nan], [0.2, np.nan]]))
    assert panel.dense_assets(p).select("asset").distinct().count() == 1 and {r.asset: r.missing for r in panel.na_report(p, "asset").collect()} == {"a0": 0.0, "a1": 1.0}
