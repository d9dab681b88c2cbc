"""Skylines and ranks against each row with each other row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewind.functions import stats
from tidewind.operators import analytics, ranks, skyline


def brute_front(x):
    return [k for k, a in enumerate(x) if not any((b >= a).all() and (b > a).any() for b in x)]


@pytest.mark.parametrize("kind", ["random", "against", "ties"])
def test_skyline_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    if kind == "against":  # nothing dominates anything
        x = np.column_stack([np.arange(400.0), -np.arange(400.0), rng.normal(size=400)])
    if kind == "ties":
        x = rng.integers(0, 4, size=(400, 3)).astype(float)
    rows = [(f"r{k}", float(a), float(-b), float(-c)) for k, (a, b, c) in enumerate(x)] + [("none", None, 1.0, 1.0), ("gap", 99.0, None, -99.0)]
    df = spark.createDataFrame(rows, "run string, a double, b double, c double").repartition(4)
    got = {r.run for r in skyline.skyline(df, ["a"], ["b", "c"], block=7 if kind != "against" else 90).collect()}
    assert got == {f"r{k}" for k in brute_front(x)} | {"none", "gap"}
    assert skyline.skyline(df.limit(0), ["a"], ["b"]).count() == 0
    if kind == "random":
        assert {r.run for r in analytics.pareto(df, ["a"], ["b"]).where("run <> 'none'").collect()} - {"gap"} == {f"r{k}" for k in brute_front(x[:, :2])}


def test_no_row_is_compared_with_all_others(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    plan = skyline.skyline(df, ["a"], ["b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Cross" not in plan


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_places_in_buckets(spark, buckets):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], 700), "v": np.round(rng.normal(size=700), 1)})
    df = spark.createDataFrame(frame).repartition(5)
    got = df.join(ranks.placed(df, ["g"], buckets=buckets).withColumn("rank", ranks.mean_rank()), ["g", "v"]).toPandas()
    want = frame.assign(rank=frame.groupby("g")["v"].rank(), before=frame.groupby("g")["v"].rank("min") - 1)
    assert sorted(zip(got["g"], got["v"], got["rank"], got["before"], strict=True)) == sorted(zip(want["g"], want["v"], want["rank"], want["before"], strict=True))
    medians = {r.g: r.m for r in ranks.medians(ranks.placed(df, ["g"], buckets=buckets), ["g"], "m").collect()}
    assert medians == pytest.approx(frame.groupby("g")["v"].median().to_dict())


def test_signed_ranks(spark):
    rng = np.random.default_rng(3)
    base, other = np.round(rng.normal(size=(2, 120)), 1)
    rows = [(k, "roll", float(b)) for k, b in enumerate(base)] + [(k, "model", float(o)) for k, o in enumerate(other)] + [(500, "model", 1.0), (501, "roll", None)]
    got = analytics.wilcoxon(spark.createDataFrame(rows, "date int, method string, value double"), "roll").first()
    d = pd.Series(base - other)
    away = d[d != 0]
    r = away.abs().rank()
    w = min(r[away > 0].sum(), r[away < 0].sum())
    sizes = away.abs().value_counts()
    assert (got.n, got.w, got.ties) == (len(away), pytest.approx(w), (sizes**3 - sizes).sum()) and got.median_advantage == pytest.approx(d.median())
    assert got.p == pytest.approx(stats.wilcoxon_pvalue(w, len(away), float((sizes**3 - sizes).sum())))


def test_marks_of_p_values(spark):
    df = spark.createDataFrame([(0.001,), (0.02,), (0.07,), (0.5,), (None,)], "p double")
    assert [r.s for r in df.select(analytics.stars(F.col("p")).alias("s")).collect()] == ["***", "**", "*", "", None]


def test_fronts_of_values_that_change_when_they_are_made_again(spark):
    def noisy(frames):
        rng = np.random.default_rng()
        for pdf in frames:
            yield pdf.assign(a=pdf["a"] + 1e-12 * rng.random(len(pdf)))

    df = spark.createDataFrame([(f"r{k}", float(k), float(k)) for k in range(50)], "run string, a double, b double").repartition(3).mapInPandas(noisy, "run string, a double, b double")
    assert {r.run for r in skyline.skyline(df, ["a"], ["b"]).collect()} == {f"r{k}" for k in range(50)}
