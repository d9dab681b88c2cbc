"""Memberships by hour: one pass over events, without a grid, and numbers made in blocks."""

import datetime

from pyspark.sql import functions as F

from tidewind.operators import scan
from tidewind.plans import forecasts
from tidewind.sources import panels


def test_hours_of_no_time_come_last_and_count_as_in_the_sql(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=5)
    rows = [(at(0), "click", 3.0), (at(2), "view", 5.0), (at(9000), "signup", 2.0), (at(9000), "other", 7.0), (None, "click", 4.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.anchor: [round(x, 9) for x in r.p] for r in forecasts.memberships(spark, str(tmp_path)).collect()}
    third = [round(1 / 3, 9)] * 3
    assert got == {0: [0.6, 0.2, 0.2], 1: [round(x / 7, 9) for x in (1, 5, 1)], 2: [0.25, 0.25, 0.5], 3: third}


def test_places_in_blocks_are_those_of_one_order(spark, monkeypatch):
    monkeypatch.setattr(panels, "STEPS", 4)
    hours = [0, 1, 3, 4, 17, 18, 19, 40]
    df = spark.createDataFrame([(datetime.datetime(1969, 12, 31, 20) + datetime.timedelta(hours=h), h) for h in reversed(hours)], "date timestamp, h int")
    assert {r.h: r.t for r in panels.placed(df, 3600).collect()} == {h: k for k, h in enumerate(hours)}


def test_no_table_of_hours_is_sent_to_the_driver(spark, sf, monkeypatch):
    monkeypatch.setattr(scan, "SIZE", 64)
    p = forecasts.memberships(spark, sf)
    for df in (p, scan.latest_before(p, "p", "before", []), scan.forward_filter(p.withColumn("series", F.lit(0)), [[0.5, 0.5, 0.2], [0.3, 0.3, 0.4], [0.2, 0.3, 0.5]])):
        plan = df._jdf.queryExecution().toString()
        assert "Broadcast" not in plan and "Cartesian" not in plan
