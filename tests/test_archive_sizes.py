"""Archives as their queries write them: work that grows with the rows, files written member by member."""

import inspect

from pyspark.sql import functions as F

from tidewind.plans import files
from tidewind.sources import archives


def test_quotes_of_a_day_are_made_in_one_pass():
    assert "array_min" not in inspect.getsource(files.ticks)  # once for each row of a day was quadratic


def test_members_of_several_assets_are_written_one_by_one(spark, tmp_path):
    rows = [(a, f"{a}/2020-01-0{k}.csv", f"timestamp,Close\n0,{k}.5\n") for a in ("AF", "NO") for k in range(1, 8)]
    df = spark.createDataFrame(rows, "asset string, member string, content string")
    folder = files._archived(df.repartition(5), str(tmp_path / "x"))
    found = archives.daily_closes(spark, f"{folder}/*.zip")
    assert sorted((r.asset, r.close) for r in found.collect()) == sorted((a, k + 0.5) for a in ("AF", "NO") for k in range(1, 8))
    heads = archives.sample_columns(spark, f"{folder}/*.zip", 1).where(F.col("column") == "close").collect()
    assert sorted((r.member, r["kind"], list(r["first"])) for r in heads) == [(f"{a}/2020-01-01.csv", "double", ["1.5"]) for a in ("AF", "NO")]
