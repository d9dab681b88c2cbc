"""Readers and writers of panels; a panel is long: date, t, asset and a value."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse_date(x: Column) -> Column:
    """Dates written as YYYY-MM-DD, YYYYMMDD or XYYYYMMDD; NULL for anything else."""
    x = F.regexp_replace(F.trim(x), "^X", "")
    return F.coalesce(F.try_to_date(x, "yyyy-MM-dd"), F.try_to_date(x, "yyyyMMdd"))


def epoch_date(x: Column, first: str = "2000-01-01") -> Column:
    """Date of an epoch number in s, ms, us or ns: the first unit that gives a date from first to today."""
    out = None
    for unit in (1, 1_000, 1_000_000, 1_000_000_000):
        seconds = F.floor(x / unit)
        d = F.to_date(F.timestamp_seconds(F.when(seconds.between(0, 4_102_444_800), seconds)))  # within this century's end
        ok = F.when(d.between(F.lit(first).cast("date"), F.current_date()), d)
        out = ok if out is None else F.coalesce(out, ok)
    return out


def read_wide(spark: SparkSession, path: str, date_col: str = "date") -> DataFrame:
    """A wide dates-by-assets parquet table, as a dense panel (date, t, asset, r)."""
    wide = spark.read.parquet(path)
    assets = [c for c in wide.columns if c != date_col]
    numbers = wide.select(F.col(f"`{date_col}`").cast("date").alias("date"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in assets])
    return indexed(numbers.unpivot(["date"], assets, "asset", "r").withColumn("r", finite(F.col("r"))))


def read_daily_csv(spark: SparkSession, glob: str, value: str = "pvCLCL") -> DataFrame:
    """Daily files YYYYMMDD.csv with ticker and value: date, asset, value; of an asset's rows in a file the last one that is a number counts."""
    rows = spark.read.option("header", True).csv(glob).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.select(
        F.try_to_date(F.regexp_extract("file", r"(\d{8})\.csv$", 1), "yyyyMMdd").alias("date"), F.trim("ticker").alias("asset"), F.expr(f"try_cast(`{value}` AS DOUBLE)").alias("value"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k")).alias("place"),
    ) if "ticker" in rows.columns else rows.limit(0)
    return rows.where("asset <> '' AND value IS NOT NULL AND date IS NOT NULL").groupBy("date", "asset").agg(F.max_by("value", "place").alias("value"))


def read_matrix(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """A matrix in CSV, gzipped or zipped (told by its first bytes; of an archive, the named member or its first CSV or parquet), as rows of line number and fields.

    A parquet member's rows are its index or first column and its values as text, under a line of its column names."""
    import csv
    import gzip
    import io
    import zipfile

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                raw = bytes(raw)
                if raw[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        name = member or next(n for n in z.namelist() if n.endswith((".csv", ".parquet")))
                        raw = z.read(name)
                    if name.endswith(".parquet"):
                        wide = pd.read_parquet(io.BytesIO(raw))
                        wide = wide.reset_index() if wide.index.name is not None or wide.index.dtype == object else wide
                        text = lambda v: "" if pd.isna(v) else str(v)
                        rows = [[str(c) for c in wide.columns], *([text(v) for v in row] for row in wide.itertuples(index=False))]
                        yield pd.DataFrame({"line": range(len(rows)), "fields": rows})
                        continue
                elif raw[:2] == b"\x1f\x8b":
                    raw = gzip.decompress(raw)
                rows = list(csv.reader(io.StringIO(raw.decode("utf-8"))))
                yield pd.DataFrame({"line": range(len(rows)), "fields": rows})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "line long, fields array<string>")


def read_first_matrix(spark: SparkSession, paths: list[str]) -> DataFrame:
    """date, asset, value of the first of the paths that loads, a matrix of assets by dates; an error that names them all if none does."""
    why = []
    for path in paths:
        try:
            lines = read_matrix(spark, path)
            head = lines.where("line = 0").first()
        except Exception as e:  # the next one may load; all reasons are told if none does
            why.append(f"{path}: {str(e).splitlines()[0][:120]}")
            continue
        if head is None:
            why.append(f"{path}: empty")
            continue
        dates = F.array(*[F.lit(x) for x in head.fields[1:]])
        cells = F.arrays_zip(dates.alias("date"), F.slice("fields", 2, max(1, len(head.fields) - 1)).alias("value"))
        rows = lines.where("line > 0").select(F.trim(F.element_at("fields", 1)).alias("asset"), F.inline(cells))
        rows = rows.select(parse_date(F.substring("date", 1, 11)).alias("date"), "asset", F.expr("try_cast(value AS DOUBLE)").alias("value"))
        return rows.where("date IS NOT NULL AND asset <> ''").withColumn("value", finite(F.col("value")))
    raise FileNotFoundError(f"no matrix could be read: {'; '.join(why) or 'no paths'}")


def clean_file(spark: SparkSession, path: str, out: str | None = None, log: str | None = None, policy: str = "drop_date", q99: float = 0.5, largest: float = 1.0, least_filled: float = 0.2) -> DataFrame:
    """The cleaned panel of a wide parquet table; written to out as a wide table, and its log (a row for each date) to log as CSV, where those are given."""
    from ..operators import clean

    panel = read_wide(spark, path)
    flags = clean.date_flags(panel, q99, largest, least_filled)
    cleaned = clean.apply_policy(panel, flags, policy)
    if log:
        action = F.when(F.col("flagged"), policy).otherwise("keep")
        flags.withColumn("action", action).orderBy("date").coalesce(1).write.mode("overwrite").option("header", True).csv(log)
    if out:
        cleaned.groupBy("date").pivot("asset").agg(F.first("r")).orderBy("date").write.mode("overwrite").parquet(out)
    return cleaned


def indexed(rows: DataFrame) -> DataFrame:
    """With t, the place of each date among the distinct dates. There are as many dates as days, so one task numbers them."""
    dates = rows.select("date").distinct().withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))
    return rows.join(dates, "date")


#: Steps of time that are numbered by one task.
STEPS = 4096


def placed(rows: DataFrame, step: int) -> DataFrame:
    """rows, one for each time (date, at most one a step of seconds; NULL is last), with t, its place: numbered in blocks of time, so that nothing but a row for each block comes together."""
    block = F.coalesce(F.floor(F.unix_seconds("date") / (step * STEPS)), F.lit(2**40)).cast("long")
    rows = rows.withColumn("block", block)
    before = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    both = rows.withColumn("own", F.lit(1)).unionByName(before.withColumn("own", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy("block").orderBy("own", "date")
    placed = both.withColumn("t", (F.first("before").over(by) + F.row_number().over(by) - 2).cast("int"))
    return placed.where("own = 1").drop("block", "own", "before")


def dense(rows: DataFrame, value: str = "close") -> DataFrame:
    """date, t, asset, value for every date and asset; NULL where rows have none."""
    dates = indexed(rows.select("date").distinct())
    # the assets of a panel are a few thousand names, however many rows it has
    grid = dates.crossJoin(F.broadcast(rows.select("asset").distinct()))
    return grid.join(rows.select("date", "asset", value), ["date", "asset"], "left")


def daily(lineitem: DataFrame, asset: Column) -> DataFrame:
    """Average price of each day and asset."""
    return lineitem.groupBy(F.to_date("l_shipdate").alias("date"), asset.alias("asset")).agg(F.avg("l_extendedprice").alias("close"))


def flag_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(table(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus"))


def status_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(table(spark, sf_dir, "lineitem"), F.col("l_linestatus"))


def nation_prices(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    date = F.to_date(F.date_trunc(unit, "l_shipdate"))
    return items.groupBy(date.alias("date"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("asset")).agg(F.avg("l_extendedprice").alias("close"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (the hour), asset (event type), x: average value."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("date"), F.col("event_type").alias("asset")).agg(F.avg("value").alias("x"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("z"), "label")


def write_backtest(rows: DataFrame, report: DataFrame, folder: str, config: dict | None = None, stats: dict | None = None) -> None:
    """Sinks of a backtest: rows as parquet and CSV, the report as CSV, config and statistics as JSON."""
    rows.write.mode("overwrite").parquet(f"{folder}/backtest.parquet")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/backtest_csv")
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/report_csv")
    if config is not None:
        import yaml

        write_text(rows.sparkSession, yaml.safe_dump(json.loads(json.dumps(config, default=str)), sort_keys=False), f"{folder}/config_used.yaml")
    if stats is not None:
        write_text(rows.sparkSession, json.dumps(stats, indent=2, default=str), f"{folder}/stats.json")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text, through Spark's writers, so that any store that Spark reaches will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_files(files: DataFrame, folder: str) -> str:
    """Each row (name, content: bytes) as a file of that name in a folder of any store that pyarrow reaches, written by tasks; the folder."""
    from .archives import written

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                written(f"{folder}/{name}", bytes(content))
            yield pd.DataFrame({"name": pdf["name"]})

    files.select("name", "content").mapInPandas(run, "name string").count()
    return folder


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def read_backtest(spark: SparkSession, path: str) -> DataFrame:
    """A backtest table: the parquet table, or the CSV folder beside it where that is missing. Other errors of reading are errors."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.read.option("header", True).option("inferSchema", True).csv(str(Path(path).with_suffix("")) + "_csv")


def row_of(rows: DataFrame, **keys) -> DataFrame:
    """The rows with these values (a date, a choice, an anchor); an error if there are none."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    if not rows.head(1):
        raise LookupError(f"no row with {', '.join(f'{k} = {v}' for k, v in keys.items())}")
    return rows


def write_universe(spark: SparkSession, universe: DataFrame, folder: str, n: int, facts: dict) -> None:
    """The first n assets (by place) as a CSV of one column, and a summary of the facts and assets as text."""
    chosen = universe.where(F.col("place") <= n).orderBy("place").select(F.col("asset").alias("ticker"))
    chosen.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/universe_{n}")
    names = [r.ticker for r in chosen.collect()]  # n at most
    lines = ["Universe summary", *(f"{k}: {v}" for k, v in facts.items()), f"assets: {len(names)}", *(", ".join(names[k : k + 15]) for k in range(0, len(names), 15))]
    write_text(spark, "\n".join(lines), f"{folder}/universe_summary")


def preview(panel: DataFrame, dates: int = 5, assets: int = 5, value: str = "r") -> DataFrame:
    """The panel's corner: the first dates by the first assets, wide."""
    first = panel.select("asset").distinct().orderBy("asset").limit(assets)
    days = panel.select("date").distinct().orderBy("date").limit(dates)
    rows = panel.join(F.broadcast(first), "asset", "left_semi").join(F.broadcast(days), "date", "left_semi")
    return rows.groupBy("date").pivot("asset").agg(F.first(value)).orderBy("date")
