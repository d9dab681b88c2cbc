"""Queries on files: what Spark derives from the tables is written the way that the readers find it, and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions.nulls import finite
from ..operators import analytics
from ..sources import archives, panels as src, paths
from .analysis import results
from .catalog import FLAGS, RESULTS, query
from .panels import flags_panel

#: Files are dated in years that readers of archives take for possible.
LATER = 7305


def _wide(panel, number="CAST({} AS STRING)"):
    """Dates by assets, with text for numbers and n/a where one is missing."""
    wide = panel.groupBy("date").pivot("asset").agg(F.first("r"))
    return wide.select("date", *[F.coalesce(F.expr(number.format(f"`{c}`")), F.lit("n/a")).alias(c) for c in wide.columns if c != "date"])


@query("wide_file_scan", f"WITH {FLAGS} SELECT date, t, asset, r FROM panel", "r", "t", "date")
def _(spark, d):
    """A wide parquet table of texts, as a panel of numbers."""
    path = f"{paths.scratch(spark)}/wide.parquet"
    _wide(flags_panel(spark, d)).write.parquet(path)
    return src.read_wide(spark, path).select("date", "t", "asset", "r")


_FLAGGED_FILE = f"""{FLAGS}, fl AS (SELECT date, coalesce(quantile_cont(abs(r), 0.99) > 0.05 OR max(abs(r)) > 0.06, false) OR avg((r IS NOT NULL)::DOUBLE) < 0.2 AS flagged FROM panel GROUP BY date)"""


@query("clean_file_scan", f"WITH {_FLAGGED_FILE} SELECT date, asset, CASE WHEN NOT flagged THEN r END AS r, CASE WHEN flagged THEN 'drop_date' ELSE 'keep' END AS action FROM panel JOIN fl USING (date)", "r", "", "date")
def _(spark, d):
    """Cleaned on load, written wide with its log, and both read again."""
    folder = paths.scratch(spark)
    _wide(flags_panel(spark, d)).write.parquet(f"{folder}/in.parquet")
    src.clean_file(spark, f"{folder}/in.parquet", f"{folder}/out.parquet", f"{folder}/log", "drop_date", 0.05, 0.06, 0.2)
    log = spark.read.option("header", True).csv(f"{folder}/log").select(F.col("date").cast("date").alias("date"), "action")
    return src.read_wide(spark, f"{folder}/out.parquet").join(log, "date").select("date", "asset", "r", "action")


@query("daily_csv_scan", f"WITH {FLAGS} SELECT date, asset, r AS value FROM panel WHERE r IS NOT NULL", "value", "", "date")
def _(spark, d):
    """A file for each date, in a folder for each year; before an asset's last number stand another one and one that is none."""
    rows = flags_panel(spark, d).select("date", "asset", F.concat_ws("\n", F.concat_ws(",", F.concat(F.lit(" "), "asset"), F.lit("0.5")), F.concat_ws(",", "asset", F.coalesce(F.col("r").cast("string"), F.lit("x"))), F.concat_ws(",", "asset", F.lit("none"))).alias("line"), "r")
    day = rows.where("r IS NOT NULL").groupBy("date").agg(F.concat_ws("\n", F.array_sort(F.collect_list("line"))).alias("lines"))
    content = F.concat(F.lit("ticker,pvCLCL\n"), "lines", F.lit("\n")).cast("binary")
    folder = src.write_files(day.select(F.concat(F.date_format("date", "yyyy"), F.lit("/"), F.date_format("date", "yyyyMMdd"), F.lit(".csv")).alias("name"), content.alias("content")), paths.scratch(spark))
    return src.read_daily_csv(spark, f"{folder}/*/*.csv").select("date", "asset", "value")


def _zipped(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """An archive of an asset's days: rows (member, content)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for member, content in sorted(zip(rows["member"], rows["content"], strict=True)):
            z.writestr(member, content)
    return pd.DataFrame({"name": [f"{key[0]}__minutes.zip"], "content": [out.getvalue()]})


def _archived(rows, folder: str) -> str:
    """An archive for each asset with its members (asset, member, content), written as they come in; the folder."""

    def run(batches):
        now = store = archive = None
        for pdf in batches:
            for asset, member, content in zip(pdf["asset"], pdf["member"], pdf["content"], strict=True):
                if asset != now:
                    if archive is not None:
                        archive.close()
                        store.close()
                    now, store = asset, archives.created(f"{folder}/{asset}__minutes.zip")
                    archive = zipfile.ZipFile(store, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(member, content)
            yield pd.DataFrame({"asset": pdf["asset"]})
        if archive is not None:
            archive.close()
            store.close()

    rows.repartition("asset").sortWithinPartitions("asset", "member").mapInPandas(run, "asset string").count()
    return folder


def ticks(spark, d):
    """An archive for each asset with a member for each day: closes on even days, quotes on odd ones, in order of their prices; the archives' folder."""
    items = src.table(spark, d, "lineitem").select(F.date_add(F.col("l_shipdate").cast("date"), LATER).alias("date"), F.concat("l_returnflag", "l_linestatus").alias("asset"), F.col("l_extendedprice").cast("double").alias("p"))
    day = items.groupBy("date", "asset").agg(F.array_sort(F.collect_list("p")).alias("p"))
    even = F.day("date") % 2 == 0
    lines = F.when(even, F.transform("p", lambda x, k: F.concat_ws(",", k.cast("string"), x.cast("string")))).otherwise(F.transform("p", lambda x, k: F.concat_ws(",", k.cast("string"), F.get("p", F.lit(0)).cast("string"), x.cast("string"))))
    content = F.concat(F.when(even, "timestamp,Close\n").otherwise("timestamp,bid_1,ask_1\n"), F.array_join(lines, "\n"))
    member = F.concat("asset", F.lit("/"), F.when(even, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "yyyyMMdd")), F.lit(".csv"))
    return _archived(day.select("asset", member.alias("member"), content.alias("content")), paths.scratch(spark))


_TICKS = f"SELECT date, asset, CASE WHEN day(date) % 2 = 0 THEN max(p) ELSE (min(p) + max(p)) / 2 END AS close FROM (SELECT CAST(l_shipdate AS DATE) + {LATER} AS date, l_returnflag || l_linestatus AS asset, l_extendedprice AS p FROM lineitem) GROUP BY date, asset"


@query("archive_closes", _TICKS, "close", "", "date")
def _(spark, d):
    return archives.daily_closes(spark, f"{ticks(spark, d)}/*.zip")


@query("archive_closes_between", f"SELECT * FROM ({_TICKS}) WHERE date BETWEEN DATE '2015-03-01' AND DATE '2015-06-30'", "close", "", "date")
def _(spark, d):
    """Members of other dates are not read."""
    return archives.daily_closes(spark, f"{ticks(spark, d)}/*.zip", "2015-03-01", "2015-06-30")


@query("archive_inventory", "SELECT 'zip' AS ending, count(DISTINCT l_returnflag || l_linestatus) AS n, count(DISTINCT (CAST(l_shipdate AS DATE), l_returnflag, l_linestatus)) AS members FROM lineitem", "", "n members")
def _(spark, d):
    path = f"{ticks(spark, d)}/*"
    return archives.inventory(spark, path).crossJoin(archives.zip_members(spark, path).agg(F.count(F.lit(1)).alias("members"))).select("ending", "n", "members")


@query("archive_columns", "SELECT asset, unnest(['timestamp', 'close']) AS column_, unnest(['long', 'double']) AS kind, unnest(['time', 'close']) AS role FROM (SELECT DISTINCT l_returnflag || l_linestatus AS asset FROM lineitem)")
def _(spark, d):
    """Columns of each archive's first member, which is of an even day."""
    found = archives.sample_columns(spark, f"{ticks(spark, d)}/*.zip")
    return found.select(archives.ticker_of(F.col("archive")).alias("asset"), F.col("column").alias("column_"), "kind", "role")


@query("matrix_scan", f"WITH {FLAGS} SELECT date, asset, r AS value FROM panel", "value", "", "date")
def _(spark, d):
    """A zipped matrix of assets by dates, the second of three places and the first that loads."""
    panel, folder = flags_panel(spark, d), paths.scratch(spark)
    dates = panel.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("dates"))  # a matrix has them as its columns
    head = dates.select(F.lit("").alias("asset"), F.transform("dates", lambda x: F.concat(F.lit("X"), F.date_format(x, "yyyyMMdd"))).alias("cells"))
    rows = panel.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("date", F.coalesce(F.col("r").cast("string"), F.lit("")).alias("r")))).alias("x")).select(F.concat(F.lit(" "), "asset").alias("asset"), F.col("x.r").alias("cells"))
    lines = head.withColumn("k", F.lit(0)).unionByName(rows.withColumn("k", F.lit(1))).select("k", F.concat_ws(",", "asset", F.array_join("cells", ",")).alias("line"))
    text = lines.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"])).alias("content"))
    src.write_files(text.select(F.lit("m").alias("asset"), F.lit("matrix.csv").alias("member"), "content").groupBy("asset").applyInPandas(_zipped, "name string, content binary"), folder)
    return src.read_first_matrix(spark, [f"{folder}/none.zip", f"{folder}/m__minutes.zip", f"{folder}/m__minutes.zip"])


@query("results_file_scan", f"WITH {RESULTS} SELECT date, method, value FROM rows", "value", "", "", "date")
def _(spark, d):
    """Results as their sinks write them; the table is read from the CSV beside it, as there is no parquet file at the place that is asked for."""
    folder = paths.scratch(spark)
    rows = results(spark, d).select(F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "method", "value")
    src.write_backtest(rows, analytics.report(rows.withColumn("metric", F.lit("ret"))), f"{folder}/written", {"target": "cov"}, {"n": 1})
    spark.read.option("header", True).csv(f"{folder}/written/backtest_csv").write.option("header", True).csv(f"{folder}/moved/backtest_csv")
    found = src.read_backtest(spark, f"{folder}/moved/backtest.parquet")
    return found.select(F.col("date").cast("timestamp").alias("date"), "method", "value")


@query("universe_file_scan", "SELECT ticker, place FROM (SELECT 'N' || s_nationkey AS ticker, row_number() OVER (ORDER BY count(*) DESC, 'N' || s_nationkey) AS place FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) WHERE place <= 10", "", "place")
def _(spark, d):
    """The ten nations with the most items, as the universe's file has them, in its order."""
    from pyspark.sql import Window

    items = src.table(spark, d, "lineitem").join(src.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counted = items.groupBy(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("asset")).agg(F.count(F.lit(1)).alias("n"))  # a row for each nation
    folder = paths.scratch(spark)
    src.write_universe(spark, counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "asset"))), folder, 10, {"items": "all"})
    names = spark.read.option("header", True).csv(f"{folder}/universe_10")
    return names.join(counted, names["ticker"] == counted["asset"]).select("ticker", F.row_number().over(Window.orderBy(F.desc("n"), "ticker")).alias("place"))


@query("finite_mask", "SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_discount NOT IN (0, 0.01, 0.02) THEN 1 END) AS there, sum(CASE WHEN l_discount NOT IN (0, 0.01, 0.02) THEN l_discount END) AS total FROM lineitem GROUP BY l_returnflag", "total", "n there")
def _(spark, d):
    """Infinite values and those that are no numbers become missing."""
    x = F.col("l_discount").cast("double")
    odd = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_discount") == F.lit(0.01), F.lit(float("-inf"))).when(F.col("l_discount") == F.lit(0.02), F.lit(float("nan"))).otherwise(x)
    return src.table(spark, d, "lineitem").withColumn("x", finite(odd)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("there"), F.sum("x").alias("total"))


@query("row_lookup", f"WITH {RESULTS} SELECT date, method, value FROM rows WHERE method = 'mix'", "value", "", "", "date")
def _(spark, d):
    return src.row_of(results(spark, d), method="mix").select("date", "method", "value")
