"""Panel construction and quality: returns, availability, universes, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.nulls import ratio
from .selection import quantiles


def by_asset() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("t")


def log_returns(panel: DataFrame, scale: float = 1.0, value: str = "close") -> DataFrame:
    """r = scale * ln(value / value on the previous row of the grid); NULL where either is missing or not positive."""
    before = F.lag(value).over(by_asset())
    return panel.withColumn("r", F.when((F.col(value) > 0) & (before > 0), scale * F.log(F.col(value) / before)))


def quality(panel: DataFrame, recent: tuple[str, str], max_gap: int = 30, high: float = 1.0, low: float = -0.9) -> DataFrame:
    """Per asset: first and last date, days, availability in percent (overall and in the recent range), longest gap, extreme days, exclusion."""
    own = Window.partitionBy("asset").orderBy("date")
    there = panel.where("r IS NOT NULL").withColumn("gap", F.date_diff("date", F.lag("date").over(own)))
    per = there.groupBy("asset").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("days"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"),
        F.count_if((F.col("r") > high) | (F.col("r") < low)).alias("extreme_days"), F.count_if(F.col("date").between(*[F.lit(x).cast("date") for x in recent])).alias("recent_days"),
    )
    dates = panel.select("date").distinct().agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("date").between(*[F.lit(x).cast("date") for x in recent])).alias("all_recent"))
    per = panel.select("asset").distinct().join(per, "asset", "left").crossJoin(F.broadcast(dates))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return per.select(
        "asset", "first_date", "last_date", zero("days").alias("days"), (100 * ratio(zero("days"), F.col("all"))).alias("availability_pct"),
        F.coalesce(100 * ratio(zero("recent_days"), F.col("all_recent")), F.lit(0.0)).alias("recent_availability_pct"), zero("longest_gap").alias("longest_gap"), zero("extreme_days").alias("extreme_days"),
    ).withColumn("excluded", (F.col("longest_gap") > max_gap) | (F.col("extreme_days") > 0))


def na_report(panel: DataFrame, by: str, value: str = "r") -> DataFrame:
    """Missing values of each date or asset: n, n_missing, share."""
    return panel.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.avg(F.col(value).isNull().cast("double")).alias("missing"))


def coverage(panel: DataFrame, outlier: float, value: str = "r") -> DataFrame:
    """code: 0 missing, 1 valid, 2 outlier."""
    return panel.withColumn("code", F.when(F.col(value).isNull(), 0).when(F.abs(value) > outlier, 2).otherwise(1))


def dense_assets(panel: DataFrame, most_missing: float = 0.6) -> DataFrame:
    """The panel without assets of which more than that share is missing."""
    keep = na_report(panel, "asset").where(F.col("missing") <= most_missing).select("asset")
    return panel.join(keep, "asset", "left_semi")


def select_top(quality_rows: DataFrame, forced: list[str], n: int = 150) -> DataFrame:
    """asset, place: forced assets first, then by recent availability; ties by asset."""
    order = Window.orderBy(F.desc(F.col("asset").isin(forced)), F.desc("recent_availability_pct"), "asset")
    return quality_rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def select_universe(
    quality_rows: DataFrame, mega: list[str], excluded: list[str], n: int, *, least_recent: float = 85, least_all: float = 70, longest_gap: int = 365, most_extreme: int = 50, mega_least: float = 80
) -> DataFrame:
    """asset, score, place: hard filters (mega caps need mega_least only), then mega caps first, then half recent and half overall availability."""
    ok = (F.col("recent_availability_pct") >= least_recent) & (F.col("availability_pct") >= least_all) & (F.col("longest_gap") <= longest_gap) & (F.col("extreme_days") <= most_extreme)
    big = F.col("asset").isin(mega) & (F.col("recent_availability_pct") >= mega_least)
    rows = quality_rows.where((ok | big) & ~F.col("asset").isin(excluded)).withColumns({"mega": big, "score": 0.5 * F.col("recent_availability_pct") + 0.5 * F.col("availability_pct")})
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mega"), F.desc("score"), "asset"))).where(F.col("place") <= n).select("asset", "score", "mega", "place")


def source_correlation(one: DataFrame, two: DataFrame, least: int = 10) -> DataFrame:
    """asset, n, corr of two sources' values (r) on their common dates; from least dates on."""
    both = one.where("r IS NOT NULL").select("date", "asset", F.col("r").alias("a")).join(two.where("r IS NOT NULL").select("date", "asset", F.col("r").alias("b")), ["date", "asset"])
    return both.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("corr")).where(F.col("n") >= least)


def merge_sources(primary: DataFrame, secondary: DataFrame, least: int = 10) -> DataFrame:
    """date, asset, r, source: each asset from the primary source if that has enough values, else from the secondary; on the union of dates."""
    counts = primary.groupBy("asset").agg(F.count("r").alias("n"))
    assets = primary.select("asset").union(secondary.select("asset")).distinct().join(counts, "asset", "left").select("asset", (F.coalesce("n", F.lit(0)) >= least).alias("first"))
    dates = primary.select("date").union(secondary.select("date")).distinct()
    grid = dates.crossJoin(F.broadcast(assets))
    both = grid.join(primary.select("date", "asset", F.col("r").alias("a")), ["date", "asset"], "left").join(secondary.select("date", "asset", F.col("r").alias("b")), ["date", "asset"], "left")
    return both.select("date", "asset", F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("r"), F.when(F.col("first"), "primary").otherwise("secondary").alias("source"))


def last_close(ticks: DataFrame, keys: list[str], order: Column, close: Column, bid: Column | None = None, ask: Column | None = None) -> DataFrame:
    """The last close of each key by a total order; where it is missing, the middle of bid and ask if both are positive."""
    price = close if bid is None else F.coalesce(close, F.when((bid > 0) & (ask > 0), (bid + ask) / 2))
    return ticks.groupBy(*keys).agg(F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("n_ticks"))


def pooled_percentiles(panel: DataFrame, shares: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), value: str = "r") -> DataFrame:
    """share, value: percentiles of all values of all assets together."""
    found = quantiles(panel.select(F.col(value).alias("v")), list(shares))
    return panel.sparkSession.createDataFrame(list(zip(shares, found, strict=True)), "share double, value double")


def cross_section(panel: DataFrame, window: int = 60) -> DataFrame:
    """Per date: volatility over assets, and its mean over the last dates (NULL until there are as many)."""
    per = panel.groupBy("date", "t").agg(F.stddev_samp("r").alias("vol"))
    last = Window.orderBy("t").rowsBetween(1 - window, 0)
    return per.withColumn("vol_mean", F.when(F.count("vol").over(last) == window, F.avg("vol").over(last)))
