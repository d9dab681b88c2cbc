"""Portfolio statistics of weights (anchor, method, asset, w) and future returns (anchor, t, asset, r)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hold_stats(weights: DataFrame, ahead: DataFrame, n_assets: int) -> DataFrame:
    """anchor, method, days, cumret, mean, var, vol, sharpe of the hold period; a day on which any asset is missing is left out."""
    days = weights.join(ahead, ["anchor", "asset"]).groupBy("anchor", "method", "t").agg(F.when(F.count("r") == n_assets, F.sum(F.col("w") * F.col("r"))).alias("rp"))
    per = days.groupBy("anchor", "method").agg(
        F.count("rp").alias("days"), (F.product(1 + F.col("rp")) - 1).alias("cumret"), F.avg("rp").alias("mean"), F.var_samp("rp").alias("var")
    )
    # of a single day the variance is 0; without days, or without volatility, there is no Sharpe ratio
    per = per.withColumn("var", F.when(F.col("days") == 1, 0.0).otherwise(F.col("var"))).withColumn("cumret", F.when(F.col("days") > 0, F.col("cumret"))).withColumn("vol", F.sqrt("var"))
    return per.withColumn("sharpe", F.when(F.col("vol") > 0, F.col("mean") / (F.col("vol") + 1e-12) * F.sqrt(F.lit(252.0))))


def turnover(weights: DataFrame) -> DataFrame:
    """anchor, method, turnover: sum over assets of changes since the method's last anchor; NULL at the first."""
    last = F.lag("w").over(Window.partitionBy("method", "asset").orderBy("anchor"))
    return weights.withColumn("d", F.abs(F.col("w") - last)).groupBy("anchor", "method").agg(F.sum("d").alias("turnover"))


def concentration(weights: DataFrame) -> DataFrame:
    return weights.groupBy("anchor", "method").agg(F.sum(F.col("w") * F.col("w")).alias("hhi"), F.max(F.abs("w")).alias("max_abs"), F.sum(F.abs("w")).alias("l1"))


def portfolio_variance(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """anchor, method, variance: w' S w."""
    one, two = weights.select("anchor", "method", F.col("asset").alias("i"), F.col("w").alias("wi")), weights.select("anchor", "method", F.col("asset").alias("j"), F.col("w").alias("wj"))
    return cov.join(one, ["anchor", "i"]).join(two, ["anchor", "method", "j"]).groupBy("anchor", "method").agg(F.sum(F.col("wi") * F.col("v") * F.col("wj")).alias("variance"))


def precision_weights(precision: DataFrame) -> DataFrame:
    """anchor, asset, w: row sums of a precision matrix, normalised."""
    rows = precision.groupBy("anchor", F.col("i").alias("asset")).agg(F.sum("v").alias("s"))
    total = rows.groupBy("anchor").agg(F.sum("s").alias("z"))
    return rows.join(total, "anchor").select("anchor", "asset", F.try_divide("s", "z").alias("w"))
