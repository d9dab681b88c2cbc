"""Ranks within groups of any size: ties are one row, and a group is dealt to tasks in buckets of its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group, and the accuracy of the sketch that says where they end.
BUCKETS, ACCURACY = 256, 10_000


def placed(values: DataFrame, keys: list[str], *sums: Column, buckets: int = BUCKETS) -> DataFrame:
    """keys, v, size and sums of the rows of values (keys, v) with equal v, and before: the rows of the group with smaller v.

    A sketch cuts each group into buckets of about as many values, whole buckets before are added up from their totals, and only a bucket's
    own values are sorted together."""
    ties = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("size"), *sums)
    shares = F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)])
    ends = ties.groupBy(*keys).agg(F.percentile_approx("v", shares, ACCURACY).alias("ends"))
    ties = ties.join(ends, keys).withColumn("bucket", F.size(F.filter("ends", lambda e: e < F.col("v")))).drop("ends")
    before = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ties.groupBy(*keys, "bucket").agg(F.sum("size").alias("n"))
    totals = totals.select(*keys, "bucket", F.coalesce(F.sum("n").over(before("bucket", *keys)), F.lit(0)).alias("whole"))
    own = ties.withColumn("before", F.coalesce(F.sum("size").over(before("v", *keys, "bucket")), F.lit(0)))
    return own.join(totals, [*keys, "bucket"]).withColumn("before", F.col("before") + F.col("whole")).drop("bucket", "whole")


def mean_rank() -> Column:
    """The rank, from 1, that the rows of a placed() row share."""
    return F.col("before") + (F.col("size") + 1) / 2


def medians(places: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and the median of each group of placed() rows, between the two middle values."""
    n = places.groupBy(*keys).agg(F.sum("size").alias("n"))
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("size"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = places.join(n, keys).groupBy(*keys).agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))
    return middle.select(*keys, ((F.col("a") + F.col("b")) / 2).alias(name))
