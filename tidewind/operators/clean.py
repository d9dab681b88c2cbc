"""Cleaning of return panels (date, t, asset, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.nulls import clip


def by_asset() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("t")


def date_flags(panel: DataFrame, q99: float = 0.5, largest: float = 1.0, least_filled: float = 0.0) -> DataFrame:
    """date, q99, max_abs, filled, flagged of each date."""
    size = F.abs("r")
    per = panel.groupBy("date").agg(F.percentile(size, 0.99).alias("q99"), F.max(size).alias("max_abs"), F.avg(F.col("r").isNotNull().cast("double")).alias("filled"))
    return per.withColumn("flagged", F.coalesce((F.col("q99") > q99) | (F.col("max_abs") > largest), F.lit(False)) | (F.col("filled") < least_filled))


def apply_policy(panel: DataFrame, flags: DataFrame, policy: str, low: float = -0.3, high: float = 0.3, largest: float = 1.0) -> DataFrame:
    """drop_date: no values on flagged dates; winsorize_date: clipped there; drop_ticker_values: large ones go there."""
    values: dict[str, Column] = {
        "drop_date": F.lit(None).cast("double"),
        "winsorize_date": clip(F.col("r"), low, high),
        "drop_ticker_values": F.when(F.abs("r") <= largest, F.col("r")),
    }
    if policy not in values:
        raise ValueError(f"unknown policy {policy!r}; known: {', '.join(values)}")
    marked = panel.join(flags.select("date", "flagged"), "date")
    return marked.withColumn("r", F.when(F.col("flagged"), values[policy]).otherwise(F.col("r"))).drop("flagged")


def cleaning_log(flags: DataFrame, policy: str, worst: int = 5) -> DataFrame:
    """The worst flagged dates by largest value."""
    return flags.where("flagged").withColumn("action", F.lit(policy)).orderBy(F.desc("max_abs"), "date").limit(worst)


def worst_cells(cells: DataFrame, n: int = 10) -> DataFrame:
    """The removed cells (date, asset, r, reason) with the largest values, each once: its first reason stays."""
    first = Window.partitionBy("date", "asset").orderBy("reason")
    once = cells.where("reason IS NOT NULL").withColumn("k", F.row_number().over(first)).where("k = 1")
    return once.orderBy(F.desc(F.abs("r")), "date", "asset").limit(n).select("date", "asset", "r", "reason")


def in_periods(date: Column, periods: list[tuple[str, str]]) -> Column:
    out = F.lit(False)
    for first, last in periods:
        out = out | date.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return out


def cell_mask(panel: DataFrame, volatile: list[tuple[str, str]], huge: float = 5.0, large: float = 2.0) -> DataFrame:
    """reason of each bad cell: huge; split_pair (a large value beside a large one of the other sign); suspicious_multi (two large ones on a calm date)."""
    r, big = F.col("r"), F.abs("r") > large
    beside = lambda x: (F.abs(x) > large) & (F.signum(x) != F.signum(r))
    n = F.count_if(big).over(Window.partitionBy("date"))
    reason = (
        F.when(F.abs("r") > huge, "huge")
        .when(big & (F.coalesce(beside(F.lead("r").over(by_asset())), F.lit(False)) | F.coalesce(beside(F.lag("r").over(by_asset())), F.lit(False))), "split_pair")
        .when(big & ~in_periods(F.col("date"), volatile) & (n >= 2), "suspicious_multi")
    )
    return panel.withColumn("reason", reason)


def masked(cells: DataFrame) -> DataFrame:
    return cells.withColumn("r", F.when(F.col("reason").isNull(), F.col("r"))).drop("reason")


def mask_summary(cells: DataFrame) -> DataFrame:
    return cells.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("dates"), F.max(F.abs("r")).alias("max_abs"))


def extreme_days(panel: DataFrame, least: float = 0.5) -> DataFrame:
    """Per date with a value over least: the asset with the largest one (ties: first by name), its neighbours in time, how many are large."""
    near = panel.withColumns({"before": F.lag("r").over(by_asset()), "next1": F.lead("r", 1).over(by_asset()), "next2": F.lead("r", 2).over(by_asset())})
    per = near.where(F.abs("r") > least)
    # the largest value; of equal ones the name that comes first
    best = F.min_by(F.struct("asset", "r", "before", "next1", "next2"), F.struct(-F.abs("r"), "asset"))
    return per.groupBy("date").agg(best.alias("b"), F.count(F.lit(1)).alias("n_extreme")).select("date", "b.*", "n_extreme")


def reverse_split(r: Column, next1: Column, next2: Column, large: float = 2.0) -> Column:
    """A large value that one of the next two takes back; false where the next is missing."""
    back = lambda x: F.coalesce((F.abs(x) > large) & (F.signum(x) != F.signum(r)), F.lit(False))
    return next1.isNotNull() & (F.abs(r) > large) & (back(next1) | back(next2))


def classify(days: DataFrame, volatile: list[tuple[str, str]], huge: float = 5.0, large: float = 2.0, middle: float = 1.0, least: float = 0.5) -> DataFrame:
    """kind of each extreme day; the first rule that holds decides.

    ARTIFACT: huge, a reverse split, or large with two other assets. LEGITIMATE: one asset alone and not large, in a volatile period or
    up to middle. SUSPICIOUS: large, or not alone, or above middle on a calm date. LEGITIMATE: whatever is left."""
    size, n, calm = F.abs("r"), F.col("n_extreme"), ~in_periods(F.col("date"), volatile)
    kind = (
        F.when((size > huge) | reverse_split(F.col("r"), F.col("next1"), F.col("next2"), large) | (n >= 3) & (size > large), "ARTIFACT")
        .when(size.between(least, large) & (n == 1) & (~calm | (size <= middle)), "LEGITIMATE")
        .when((size > large) | (n >= 2) | (size > middle) & calm, "SUSPICIOUS")
        .otherwise("LEGITIMATE")
    )
    return days.withColumn("kind", kind)


TIERS = {"strict": ("ARTIFACT",), "moderate": ("ARTIFACT", "SUSPICIOUS"), "lenient": ("ARTIFACT",)}


def drop_tier(panel: DataFrame, classified: DataFrame, tier: str) -> DataFrame:
    return panel.join(classified.where(F.col("kind").isin(*TIERS[tier])).select("date"), "date", "left_anti")


def tier_stats(panel: DataFrame, classified: DataFrame) -> DataFrame:
    """Days, largest value, 99th percentile and missing values of each tier."""
    out = None
    for tier in TIERS:
        one = drop_tier(panel, classified, tier).agg(
            F.count_distinct("date").alias("days"), F.max(F.abs("r")).alias("max_abs"), F.percentile(F.abs("r"), 0.99).alias("q99"), F.count_if(F.col("r").isNull()).alias("n_na")
        ).withColumn("tier", F.lit(tier))
        out = one if out is None else out.unionByName(one)
    return out


def conservative(panel: DataFrame, most: float = 0.5) -> DataFrame:
    """Without the days on which a value exceeds most."""
    return panel.join(panel.where(F.abs("r") > most).select("date").distinct(), "date", "left_anti")


def aggressive(panel: DataFrame, most: float = 0.5) -> DataFrame:
    """With the values that exceed most missing."""
    return panel.withColumn("r", F.when(F.abs("r") <= most, F.col("r")))


#: Returns of usual splits: name, return, tolerance (fixed values).
SPLITS = [
    ("2-for-1 split", -0.5, 0.05),
    ("3-for-2 split", -0.667, 0.05),
    ("1-for-10 reverse", 9.0, 1.0),
    ("1-for-5 reverse", 4.0, 0.5),
    ("1-for-3 reverse", 2.0, 0.3),
    ("3-for-1 split", -0.33, 0.05),
]


def match_splits(panel: DataFrame, splits: list[tuple[str, float, float]] = SPLITS) -> DataFrame:
    """The first split, in the given order, whose return is within its tolerance of r."""
    hit = F.coalesce(*[F.when(F.abs(F.col("r") - value) <= tolerance, name) for name, value, tolerance in splits])
    return panel.withColumn("split", hit).where("split IS NOT NULL")


def histogram(panel: DataFrame, unit: str, least: float = 0.5) -> DataFrame:
    """Large values by year, month or day of week (0 is Monday)."""
    by = {"year": F.year("date"), "month": F.month("date"), "dow": F.weekday("date")}[unit]
    return panel.where(F.abs("r") > least).groupBy(by.alias(unit)).agg(F.count(F.lit(1)).alias("n"))


def winsorize(panel: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clipped at each asset's quantiles."""
    q = panel.groupBy("asset").agg(F.percentile("r", low).alias("lo"), F.percentile("r", high).alias("hi"))
    return panel.join(q, "asset").withColumn("r", F.when(F.col("r").isNotNull(), F.least(F.greatest("r", "lo"), "hi"))).drop("lo", "hi")


def clean_on_load(panel: DataFrame, policy: str = "drop_date", **limits: float) -> tuple[DataFrame, DataFrame]:
    """The cleaned panel and the log of flags."""
    flags = date_flags(panel, **limits)
    return apply_policy(panel, flags, policy), flags
