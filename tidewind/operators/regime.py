"""Regimes over time: transition matrices, the forward filter, diagnostics. Memberships are rows (anchor, p) with p an array over regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import entropy, normalised, total
from . import scan


def series_of(rows: DataFrame) -> list[str]:
    """What names a row's series; rows without a column series are one series."""
    return ["series"] if "series" in rows.columns else []


def steps(rows: DataFrame, value: str, size: int = scan.SIZE) -> DataFrame:
    """b, a: the value of each row but the first of a series, and the one before it."""
    pairs = scan.latest_before(rows, value, "before", series_of(rows), size=size)
    return pairs.where("before IS NOT NULL").select(F.col("before").alias("b"), F.col(value).alias("a"))


def assigned(pi: DataFrame) -> DataFrame:
    """anchor, state: the first most likely regime."""
    return pi.select(*series_of(pi), "anchor", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("state"))


def _row_normalised(counts: DataFrame, k: int, smooth: float, empty_uniform: bool = True) -> DataFrame:
    """i, j, a from counts (i, j, n), with smooth added to each cell."""
    spark = counts.sparkSession
    grid = spark.range(k * k).select((F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"))
    cells = grid.join(counts, ["i", "j"], "left").select("i", "j", (F.coalesce("n", F.lit(0.0)) + smooth).alias("n"))
    rows = cells.groupBy("i").agg(F.sum("n").alias("s"))
    a = F.coalesce(F.try_divide("n", "s"), F.lit(1.0 / k if empty_uniform else 0.0))
    return cells.join(rows, "i").select("i", "j", a.alias("a"))


def transition_hard(states: DataFrame, k: int, smooth: float = 10.0, empty_uniform: bool = True) -> DataFrame:
    """From (anchor, state): counts of consecutive states of each series, smoothed and normalised by row."""
    return _row_normalised(steps(states, "state").groupBy(F.col("b").alias("i"), F.col("a").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("n")), k, smooth, empty_uniform)


def transition_soft(pi: DataFrame, k: int, smooth: float = 10.0) -> DataFrame:
    """From (anchor, p): sums of products of consecutive memberships, smoothed and normalised by row."""
    cells = F.flatten(F.transform("b", lambda x, i: F.transform("a", lambda y, j: F.struct(i.alias("i"), j.alias("j"), (x * y).alias("x")))))
    return _row_normalised(steps(pi, "p").select(F.inline(cells)).groupBy("i", "j").agg(F.sum("x").alias("n")), k, smooth)


def given_switch(trans: DataFrame) -> DataFrame:
    """Transition probabilities given that the regime changes: no diagonal, normalised again."""
    rest = trans.where("i <> j")
    return rest.join(rest.groupBy("i").agg(F.sum("a").alias("s")), "i").select("i", "j", F.coalesce(F.try_divide("a", "s"), F.lit(0.0)).alias("a"))


def as_matrix(trans: DataFrame) -> list[list[float]]:
    """K x K on the driver."""
    cells = {(r.i, r.j): r.a for r in trans.collect()}
    k = 1 + max(i for i, _ in cells)
    return [[cells[i, j] for j in range(k)] for i in range(k)]


def step(alpha: Column, p: Column, trans: list[list[float]]) -> Column:
    """alpha A (.) p, normalised; p where its mass is gone."""
    moved = F.array(*[total(F.zip_with(alpha, F.array(*[F.lit(row[j]) for row in trans]), lambda x, a: x * a)) for j in range(len(trans))])
    now = F.zip_with(moved, p, lambda x, y: x * y)
    return F.when(total(now) > 1e-12, F.transform(now, lambda x: x / total(now))).otherwise(p)


def forward_filter(pi: DataFrame, trans: list[list[float]], alpha0: list[float] | None = None, size: int = scan.SIZE) -> DataFrame:
    """anchor, alpha (and series): filtered memberships along each series, by a scan over blocks of anchors."""
    if "series" in pi.columns:
        return scan.forward_filter(pi, trans, alpha0, size)
    return scan.forward_filter(pi.withColumn("series", F.lit(0)), trans, alpha0, size).drop("series")


def as_of(queries: DataFrame, alpha: DataFrame, size: int = scan.SIZE) -> DataFrame:
    """For each query (anchor, of a series if there are several): the latest alpha with a smaller anchor. Both lists are merged and scanned in blocks, without a join of all pairs."""
    own = series_of(queries)
    both = alpha.select(*own, "anchor", "alpha", F.lit(0).alias("q")).unionByName(queries.select(*own, "anchor", F.lit(None).cast("array<double>").alias("alpha"), F.lit(1).alias("q")))
    latest = scan.latest_before(both, "alpha", "latest", own, F.desc("q"), size)
    return latest.where("q = 1").select(*own, "anchor", F.col("latest").alias("alpha"))


def diagnostics(pi: DataFrame, top: int = 3) -> DataFrame:
    """anchor, state, entropy, best: the most likely regimes with their probabilities."""
    order = F.slice(F.sort_array(F.transform("p", lambda x, k: F.struct(x.alias("p"), (-k).alias("k"))), asc=False), 1, top)
    return pi.join(assigned(pi), "anchor").select("anchor", "state", entropy(F.col("p")).alias("entropy"), F.transform(order, lambda s: -s["k"]).alias("best"))


def memberships(scores: Column) -> Column:
    """Floored at 1e-12 and normalised."""
    return normalised(F.transform(scores, lambda x: F.greatest(x, F.lit(1e-12))))
