"""Connected components of an edge table.

Edges that fit in one task by count go through one union-find there; more are joined by alternating star operations, which are written
to the shared folder after each round. Both give the same labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

ROUNDS = 60
#: Edges that one task takes (16 bytes each, some hundred in its maps).
LOCAL_EDGES = 500_000


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
    rows = [(x, r) for x in root if (r := top(x)) != x]
    yield pd.DataFrame(rows, columns=["node", "component"]).astype("int64")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, component (its smallest node) for each node of edges (u, v; u <> v) that isn't the smallest itself."""
    folder = shared_dir(edges.sparkSession)
    now = written(edges.select("u", "v").where("u <> v").distinct(), "r0", folder)
    if now.count() <= local_edges:
        return written(now.coalesce(1).mapInPandas(_union_find, "node long, component long"), "labels", folder)
    state = None
    for k in range(1, ROUNDS + 1):
        now = written(_small_star(_large_star(now)), f"r{k}", folder)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
