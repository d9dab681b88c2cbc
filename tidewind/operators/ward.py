"""Ward's agglomeration of rows of any number, in rounds: all pairs of groups that are each other's nearest merge at once.

Such a pair stays the nearest whatever else merges, so the tree is that of one merge at a time; a cut takes its last merges back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import CHUNK, Kept, block_of, matrix, number, paired
from .cluster import squared

#: Groups that one task takes to the end, one merge at a time.
FEW = 1_000


def _costs(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Twice the growth of variance if a row of x (of n rows) merges with one of y."""
    return squared(x, y) * (2 * n[:, None] * m[None] / (n[:, None] + m[None]))


def _packed(groups: DataFrame, blocks: int) -> DataFrame:
    """block, n, ids, x (means), m (rows) of the groups (id, m, c) of each block."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("id")
        x = own["c"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        cells = [own["id"].to_numpy().astype(np.int64), x, own["m"].to_numpy().astype(float)]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": [own.num_rows], **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("ids", "x", "m"), cells, strict=True)}})

    return groups.select("id", "m", "c", block_of(blocks).alias("block")).groupBy("block").applyInArrow(run, "block int, n long, ids binary, x binary, m binary")


def nearest(groups: DataFrame, blocks: int) -> DataFrame:
    """id, other, cost: the group that each costs least to merge with; ties to the smaller identifier."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own = {r["block"]: r for r in rows.to_pylist()}
        i, j = (k.as_py() for k in key)
        if i not in own or j not in own:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "cost": pa.array([], pa.float64())})
        x, m, ids = ({b: of(r) for b, r in own.items()} for of in (lambda r: matrix(r["x"], r["n"]), lambda r: np.frombuffer(r["m"], float), lambda r: np.frombuffer(r["ids"], np.int64)))
        best = {b: (np.full(len(v), np.inf), np.full(len(v), np.iinfo(np.int64).max)) for b, v in ids.items()}

        def told(b: int, at: slice, cost: np.ndarray, other: np.ndarray) -> None:
            least = cost.argmin(1)
            c, o = cost[np.arange(len(cost)), least], other[least]
            now, named = (v[at] for v in best[b])
            better = (c < now) | ((c == now) & (o < named))
            now[better], named[better] = c[better], o[better]

        for a in range(0, len(ids[i]), CHUNK):
            one = slice(a, a + CHUNK)
            for b in range(a if i == j else 0, len(ids[j]), CHUNK):
                two = slice(b, b + CHUNK)
                cost = _costs(x[i][one], m[i][one], x[j][two], m[j][two])
                if i == j and a == b:
                    cost = np.minimum(cost, cost.T)  # the same both ways
                    np.fill_diagonal(cost, np.inf)
                told(i, one, cost, ids[j][two])
                if i != j or a != b:
                    told(j, two, cost.T, ids[i][one])
        found = [(ids[b], best[b][1], best[b][0]) for b in own]
        who, other, cost = (np.concatenate(v) for v in zip(*found, strict=True))
        some = np.isfinite(cost)
        return pa.table({"id": who[some], "other": other[some], "cost": cost[some]})

    met = paired(_packed(groups, blocks), blocks).groupBy("i", "j").applyInArrow(run, "id long, other long, cost double")
    return met.groupBy("id").agg(F.min(F.struct("cost", "other")).alias("b")).select("id", "b.other", "b.cost")


def _rest(groups: DataFrame) -> list[tuple[int, int, float]]:
    """The merges (child, into, height) of the last few groups (id, m, c, h), made one at a time in one task."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("id")
        ids, size, h = own["id"].to_numpy(), own["m"].to_numpy().astype(float), own["h"].to_numpy().copy()
        x = own["c"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        d = _costs(x, size, x, size)
        np.fill_diagonal(d, np.inf)
        alive, out = np.ones(len(ids), bool), []
        for _ in range(len(ids) - 1):
            i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
            h[i] = max(d[i, j], h[i], h[j])
            out.append((int(ids[j]), int(ids[i]), float(h[i])))
            row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
            alive[j] = False
            row[~alive] = np.inf
            row[i] = np.inf
            d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
            size[i] += size[j]
        child, into, height = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"place": pa.array(range(len(out)), pa.int64()), "child": pa.array(child, pa.int64()), "into": pa.array(into, pa.int64()), "h": pa.array(height, pa.float64())})

    rows = groups.groupBy(F.lit(0).alias("all")).applyInArrow(run, "place long, child long, into long, h double").collect()  # FEW at most
    return [(r.child, r["into"], r.h) for r in sorted(rows, key=lambda r: r.place)]


def ward(vectors: DataFrame, n: int, d: int, k: int, seed: int = 0) -> DataFrame:
    """id, label: the k groups of vectors (id, z) that Ward's merges leave; labels in no stated order."""
    spark, kept = vectors.sparkSession, Kept(vectors.sparkSession)
    groups = kept(vectors.select("id", F.lit(1).cast("long").alias("m"), F.col("z").alias("c"), F.lit(0.0).alias("h")))
    merges, left, rounds = None, n, 0
    while left > max(FEW, k):
        near = kept(nearest(groups, number(groups, left)))
        a, b = near.alias("a"), near.alias("b")
        pairs = a.join(b, (F.col("a.other") == F.col("b.id")) & (F.col("b.other") == F.col("a.id")) & (F.col("a.id") < F.col("b.id")))
        pairs = pairs.select(F.col("b.id").alias("child"), F.col("a.id").alias("into"), F.col("a.cost").alias("cost"), F.lit(rounds).alias("round"))
        named = groups.join(pairs.select(F.col("child").alias("id"), "into", "cost").unionByName(pairs.select(F.col("into").alias("id"), "into", "cost")), "id", "left")
        named = named.select("id", F.coalesce("into", "id").alias("into"), "m", "c", F.greatest("h", F.coalesce("cost", F.lit(0.0))).alias("h"))
        # at most two of a group: the one that stays, and the one that joins it
        two = named.groupBy("into").agg(F.array_sort(F.collect_list(F.struct("id", "m", "c"))).alias("g"), F.max("h").alias("h"))
        x, y, m = F.col("g")[0], F.get("g", F.lit(1)), F.aggregate("g", F.lit(0).cast("long"), lambda s, g: s + g["m"])
        mean = F.when(F.size("g") == 1, x["c"]).otherwise(F.zip_with(x["c"], y["c"], lambda u, v: (x["m"] * u + y["m"] * v) / (x["m"] + y["m"])))
        merged = kept(two.select(F.col("into").alias("id"), m.alias("m"), mean.alias("c"), "h", F.transform(F.slice("g", 2, 1), lambda g: g["id"]).alias("child")))
        new = merged.select(F.explode("child").alias("child"), F.col("id").alias("into"), "h", F.lit(rounds).alias("round"))
        merges = new if merges is None else merges.unionByName(new)
        groups, rounds = merged.drop("child"), rounds + 1
        now = groups.count()
        if now == left:
            raise RuntimeError("no two groups are each other's nearest: is a vector without a value?")
        left = now
    rest = [(h, rounds + at, child, into) for at, (child, into, h) in enumerate(_rest(groups))]
    highest = [(r.h, r["round"], r.child, r["into"]) for r in merges.orderBy(F.desc("h"), F.desc("round"), "child").limit(k - 1).collect()] if merges is not None else []
    cut = sorted(rest + highest, key=lambda m: (-m[0], -m[1], m[2]))[: k - 1]
    taken = {child for _, _, child, _ in cut}
    last = [(child, into) for _, _, child, into in rest if child not in taken]
    up = spark.createDataFrame(last, "id long, up long")  # FEW at most
    if merges is not None:
        up = up.unionByName(merges.where(~F.col("child").isin(sorted(taken))).select(F.col("child").alias("id"), F.col("into").alias("up")))
    labels = kept(vectors.select("id").join(up, "id", "left").select("id", F.coalesce("up", "id").alias("up")))
    while True:  # each jump doubles the steps
        onward = labels.select(F.col("id").alias("up"), F.col("up").alias("far"))
        new = kept(labels.join(onward, "up").select("id", "up", "far"))
        labels = new.select("id", F.col("far").alias("up"))
        if not new.where("up <> far").head(1):
            return labels.select("id", F.col("up").alias("label"))
