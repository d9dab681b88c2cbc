"""Exact nearest neighbours, their weights, and weighted forecasts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.vectors import canonical

#: Queries and rows of the index that meet in one group at most, and rows of a part of the index that make it worth a group of its own.
BLOCK, PART, LEAST = 16_384, 65_536, 1_000
#: Queries and rows whose distances are in memory at once, and pairs whose distances are made again.
ASKED, ROWS, PAIRS = 64, 2_048, 1 << 16
_EPS = float(np.finfo(float).eps)


def neighbours(queries: DataFrame, index: DataFrame, k: int, distance: str = "l2", p: float | None = None, exclude_self: bool = True) -> DataFrame:
    """q, id, dist, rank: the k nearest of index (id, z) to each query (id, z); ties by id, missing distances last.

    Queries come in blocks and the index in parts, both of bounded size. Each block meets each part in one group, which keeps its own k best
    of each query; only those are shuffled again."""
    same = queries is index
    n = index.count()
    blocks = max(1, -(-(n if same else queries.count()) // BLOCK))
    parts = max(1, -(-n // PART), min(4 * index.sparkSession.sparkContext.defaultParallelism // blocks, n // LEAST))
    asked = queries.select(F.col("id").alias("q"), F.col("z").alias("zq"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.select("q", "zq", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "block")
    held = index.select("id", "z", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
    held = held.select("id", "z", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, index)]
    near = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(_nearest(k, distance, p, exclude_self), f"q {kinds[0]}, id {kinds[1]}, dist double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.asc_nulls_last("dist"), "id"))).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Vectors as rows; those that are missing or of another length than d have no value."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    values = lambda c: c.combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    whole = lengths == d
    if whole.all():
        return values(column).reshape(-1, d)
    out = np.full((len(lengths), d), np.nan)
    out[whole] = values(column.filter(pa.array(whole))).reshape(-1, d)
    return out


def _pair_distances(name: str, p: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of the rows of a and b, two by two, added up in the order of their values."""

    def added(a: np.ndarray, b: np.ndarray, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        s = np.zeros(len(a))
        for x, y in zip(a.T, b.T, strict=True):
            s = np.maximum(s, of(x, y)) if name == "chebyshev" else s + of(x, y)
        return s

    def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        aa, bb = (np.sqrt(added(x, x, np.multiply)) for x in (a, b))
        similar = np.clip(added(a, b, np.multiply) / np.maximum(aa * bb, 1e-12), -1.0, 1.0)
        return 1.0 - similar if name == "cosine" else np.arccos(similar)

    if name in ("cosine", "angular"):
        return angle
    if name == "l2" or (name == "lp" and p == 2):
        return lambda a, b: np.sqrt(added(a, b, lambda x, y: (x - y) * (x - y)))
    if name in ("l1", "chebyshev") or p == 1:
        return lambda a, b: added(a, b, lambda x, y: np.abs(x - y))
    return lambda a, b: added(a, b, lambda x, y: np.abs(x - y) ** p) ** (1.0 / p)


def _block_distances(name: str, p: float) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Numbers in the order of the distances of all rows of a to all of b, but for rounding, and for each row of a by how much that may be off at most."""

    def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        return aa[:, None] - 2 * (a @ b.T) + bb[None], 16 * (a.shape[1] + 8) * _EPS * (aa + bb.max())

    def similarities(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        aa, bb = (np.sqrt((x * x).sum(1)) for x in (a, b))
        return -np.clip((a @ b.T) / np.maximum(aa[:, None] * bb[None], 1e-12), -1.0, 1.0), np.full(len(a), 16 * (a.shape[1] + 8) * _EPS)

    def sums(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, columns = np.empty((len(a), len(b))), np.ascontiguousarray(a.T)
        for begin in range(0, len(b), ROWS):
            part = np.ascontiguousarray(b[begin : begin + ROWS].T)
            total, x, y = (np.zeros((len(a), part.shape[1])) for _ in range(3))
            for one, two in zip(columns, part, strict=True):
                np.subtract(one[:, None], two[None], out=x)
                np.abs(x, out=x)
                if name == "chebyshev":
                    np.maximum(total, x, out=total)
                    continue
                if name == "lp" and p == 3:  # a power takes many times as long as two products
                    np.multiply(x, x, out=y)
                    np.multiply(x, y, out=x)
                elif name == "lp" and p != 1:
                    np.power(x, p, out=x)
                np.add(total, x, out=total)
            out[:, begin : begin + ROWS] = total
        return out, np.zeros(len(a))

    if name in ("cosine", "angular"):
        return similarities
    return squares if name == "l2" or (name == "lp" and p == 2) else sums


def _nearest(k: int, distance: str, p: float | None, exclude_self: bool):
    """The k nearest rows of a part to each query of a block: those that may be by all distances at once, then by distances made one by one."""
    name, order = canonical(distance), 2.0 if p is None else float(p)
    if not order > 0:
        raise ValueError("p must be positive")
    if order == float("inf") and name == "lp":
        name = "chebyshev"
    block, pairs = _block_distances(name, order), _pair_distances(name, order)

    def kept(zq: np.ndarray, q: np.ndarray, z: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        about, off = block(zq, z)
        other = q[:, None] != ids[None] if exclude_self else np.ones(about.shape, bool)
        about[~other] = np.inf
        if about.shape[1] > k:
            edge = np.partition(about, k - 1, axis=1)[:, k - 1]
            edge = edge + 2 * off + 1e-12 * np.abs(edge)
            other &= ~(about > edge[:, None])
        row, column = np.nonzero(other)
        dist = np.concatenate([pairs(zq[row[a : a + PAIRS]], z[column[a : a + PAIRS]]) for a in range(0, len(row), PAIRS)] or [np.empty(0)])
        by = np.lexsort((ids[column], dist, row))
        row, column, dist = row[by], column[by], dist[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < k], column[place < k], dist[place < k]

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        lengths = [pc.max(pc.list_value_length(c)).as_py() or 0 for c in (asked["zq"], held["z"])]
        d = max(lengths)
        zq, z = _matrix(asked["zq"], d), _matrix(held["z"], d)
        q, ids = asked["q"].to_numpy(), held["id"].to_numpy()
        found = []
        with np.errstate(all="ignore"):
            for a in range(0, len(q) if len(ids) else 0, ASKED):
                row, column, dist = kept(zq[a : a + ASKED], q[a : a + ASKED], z, ids)
                found.append((row + a, column, dist))
        row, column, dist = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"q": pa.array(q[row]), "id": pa.array(ids[column]), "dist": pa.array(dist, pa.float64(), from_pandas=True)})

    return run


def eligible(near: DataFrame, k: int, horizon: int, gap: int, overshoot: int = 5, strict: bool = False) -> DataFrame:
    """Neighbours whose anchor (id) is at most q - horizon - gap: of the overshoot * k nearest, or with strict of all; then the first k."""
    pool = near if strict else near.where(F.col("rank") <= overshoot * k)
    ok = pool.where(F.col("id") <= F.col("q") - horizon - max(gap, 0))
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))).where(F.col("rank") <= k)


def by_query() -> WindowSpec:
    return Window.partitionBy("q")


def kernel_weights(near: DataFrame, tau: float) -> DataFrame:
    """kappa: exp(-dist / tau), normalised for each query."""
    e = F.exp(-F.col("dist") / max(tau, 1e-12))
    return near.withColumn("kappa", e / F.sum(e).over(by_query()))


def inverse_weights(near: DataFrame, eps: float = 1e-8) -> DataFrame:
    e = 1.0 / (F.col("dist") + eps)
    return near.withColumn("kappa", e / F.sum(e).over(by_query()))


def rank_weights(near: DataFrame) -> DataFrame:
    e = 1.0 / F.col("rank")
    return near.withColumn("kappa", e / F.sum(e).over(by_query()))


def regime_weights(weighted: DataFrame, pi: DataFrame) -> DataFrame:
    """q, id, k, w: kappa times the neighbour's membership of regime k, normalised over neighbours."""
    rows = weighted.join(pi.select(F.col("anchor").alias("id"), "p"), "id").select("q", "id", "kappa", F.posexplode("p").alias("k", "pk"))
    x = F.col("kappa") * F.col("pk")
    return rows.withColumn("w", x / F.greatest(F.sum(x).over(Window.partitionBy("q", "k")), F.lit(1e-12))).select("q", "id", "k", "kappa", "pk", "w")


def euclidean_mean(weights: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """q, k, *keys, y: weighted sum of the neighbours' targets (id, *keys, v)."""
    return weights.join(targets, "id").groupBy("q", "k", *keys).agg(F.sum(F.col("w") * F.col("v")).alias("y"))


def regime_mix(per_regime: DataFrame, alpha: DataFrame, keys: list[str]) -> DataFrame:
    """q, *keys, v: sum over regimes of alpha_k times y."""
    a = alpha.select(F.col("anchor").alias("q"), F.posexplode("alpha").alias("k", "ak"))
    return per_regime.join(a, ["q", "k"]).groupBy("q", *keys).agg(F.sum(F.col("ak") * F.col("y")).alias("v"))


def regime_parts(weights: DataFrame, near: DataFrame, alpha: DataFrame) -> DataFrame:
    """q, id, k, kappa, pk, w, ak, part: what each regime gives to a neighbour's total weight."""
    a = alpha.select(F.col("anchor").alias("q"), F.posexplode("alpha").alias("k", "ak"))
    return weights.join(a, ["q", "k"]).select("q", "id", "k", "kappa", "pk", "w", "ak", (F.col("ak") * F.col("w")).alias("part"))


def exported(weights: DataFrame, near: DataFrame, alpha: DataFrame) -> DataFrame:
    """q, id, lag, dist, total_weight: what a forecast was made of."""
    a = alpha.select(F.col("anchor").alias("q"), F.posexplode("alpha").alias("k", "ak"))
    w = weights.join(a, ["q", "k"]).groupBy("q", "id").agg(F.sum(F.col("ak") * F.col("w")).alias("total_weight"))
    return near.join(w, ["q", "id"]).select("q", "id", (F.col("q") - F.col("id")).alias("lag"), "dist", "rank", "total_weight")
