"""Spectral groups of rows of any number: eigenvectors by filtered subspace iteration whose products are made block by block.

No matrix of rows by rows is held. A kernel's entries are made anew in each product, in groups of two blocks; a graph's are edges. The
vectors lie in blocks, too; the driver gets their products with each other alone, a matrix of some twenty rows and columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fits, knn
from .blocks import CHUNK, Kept, blocked, matrix, number, paired
from .cluster import squared

#: Vectors beside those asked for, those for a kernel's dimensions at most; degree of a filter at most, how much it may enlarge vectors that aren't found yet and those that are, and how far from parallel vectors must be
#: for their products to tell.
MORE, MOST, DEGREE, GROWN, FOUND, SOUND = 12, 128, 60, 1e4, 1e11, 1e-6
#: Length of what is left of an eigenvector (of its eigenvalue's distance from the least one), rounds, rows of a graph's block at most, and rows that make a further one worth it.
LEFT, ROUNDS, GRAPH, ROWS = 1e-6, 500, 65_536, 2_048
#: Products of one job at most, and bytes that they shuffle: a job's files are deleted when it ends.
CHAIN, SHUFFLED = 10, 2e9

_STATE = {"block": pa.int32(), "n": pa.int64(), "x": pa.binary(), "s": pa.binary(), "y": pa.binary(), "p": pa.binary()}
_MESSAGE = {**_STATE, "at": pa.binary(), "w": pa.binary()}
_STATE_DDL = "block int, n long, x binary, s binary, y binary, p binary"
_MESSAGE_DDL = f"{_STATE_DDL}, at binary, w binary"
#: What becomes of a block: (sum, scale, y, p) -> (scale, y, p).
After = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _table(rows: list[dict], shape: dict) -> pa.Table:
    return pa.table({name: pa.array([r.get(name) for r in rows], kind) for name, kind in shape.items()})


def _chain(cells: float) -> int:
    """Products of one job, of which each shuffles so many numbers."""
    return max(1, min(CHAIN, int(SHUFFLED / (8 * cells))))


def _total(rows: list[dict], after: After) -> dict:
    """A block after a product, of its state and the partial sums."""
    own = next(r for r in rows if r["y"] is not None)
    n = own["n"]
    s, y, p = (matrix(own[c], n) for c in ("s", "y", "p"))
    total = np.zeros_like(y)
    for r in sorted((r for r in rows if r["w"] is not None), key=lambda r: r["w"]):  # in one order, whatever came first
        if r["at"] is None:
            total += matrix(r["w"], n)
        else:
            at = np.frombuffer(r["at"], np.int32)
            total[at] += matrix(r["w"], len(at))
    s, y, p = after(total, s, y, p)
    return {**own, "s": s.tobytes(), "y": y.tobytes(), "p": p.tobytes()}


def _summed(messages: DataFrame, after: After) -> DataFrame:
    """The blocks after a product, of its partial sums."""
    return messages.groupBy("block").applyInArrow(lambda key, rows: _table([_total(rows.to_pylist(), after)], _STATE), _STATE_DDL)


class Kernel:
    """exp(-gamma * squared distance) of all rows, between the scales of its rows."""

    def __init__(self, gamma: float, blocks: int, chain: int = CHAIN):
        self.gamma, self.blocks, self.chain = gamma, blocks, chain

    def onward(self, messages: DataFrame, after: After) -> DataFrame:
        return self.messages(_summed(messages, after))

    def close(self) -> None:
        pass

    def messages(self, state: DataFrame) -> DataFrame:
        gamma = self.gamma

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            own = {r["block"]: r for r in rows.select(list(_STATE)).to_pylist()}
            i, j = (k.as_py() for k in key)
            if i not in own or j not in own:  # a block without rows
                return _table([], _MESSAGE)
            x, u = ({b: of(r) for b, r in own.items()} for of in (lambda r: matrix(r["x"], r["n"]), lambda r: matrix(r["s"], r["n"]) * matrix(r["y"], r["n"])))
            out = {b: np.zeros_like(u[b]) for b in own}
            for a in range(0, len(x[i]), CHUNK):
                for b in range(0, len(x[j]), CHUNK):
                    e = squared(x[i][a : a + CHUNK], x[j][b : b + CHUNK])
                    e *= -gamma
                    np.exp(e, out=e)
                    out[i][a : a + CHUNK] += e @ u[j][b : b + CHUNK]
                    if i != j:
                        out[j][b : b + CHUNK] += e.T @ u[i][a : a + CHUNK]
            return _table([{**(r if i == j else {"block": b, "n": r["n"]}), "w": out[b].tobytes()} for b, r in own.items()], _MESSAGE)

        # a block's p stays with itself
        met = paired(state, self.blocks, "p").groupBy("i", "j")
        return met.applyInArrow(run, _MESSAGE_DDL)


class Graph:
    """A symmetric matrix as edges (id, other, w), of which equal ones are added up."""

    def __init__(self, edges: DataFrame, rows: DataFrame, blocks: int, chain: int = CHAIN):
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids"), strict=True):
                    own = np.frombuffer(ids.as_buffer(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block, np.int32)), pa.array(np.arange(len(own), dtype=np.int32))], names=["id", "block", "at"])

        place = rows.mapInArrow(places, "id long, block int, at int")
        one = place.select(F.col("id"), F.col("block").alias("to"), F.col("at").alias("row"))
        two = place.select(F.col("id").alias("other"), "block", F.col("at").alias("col"))
        found = edges.groupBy("id", "other").agg(F.sum("w").alias("w")).join(one, "id").join(two, "other")

        def pack(key: tuple, own: pa.Table) -> pa.Table:
            own = own.sort_by([("row", "ascending"), ("col", "ascending")])
            cells = [pa.array([own[c].to_numpy().tobytes()], pa.binary()) for c in ("row", "col", "w")]
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "to": pa.array([key[1].as_py()], pa.int32()), **dict(zip(("row", "col", "w"), cells, strict=True))})

        packed = found.select("block", "to", "row", "col", "w").groupBy("block", "to").applyInArrow(pack, "block int, to int, row binary, col binary, w binary")
        # held by block, so that a product shuffles vectors alone
        self.edges, self.chain = packed.repartition(blocks, "block").persist(), chain

    def close(self) -> None:
        self.edges.unpersist()

    def _sent(self, rows: DataFrame, after: After | None) -> DataFrame:
        def run(rows: pa.Table, edges: pa.Table) -> pa.Table:
            rows, out = rows.to_pylist(), []
            if rows:
                own = rows[0] if after is None else _total(rows, after)
                y = matrix(own["y"], own["n"])
                out.append(own | {"at": None, "w": None})
                for e in edges.to_pylist():
                    row, col, w = np.frombuffer(e["row"], np.int32), np.frombuffer(e["col"], np.int32), np.frombuffer(e["w"], float)
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    out.append({"block": e["to"], "at": row[first].tobytes(), "w": np.add.reduceat(w[:, None] * y[col], first, axis=0).tobytes()})
            return _table(out, _MESSAGE)

        return rows.groupBy("block").cogroup(self.edges.groupBy("block")).applyInArrow(run, _MESSAGE_DDL)

    def messages(self, state: DataFrame) -> DataFrame:
        return self._sent(state, None)

    def onward(self, messages: DataFrame, after: After) -> DataFrame:
        """The next product's partial sums: a block is added up where it is multiplied."""
        return self._sent(messages, after)


def _changed(state: DataFrame, of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The blocks with y and p made anew, each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                y, p = of(matrix(r["y"], r["n"]), matrix(r["p"], r["n"]))
                yield from _table([{**r, "y": y.tobytes(), "p": p.tobytes()}], _STATE).to_batches()

    return state.mapInArrow(run, _STATE_DDL)


def _products(state: DataFrame) -> list[np.ndarray]:
    """y'y, y'p and p'p of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for r in batch.to_pylist():
                y, p = matrix(r["y"], r["n"]), matrix(r["p"], r["n"])
                own = np.stack([y.T @ y, y.T @ p, p.T @ p])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    found = [np.frombuffer(r.sums, float) for r in state.mapInArrow(run, "sums binary").collect()]  # a few kB of each task
    total = np.sum(sorted(found, key=lambda a: a.tolist()), axis=0)
    width = round((len(total) / 3) ** 0.5)
    return list(total.reshape(3, width, width))


def _ritz(yy: np.ndarray, yp: np.ndarray, pp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Ritz values, largest first, their vectors in terms of y, the lengths of what is left of them, and whether y is far enough from parallel for these to hold."""
    scale = 1 / np.sqrt(np.maximum(np.diag(yy), 1e-300))
    g, c = np.linalg.eigh(yy * scale[:, None] * scale)
    ok = g > 1e-12 * g[-1]
    t = scale[:, None] * c[:, ok] / np.sqrt(g[ok])
    h = t.T @ yp @ t
    theta, u = np.linalg.eigh((h + h.T) / 2)
    theta, r = theta[::-1], (t @ u)[:, ::-1]
    return theta, r, np.sqrt(np.maximum(((pp @ r) * r).sum(0) - theta**2, 0)), bool(g[0] > SOUND * g[-1])


def _degree(first: float, open_: float) -> int:
    """Degree of the filter: the largest that doesn't enlarge the first eigenvector, and the first that isn't found yet, too much."""
    grown = lambda m, x: m * np.arccosh(max(x, 1.0))
    return next((m for m in range(DEGREE, 1, -1) if grown(m, first) <= np.arccosh(FOUND) and grown(m, open_) <= np.arccosh(GROWN)), 1)


def leading(operator: Kernel | Graph, state: DataFrame, k: int, low: float, kept: Kept) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Blocks whose y times the matrix has the k eigenvectors of the largest eigenvalues as its columns, that matrix, and the eigenvalues. low: a bound below all eigenvalues."""
    last: After = lambda w, s, y, p: (s, y, s * w)
    afters, made = [last], None
    for _ in range(ROUNDS):
        while afters:
            now, afters = afters[: operator.chain], afters[operator.chain :]
            messages = operator.messages(state)
            for after in now[:-1]:
                messages = operator.onward(messages, after)
            state = made = kept(_summed(messages, now[-1]), made)
        theta, r, left, sound = _ritz(*_products(state))
        found = left <= LEFT * np.maximum(theta - low, 1e-12)
        if len(theta) < k or (sound and found[:k].all()):
            return state, r[:, :k], theta[:k]
        middle, half = (low + theta[-1]) / 2, max((theta[-1] - low) / 2, 1e-12)
        degree = _degree((theta[0] - middle) / half, (theta[np.flatnonzero(~found)[:1]].max(initial=low) - middle) / half)
        state = _changed(state, lambda y, p, r=r, c=middle, e=half: ((p @ r - c * (y @ r)) / e, y @ r))
        afters = [lambda w, s, y, p, c=middle, e=half: (s, 2 / e * (s * w - c * y) - p, y)] * (degree - 1) + [last]
    raise RuntimeError(f"eigenvectors were not found in {ROUNDS} rounds")


def _started(rows: DataFrame, width: int, seed: int, whole: bool) -> DataFrame:
    """Blocks with random vectors of hashes of identifiers; whole: with their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                y = fits.uniform(np.frombuffer(r["ids"], np.int64), seed, width) - 0.5
                yield from _table([{"block": r["block"], "n": r["n"], "x": r["x"] if whole else b"", "s": np.ones((r["n"], 1)).tobytes(), "y": y.tobytes(), "p": y.tobytes()}], _STATE).to_batches()

    return rows.mapInArrow(run, _STATE_DDL)


def _embedding(rows: DataFrame, state: DataFrame, r: np.ndarray, unit: bool) -> DataFrame:
    """id, z: each row of the eigenvectors, of length 1 if unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                v = matrix(b["y"], b["n"]) @ r
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if unit else v
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b["ids"], np.int64)), pa.array(list(v), pa.list_(pa.float64()))], names=["id", "z"])

    return rows.select("block", "n", "ids").join(state.select("block", "y"), "block").mapInArrow(run, "id long, z array<double>")


def _grouped(rows: DataFrame, found: tuple, k: int, seed: int, unit: bool, kept: Kept) -> DataFrame:
    state, r, _ = found
    v = fits.Vectors(kept(_embedding(rows, state, r, unit)))
    c = fits.kmeans(v, k, seed)
    out = kept(v.mapped(lambda z: squared(z, c).argmin(1).astype(np.int32), "label int"))
    v.close()
    return out


def rbf(vectors: DataFrame, n: int, d: int, k: int, gamma: float | None = None, seed: int = 0) -> DataFrame:
    """id, label: normalised cut of exp(-gamma * squared distance)."""
    kept, blocks = Kept(vectors.sparkSession), number(vectors, n)
    rows = kept(blocked(vectors, blocks))
    width = min(n, k + min(d, MOST) + MORE)  # a kernel that is nearly linear has eigenvalues of some size for each dimension, and few others
    kernel = Kernel(gamma or 1 / d, blocks, _chain(blocks * n * (d + 2 * width)))
    ones = _changed(_started(rows, 1, seed, True), lambda y, p: (np.ones_like(y), np.ones_like(p)))
    degrees = _summed(kernel.messages(ones), lambda w, s, y, p: (np.maximum(w, 1e-12) ** -0.5, y, p)).select("block", "s")
    state = kept(_started(rows, width, seed, True).drop("s").join(degrees, "block").select(*_STATE))
    return _grouped(rows, leading(kernel, state, k, 0.0, kept), k, seed, True, kept)


def _graph(vectors: DataFrame, n: int, k: int, edges: DataFrame, low: float, width: int, unit: bool, seed: int, kept: Kept) -> DataFrame:
    blocks = max(1, -(-n // GRAPH), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, n // ROWS))
    rows = kept(blocked(vectors, blocks))
    wide = min(n, width + MORE)
    state = kept(_started(rows, wide, seed, False))
    graph = Graph(edges, rows, blocks, _chain((blocks + 2) * n * wide))
    out = _grouped(rows, leading(graph, state, width, low, kept), k, seed, unit, kept)
    graph.close()
    return out


def _both(near: DataFrame, w) -> DataFrame:
    """Half of each edge in either direction, equal ones added up."""
    half = near.select(F.col("q").alias("id"), F.col("id").alias("other"), (w / 2).alias("w"))
    return half.unionByName(half.select(F.col("other").alias("id"), F.col("id").alias("other"), "w")).groupBy("id", "other").agg(F.sum("w").alias("w"))


def nearest(vectors: DataFrame, n: int, d: int, k: int, neighbours: int = 10, seed: int = 0) -> DataFrame:
    """id, label: normalised cut of the graph of each row's nearest rows (itself among them)."""
    kept = Kept(vectors.sparkSession)
    edges = kept(_both(knn.neighbours(vectors, vectors, neighbours, "l2", exclude_self=False), F.lit(1.0)))
    scale = edges.groupBy("id").agg(F.pow(F.greatest(F.sum("w"), F.lit(1e-12)), F.lit(-0.5)).alias("s"))
    cut = edges.join(scale, "id").join(scale.select(F.col("id").alias("other"), F.col("s").alias("so")), "other").select("id", "other", (F.col("s") * F.col("w") * F.col("so")).alias("w"))
    return _graph(vectors, n, k, cut, -1.0, k, True, seed, kept)


def signed(vectors: DataFrame, n: int, d: int, k: int, neighbours: int = 15, seed: int = 0) -> DataFrame:
    """id, label: signed Laplacian of the graph of each row's rows of largest cosine, weighed by it."""
    kept = Kept(vectors.sparkSession)
    edges = kept(_both(knn.neighbours(vectors, vectors, min(max(2, neighbours), n - 1), "cosine"), 1 - F.col("dist")))
    degree = edges.groupBy("id").agg(F.sum(F.abs("w")).alias("d"))
    # no eigenvalue of the Laplacian is larger than a row's degree and its neighbours' mean degree together, which tells much more than twice the largest degree
    around = edges.join(degree.select(F.col("id").alias("other"), F.col("d").alias("do")), "other").groupBy("id").agg(F.sum(F.abs("w") * F.col("do")).alias("m"))
    top = degree.join(around, "id").agg(F.max(F.when(F.col("d") > 0, F.col("d") + F.col("m") / F.col("d")).otherwise(0.0))).first()[0] * (1 + 1e-12) + 1e-12
    turned = edges.unionByName(degree.select("id", F.col("id").alias("other"), (top - F.col("d")).alias("w")))
    return _graph(vectors, n, k, turned, 0.0, max(2, min(k, n - 2)), False, seed, kept)


#: Groups by name of clusterer.
GROUPS = {"spectral_rbf": rbf, "spectral_knn": nearest, "signed_knn_spectral": signed}
