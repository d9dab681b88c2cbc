"""Clusterers fitted to vectors of any number, by rounds in which tasks return partial sums.

A round sends the parameters out, each task adds up what its rows contribute and returns one row of sums, and the sums make the next
parameters. Several starts go side by side in each round. Random starts are hashes of identifiers, so they depend on no order of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import FLOOR, memberships, softmax, squared
from .selection import quantiles

#: Rows of a task at least, and tasks for each core at most. Sums of up to DIRECT tasks and BYTES bytes go straight to the driver; of more, they are
#: added up in GROUPS tasks before, so that what a round sends doesn't grow with the rows.
TASK_ROWS, WAVES, DIRECT, BYTES, GROUPS = 2_000, 1, 64, 1 << 18, 1
#: Rows that are kept together as one matrix, and steps of the best start after all are still by tolerance, against cycles of rounding.
PACK, SETTLED = 4_096, 10_000

Sums = list[np.ndarray]


class Vectors:
    """Rows (id, z) that a fit goes over again and again."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("z")).alias("d")).first()
        self.n, self.d = size.n, size.d or 0
        self.tasks = max(1, min(self.n // TASK_ROWS, WAVES * spark.sparkContext.defaultParallelism))
        self.rows = rows.select("id", "z").repartition(self.tasks, "id").persist()
        self.packs = self.rows.mapInArrow(_together(self.d), "ids binary, z binary").persist()

    def close(self) -> None:
        self.packs.unpersist()
        self.rows.unpersist()

    def summed(self, of: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
        """The sums over all rows of what of(ids, vectors) gives for some of them."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total: Sums | None = None
            for ids, x in _apart(batches, d):
                own = of(ids, x)
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
            if total is not None:
                yield _packed(TaskContext.get().partitionId() % GROUPS, total)

        def add(key: tuple, rows: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_packed(key[0].as_py(), _added(zip(rows.column("shapes").to_pylist(), rows.column("sums").to_pylist(), strict=True)))])

        out = self.packs.mapInArrow(run, _SUMS)
        size = sum(np.asarray(x, float).nbytes for x in of(np.empty(0, np.int64), np.empty((0, d))))
        if self.tasks > DIRECT or self.tasks * size > BYTES:
            out = out.groupBy("part").applyInArrow(add, _SUMS)
        return _added((r["shapes"], r["sums"]) for r in out.collect())  # DIRECT or GROUPS rows of sums

    def mapped(self, of: Callable[[np.ndarray], np.ndarray], shape: str) -> DataFrame:
        """id and of(vectors)."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = of(batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) if batch.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(out) if out.ndim > 1 else out)], names=["id", shape.split()[0]])

        return self.rows.mapInArrow(run, f"id {self.rows.schema['id'].dataType.simpleString()}, {shape}")


def _together(d: int):
    """Rows as matrices: their bytes, which need no conversion in the rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PACK):
                own = batch.slice(a, PACK)
                z = own.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (own.column("id").to_numpy().astype(np.int64), z)], names=["ids", "z"])

    return run


def _apart(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, z in zip(batch.column("ids"), batch.column("z"), strict=True):
            yield np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(z.as_buffer(), float).reshape(-1, d)


_SUMS = "part int, shapes array<array<int>>, sums array<binary>"


def _packed(part: int, sums: Sums) -> pa.RecordBatch:
    own = [np.asarray(x, float) for x in sums]
    kinds = [pa.int32(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, [list(x.shape) for x in own], [x.tobytes() for x in own]), kinds, strict=True)], names=["part", "shapes", "sums"])


def _added(rows) -> Sums:
    total: Sums = []
    for shapes, sums in rows:
        own = [np.frombuffer(b, float).reshape(s) for s, b in zip(shapes, sums, strict=True)]
        total = [a + b for a, b in zip(total, own, strict=True)] if total else own
    return total


def uniform(ids: np.ndarray, salt: int, width: int) -> np.ndarray:
    """Numbers between 0 and 1 for each identifier: finalised hashes."""
    x = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(width, dtype=np.uint64) + np.uint64(salt * 1_000_003 + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def in_order(c: np.ndarray) -> np.ndarray:
    """Centres by their first coordinates."""
    return np.lexsort(c.T[::-1])


# k-means -----------------------------------------------------------------------------------------------------------------------------------


def candidates(v: Vectors, k: int, seed: int, prepare: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Some 4 * k * rounds rows that lie far from each other, with the number of rows that each is the nearest of."""
    least = v.rows.select(F.min(F.struct(F.xxhash64("id", F.lit(seed)), "id")).alias("m")).first().m["id"]
    d = v.d

    def chosen(of) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _apart(batches, d):
                ids, x = prepare(ids, x)
                own = of(ids, x)
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(list(x[own]), pa.list_(pa.float64()))], names=["id", "x"])

        got = v.packs.mapInArrow(run, "id long, x array<double>").collect()  # some 4 * k rows
        return np.array([r.x for r in sorted(got, key=lambda r: r.id)], float).reshape(len(got), v.d)

    c = chosen(lambda ids, x: ids == least)
    if not len(c):  # the first row is left out by prepare: the first of the others
        first = v.summed(lambda ids, x: [prepare(ids, x)[1].sum(0), np.array([len(prepare(ids, x)[0])])])
        c = (first[0] / max(first[1][0], 1))[None]
    for number in range(rounds):
        def far(ids, x, c=c):
            return squared(prepare(ids, x)[1], c).min(1).sum(keepdims=True)

        cost = v.summed(lambda ids, x: [far(ids, x)])[0][0]
        if cost <= 0:
            break
        new = chosen(lambda ids, x, c=c, cost=cost, number=number: uniform(ids, seed + 7919 * (number + 1), 1)[:, 0] < 4 * k * squared(x, c).min(1) / cost)
        c = np.vstack([c, new]) if len(new) else c
    c = np.unique(c, axis=0)

    def nearest(ids, x):
        own = prepare(ids, x)[1]
        return [np.bincount(squared(own, c).argmin(1), minlength=len(c)).astype(float)] if len(own) else [np.zeros(len(c))]

    return c, v.summed(nearest)[0]


def _all(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids, x


def kmeans_starts(v: Vectors, k: int, seed: int = 0, n_init: int = 10, iterations: int = 300, prepare=_all) -> tuple[np.ndarray, np.ndarray]:
    """The centres of n_init starts, which are drawn from the candidates by their weights and distances, and their costs. prepare: which rows count, and as what."""
    c, weight = candidates(v, k, seed, prepare)
    rng, starts = np.random.default_rng(seed), []
    for _ in range(n_init):
        own = c[[rng.choice(len(c), p=weight / weight.sum())]]
        while len(own) < k:
            d = weight * squared(c, own).min(1)
            own = np.vstack([own, c[rng.choice(len(c), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(c))]])
        starts.append(own)
    centres = np.stack(starts)

    cost, live = np.zeros(n_init), np.ones(n_init, bool)
    for _ in range(iterations):
        def step(ids: np.ndarray, x: np.ndarray, centres=centres, live=live) -> Sums:
            _, x = prepare(ids, x)
            counts, sums, cost = np.zeros(centres.shape[:2]), np.zeros_like(centres), np.zeros(len(centres))
            for s in np.flatnonzero(live):
                if len(x):
                    d = squared(x, centres[s])
                    one = np.eye(k)[d.argmin(1)]
                    counts[s], sums[s], cost[s] = one.sum(0), one.T @ x, d.min(1).sum()
            return [counts, sums, cost]

        counts, sums, told = v.summed(step)
        cost = np.where(live, told, cost)
        new = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], centres)
        live = live & ~np.isclose(new, centres, atol=1e-10).all((1, 2))  # a start that is still takes no further steps
        if not live.any():
            break
        centres = np.where(live[:, None, None], new, centres)
    return centres, cost


def settled(v: Vectors, centres: np.ndarray, prepare=_all) -> np.ndarray:
    """Centres after further steps, until no row changes its group: then they are the means of their own groups."""
    before, k = None, len(centres)
    for _ in range(SETTLED):
        def step(ids: np.ndarray, x: np.ndarray, centres=centres, before=before) -> Sums:
            _, x = prepare(ids, x)
            label = squared(x, centres).argmin(1)
            one = np.eye(k)[label]
            return [one.sum(0), one.T @ x, np.array([(label != squared(x, before).argmin(1)).sum() if before is not None else 1.0])]

        counts, sums, moved = v.summed(step)
        if not moved[0]:
            break
        before, centres = centres, np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def kmeans(v: Vectors, k: int, seed: int = 0, n_init: int = 10, prepare=_all, **more) -> np.ndarray:
    """The centres of the best start, settled."""
    centres, cost = kmeans_starts(v, k, seed, n_init, prepare=prepare, **more)
    best = settled(v, centres[int(cost.argmin())], prepare)
    return best[in_order(best)]


def label_means(v: Vectors, labels: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Means of the vectors of each label; that of all where a label has none."""

    def step(ids: np.ndarray, x: np.ndarray) -> Sums:
        one = np.eye(k)[labels(x)]
        return [one.sum(0), one.T @ x, x.sum(0)]

    n, sums, total = v.summed(step)
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], total / v.n)


class Fit:
    """What is left of a fit: memberships and, where there are groups, labels of vectors."""

    def __init__(self, predict: Callable[[np.ndarray], np.ndarray], labels: Callable[[np.ndarray], np.ndarray] | None = None):
        self.predict, self.labels = predict, labels


def _prototyped(v: Vectors, labels: Callable[[np.ndarray], np.ndarray], k: int, temperature: float) -> Fit:
    means = label_means(v, labels, k)
    return Fit(lambda x: softmax(squared(x, means), temperature), labels)


def kmeans_soft(v: Vectors, k: int, temperature: float = 1.0, seed: int = 0) -> Fit:
    c = kmeans(v, k, seed)
    return _prototyped(v, lambda x: squared(x, c).argmin(1), k, temperature)


def two_stage(v: Vectors, k: int, quantile: float = 0.9, temperature: float = 1.0, seed: int = 0) -> Fit:
    """Rows far from the mean (from the quantile on) are regime 0, the others k-means of their directions."""
    if k < 2:
        raise ValueError("two stages need two regimes at least")
    mean = v.summed(lambda ids, x: [x.sum(0)])[0] / v.n
    far = lambda x: ((x - mean) ** 2).sum(1)
    (edge,) = quantiles(v.mapped(far, "v double").select("v"), [quantile])
    inner = v.summed(lambda ids, x: [np.array([(far(x) < edge).sum()])])[0][0]
    edge = edge if inner >= k - 1 else np.inf
    turned = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = kmeans(v, k - 1, seed, prepare=lambda ids, x: (ids[far(x) < edge], turned(x[far(x) < edge])))
    return _prototyped(v, lambda x: np.where(far(x) >= edge, 0, 1 + squared(turned(x), c).argmin(1)), k, temperature)


# fuzzy c-means and mixtures ------------------------------------------------------------------------------------------------------------------


def fuzzy_cmeans(v: Vectors, k: int, m: float = 2.0, error: float = 1e-5, iterations: int = 300, seed: int = 0) -> Fit:
    def shares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        u = np.maximum(np.sqrt(squared(x, c)), np.finfo(float).eps) ** (-2 / (m - 1))
        return u / u.sum(1, keepdims=True)

    def random(ids: np.ndarray) -> np.ndarray:
        u = uniform(ids, seed, k) + FLOOR
        return u / u.sum(1, keepdims=True)

    before: np.ndarray | None = None
    now: np.ndarray | None = None
    for _ in range(iterations):
        def step(ids: np.ndarray, x: np.ndarray, before=before, now=now) -> Sums:
            u = random(ids) if now is None else shares(x, now)
            last = u if now is None else random(ids) if before is None else shares(x, before)
            w = u**m
            return [w.sum(0), w.T @ x, ((u - last) ** 2).sum(keepdims=True)[:1].ravel()]

        weight, sums, moved = v.summed(step)
        if now is not None and np.sqrt(moved[0]) < error:
            break
        before, now = now, sums / weight[:, None]
    c = now[in_order(now)]
    return Fit(lambda x: memberships(shares(x, c)))


def gmm(v: Vectors, k: int, reg: float = 1e-3, iterations: int = 300, tol: float = 1e-3, init: str = "kmeans", n_init: int = 1, seed: int = 0) -> Fit:
    """A mixture of Gaussians with diagonal covariances; all starts take their steps side by side."""
    if init not in ("kmeans", "random", "random_from_data"):
        raise ValueError(f"unknown init {init!r}")
    shape = (n_init, k)

    def logs(x: np.ndarray, w: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
        quad = (x * x) @ (1 / var).T - 2 * x @ (mu / var).T + (mu * mu / var).sum(1)
        return np.log(w) - 0.5 * (quad + np.log(2 * np.pi * var).sum(1))

    if init == "kmeans":
        seeds = kmeans_starts(v, k, seed, n_init)[0]
    elif init == "random_from_data":
        rows = [v.rows.orderBy(F.xxhash64("id", F.lit(seed + run)), "id").limit(k).collect() for run in range(n_init)]
        seeds = np.array([[r.z for r in own] for own in rows], float)

    def first(ids: np.ndarray, x: np.ndarray, run: int) -> np.ndarray:
        if init == "random":
            r = uniform(ids, seed + run, k) + FLOOR
            return r / r.sum(1, keepdims=True)
        d = squared(x, seeds[run])
        # of rows from the data, only those rows themselves belong to a component at first
        return np.eye(k)[d.argmin(1)] if init == "kmeans" else (d <= 1e-12).astype(float)

    w = mu = var = None
    last, live = np.full(n_init, -np.inf), np.ones(n_init, bool)
    for _ in range(iterations):
        def step(ids: np.ndarray, x: np.ndarray, w=w, mu=mu, var=var, live=live) -> Sums:
            n, s, q, told = np.zeros(shape), np.zeros((*shape, x.shape[1])), np.zeros((*shape, x.shape[1])), np.zeros(n_init)
            for run in np.flatnonzero(live):
                if w is None:
                    r = first(ids, x, run)
                else:
                    log = logs(x, w[run], mu[run], var[run])
                    top = log.max(1, keepdims=True)
                    norm = top[:, 0] + np.log(np.exp(log - top).sum(1))
                    r, told[run] = np.exp(log - norm[:, None]), norm.sum()
                n[run], s[run], q[run] = r.sum(0), r.T @ x, r.T @ (x * x)
            return [n, s, q, told]

        n, s, q, told = v.summed(step)
        if w is not None:
            now = told / v.n
            live = live & ~(np.abs(now - last) < tol)
            last = np.where(told != 0, now, last)
            if not live.any():
                break
        n = n + 10 * np.finfo(float).eps
        means = s / n[..., None]
        spread = np.maximum(q / n[..., None] - means**2, 0) + reg
        if w is None:
            w, mu, var = n / n.sum(1, keepdims=True), means, spread
        else:
            w, mu, var = np.where(live[:, None], n / n.sum(1, keepdims=True), w), np.where(live[:, None, None], means, mu), np.where(live[:, None, None], spread, var)
    run = int(last.argmax())
    order = in_order(mu[run])
    w, mu, var = w[run][order], mu[run][order], var[run][order]

    def predict(x: np.ndarray) -> np.ndarray:
        log = logs(x, w, mu, var)
        e = np.exp(log - log.max(1, keepdims=True))
        return memberships(e / e.sum(1, keepdims=True))

    return Fit(predict)


#: Clusterers that are fitted in rounds.
ROUNDS = {"gmm": gmm, "kmeans_soft": kmeans_soft, "fuzzy_cmeans": fuzzy_cmeans, "modified_two_stage": two_stage}
