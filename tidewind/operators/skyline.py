"""Rows that no other row is as good as everywhere and better than somewhere, from tables of any number of rows.

Tasks first leave out what their own rows dominate. A row can only be dominated by one that comes before it when rows are sorted by all
objectives, so of the rest the first BLOCK points are settled among themselves, those left dominate what they can of the others, and so on:
as many rounds as there are blocks in the front, none of which compares all rows with all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that are settled on the driver in one round.
BLOCK = 4096


def dominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which of the points x are dominated by one of the others."""
    out = np.zeros(len(x), bool)
    for a in range(0, len(by), 1024):
        for b in range(0, len(x), 1024):
            one, two = by[None, a : a + 1024], x[b : b + 1024, None]
            out[b : b + 1024] |= ((one >= two).all(2) & (one > two).any(2)).any(1)
    return out


def front(x: np.ndarray) -> np.ndarray:
    """The points that none dominates."""
    x = x[np.lexsort(x.T[::-1])[::-1]]
    kept = x[:0]
    for a in range(0, len(x), 256):
        own = x[a : a + 256]
        own = own[~dominated(own, kept)]
        kept = np.vstack([kept, own[~dominated(own, own)]])
    return kept


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _batch(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(x.T)], names=[f"c{k}" for k in range(x.shape[1])])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's points leave of each other."""
    kept: np.ndarray | None = None
    for batch in batches:
        if batch.num_rows:
            x = _points(batch)
            kept = front(x if kept is None else np.vstack([kept, x]))
    if kept is not None:
        yield _batch(kept)


def _without(settled: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _points(batch)
            yield _batch(x[~dominated(x, settled)])

    return run


def skyline(rows: DataFrame, up: list[str], down: list[str], block: int = BLOCK) -> DataFrame:
    """The rows that none dominates: more is better of the columns up, less of the columns down. Equal rows stay together; a row that lacks a value neither dominates nor is dominated."""
    names = [f"c{k}" for k in range(len(up) + len(down))]
    signed = [F.col(c).cast("double") for c in up] + [-F.col(c).cast("double") for c in down]
    whole = F.lit(True)
    for c in (*up, *down):
        whole = whole & F.col(c).isNotNull()
    shape = ", ".join(f"{n} double" for n in names)
    rows = rows.persist()  # sums of doubles may come out otherwise when they are made again, and points are found by their values
    rest = rows.where(whole).select(*[c.alias(n) for c, n in zip(signed, names, strict=True)]).distinct().mapInArrow(_local, shape).persist()
    first, settled = rest, []
    while True:
        top = np.array([tuple(r) for r in rest.orderBy(*[F.desc(n) for n in names]).limit(block).collect()], float).reshape(-1, len(names))
        own = front(top)
        settled.append(own)
        if len(top) < block:
            break
        # what comes after the block's last point, and isn't dominated by a point of the block
        after, equal = F.lit(False), F.lit(True)
        for n, last in zip(names, top[-1].tolist(), strict=True):
            after = after | (equal & (F.col(n) < F.lit(last)))
            equal = equal & (F.col(n) == F.lit(last))
        rest = rest.where(after).mapInArrow(_without(own), shape)
    first.unpersist()
    kept = rows.sparkSession.createDataFrame([tuple(map(float, p)) for own in settled for p in own], shape)
    found = rows.join(kept, [c == kept[n] for c, n in zip(signed, names, strict=True)], "left_semi")
    return found.unionByName(rows.where(~whole))
