"""Rows in blocks of bounded size, and groups in which two blocks meet, for what compares all rows with all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import paths

#: Rows of a block at most, and rows that make a further block worth it; rows of one block that meet those of another at once.
BLOCK, LEAST, CHUNK = 32_768, 256, 1_024


def number(rows: DataFrame, n: int) -> int:
    """Blocks of n rows: as many as keep the cores busy, more where blocks would be too large."""
    return max(1, -(-n // BLOCK), min(2 * rows.sparkSession.sparkContext.defaultParallelism, n // LEAST))


def block_of(blocks: int):
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")


def blocked(rows: DataFrame, blocks: int) -> DataFrame:
    """block, n, ids, x: the rows (id, z) of each block in order of their identifiers, as matrices."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("id")
        z = own["z"].combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        ids = own["id"].to_numpy().astype(np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": [len(ids)], "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([z.tobytes()], pa.binary())})

    return rows.select("id", "z", block_of(blocks).alias("block")).groupBy("block").applyInArrow(run, "block int, n long, ids binary, x binary")


def paired(state: DataFrame, blocks: int, *alone: str) -> DataFrame:
    """Each block's row once for each group (i, j), i <= j, in which it meets another block or itself. Groups are dealt to as many tasks as there is work for.
    alone: columns that are needed only where a block meets itself."""
    both = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    tasks = min(blocks * (blocks + 1) // 2, 4 * state.sparkSession.sparkContext.defaultParallelism)
    met = state.select("*", F.inline(both))
    return met.withColumns({c: F.when(F.col("i") == F.col("j"), F.col(c)) for c in alone}).repartition(max(1, tasks), "i", "j")


def matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, float).reshape(n, -1)


#: Deletes what a job has shuffled when it ends; without it, files stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Kept:
    """Tables of a fit's rounds, in the shared folder."""

    def __init__(self, spark):
        self.folder, self.count, self.places = paths.scratch(spark), 0, {}

    def __call__(self, df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
        """df as a table; instead: one of these tables that is deleted then, as nothing else is made of it."""
        spark = df.sparkSession
        self.count += 1
        path = f"{self.folder}/round_{self.count}"
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
        if instead is not None:
            paths.delete(spark, self.places.pop(id(instead))[1])
        new = spark.read.schema(df.schema).parquet(path)
        self.places[id(new)] = new, path
        return new
