"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


#: Rows and bytes that Python workers get at once, where the session has no bounds of its own; what they hold doesn't grow with the rows.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": (None, BATCH_BYTES)}


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches bounded in rows and bytes unless it bounds them itself."""
    for name, (default, value) in _BOUNDS.items():
        now = spark.conf.get(name, None)
        if now == default or now is None or not now.isdigit() or int(now) >= 2**31 - 1:
            spark.conf.set(name, str(value))
    return spark


#: Where tables go in a local session that names no folder: Spark lets no session set spark.checkpoint.dir once it runs.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir). Where that is unset, a temporary one for a local master; an error on a cluster."""
    base = bounded(spark).conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tidewind-"))
        base = _LOCAL[0]
    folder = f"{base.rstrip('/')}/tidewind-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


#: Folders that this session has made.
_MADE: list[str] = []


def tidy(spark: SparkSession) -> int:
    """Deletes all folders that this session has made, once their results are written or shown; how many there were."""
    made = list(dict.fromkeys(_MADE))
    _MADE.clear()
    for folder in made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


class Remembered(dict):
    """What a task has worked out for short strings, up to a number of bytes; None for what it doesn't know.

    When half of the bytes are used, what is there becomes old, and what was old before is forgotten; old things that are asked for become
    new again, so frequent ones stay."""

    def __init__(self, most: int = 24 << 20, longest: int = 48):
        super().__init__()
        self.most, self.longest, self.held, self.old = most // 2, longest, 0, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        return None if got is None else self.put(key, got)

    def put(self, key: str, value):
        if len(key) <= self.longest:
            self.held += 160 + len(key) + (sum(map(sys.getsizeof, value)) if isinstance(value, tuple) else sys.getsizeof(value))
            if self.held > self.most:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[key] = value
        return value


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each changed until no column has it, whatever its case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as it stands in an expression, with dots or back quotes in it."""
    return "`" + name.replace("`", "``") + "`"


def every(df: DataFrame, but: Iterable[str] = ()) -> list[Column]:
    """All columns of df, whatever their names, but for those in but."""
    gone = {c.lower() for c in but}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: the lineage ends there, so a lost executor costs no more than the last step."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the given columns (new name = old name); whatever else a table has can't clash then."""
    return df.select(*[F.col(quoted(old)).alias(new) for new, old in named.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a written table has no more than so many rows (asked of the files' footers)."""
    return df.count() <= rows


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows; beyond, the join shuffles."""
    return F.broadcast(df) if small_enough(df, rows) else df


def without_spaces(text: str = "text") -> F.Column:
    """The text without white space; null as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def by_rows(rows: DataFrame, run, schema: str, key: str = "doc_id") -> DataFrame:
    """rows.mapInPandas(run) where run gets the key as text and returns it first: whole numbers of any size keep their digits beside nulls."""
    kind = rows.schema[key].dataType
    out = rows.withColumn(key, F.col(key).cast("string")).mapInPandas(run, f"{key} string, {schema}")
    return out.withColumn(key, F.col(key).cast(kind))


def map_rows(df: DataFrame, run) -> DataFrame:
    """df.mapInArrow(run, df.schema) for columns of any name: run gets them as c0, c1 and so on, in their order."""
    names = df.columns
    safe = df.toDF(*[f"c{k}" for k in range(len(names))])
    return safe.mapInArrow(run, safe.schema).toDF(*names)
