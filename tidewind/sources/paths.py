"""Where inputs and results are: the first place that is there, new layouts before old ones. Paths of any store that Spark reaches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

#: Variable that names the folder of archives, and where it is looked for beside (fixed values).
ENV = "DATA_BY_STOCKS"
PLACES = ("data/raw/data_by_stocks", "~/Downloads/data_by_stocks")
#: Names that results of a tag had before tags were folders (fixed values).
OLD_NAMES = {"regime_covariance": "regime_similarity"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


#: Where files go in a local session that names no folder.
_LOCAL: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir); a temporary one only for a local master, an error on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL[:] = _LOCAL or [tempfile.mkdtemp(prefix="tidewind-files-")]
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def data_dir(given: str | None = None, root: str = ".", env: dict | None = None) -> Path:
    """The folder of archives: the given one, the variable's, or one of PLACES, whichever is there first; else what was asked for."""
    env = os.environ if env is None else env
    asked = [x for x in (given, env.get(ENV)) if x]
    full = [Path(x).expanduser().resolve() for x in asked]
    places = [Path(root, x).resolve() if not x.startswith("~") else Path(x).expanduser().resolve() for x in PLACES]
    return next((p for p in (*full, *places) if p.exists()), (full or places)[0])


def _first(spark: SparkSession, candidates: Iterable[str], otherwise: str) -> str:
    return next((c for c in candidates if exists(spark, c)), otherwise)


def backtest_path(spark: SparkSession, results: str, tag: str) -> str:
    """The backtest table of a tag: its folder's, or an older file's; the folder's if there is none."""
    names = [f"{tag}/backtest", f"{tag}_backtest", *([f"{OLD_NAMES[tag]}_backtest"] if tag in OLD_NAMES else [])]
    candidates = [f"{results}/{n}{end}" for n in names for end in (".parquet", ".csv")]
    return _first(spark, candidates, candidates[0])


def figures_dir(spark: SparkSession, results: str, tag: str) -> str:
    new, old = f"{results}/{tag}/figs", f"{results}/figs_{tag}"
    older = [f"{results}/figs_{OLD_NAMES[tag]}"] if tag in OLD_NAMES else []
    return _first(spark, [new, old, *older], old)


def report_path(spark: SparkSession, results: str, tag: str, target: str | None = None) -> str:
    old = f"{results}/{tag}_report.csv"
    candidates = [f"{results}/{tag}/report.csv", *([f"{results}/regime_volatility_report.csv"] if target == "volatility" else []), old]
    candidates += [f"{results}/{OLD_NAMES[tag]}_report.csv"] if tag in OLD_NAMES else []
    return _first(spark, candidates, old)


def _copy(spark: SparkSession, source: str, to: str) -> bool:
    """Copies a file or folder where there is none (or an empty one) yet."""
    from_fs, a = _fs(spark, source)
    to_fs, b = _fs(spark, to)
    if source == to or not from_fs.exists(a) or to_fs.exists(b) and to_fs.getContentSummary(b).getLength() > 0:
        return False
    if to_fs.exists(b):
        to_fs.delete(b, True)
    to_fs.mkdirs(b.getParent())
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, to_fs, b, False, spark.sparkContext._jsc.hadoopConfiguration())


def migrate(spark: SparkSession, results: str, tag: str, target: str | None = None) -> list[str]:
    """Copies a tag's results from older places to its folder, where they are missing; what was copied. Nothing is deleted."""
    found = backtest_path(spark, results, tag)
    moves = [(found, f"{results}/{tag}/backtest{Path(found).suffix}"), (report_path(spark, results, tag, target), f"{results}/{tag}/report.csv")]
    moves.append((figures_dir(spark, results, tag), f"{results}/{tag}/figs"))
    old = [f"{OLD_NAMES[tag]}_backtest"] if tag in OLD_NAMES else []
    moves += [(f"{results}/{n}{end}", f"{results}/{tag}/backtest{end}") for n in (*old, f"{tag}_backtest") for end in (".csv", ".parquet")]
    return [to for source, to in moves if _copy(spark, source, to)]
