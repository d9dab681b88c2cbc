"""Minute archives: closes of each day out of compressed files of CSVs (one archive for each ticker)."""

from __future__ import annotations

import csv
import io
import itertools
import math
import re
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .panels import parse_date

#: Column names that hold a close and a time, best first, and those of the best quotes (fixed values; compared in lower case).
CLOSE = ("close", "last", "cl", "adj close", "adj_close")
TIME = ("timestamp", "date", "datetime", "time", "t")
BID, ASK = "bid_1", "ask_1"


def close_column(names: list[str]) -> str | None:
    """The column that holds the close: one of CLOSE, else the first whose name has close or last in it."""
    return next((c for c in CLOSE if c in names), next((n for n in names if "close" in n or "last" in n), None))


def quote_column(names: list[str], exact: str, part: str) -> str | None:
    """The column of the best bid or ask: its own name, else the first that has bid or ask in it and is no size."""
    return exact if exact in names else next((n for n in names if part in n and "size" not in n), None)


def time_column(names: list[str]) -> str | None:
    """The column that holds the time: one of TIME, else the first."""
    return next((t for t in TIME if t in names), names[0] if names else None)


def ticker_of(path: Column) -> Column:
    """Ticker in an archive's name: what stands before "__", 2 to 5 letters."""
    name = F.regexp_extract(path, r"([^/]+?)\.[A-Za-z0-9.]+$", 1)
    return F.upper(F.regexp_extract(name, r"^([A-Za-z]{2,5})(?:__|$)", 1))


def date_of(path: Column, first: str = "2000-01-01") -> Column:
    """Date in a member's name, if it lies between first and today."""
    d = F.coalesce(parse_date(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1)), parse_date(F.regexp_extract(path, r"(?<!\d)(\d{8})(?!\d)", 1)))
    return F.when(d.between(F.lit(first).cast("date"), F.current_date()), d)


def members(name: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the CSVs of a zip or tar archive; 7z needs py7zr and is skipped with an error that says so where that is missing."""
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for n in z.namelist():
                if n.lower().endswith(".csv"):
                    yield n, z.read(n)
    elif raw[:6] == b"7z\xbc\xaf\x27\x1c":
        try:
            import py7zr
        except ImportError as e:
            raise RuntimeError(f"{name} is a 7z archive; reading those needs py7zr") from e
        with py7zr.SevenZipFile(io.BytesIO(raw)) as z:
            for n, f in z.readall().items():
                if n.lower().endswith(".csv"):
                    yield n, f.read()
    elif name.lower().endswith(".csv"):
        yield name, raw
    else:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t:
                if m.name.lower().endswith(".csv"):
                    yield m.name, t.extractfile(m).read()


def last_row(lines: Iterable[str]) -> tuple[float | None, float | None, float | None, str | None]:
    """(close, bid, ask, time) of the last row of a CSV, of which only the row at hand is held."""
    last = None
    for last in csv.DictReader(lines):
        pass
    if last is None:
        return None, None, None, None
    low = {(k or "").strip().lower(): v for k, v in last.items() if isinstance(v, str)}
    names = list(low)

    def number(name: str | None) -> float | None:
        try:
            x = float(low[name]) if name is not None else math.nan
        except ValueError:
            return None
        return x if math.isfinite(x) else None

    when = time_column(names)
    return number(close_column(names)), number(quote_column(names, BID, "bid")), number(quote_column(names, ASK, "ask")), low[when] if when is not None else None


def _store(path: str):
    """The store of a path, as pyarrow reaches it, and the path there."""
    from pyarrow import fs

    if ":" not in path:
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", path))
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file of any store that pyarrow reaches, to read parts of."""
    store, place = _store(path)
    return store.open_input_file(place)


def created(path: str):
    """A new file of any store that pyarrow reaches, to write one part after the other."""
    store, place = _store(path)
    store.create_dir(place.rsplit("/", 1)[0])
    return store.open_output_stream(place)


def written(path: str, content: bytes) -> None:
    with created(path) as f:
        f.write(content)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """path, member, bytes of the CSVs in zip archives: only the archives' directories are read, at their ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in pdf["path"]:
                with opened(name) as f, zipfile.ZipFile(f) as z:
                    rows += [(name, m.filename, m.file_size) for m in z.infolist() if m.filename.lower().endswith(".csv")]
            yield pd.DataFrame(rows, columns=["path", "member", "bytes"])

    files = spark.read.format("binaryFile").load(path).select("path").where(F.lower("path").endswith(".zip"))
    return files.mapInPandas(run, "path string, member string, bytes long")


#: Members of a task.
MEMBERS = 64
_LAST = "path string, member string, close double, bid double, ask double, time string"


def zip_last_rows(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """path, member, close, bid, ask, time of the last row of each CSV in zip archives. Members are dealt to tasks one by one and read as streams; those whose names have a date outside first to last are not read."""
    found = zip_members(spark, path)
    date = date_of(F.col("member"))
    for edge, inside in ((first, date >= F.lit(first)), (last, date <= F.lit(last))):
        if edge is not None:
            found = found.where(date.isNull() | inside)
    tasks = max(1, -(-found.count() // MEMBERS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, own in pdf.groupby("path"):
                with opened(name) as f, zipfile.ZipFile(f) as z:
                    for member in own["member"]:
                        with z.open(member) as raw:
                            rows.append((name, member, *last_row(io.TextIOWrapper(raw, "utf-8", "replace", newline=""))))
            yield pd.DataFrame(rows, columns=["path", "member", "close", "bid", "ask", "time"])

    return found.repartition(tasks, "path", "member").mapInPandas(run, _LAST)


def daily_closes(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """date, asset, close of each archive's members (from first to last, where given): the last row's close, else the middle of bid and ask if both are positive. Members of zip archives are tasks of their own, other archives are a task each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name, member, *last_row(io.StringIO(content.decode("utf-8", "replace"), newline=""))) for member, content in members(name, bytes(raw))]
                yield pd.DataFrame(rows, columns=["path", "member", "close", "bid", "ask", "time"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").where(~F.lower("path").endswith(".zip"))
    rows = zip_last_rows(spark, path, first, last).unionByName(files.mapInPandas(run, _LAST))
    close = F.coalesce("close", F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("bid") + F.col("ask")) / 2))
    date = F.coalesce(date_of(F.col("member")), parse_date(F.substring("time", 1, 10)))
    rows = rows.select(date.alias("date"), ticker_of(F.col("path")).alias("asset"), close.alias("close"), "member")
    for edge, inside in ((first, F.col("date") >= F.lit(first)), (last, F.col("date") <= F.lit(last))):
        rows = rows.where(inside) if edge is not None else rows
    return rows.where("date IS NOT NULL AND asset <> '' AND close IS NOT NULL").groupBy("date", "asset").agg(F.max_by("close", "member").alias("close"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Archives by ending: how many, how large."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1).alias("ending")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def sample_columns(spark: SparkSession, path: str, rows: int = 5) -> DataFrame:
    """archive, member, column, kind (double, long or string), role (close, time, bid, ask or null) and the first values, of the first CSV of each archive; of a zip archive its first lines alone are read."""

    def kind(values: list[str]) -> str:
        for name, of in (("long", int), ("double", float)):
            try:
                [of(v) for v in values if v]
            except ValueError:
                continue
            return name
        return "string"

    def told(name: str, member: str | None, lines: Iterable[str]) -> list[tuple]:
        table = list(itertools.islice(csv.reader(lines), rows + 1))
        names = [c.strip().lower() for c in table[0]] if table else []
        roles = {close_column(names): "close", time_column(names): "time"}
        roles |= {quote_column(names, BID, "bid"): "bid", quote_column(names, ASK, "ask"): "ask"} if close_column(names) is None else {}
        first = ([row[k] for row in table[1:] if k < len(row)] for k in range(len(names)))
        return [(name, member, column, kind(values), roles.get(column), values) for column, values in zip(names, first, strict=True)]

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name in pdf["path"]:
                with opened(name) as f, zipfile.ZipFile(f) as z:
                    member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                    if member is not None:
                        with z.open(member) as raw:
                            out += told(name, member, io.TextIOWrapper(raw, "utf-8", "replace", newline=""))
            yield pd.DataFrame(out, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                member, content = next(members(name, bytes(raw)), (None, b""))
                out += told(name, member, io.StringIO(content.decode("utf-8", "replace"), newline=""))
            yield pd.DataFrame(out, columns=columns)

    columns = ["archive", "member", "column", "kind", "role", "first"]
    shape = "archive string, member string, column string, kind string, role string, first array<string>"
    files, own = spark.read.format("binaryFile").load(path), F.lower("path").endswith(".zip")
    return files.select("path").where(own).mapInPandas(zipped, shape).unionByName(files.select("path", "content").where(~own).mapInPandas(run, shape))


def synthetic_panel(spark: SparkSession, n_dates: int = 3655, n_assets: int = 100, seed: int = 42, missing: float = 0.012, latest: int = 800, outliers: int = 120, size: float = 6.0) -> DataFrame:
    """date, asset, r: business days, later starts of assets, gaps, and planted outliers of plus or minus size (where a value stands)."""
    first = F.lit("2007-06-27").cast("date")
    days = spark.range(n_dates * 2).select(F.date_add(first, F.col("id").cast("int")).alias("date")).where(F.weekday("date") < 5)
    dates = days.orderBy("date").limit(n_dates).withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)
    assets = spark.range(n_assets).select(F.format_string("S%03d", "id").alias("asset"), F.col("id").alias("a"), F.floor(F.rand(seed) * latest).alias("start"))
    rows = dates.crossJoin(F.broadcast(assets)).withColumns({"z": F.randn(seed + 1) * 0.015, "u": F.rand(seed + 2)})
    planted = spark.range(outliers).select(F.floor(F.rand(seed + 3) * n_dates).alias("t"), F.floor(F.rand(seed + 4) * n_assets).alias("a"), F.when(F.rand(seed + 5) < 0.5, -size).otherwise(size).alias("out")).dropDuplicates(["t", "a"])
    there = (F.col("t") >= F.col("start")) & (F.col("u") >= missing)
    return rows.join(F.broadcast(planted), ["t", "a"], "left").select("date", "asset", F.when(there, F.coalesce("out", "z")).alias("r"))
