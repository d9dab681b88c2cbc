"""Registered queries: each name has a Spark plan and, where SQL can say the same, the SQL.

Plans return long integers, doubles rounded to 8 places, dates as text; SQL is wrapped to do the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}
DIGITS = 8


def plain(df: DataFrame) -> DataFrame:
    """Columns in the types that results are compared in."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss") if not isinstance(f.dataType, T.DateType) else c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str = "", doubles: str = "", longs: str = "", dates: str = "", hours: str = "") -> Callable[[Plan], Plan]:
    """Registers a plan; of the SQL's columns, doubles are rounded, longs cast, dates and hours written as text."""

    def put(f: Plan) -> Plan:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            parts = [f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
            parts += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split()] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in hours.split()]
            SQL[name] = f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})" if parts else sql
        return f

    return put


# SQL of the fixture panels -----------------------------------------------------------------------------------------------------------


def sql_panel(prices: str, scale: float, name: str = "panel", value: str = "close") -> str:
    """CTEs <name>_px, <name>_d and <name>: the dense panel with log returns."""
    return f"""{name}_px AS ({prices}),
{name}_d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM {name}_px)),
{name} AS (SELECT date, t, asset, close, {scale} * ln(close / lag(close) OVER (PARTITION BY asset ORDER BY t)) AS r
  FROM {name}_d CROSS JOIN (SELECT DISTINCT asset FROM {name}_px) LEFT JOIN {name}_px USING (date, asset))"""


FLAGS = sql_panel("SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || l_linestatus AS asset, avg(l_extendedprice) AS close FROM lineitem GROUP BY ALL", 0.02)
STATUS = sql_panel("SELECT CAST(l_shipdate AS DATE) AS date, l_linestatus AS asset, avg(l_extendedprice) AS close FROM lineitem GROUP BY ALL", 0.02)
_NATION = "SELECT CAST(date_trunc('{}', l_shipdate) AS DATE) AS date, 'N' || s_nationkey AS asset, avg(l_extendedprice) AS close FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"
DIRTY = sql_panel(_NATION.format("week"), 1)
NATIONS = sql_panel(_NATION.format("day"), 0.02)
HOURS = """hx AS (SELECT date_trunc('hour', ts) AS date, event_type AS asset, avg(value) AS x FROM events GROUP BY ALL),
hd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM hx)),
hours AS (SELECT date, t, asset, x FROM hd CROSS JOIN (SELECT DISTINCT asset FROM hx) LEFT JOIN hx USING (date, asset))"""
#: Methods that event types stand for in the result table.
METHODS = {"click": "model", "view": "mix", "purchase": "roll", "signup": "pers", "error": "shrink"}
RESULTS = f"""{HOURS},
rows AS (SELECT date, t, CASE asset {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in METHODS.items())} END AS method, (x - 50) / 2000 AS value FROM hours)"""
PERIODS = [("1996-01-01", "1996-06-30", "first"), ("1998-03-01", "1998-12-31", "second"), ("2000-02-01", "2000-09-30", "third")]
HOUR_PERIODS = [("2024-01-03 00:00:00", "2024-01-06 23:00:00", "first"), ("2024-01-12 00:00:00", "2024-01-18 23:00:00", "second")]
VOLATILE = [(a, b) for a, b, _ in PERIODS[:2]]
CALM_SQL = "NOT (" + " OR ".join(f"date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in VOLATILE) + ")"
VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS z, label FROM embeddings)"


def sql_windows(source: str, lookback: int, stride: int, horizon: int, value: str = "r") -> str:
    """CTEs ends (anchor), w (anchor, t, asset, r: past windows) and f (future ones)."""
    return f"""ends AS (SELECT unnest(range({lookback} - 1, (SELECT max(t) FROM {source}) + 1 - {horizon}, {stride})) AS anchor),
w AS (SELECT anchor, t, asset, {value} AS r FROM ends JOIN {source} ON t BETWEEN anchor - {lookback} + 1 AND anchor),
f AS (SELECT anchor, t, asset, {value} AS r FROM ends JOIN {source} ON t BETWEEN anchor + 1 AND anchor + {horizon})"""


def sql_cov(windows: str, name: str) -> str:
    """CTE <name>: covariances of imputed windows with the ridge."""
    return f"""{name}_x AS (SELECT anchor, t, asset, x - avg(x) OVER (PARTITION BY anchor, asset) AS x
  FROM (SELECT anchor, t, asset, coalesce(r, avg(r) OVER (PARTITION BY anchor, asset), 0) AS x FROM {windows})),
{name} AS (SELECT anchor, i, j, s / greatest(1, n - 1) + CASE WHEN i = j THEN 1e-8 ELSE 0 END AS v FROM (
  SELECT a.anchor AS anchor, a.asset AS i, b.asset AS j, sum(a.x * b.x) AS s, count(*) AS n FROM {name}_x a JOIN {name}_x b ON a.anchor = b.anchor AND a.t = b.t GROUP BY 1, 2, 3))"""


def all_queries() -> tuple[dict[str, Plan], dict[str, str]]:
    from . import analysis, files, forecasts, panels, spectral  # noqa: F401  they register themselves

    return QUERIES, SQL
