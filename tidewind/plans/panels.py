"""Queries on panels: returns, quality, cleaning, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, panel, windows
from ..sources import panels as src
from .catalog import CALM_SQL, DIRTY, FLAGS, HOURS, NATIONS, PERIODS, VOLATILE, query, sql_panel, sql_windows


def flags_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.log_returns(src.dense(src.flag_prices(spark, d)), 0.02)


def status_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.log_returns(src.dense(src.status_prices(spark, d)), 0.02)


def dirty_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.log_returns(src.dense(src.nation_prices(spark, d, "week")))


def nations_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.log_returns(src.dense(src.nation_prices(spark, d)), 0.02)


def hours_panel(spark: SparkSession, d: str) -> DataFrame:
    return src.dense(src.hourly(spark, d), "x")


def last_anchor(df: DataFrame, horizon: int) -> int:
    """T - H - 1; T is the number of dates."""
    return df.agg(F.max("t")).first()[0] - horizon


@query("panel_log_returns", f"WITH {FLAGS} SELECT date, t, asset, close, r FROM panel", "close r", "t", "date")
def _(spark, d):
    return flags_panel(spark, d).select("date", "t", "asset", "close", "r")


RECENT = ("1998-01-01", "2000-12-31")
_QUALITY = f"""{NATIONS},
there AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY asset ORDER BY date), date) AS gap FROM panel WHERE r IS NOT NULL),
al AS (SELECT count(*) AS n, count(*) FILTER (date BETWEEN DATE '{RECENT[0]}' AND DATE '{RECENT[1]}') AS nr FROM panel_d),
per AS (SELECT asset, min(date) AS first_date, max(date) AS last_date, count(*) AS days, coalesce(max(gap), 0) AS longest_gap, count(*) FILTER (r > 0.02 OR r < -0.02) AS extreme_days,
  count(*) FILTER (date BETWEEN DATE '{RECENT[0]}' AND DATE '{RECENT[1]}') AS recent FROM there GROUP BY asset),
q AS (SELECT asset, first_date, last_date, coalesce(days, 0) AS days, 100.0 * coalesce(days, 0) / n AS availability_pct, coalesce(100.0 * coalesce(recent, 0) / nullif(nr, 0), 0) AS recent_availability_pct,
  coalesce(longest_gap, 0) AS longest_gap, coalesce(extreme_days, 0) AS extreme_days
  FROM (SELECT DISTINCT asset FROM panel_px) LEFT JOIN per USING (asset), al)"""


def _quality(spark, d):
    return panel.quality(nations_panel(spark, d), RECENT, high=0.02, low=-0.02)


@query("panel_quality_by_asset", f"WITH {_QUALITY} SELECT *, longest_gap > 30 OR extreme_days > 0 AS excluded FROM q", "availability_pct recent_availability_pct", "days longest_gap extreme_days", "first_date last_date")
def _(spark, d):
    return _quality(spark, d)


MEGA, OUT = ["N1", "N5", "N9"], ["N3"]


@query(
    "universe_select",
    f"""WITH {_QUALITY}, c AS (SELECT *, asset IN ('N1', 'N5', 'N9') AND recent_availability_pct >= 5 AS mega, 0.5 * recent_availability_pct + 0.5 * availability_pct AS score FROM q)
SELECT asset, score, mega, row_number() OVER (ORDER BY mega DESC, score DESC, asset) AS place FROM c
WHERE (recent_availability_pct >= 10 AND availability_pct >= 10 AND longest_gap <= 400 AND extreme_days <= 1000 OR mega) AND asset NOT IN ('N3') QUALIFY place <= 10""",
    "score", "place",
)
def _(spark, d):
    return panel.select_universe(_quality(spark, d), MEGA, OUT, 10, least_recent=10, least_all=10, longest_gap=400, most_extreme=1000, mega_least=5)


@query("universe_top", f"WITH {_QUALITY} SELECT asset, recent_availability_pct, row_number() OVER (ORDER BY asset IN ('N1', 'N5', 'N9') DESC, recent_availability_pct DESC, asset) AS place FROM q QUALIFY place <= 8", "recent_availability_pct", "place")
def _(spark, d):
    return panel.select_top(_quality(spark, d), MEGA, 8).select("asset", "recent_availability_pct", "place")


for by in ("date", "asset"):

    @query(f"na_report_by_{by}", f"WITH {NATIONS} SELECT {by}, count(*) AS n, count(*) FILTER (r IS NULL) AS n_missing, avg((r IS NULL)::DOUBLE) AS missing FROM panel GROUP BY {by}", "missing", "n n_missing", "date" if by == "date" else "")
    def _(spark, d, by=by):
        return panel.na_report(nations_panel(spark, d), by)


@query("coverage_codes", f"WITH {DIRTY} SELECT date, asset, CASE WHEN r IS NULL THEN 0 WHEN abs(r) > 1 THEN 2 ELSE 1 END AS code FROM panel", "", "code", "date")
def _(spark, d):
    return panel.coverage(dirty_panel(spark, d), 1.0).select("date", "asset", "code")


@query("dense_assets", f"WITH {NATIONS} SELECT asset, count(*) AS n FROM panel WHERE asset IN (SELECT asset FROM panel GROUP BY asset HAVING avg((r IS NULL)::DOUBLE) <= 0.6) GROUP BY asset", "", "n")
def _(spark, d):
    return panel.dense_assets(nations_panel(spark, d)).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


_ORDERS = "SELECT CAST(o_orderdate AS DATE) AS date, left(o_orderpriority, 1) AS asset, avg(o_totalprice) AS close FROM orders GROUP BY ALL"
_ITEMS = "SELECT CAST(l_shipdate AS DATE) AS date, ((l_linenumber - 1) % 5 + 1)::VARCHAR AS asset, avg(l_extendedprice) AS close FROM lineitem GROUP BY ALL"
_SOURCES = f"{sql_panel(_ORDERS, 1, 'one')}, {sql_panel(_ITEMS, 1, 'two')}"


def _sources(spark, d):
    orders = src.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.left("o_orderpriority", F.lit(1)).alias("asset")).agg(F.avg("o_totalprice").alias("close"))
    items = src.daily(src.table(spark, d, "lineitem"), ((F.col("l_linenumber") - 1) % 5 + 1).cast("string"))
    return panel.log_returns(src.dense(orders)), panel.log_returns(src.dense(items))


@query("source_corr", f"WITH {_SOURCES} SELECT asset, count(*) AS n, corr(a.r, b.r) AS corr FROM one a JOIN two b USING (date, asset) WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY asset HAVING count(*) >= 10", "corr", "n")
def _(spark, d):
    return panel.source_correlation(*_sources(spark, d))


@query(
    "source_merge",
    f"""WITH {_SOURCES}, a AS (SELECT asset, coalesce(n, 0) >= 300 AS first FROM (SELECT asset FROM one UNION SELECT asset FROM two) LEFT JOIN (SELECT asset, count(r) AS n FROM one GROUP BY asset) USING (asset))
SELECT date, asset, CASE WHEN first THEN one.r ELSE two.r END AS r, CASE WHEN first THEN 'primary' ELSE 'secondary' END AS source
FROM (SELECT date FROM one UNION SELECT date FROM two) CROSS JOIN a LEFT JOIN one USING (date, asset) LEFT JOIN two USING (date, asset)""",
    "r", "", "date",
)
def _(spark, d):
    return panel.merge_sources(*_sources(spark, d), least=300)


_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("ticks_last_close", f"SELECT CAST(l_shipdate AS DATE) AS date, l_linestatus AS asset, arg_max(l_extendedprice, row({_KEY})) AS close, count(*) AS n_ticks FROM lineitem GROUP BY ALL", "close", "n_ticks", "date")
def _(spark, d):
    ticks = src.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("asset"), *_KEY.split(", "))
    return panel.last_close(ticks, ["date", "asset"], F.struct(*_KEY.split(", ")), F.col("l_extendedprice"))


@query(
    "cross_section_vol",
    f"""WITH {FLAGS}, p AS (SELECT date, t, stddev_samp(r) AS vol FROM panel GROUP BY ALL)
SELECT date, vol, CASE WHEN count(vol) OVER w = 60 THEN avg(vol) OVER w END AS vol_mean FROM p WINDOW w AS (ORDER BY t ROWS 59 PRECEDING)""",
    "vol vol_mean", "", "date",
)
def _(spark, d):
    return panel.cross_section(flags_panel(spark, d)).select("date", "vol", "vol_mean")


# cleaning ----------------------------------------------------------------------------------------------------------------------------

_FLAGGED = f"""{DIRTY},
fl AS (SELECT date, q99, max_abs, filled, coalesce(q99 > 0.9 OR max_abs > 1.2, false) OR filled < 0.2 AS flagged FROM (
  SELECT date, quantile_cont(abs(r), 0.99) AS q99, max(abs(r)) AS max_abs, avg((r IS NOT NULL)::DOUBLE) AS filled FROM panel GROUP BY date))"""
_LIMITS = {"q99": 0.9, "largest": 1.2, "least_filled": 0.2}


@query("clean_flag_dates", f"WITH {_FLAGGED} SELECT * FROM fl", "q99 max_abs filled", "", "date")
def _(spark, d):
    return clean.date_flags(dirty_panel(spark, d), **_LIMITS)


for _name, _policy, _value in (
    ("clean_drop_date", "drop_date", "NULL"),
    ("clean_winsorize", "winsorize_date", "CASE WHEN r IS NOT NULL THEN least(greatest(r, -0.3), 0.3) END"),
    ("clean_drop_values", "drop_ticker_values", "CASE WHEN abs(r) <= 1.0 THEN r END"),
):

    @query(_name, f"WITH {_FLAGGED} SELECT date, asset, CASE WHEN flagged THEN {_value} ELSE r END AS r FROM panel JOIN fl USING (date)", "r", "", "date")
    def _(spark, d, policy=_policy):
        rows = dirty_panel(spark, d)
        return clean.apply_policy(rows, clean.date_flags(rows, **_LIMITS), policy).select("date", "asset", "r")


@query("clean_worst_dates", f"WITH {_FLAGGED} SELECT date, max_abs, 'drop_date' AS action FROM fl WHERE flagged ORDER BY max_abs DESC, date LIMIT 5", "max_abs", "", "date")
def _(spark, d):
    return clean.cleaning_log(clean.date_flags(dirty_panel(spark, d), **_LIMITS), "drop_date").select("date", "max_abs", "action")


_CELLS = f"""{DIRTY},
cells AS (SELECT date, t, asset, r, CASE WHEN abs(r) > 3 THEN 'huge'
  WHEN abs(r) > 1 AND (coalesce(abs(lead(r) OVER a) > 1 AND sign(lead(r) OVER a) <> sign(r), false) OR coalesce(abs(lag(r) OVER a) > 1 AND sign(lag(r) OVER a) <> sign(r), false)) THEN 'split_pair'
  WHEN abs(r) > 1 AND {CALM_SQL} AND count(*) FILTER (abs(r) > 1) OVER (PARTITION BY date) >= 2 THEN 'suspicious_multi' END AS reason
  FROM panel WINDOW a AS (PARTITION BY asset ORDER BY t))"""


def _cells(spark, d):
    return clean.cell_mask(dirty_panel(spark, d), VOLATILE, 3.0, 1.0)


@query("cellwise_mask", f"WITH {_CELLS} SELECT date, asset, r, reason FROM cells WHERE reason IS NOT NULL", "r", "", "date")
def _(spark, d):
    return _cells(spark, d).where("reason IS NOT NULL").select("date", "asset", "r", "reason")


@query("cellwise_summary", f"WITH {_CELLS} SELECT reason, count(*) AS n, count(DISTINCT date) AS dates, max(abs(r)) AS max_abs FROM cells WHERE reason IS NOT NULL GROUP BY reason", "max_abs", "n dates")
def _(spark, d):
    return clean.mask_summary(_cells(spark, d))


@query("cellwise_cleaned", f"WITH {_CELLS} SELECT asset, count(r) FILTER (reason IS NULL) AS n, max(abs(r)) FILTER (reason IS NULL) AS max_abs FROM cells GROUP BY asset", "max_abs", "n")
def _(spark, d):
    return clean.masked(_cells(spark, d)).groupBy("asset").agg(F.count("r").alias("n"), F.max(F.abs("r")).alias("max_abs"))


_OPP = "coalesce(abs({0}) > 1 AND sign({0}) <> sign(r), false)"
_EXTREME = f"""{DIRTY},
near AS (SELECT date, asset, r, lag(r) OVER a AS before, lead(r) OVER a AS next1, lead(r, 2) OVER a AS next2 FROM panel WINDOW a AS (PARTITION BY asset ORDER BY t)),
days AS (SELECT date, asset, r, before, next1, next2, count(*) OVER (PARTITION BY date) AS n_extreme FROM near WHERE abs(r) > 0.5
  QUALIFY row_number() OVER (PARTITION BY date ORDER BY abs(r) DESC, asset) = 1),
kinds AS (SELECT *, next1 IS NOT NULL AND abs(r) > 1 AND ({_OPP.format("next1")} OR {_OPP.format("next2")}) AS split FROM days),
classed AS (SELECT date, asset, r, n_extreme, CASE WHEN abs(r) > 3 OR split OR n_extreme >= 3 AND abs(r) > 1 THEN 'ARTIFACT'
  WHEN abs(r) BETWEEN 0.5 AND 1 AND n_extreme = 1 AND (NOT {CALM_SQL} OR abs(r) <= 0.7) THEN 'LEGITIMATE'
  WHEN abs(r) > 1 OR n_extreme >= 2 OR abs(r) > 0.7 AND {CALM_SQL} THEN 'SUSPICIOUS' ELSE 'LEGITIMATE' END AS kind FROM kinds)"""


def _classed(spark, d):
    return clean.classify(clean.extreme_days(dirty_panel(spark, d)), VOLATILE, 3.0, 1.0, 0.7)


@query("extreme_days", f"WITH {_EXTREME} SELECT * FROM days", "r before next1 next2", "n_extreme", "date")
def _(spark, d):
    return clean.extreme_days(dirty_panel(spark, d))


@query("extreme_class", f"WITH {_EXTREME} SELECT * FROM classed", "r", "n_extreme", "date")
def _(spark, d):
    return _classed(spark, d).select("date", "asset", "r", "n_extreme", "kind")


_TIERS = " UNION ALL ".join(
    f"SELECT '{tier}' AS tier, count(DISTINCT date) AS days, max(abs(r)) AS max_abs, quantile_cont(abs(r), 0.99) AS q99, count(*) FILTER (r IS NULL) AS n_na FROM panel WHERE date NOT IN (SELECT date FROM classed WHERE kind IN ({', '.join(repr(k) for k in kinds)}))"
    for tier, kinds in clean.TIERS.items()
)


@query("tier_stats", f"WITH {_EXTREME} {_TIERS}", "max_abs q99", "days n_na")
def _(spark, d):
    return clean.tier_stats(dirty_panel(spark, d), _classed(spark, d))


@query("tier_dates", f"WITH {_EXTREME} SELECT DISTINCT date FROM panel WHERE date NOT IN (SELECT date FROM classed WHERE kind IN ('ARTIFACT', 'SUSPICIOUS'))", "", "", "date")
def _(spark, d):
    return clean.drop_tier(dirty_panel(spark, d), _classed(spark, d), "moderate").select("date").distinct()


@query("extreme_variants", f"WITH {DIRTY} SELECT 'conservative' AS variant, count(*) AS n, count(r) AS n_values FROM panel WHERE date NOT IN (SELECT date FROM panel WHERE abs(r) > 0.5) UNION ALL SELECT 'aggressive', count(*), count(r) FILTER (abs(r) <= 0.5) FROM panel", "", "n n_values")
def _(spark, d):
    p = dirty_panel(spark, d)
    one = lambda df, name: df.agg(F.lit(name).alias("variant"), F.count(F.lit(1)).alias("n"), F.count("r").alias("n_values"))
    return one(clean.conservative(p), "conservative").unionByName(one(clean.aggressive(p), "aggressive"))


for _unit, _sql in (("year", "year(date)"), ("month", "month(date)"), ("dow", "isodow(date) - 1")):

    @query(f"extreme_by_{_unit}", f"WITH {DIRTY} SELECT {_sql} AS {_unit}, count(*) AS n FROM panel WHERE abs(r) > 0.5 GROUP BY 1", "", f"{_unit} n")
    def _(spark, d, unit=_unit):
        return clean.histogram(dirty_panel(spark, d), unit)


_SPLIT = "CASE " + " ".join(f"WHEN abs(r - ({value})) <= {tolerance} THEN '{name}'" for name, value, tolerance in clean.SPLITS) + " END"


@query("split_pattern_match", f"WITH {DIRTY} SELECT date, asset, r, {_SPLIT} AS split FROM panel WHERE {_SPLIT} IS NOT NULL", "r", "", "date")
def _(spark, d):
    return clean.match_splits(dirty_panel(spark, d)).select("date", "asset", "r", "split")


@query("winsorized", f"WITH {DIRTY}, q AS (SELECT asset, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM panel GROUP BY asset) SELECT date, asset, CASE WHEN r IS NOT NULL THEN least(greatest(r, lo), hi) END AS r FROM panel JOIN q USING (asset)", "r", "", "date")
def _(spark, d):
    return clean.winsorize(dirty_panel(spark, d)).select("date", "asset", "r")


@query("period_membership", f"WITH {FLAGS} SELECT DISTINCT date, label FROM panel JOIN (VALUES {', '.join(f"(DATE '{a}', DATE '{b}', '{c}')" for a, b, c in PERIODS)}) p(a, b, label) ON date BETWEEN a AND b", "", "", "date")
def _(spark, d):
    periods = spark.createDataFrame(PERIODS, "first string, last string, label string").select(F.to_date("first").alias("first"), F.to_date("last").alias("last"), "label")
    return flags_panel(spark, d).join(F.broadcast(periods), F.col("date").between(F.col("first"), F.col("last"))).select("date", "label").distinct()


@query("cellwise_worst", f"WITH {_CELLS} SELECT date, asset, r, reason FROM cells WHERE reason IS NOT NULL ORDER BY abs(r) DESC, date, asset LIMIT 10", "r", "", "date")
def _(spark, d):
    return clean.worst_cells(_cells(spark, d))


@query("pooled_percentiles", f"WITH {FLAGS}, s AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS share, unnest(q) AS value FROM (SELECT quantile_cont(r, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM panel)) SELECT * FROM s", "share value")
def _(spark, d):
    return panel.pooled_percentiles(flags_panel(spark, d))


# windows -----------------------------------------------------------------------------------------------------------------------------


@query(
    "window_validity",
    f"""WITH {HOURS}, {sql_windows("hours", 20, 7, 5, "x")},
c AS (SELECT anchor, avg((r IS NULL)::DOUBLE) AS na FROM w GROUP BY anchor),
a AS (SELECT anchor, avg(s) AS assets FROM (SELECT anchor, asset, max((r IS NOT NULL)::INT) AS s FROM w GROUP BY ALL) GROUP BY anchor),
t AS (SELECT anchor, avg(s) AS dates FROM (SELECT anchor, t, max((r IS NOT NULL)::INT) AS s FROM w GROUP BY ALL) GROUP BY anchor)
SELECT anchor, na, assets, dates, na <= 0.3 AND assets >= 0.8 AND dates >= 0.5 AS valid FROM c JOIN a USING (anchor) JOIN t USING (anchor)""",
    "na assets dates", "anchor",
)
def _(spark, d):
    p = hours_panel(spark, d)
    return windows.validity(windows.past(p, 20, 7, last_anchor(p, 5), value="x"))


@query("window_impute", f"WITH {HOURS}, {sql_windows('hours', 20, 50, 5, 'x')} SELECT anchor, t, asset, coalesce(r, avg(r) OVER (PARTITION BY anchor, asset), 0) AS r FROM w", "r", "anchor t")
def _(spark, d):
    p = hours_panel(spark, d)
    return windows.imputed(windows.past(p, 20, 50, last_anchor(p, 5), value="x")).select("anchor", "t", "asset", "r")
