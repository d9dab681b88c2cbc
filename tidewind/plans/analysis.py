"""Queries on a result table: methods' hourly results."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import regime
from .catalog import HOUR_PERIODS, METHODS, RESULTS, query
from .forecasts import _MEMBER, _STATES, memberships
from .panels import hours_panel


def results(spark: SparkSession, d: str) -> DataFrame:
    """date, t, method, value."""
    rows = hours_panel(spark, d)
    name = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    return rows.select("date", "t", F.element_at(name, F.col("asset")).alias("method"), ((F.col("x") - 50) / 2000).alias("value"))


def long_results(spark, d):
    """Two metrics: the value and its size."""
    rows = results(spark, d)
    return rows.withColumn("metric", F.lit("ret")).unionByName(rows.withColumns({"value": F.abs("value"), "metric": F.lit("size")}))


_LONG = f"{RESULTS}, long AS (SELECT date, method, 'ret' AS metric, value FROM rows UNION ALL SELECT date, method, 'size', abs(value) FROM rows)"


@query("report_means", f"WITH {_LONG} SELECT metric, method, avg(value) AS value, count(value) AS n FROM long GROUP BY ALL", "value", "n")
def _(spark, d):
    return an.report(long_results(spark, d))


_NAMES = ["model", "mix", "roll", "pers", "shrink"]


@query(
    "report_pivot",
    f"""WITH {_LONG}, m AS (SELECT metric, method, avg(value) AS value FROM long GROUP BY ALL), k AS (SELECT *, CASE WHEN metric = 'size' THEN value ELSE -value END AS s FROM m)
SELECT metric, {', '.join(f"max(value) FILTER (method = '{x}') AS {x}" for x in _NAMES)}, arg_min(method, s) AS best, arg_max(method, s) AS worst FROM k GROUP BY metric""",
    " ".join(_NAMES),
)
def _(spark, d):
    return an.pivoted(long_results(spark, d), _NAMES, F.col("metric") == "size")


@query("best_method", f"WITH {RESULTS} SELECT arg_max(method, m) AS method, max(m) AS mean FROM (SELECT method, avg(value) AS m FROM rows GROUP BY method)", "mean")
def _(spark, d):
    return results(spark, d).groupBy("method").agg(F.avg("value").alias("mean")).agg(F.max_by("method", "mean").alias("method"), F.max("mean").alias("mean"))


@query("common_dates", f"WITH {RESULTS} SELECT method, count(*) AS n, avg(value) AS mean FROM rows WHERE date IN (SELECT date FROM rows GROUP BY date HAVING count(value) = 5) GROUP BY method", "mean", "n")
def _(spark, d):
    return an.common_dates(results(spark, d), 5).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("method_ranks", f"WITH {RESULTS}, m AS (SELECT method, avg(value) AS mean, stddev_samp(value) AS sd FROM rows GROUP BY method) SELECT method, mean, sd, rank() OVER (ORDER BY mean) + (count(*) OVER (PARTITION BY mean) - 1) / 2.0 AS rank FROM m", "mean sd rank")
def _(spark, d):
    return an.method_ranks(results(spark, d))


_PAIR = f"{RESULTS}, pair AS (SELECT a.date, a.method, a.value, b.value AS base FROM rows a JOIN rows b ON a.date = b.date AND b.method = 'roll' WHERE a.method <> 'roll' AND a.value IS NOT NULL AND b.value IS NOT NULL)"


@query("win_rates", f"WITH {_PAIR} SELECT method, count(*) AS n, avg((value < base)::INT) AS win_rate FROM pair GROUP BY method", "win_rate", "n")
def _(spark, d):
    return an.win_rates(results(spark, d), "roll")


@query("paired_t", f"WITH {_PAIR} SELECT method, count(*) AS n, avg(value - base) AS mean_diff, avg(value - base) / (stddev_samp(value - base) / sqrt(count(*))) AS t FROM pair GROUP BY method", "mean_diff t", "n")
def _(spark, d):
    return an.paired_t(results(spark, d), "roll").select("method", "n", "mean_diff", "t")


@query(
    "paired_wilcoxon",
    f"""WITH {_PAIR}, x AS (SELECT method, base - value AS d FROM pair), r AS (SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2.0 AS r FROM x WHERE d <> 0)
SELECT method, n, median_advantage, w FROM (SELECT method, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM r GROUP BY method) JOIN (SELECT method, quantile_cont(d, 0.5) AS median_advantage FROM x GROUP BY method) USING (method)""",
    "median_advantage w", "n",
)
def _(spark, d):
    return an.wilcoxon(results(spark, d), "roll").select("method", "n", "median_advantage", "w")


#: Student's t by its finite sums for whole degrees of freedom, the normal distribution by Simpson's rule.
_T_TAIL = """CASE WHEN df % 2 = 0 THEN sin(th) * list_sum([exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * cos(th) ** (2 * j) FOR j IN range(df // 2)])
  ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * cos(th) ** (2 * j + 1) FOR j IN range((df - 1) // 2)]), 0)) END"""
_NORMAL = "least(1, 1 - 2 * z / 2000 / 3 / sqrt(2 * pi()) * list_sum([CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (z * j / 2000) ** 2) FOR j IN range(2001)]))"
_STARS = "CASE WHEN {0} < 0.01 THEN '***' WHEN {0} < 0.05 THEN '**' WHEN {0} < 0.1 THEN '*' ELSE '' END"


@query(
    "paired_pvalues",
    f"""WITH {_PAIR}, tt AS (SELECT method, count(*) - 1 AS df, atan(abs(avg(value - base) / (stddev_samp(value - base) / sqrt(count(*)))) / sqrt(count(*) - 1)) AS th FROM pair GROUP BY method),
tp AS (SELECT method, 1 - ({_T_TAIL}) AS t_p FROM tt),
x AS (SELECT method, base - value AS d FROM pair), r AS (SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY method, abs(d)) AS m FROM x WHERE d <> 0),
w AS (SELECT method, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, sum(m * m - 1) AS ties FROM r GROUP BY method),
zz AS (SELECT method, abs(w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM w)
SELECT method, t_p, {_STARS.format("t_p")} AS stars, {_NORMAL} AS wilcoxon_p FROM tp JOIN zz USING (method)""",
    "t_p wilcoxon_p",
)
def _(spark, d):
    rows = results(spark, d)
    return an.paired_t(rows, "roll").select("method", F.col("p").alias("t_p"), "stars").join(an.wilcoxon(rows, "roll").select("method", F.col("p").alias("wilcoxon_p")), "method")


@query("forecast_corr", f"WITH {RESULTS} SELECT a.method AS a, b.method AS b, count(*) AS n, corr(a.value, b.value) AS corr FROM rows a JOIN rows b USING (date) WHERE a.method < b.method AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL HAVING count(*) >= 3", "corr", "n")
def _(spark, d):
    return an.correlations(results(spark, d))


_WEALTH = f"{RESULTS}, wl AS (SELECT date, method, value, product(1 + coalesce(value, 0)) OVER (PARTITION BY method ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM rows)"


@query("equity_curves", f"WITH {_WEALTH} SELECT date, method, wealth FROM wl", "wealth", "", "", "date")
def _(spark, d):
    return an.wealth(results(spark, d)).select("date", "method", "wealth")


for _name, _peak in (("max_drawdown", "max(wealth) OVER w"), ("max_drawdown_from_one", "greatest(max(wealth) OVER w, 1)")):

    @query(_name, f"WITH {_WEALTH}, p AS (SELECT method, wealth, {_peak} AS peak FROM wl WINDOW w AS (PARTITION BY method ORDER BY date ROWS UNBOUNDED PRECEDING)) SELECT method, min((wealth - peak) / peak) AS drawdown FROM p GROUP BY method", "drawdown")
    def _(spark, d, one=_name.endswith("one")):
        return an.max_drawdown(results(spark, d), one)


@query("terminal_wealth", f"WITH {RESULTS}, x AS (SELECT method, product(1 + coalesce(value, 0)) AS wealth FROM rows GROUP BY method) SELECT method, wealth, 100 * (wealth / (SELECT wealth FROM x WHERE method = 'roll') - 1) AS over_base_pct FROM x", "wealth over_base_pct")
def _(spark, d):
    return an.terminal_wealth(results(spark, d), "roll")


for _kind, _sql in (("median", "quantile_cont(value, 0.5)"), ("mean", "avg(value)")):

    @query(f"rolling_{_kind}", f"WITH {RESULTS} SELECT date, method, CASE WHEN count(value) OVER w >= 21 THEN {_sql} OVER w END AS rolled FROM rows WINDOW w AS (PARTITION BY method ORDER BY date ROWS 20 PRECEDING)", "rolled", "", "", "date")
    def _(spark, d, kind=_kind):
        return an.rolling(results(spark, d), 21, kind).select("date", "method", "rolled")


@query("cum_advantage", f"WITH {_PAIR} SELECT date, method, sum(base - value) OVER (PARTITION BY method ORDER BY date ROWS UNBOUNDED PRECEDING) AS advantage FROM pair", "advantage", "", "", "date")
def _(spark, d):
    return an.cumulative_advantage(results(spark, d), "roll").select("date", "method", "advantage")


@query("annualised_ir", f"WITH {RESULTS} SELECT method, avg(value) / stddev_samp(value) * sqrt(252.0) AS ir, stddev_pop(value) AS sd_pop, avg(value) AS mean FROM rows GROUP BY method", "ir sd_pop mean")
def _(spark, d):
    return an.information_ratio(results(spark, d))


@query("by_year", f"WITH {RESULTS} SELECT day(date) AS unit, method, avg(value) AS mean, count(value) AS n FROM rows GROUP BY ALL", "mean", "unit n")
def _(spark, d):
    """Days of the month stand for years, as the fixture covers one month."""
    return an.by_unit(results(spark, d), F.dayofmonth("date"))


def states(spark, d):
    """date, state."""
    dates = hours_panel(spark, d).select("t", "date").distinct()
    return regime.assigned(memberships(spark, d)).join(dates, F.col("anchor") == F.col("t")).select("date", "state")


_REG = f"{_MEMBER}, {_STATES}, reg AS (SELECT date, state FROM states JOIN hd ON anchor = t)"
_ROWS = RESULTS.split("rows AS ", 1)[1]
_BOTH = f"{_REG}, rows AS {_ROWS}"
_PERIOD_SQL = "(VALUES " + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}', '{c}')" for a, b, c in HOUR_PERIODS) + ") p(first, last, label)"


def periods(spark):
    rows = spark.createDataFrame(HOUR_PERIODS, "first string, last string, label string")
    return rows.select(F.to_timestamp("first").alias("first"), F.to_timestamp("last").alias("last"), "label")


@query("by_regime", f"WITH {_BOTH} SELECT state, a.method, avg(a.value) AS mean, count(a.value) AS n, avg((a.value < b.value)::INT) AS win FROM rows a JOIN reg USING (date) LEFT JOIN rows b ON a.date = b.date AND b.method = 'roll' GROUP BY ALL", "mean win", "state n")
def _(spark, d):
    return an.by_regime(results(spark, d), states(spark, d), "roll")


#: Columns of an hour's losses, made of the methods' results.
_LOSS = {"fro": "abs(model)", "gmvp_sharpe": "100 * mix", "turnover": "60 * abs(roll)", "vol_mse": "5 * abs(pers)"}


def losses(spark, d):
    wide = results(spark, d).groupBy("date").agg(*[F.max(F.when(F.col("method") == m, F.col("value"))).alias(m) for m in ("model", "mix", "roll", "pers")])
    return states(spark, d).join(wide, "date", "left").select("date", "state", *[F.expr(x).alias(name) for name, x in _LOSS.items()])


for _vol in (False, True):
    _NAMED = "WHEN mean_vol_mse > 0.05 THEN 'High Vol MSE'" if _vol else "WHEN mean_gmvp_sharpe > 1.5 AND mean_turnover < 0.5 THEN 'Calm Bull' WHEN mean_gmvp_sharpe < 0.5 THEN 'Stress/Low Sharpe' WHEN mean_fro > 0.025 THEN 'High Uncertainty' WHEN mean_turnover > 0.7 THEN 'Volatile/Choppy'"

    @query(
        "regime_profile_vol" if _vol else "regime_profile",
        f"""WITH {_BOTH}, wide AS (SELECT date, {', '.join(f"max(value) FILTER (method = '{m}') AS {m}" for m in ('model', 'mix', 'roll', 'pers'))} FROM rows GROUP BY date),
x AS (SELECT state, {', '.join(f'{x} AS {name}' for name, x in _LOSS.items())}, EXISTS (SELECT 1 FROM {_PERIOD_SQL} WHERE reg.date BETWEEN first AND last) AS c FROM reg LEFT JOIN wide ON wide.date = reg.date),
s AS (SELECT state, count(*) AS n, {', '.join(f'avg({m}) AS mean_{m}' for m in _LOSS)}, round(100.0 * avg(c::INT), 1) AS crisis_overlap FROM x GROUP BY state)
SELECT state, n, 100.0 * n / sum(n) OVER () AS share, {', '.join(f'mean_{m}' for m in _LOSS)}, crisis_overlap, CASE WHEN crisis_overlap > 30 THEN 'Crisis/High Stress' {_NAMED} ELSE 'Normal/Transition' END AS name FROM s""",
        f"share {' '.join(f'mean_{m}' for m in _LOSS)} crisis_overlap", "state n",
    )
    def _(spark, d, vol=_vol):
        return an.regime_profile(losses(spark, d), periods(spark), vol)


@query("crisis_overlap", f"WITH {_REG} SELECT state, label, count(*) AS n FROM reg JOIN {_PERIOD_SQL} ON date BETWEEN first AND last GROUP BY ALL", "", "state n")
def _(spark, d):
    return states(spark, d).join(F.broadcast(periods(spark)), F.col("date").between(F.col("first"), F.col("last"))).groupBy("state", "label").agg(F.count(F.lit(1)).alias("n"))


@query("detection_lag", f"WITH {_REG} SELECT label, min(date) AS first_seen, date_diff('day', CAST(any_value(first) AS DATE), CAST(min(date) AS DATE)) AS lag FROM reg JOIN {_PERIOD_SQL} ON date BETWEEN first AND last WHERE state = 2 GROUP BY label", "", "lag", "", "first_seen")
def _(spark, d):
    return an.detection_lag(states(spark, d), periods(spark), 2)


@query("threshold_crossing", f"WITH {_WEALTH} SELECT method, threshold, min(date) AS date FROM wl, (SELECT unnest([0.99, 0.95, 0.9]::DOUBLE[]) AS threshold) WHERE wealth < threshold GROUP BY ALL", "threshold", "", "", "date")
def _(spark, d):
    return an.crossings(results(spark, d), [0.99, 0.95, 0.9])


@query("ratio_outliers", f"WITH {_PAIR} SELECT date, method, ratio FROM (SELECT date, method, value / nullif(base, 0) AS ratio FROM pair) WHERE ratio > 3 OR ratio < 1.0 / 3", "ratio", "", "", "date")
def _(spark, d):
    return an.ratio_outliers(results(spark, d), "roll").select("date", "method", "ratio")


@query(
    "kde_grid",
    f"""WITH {RESULTS}, s AS (SELECT method, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi, stddev_samp(value) * count(value) ** -0.2 AS h, count(value) AS n FROM rows GROUP BY method),
g AS (SELECT *, lo + (hi - lo) * k / 199 AS x FROM s, (SELECT unnest(range(200)) AS k))
SELECT method, k, x, sum(exp(-0.5 * ((x - value) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM g JOIN rows USING (method) WHERE value IS NOT NULL GROUP BY method, k, x""",
    "x density", "k",
)
def _(spark, d):
    return an.density(results(spark, d))


# runs: each hour of the day of each method stands for a run ---------------------------------------------------------------------------

_RUNS = f"{RESULTS}, runs AS (SELECT method || '-' || hour(date) AS run, avg(value) AS sharpe_mean, var_samp(value) * 1e3 AS var, avg(abs(value)) AS turnover FROM rows GROUP BY 1)"


def runs(spark, d):
    return results(spark, d).groupBy(F.concat("method", F.lit("-"), F.hour("date").cast("string")).alias("run")).agg(
        F.avg("value").alias("sharpe_mean"), (F.var_samp("value") * 1e3).alias("var"), F.avg(F.abs("value")).alias("turnover")
    )


_DOMINATED = "SELECT 1 FROM runs o WHERE o.sharpe_mean >= r.sharpe_mean AND o.var <= r.var{0} AND (o.sharpe_mean > r.sharpe_mean OR o.var < r.var{1})"


@query("pareto3", f"WITH {_RUNS} SELECT * FROM runs r WHERE NOT EXISTS ({_DOMINATED.format(' AND o.turnover <= r.turnover', ' OR o.turnover < r.turnover')})", "sharpe_mean var turnover")
def _(spark, d):
    return an.pareto(runs(spark, d), ["sharpe_mean"], ["var", "turnover"])


@query("pareto2_knee", f"WITH {_RUNS}, fr AS (SELECT * FROM runs r WHERE NOT EXISTS ({_DOMINATED.format('', '')})) SELECT * FROM fr WHERE var <= (SELECT quantile_cont(var, 0.5) FROM fr) ORDER BY sharpe_mean DESC, var LIMIT 1", "sharpe_mean var turnover")
def _(spark, d):
    return an.knee(an.pareto(runs(spark, d), ["sharpe_mean"], ["var"]), "sharpe_mean", "var")


@query("pareto_flags", f"WITH {_RUNS}, fr AS (SELECT run FROM runs r WHERE NOT EXISTS ({_DOMINATED.format('', '')})) SELECT run, run IN (SELECT run FROM fr) AS pareto FROM runs")
def _(spark, d):
    r = runs(spark, d)
    front = an.pareto(r, ["sharpe_mean"], ["var"]).select("run", F.lit(True).alias("pareto"))
    return r.join(front, "run", "left").select("run", F.coalesce("pareto", F.lit(False)).alias("pareto"))


for _objective in ("sharpe_mean", "var"):

    @query(f"objective_rank_{_objective}", f"WITH {_RUNS} SELECT run, row_number() OVER (ORDER BY {_objective} {'DESC' if 'mean' in _objective else 'ASC'} NULLS LAST, run) AS place FROM runs", "", "place")
    def _(spark, d, objective=_objective):
        return an.ranked_runs(runs(spark, d), objective).select("run", "place")


@query("best_choice", f"WITH {_RUNS} SELECT split_part(run, '-', 1) AS axis, arg_max(run, sharpe_mean) AS best, arg_min(run, var) AS calmest FROM runs GROUP BY 1")
def _(spark, d):
    return runs(spark, d).groupBy(F.substring_index("run", "-", 1).alias("axis")).agg(F.max_by("run", "sharpe_mean").alias("best"), F.min_by("run", "var").alias("calmest"))


@query("natural_order", f"WITH {_RUNS} SELECT run, row_number() OVER (ORDER BY list_position(['roll', 'mix'], split_part(run, '-', 1)) NULLS LAST, regexp_extract(run, '([0-9]+)$', 1)::DOUBLE, run) AS place FROM runs", "", "place")
def _(spark, d):
    from pyspark.sql import Window

    custom = F.array_position(F.array(F.lit("roll"), F.lit("mix")), F.substring_index("run", "-", 1))
    order = Window.orderBy(F.when(custom > 0, custom).asc_nulls_last(), F.regexp_extract("run", "([0-9]+)$", 1).cast("double"), "run")
    return runs(spark, d).select("run", F.row_number().over(order).alias("place"))


@query("grid_expand", "SELECT metric || '|' || tau::VARCHAR || '|' || k::VARCHAR AS tag FROM (SELECT unnest(['l1', 'l2', 'lp_p1']) AS metric), (SELECT unnest([1, 2]) AS tau), (SELECT unnest([5, 10]) AS k)")
def _(spark, d):
    return spark.createDataFrame([(f"{m}|{t}|{k}",) for m, t, k in itertools.product(["l1", "l2", "lp_p1"], [1, 2], [5, 10])], "tag string")


@query("grid_dedupe", "SELECT CASE WHEN metric = 'lp_p1' THEN 'l1' ELSE metric END AS metric, tau::BIGINT AS tau, min(metric) AS kept FROM (SELECT unnest(['l1', 'l2', 'lp_p1']) AS metric), (SELECT unnest([1, 2]) AS tau) GROUP BY 1, 2")
def _(spark, d):
    """Distances of order 1 under both names are one choice: the first in order stays."""
    from pyspark.sql import Window

    rows = spark.createDataFrame(list(itertools.product(["l1", "l2", "lp_p1"], [1, 2])), "name string, tau long")
    rows = rows.withColumn("metric", F.when(F.col("name") == "lp_p1", "l1").otherwise(F.col("name")))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("metric", "tau").orderBy("name"))).where("k = 1").select("metric", "tau", F.col("name").alias("kept"))


@query("simplex_grid", "SELECT DISTINCT round(i / 10.0, 4)::DOUBLE AS model, round(j / 10.0, 4)::DOUBLE AS shrink, round((10 - i - j) / 10.0, 4)::DOUBLE AS pers FROM range(11) a(i), range(11) b(j) WHERE i + j <= 10", "model shrink pers")
def _(spark, d):
    i = spark.range(11).select(F.col("id").alias("i"))
    rows = i.crossJoin(i.withColumnRenamed("i", "j")).where("i + j <= 10")
    return rows.select(F.round(F.col("i") / 10, 4).alias("model"), F.round(F.col("j") / 10, 4).alias("shrink"), F.round((10 - F.col("i") - F.col("j")) / 10, 4).alias("pers")).dropDuplicates()


@query("guardrail_stats", f"WITH {_PAIR}, g AS (SELECT value / nullif(base, 0) AS ratio FROM pair) SELECT 100.0 * avg((ratio IS NULL OR ratio <= 0)::INT) AS triggered_pct, avg(ratio) AS mean_ratio, count(*) AS n, count(*) FILTER (ratio IS NULL OR ratio <= 0) AS n_invalid FROM g", "triggered_pct mean_ratio", "n n_invalid")
def _(spark, d):
    r = an.paired(results(spark, d), "roll").select(F.try_divide("value", "base").alias("ratio"))
    bad = F.col("ratio").isNull() | (F.col("ratio") <= 0)
    return an.guardrail_stats(r.select("ratio", bad.alias("triggered"), F.when(bad, "invalid").otherwise("none").alias("reason")))


@query("mix_advantage", f"WITH {RESULTS} SELECT a.method, avg(a.value - b.value) AS advantage, count(*) AS n FROM rows a JOIN rows b ON a.date = b.date AND b.method = 'mix' WHERE a.method <> 'mix' AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.method", "advantage", "n")
def _(spark, d):
    return an.mean_advantage(results(spark, d), "mix")


@query(
    "k_ablation",
    f"""WITH {RESULTS}, k AS (SELECT hour(date) % 6 + 1 AS k, avg(value) AS value FROM rows GROUP BY 1)
SELECT k, value, value - lag(value) OVER (ORDER BY k) AS gain, k = (SELECT arg_max(k, value) FROM k) AS best FROM k""",
    "value gain", "k",
)
def _(spark, d):
    """Six groups of hours stand for runs with one to six regimes."""
    runs = results(spark, d).groupBy((F.hour("date") % 6 + 1).alias("k")).agg(F.avg("value").alias("value"))
    return an.k_ablation(runs)


@query("evaluation_window", f"WITH {RESULTS} SELECT method, count(value) AS n, avg(value) AS mean FROM rows WHERE date BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY method", "mean", "n")
def _(spark, d):
    return an.evaluation_window(results(spark, d), "2024-01-05 00:00:00", "2024-01-20 00:00:00").groupBy("method").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


@query("box_summary", f"WITH {RESULTS} SELECT method, count(value) AS n, min(value) AS least, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS largest FROM rows GROUP BY method", "least q25 q50 q75 largest", "n")
def _(spark, d):
    return an.summary_quantiles(results(spark, d))


@query(
    "neighbour_overlay",
    f"""WITH {RESULTS}, s AS (SELECT t, value FROM rows WHERE method = 'model'), n AS (SELECT q, q - 24 * k AS id, 1.0 / k AS total_weight FROM (SELECT unnest([200, 300]) AS q), (SELECT unnest([1, 2, 3]) AS k))
SELECT q, id, step, q + step AS moved, value, total_weight FROM n, (SELECT unnest(range(6)) AS step), s WHERE s.t = id + step""",
    "value total_weight", "q id step moved",
)
def _(spark, d):
    near = spark.createDataFrame([(q, q - 24 * k, 1.0 / k) for q in (200, 300) for k in (1, 2, 3)], "q int, id int, total_weight double")
    return an.overlay(near, results(spark, d).where("method = 'model'").select("t", "value"), 5)


@query("beyond_limits", f"WITH {_LONG} SELECT date, method, metric, value FROM long WHERE abs(value) > CASE metric WHEN 'ret' THEN 0.004 ELSE 0.005 END", "value", "", "", "date")
def _(spark, d):
    return an.beyond(long_results(spark, d), {"ret": 0.004, "size": 0.005}).select("date", "method", "metric", "value")


@query("unit_comparison", f"WITH {_LONG} SELECT method, metric, count(value) FILTER (day(date) = 15) AS n, avg(value) FILTER (day(date) = 15) AS mean, max(value) FILTER (day(date) = 15) AS most, avg(value) FILTER (day(date) <> 15) AS mean_outside FROM long GROUP BY ALL", "mean most mean_outside", "n")
def _(spark, d):
    """The 15th of the month stands for the year that is looked at."""
    return an.unit_comparison(long_results(spark, d), F.dayofmonth("date") == 15)


@query("run_summary", f"WITH {_LONG} SELECT hour(date)::VARCHAR AS run, metric, avg(value) AS mean, count(value) AS n FROM long WHERE method = 'model' GROUP BY ALL", "mean", "n")
def _(spark, d):
    """Hours of the day stand for the runs of an ablation."""
    return an.run_summary(long_results(spark, d).withColumn("run", F.hour("date").cast("string")), "model")
