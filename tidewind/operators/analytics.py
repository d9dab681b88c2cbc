"""Analytics over a long result table: date, method, value (one metric), or date, method, metric, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.stats import t_pvalue, wilcoxon_pvalue
from .ranks import mean_rank, medians, placed
from .skyline import skyline


def stars(p: Column) -> Column:
    """Marks of a p-value (fixed values); null of none."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").when(p.isNotNull(), "")



def by_method() -> WindowSpec:
    return Window.partitionBy("method").orderBy("date")


def report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric", "method").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def pivoted(rows: DataFrame, methods: list[str], lower_better: Column) -> DataFrame:
    """metric, a column for each method, best and worst."""
    means = report(rows)
    sign = F.when(lower_better, F.col("value")).otherwise(-F.col("value"))
    ends = means.groupBy("metric").agg(F.min_by("method", F.struct(sign, "method")).alias("best"), F.max_by("method", F.struct(sign, "method")).alias("worst"))
    return means.groupBy("metric").pivot("method", methods).agg(F.first("value")).join(ends, "metric")


def common_dates(rows: DataFrame, n_required: int) -> DataFrame:
    """Rows of dates on which all methods (and metrics) have a value."""
    whole = rows.groupBy("date").agg(F.count("value").alias("n")).where(F.col("n") == n_required).select("date")
    return rows.join(whole, "date", "left_semi")


def method_ranks(rows: DataFrame, lower_better: bool = True) -> DataFrame:
    """method, mean, sd, rank (ties get their mean rank)."""
    per = rows.groupBy("method").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    key = F.col("mean") if lower_better else -F.col("mean")
    return per.withColumn("rank", F.rank().over(Window.orderBy(key)) + (F.count(F.lit(1)).over(Window.partitionBy("mean")) - 1) / 2)


def paired(rows: DataFrame, base: str) -> DataFrame:
    """date, method, value, base: each method beside the base, where both have values."""
    ref = rows.where((F.col("method") == base) & F.col("value").isNotNull()).select("date", F.col("value").alias("base"))
    return rows.where((F.col("method") != base) & F.col("value").isNotNull()).join(ref, "date")


def win_rates(rows: DataFrame, base: str, lower_better: bool = True) -> DataFrame:
    win = F.col("value") < F.col("base") if lower_better else F.col("value") > F.col("base")
    return paired(rows, base).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(win.cast("double")).alias("win_rate"))


def paired_t(rows: DataFrame, base: str, alternative: str = "two-sided") -> DataFrame:
    """method, n, mean_diff, t, p, stars."""
    d = F.col("value") - F.col("base")
    per = paired(rows, base).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("t"))
    p = F.udf(lambda t, n: None if t is None or n < 2 else float(t_pvalue(t, n - 1, alternative)), "double")  # a row for each method
    return per.withColumn("p", p("t", "n")).withColumn("stars", stars(F.col("p")))


def wilcoxon(rows: DataFrame, base: str) -> DataFrame:
    """method, n, median_advantage (base - value), w, ties, p: signed ranks of the non-zero differences."""
    d = paired(rows, base).select("method", (F.col("base") - F.col("value")).alias("v"))
    ranked = placed(d.where("v <> 0").select("method", F.abs("v").alias("v"), (F.col("v") > 0).alias("up")), ["method"], F.count_if("up").alias("ups"))
    size = F.col("size").cast("double")
    per = ranked.groupBy("method").agg(F.sum("size").alias("n"), F.sum(F.col("ups") * mean_rank()).alias("plus"), F.sum((F.col("size") - F.col("ups")) * mean_rank()).alias("minus"), F.sum(size * (size * size - 1)).alias("ties"))
    median = medians(placed(d, ["method"]), ["method"], "median_advantage")
    p = F.udf(lambda w, n, ties: float(wilcoxon_pvalue(w, n, ties)), "double")  # a row for each method
    return median.join(per, "method").withColumn("w", F.least("plus", "minus")).withColumn("p", p("w", "n", "ties")).select("method", "n", "median_advantage", "w", "ties", "p")


def correlations(rows: DataFrame, least: int = 3) -> DataFrame:
    """a, b, n, corr for each two methods, on dates that have both."""
    two = rows.where("value IS NOT NULL").select("date", F.col("method").alias("b"), F.col("value").alias("y"))
    both = rows.where("value IS NOT NULL").select("date", F.col("method").alias("a"), F.col("value").alias("x")).join(two, "date").where("a < b")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("corr")).where(F.col("n") >= least)


def wealth(rows: DataFrame) -> DataFrame:
    """wealth: product of 1 + value along each method's dates; missing values count as 0."""
    return rows.withColumn("wealth", F.product(1 + F.coalesce("value", F.lit(0.0))).over(by_method().rowsBetween(Window.unboundedPreceding, 0)))


def max_drawdown(rows: DataFrame, from_one: bool = False) -> DataFrame:
    """method, drawdown: least (wealth - peak) / peak; the peak starts at the first wealth, or at 1."""
    peak = F.max("wealth").over(by_method().rowsBetween(Window.unboundedPreceding, 0))
    peak = F.greatest(peak, F.lit(1.0)) if from_one else peak
    return wealth(rows).withColumn("dd", (F.col("wealth") - peak) / peak).groupBy("method").agg(F.min("dd").alias("drawdown"))


def terminal_wealth(rows: DataFrame, base: str) -> DataFrame:
    per = rows.groupBy("method").agg(F.product(1 + F.coalesce("value", F.lit(0.0))).alias("wealth"))
    ref = per.where(F.col("method") == base).select(F.col("wealth").alias("b"))
    return per.crossJoin(F.broadcast(ref)).select("method", "wealth", (100 * (F.try_divide("wealth", "b") - 1)).alias("over_base_pct"))


def rolling(rows: DataFrame, window: int = 21, kind: str = "median", least: int | None = None) -> DataFrame:
    """Rolling median or mean of value; NULL until there are least values (the window's size by default)."""
    frame = by_method().rowsBetween(1 - window, 0)
    out = F.percentile("value", 0.5).over(frame) if kind == "median" else F.avg("value").over(frame)
    return rows.withColumn("rolled", F.when(F.count("value").over(frame) >= (window if least is None else least), out))


def cumulative_advantage(rows: DataFrame, base: str) -> DataFrame:
    return paired(rows, base).withColumn("advantage", F.sum(F.col("base") - F.col("value")).over(by_method().rowsBetween(Window.unboundedPreceding, 0)))


def information_ratio(rows: DataFrame) -> DataFrame:
    return rows.groupBy("method").agg((F.try_divide(F.avg("value"), F.stddev_samp("value")) * F.sqrt(F.lit(252.0))).alias("ir"), F.stddev_pop("value").alias("sd_pop"), F.avg("value").alias("mean"))


def by_unit(rows: DataFrame, unit: Column) -> DataFrame:
    return rows.groupBy(unit.alias("unit"), "method").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def by_regime(rows: DataFrame, regimes: DataFrame, base: str) -> DataFrame:
    """state, method, mean, n, win rate over the base; regimes: date, state."""
    ref = rows.where(F.col("method") == base).select("date", F.col("value").alias("base"))
    both = rows.join(regimes, "date").join(ref, "date", "left")
    return both.groupBy("state", "method").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.avg((F.col("value") < F.col("base")).cast("double")).alias("win"))


#: Names of regimes (fixed values): the first whose condition holds, of covariance and of volatility runs.
CRISIS_NAME, OTHER_NAME = "Crisis/High Stress", "Normal/Transition"


def regime_name(vol: bool = False) -> Column:
    """The name of a regime with crisis_overlap (percent) and the means mean_gmvp_sharpe, mean_turnover and mean_fro, or mean_vol_mse; a missing mean fulfils no condition."""
    sharpe, turnover, crisis = F.col("mean_gmvp_sharpe"), F.col("mean_turnover"), F.col("crisis_overlap") > 30
    if vol:
        return F.when(crisis, CRISIS_NAME).when(F.col("mean_vol_mse") > 0.05, "High Vol MSE").otherwise(OTHER_NAME)
    named = F.when(crisis, CRISIS_NAME).when((sharpe > 1.5) & (turnover < 0.5), "Calm Bull").when(sharpe < 0.5, "Stress/Low Sharpe")
    return named.when(F.col("mean_fro") > 0.025, "High Uncertainty").when(turnover > 0.7, "Volatile/Choppy").otherwise(OTHER_NAME)


def regime_profile(rows: DataFrame, periods: DataFrame, vol: bool = False) -> DataFrame:
    """state, n, share (percent of days), means of the model's fro, gmvp_sharpe, turnover and vol_mse, crisis_overlap (percent of days within the periods, one decimal) and name; rows: date, state and these four, periods: first, last."""
    metrics = ("fro", "gmvp_sharpe", "turnover", "vol_mse")
    inside = rows.select("date").distinct().join(periods, F.col("date").between(F.col("first"), F.col("last")), "left_semi").withColumn("crisis", F.lit(1.0))
    per = rows.join(inside, "date", "left").groupBy("state").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in metrics], F.round(100 * F.avg(F.coalesce("crisis", F.lit(0.0))), 1).alias("crisis_overlap"))
    share = 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each regime
    return per.select("state", "n", share.alias("share"), *[f"mean_{m}" for m in metrics], "crisis_overlap", regime_name(vol).alias("name"))


def detection_lag(regimes: DataFrame, periods: DataFrame, state: int) -> DataFrame:
    """label, first_seen, lag in days: when a state first shows in each period."""
    seen = regimes.where(F.col("state") == state).join(F.broadcast(periods), F.col("date").between(F.col("first"), F.col("last")))
    return seen.groupBy("label", "first").agg(F.min("date").alias("first_seen")).select("label", "first_seen", F.date_diff(F.to_date("first_seen"), F.to_date("first")).cast("long").alias("lag"))


def crossings(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """method, threshold, first date on which the method's wealth falls below it."""
    w = wealth(rows).withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    return w.where("wealth < threshold").groupBy("method", "threshold").agg(F.min("date").alias("date"))


def ratio_outliers(rows: DataFrame, base: str, high: float = 3.0) -> DataFrame:
    r = F.try_divide(F.col("value"), F.col("base"))
    return paired(rows, base).withColumn("ratio", r).where((F.col("ratio") > high) | (F.col("ratio") < 1 / high))


def density(rows: DataFrame, points: int = 200) -> DataFrame:
    """method, x, density: Gaussian kernels (Scott's bandwidth) on a grid between the 1st and the 99th percentile."""
    per = rows.where("value IS NOT NULL").groupBy("method").agg(F.percentile("value", 0.01).alias("lo"), F.percentile("value", 0.99).alias("hi"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    per = per.where("n > 1 AND sd > 0").withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    grid = per.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1))
    z = (F.col("x") - F.col("value")) / F.col("h")
    # the grid is points rows for each method; values stay where they are and meet it as a broadcast table
    both = rows.where("value IS NOT NULL").select("method", "value").join(F.broadcast(grid) if points <= 10_000 else grid, "method")
    return both.groupBy("method", "k", "x", "h", "n").agg((F.sum(F.exp(-0.5 * z * z)) / (F.col("n") * F.col("h") * F.sqrt(F.lit(2 * 3.141592653589793)))).alias("density")).select("method", "k", "x", "density")


def guardrail_stats(rows: DataFrame) -> DataFrame:
    """Of rows (ratio, triggered, reason): share triggered, mean ratio, how many."""
    return rows.agg((100 * F.avg(F.col("triggered").cast("double"))).alias("triggered_pct"), F.avg("ratio").alias("mean_ratio"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "invalid").alias("n_invalid"))


def blend_stats(rows: DataFrame) -> DataFrame:
    """Of rows (lambda, confidence): share blended towards persistence in percent, mean and least lambda, mean confidence."""
    return rows.agg(
        (100 * F.avg((F.col("lambda") < 0.999999).cast("double"))).alias("blended_pct"), F.avg("lambda").alias("lambda_mean"), F.min("lambda").alias("lambda_min"), F.avg("confidence").alias("confidence_mean"), F.count(F.lit(1)).alias("n")
    )


def reason_counts(rows: DataFrame) -> DataFrame:
    """reason, n: how often each reason of a guardrail stands in rows; none is the empty text."""
    return rows.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def beyond(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows (date, method, metric, value) whose value is larger, in size, than its metric's limit."""
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])
    return rows.withColumn("limit", F.element_at(limit, F.col("metric"))).where(F.abs("value") > F.col("limit"))


def unit_comparison(rows: DataFrame, inside: Column) -> DataFrame:
    """method, metric, n, mean and max of value inside a part of the dates, and the mean outside."""
    own = F.when(inside, F.col("value"))
    return rows.groupBy("method", "metric").agg(F.count(own).alias("n"), F.avg(own).alias("mean"), F.max(own).alias("most"), F.avg(F.when(~inside, F.col("value"))).alias("mean_outside"))


def run_summary(rows: DataFrame, method: str) -> DataFrame:
    """run, metric, mean, n: the means of one method's metrics for each run."""
    return rows.where(F.col("method") == method).groupBy("run", "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def pareto(runs: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """Runs that no other run is as good as everywhere and better than somewhere; equal runs stay together."""
    return skyline(runs, up, down)


def knee(front: DataFrame, gain: str, cost: str) -> DataFrame:
    """Of the runs of a front whose cost is up to the median, the one with the largest gain."""
    mid = front.agg(F.percentile(cost, 0.5).alias("mid"))
    return front.crossJoin(F.broadcast(mid)).where(F.col(cost) <= F.col("mid")).drop("mid").orderBy(F.desc(gain), cost).limit(1)


def ranked_runs(runs: DataFrame, objective: str) -> DataFrame:
    """Runs in order of an objective: descending if its name holds "mean" and isn't vol_mse's, missing values last."""
    down = "mean" in objective and "vol_mse" not in objective
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(objective) if down else F.asc_nulls_last(objective), "run")))


def mean_advantage(rows: DataFrame, of: str) -> DataFrame:
    """method, advantage, n: how much smaller the values of one method are than each other's, on dates that have both."""
    return paired(rows, of).groupBy("method").agg(F.avg(F.col("value") - F.col("base")).alias("advantage"), F.count(F.lit(1)).alias("n"))


def k_ablation(runs: DataFrame, up: bool = True) -> DataFrame:
    """From (k, value): each k's gain over the one before, and whether it is the best (the smallest of equals)."""
    every = Window.orderBy("k")
    order = F.struct(F.col("value"), -F.col("k")) if up else F.struct(-F.col("value"), -F.col("k"))
    best = runs.agg(F.max_by("k", order).alias("best"))
    return runs.withColumn("gain", F.col("value") - F.lag("value").over(every)).crossJoin(F.broadcast(best)).select("k", "value", "gain", (F.col("k") == F.col("best")).alias("best"))


def overlay(neighbours: DataFrame, series: DataFrame, ahead: int) -> DataFrame:
    """q, step, value, total_weight: what followed each neighbour (q, id, total_weight), moved to the query's time; series: t, value."""
    steps = neighbours.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(ahead))))
    moved = steps.withColumn("t", (F.col("id") + F.col("step")).cast("int"))
    return moved.join(series, "t").select("q", "id", "step", (F.col("q") + F.col("step")).alias("moved"), "value", "total_weight")


def evaluation_window(rows: DataFrame, first: str, last: str) -> DataFrame:
    return rows.where(F.col("date").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))


def summary_quantiles(rows: DataFrame) -> DataFrame:
    """method and the numbers of a box plot: n, least, quartiles, largest."""
    q = lambda p: F.percentile("value", p)
    return rows.groupBy("method").agg(F.count("value").alias("n"), F.min("value").alias("least"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("value").alias("largest"))
