"""Rolling windows of a dense panel, and the covariances of their assets; all of it relational."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

RIDGE = 1e-8


def past(panel: DataFrame, lookback: int, stride: int, last: int, first: int | None = None, value: str = "r") -> DataFrame:
    """anchor, t, asset, r: the rows t in [anchor - lookback + 1, anchor] of each anchor first, first + stride, ... <= last.

    A row names its anchors itself, so windows are made without a join."""
    first = lookback - 1 if first is None else first
    k0 = F.greatest(F.ceil((F.col("t") - first) / stride), F.lit(0))
    k1 = F.least(F.floor((F.col("t") + lookback - 1 - first) / stride), F.lit((last - first) // stride))
    rows = panel.where(k0 <= k1).withColumn("anchor", F.explode(F.sequence(k0, k1)))
    return rows.select((F.col("anchor") * stride + first).cast("int").alias("anchor"), "t", "asset", F.col(value).alias("r"))


def future(panel: DataFrame, lookback: int, horizon: int, stride: int, last: int) -> DataFrame:
    """The rows t in [anchor + 1, anchor + horizon] of the same anchors."""
    ahead = past(panel, horizon, stride, last + horizon, lookback - 1 + horizon)
    return ahead.withColumn("anchor", F.col("anchor") - horizon)


def validity(windows: DataFrame, most_na: float = 0.3, least_assets: float = 0.8, least_dates: float = 0.5) -> DataFrame:
    """anchor, na, assets (share with any value), dates (share with any value), valid."""
    cells = windows.groupBy("anchor").agg(F.avg(F.col("r").isNull().cast("double")).alias("na"))
    share = lambda by, name: windows.groupBy("anchor", by).agg(F.max(F.col("r").isNotNull().cast("int")).alias("any")).groupBy("anchor").agg(F.avg("any").alias(name))
    out = cells.join(share("asset", "assets"), "anchor").join(share("t", "dates"), "anchor")
    return out.withColumn("valid", (F.col("na") <= most_na) & (F.col("assets") >= least_assets) & (F.col("dates") >= least_dates))


def one_asset() -> WindowSpec:
    """An asset's rows of one window: lookback rows, so one shuffle serves imputation and demeaning."""
    return Window.partitionBy("anchor", "asset")


def imputed(windows: DataFrame) -> DataFrame:
    """Missing values become the asset's mean over the window; 0 if it has none."""
    return windows.withColumn("r", F.coalesce("r", F.avg("r").over(one_asset()), F.lit(0.0)))


def variances(windows: DataFrame, ddof: int = 1, ridge: float = RIDGE) -> DataFrame:
    """The diagonal of covariance(), without the rest of it."""
    full = imputed(windows).groupBy("anchor", "asset").agg((F.var_pop("r") * F.count(F.lit(1)) / F.greatest(F.lit(1), F.count(F.lit(1)) - ddof) + ridge).alias("v"))
    return full.select("anchor", F.col("asset").alias("i"), F.col("asset").alias("j"), "v")


def covariance(windows: DataFrame, ddof: int = 1, ridge: float = RIDGE) -> DataFrame:
    """anchor, i, j, v for all pairs of assets (both orders), of imputed windows; ridge on the diagonal."""
    x = imputed(windows).select("anchor", "t", "asset", (F.col("r") - F.avg("r").over(one_asset())).alias("x"))
    # the assets of a date side by side: each pair is made once, next to its data
    rows = x.groupBy("anchor", "t").agg(F.array_sort(F.collect_list(F.struct("asset", "x"))).alias("a"))
    pairs = F.flatten(F.transform("a", lambda p, k: F.transform(F.slice("a", k + 1, F.size("a") - k), lambda q: F.struct(p["asset"].alias("i"), q["asset"].alias("j"), (p["x"] * q["x"]).alias("xx")))))
    s = rows.select("anchor", F.inline(pairs)).groupBy("anchor", "i", "j").agg((F.sum("xx") / F.greatest(F.lit(1), F.count(F.lit(1)) - ddof)).alias("v"))
    s = s.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0))
    return s.unionByName(s.where("i <> j").select("anchor", F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def diagonal(cov: DataFrame) -> DataFrame:
    return cov.where("i = j").select("anchor", F.col("i").alias("asset"), "v")


def correlation(cov: DataFrame, floor: float = 1e-12, clipped: bool = False) -> DataFrame:
    """v / sqrt(v_ii * v_jj); clipped: within [-1, 1] with ones on the diagonal."""
    d = diagonal(cov)
    both = cov.join(d.select("anchor", F.col("asset").alias("i"), F.col("v").alias("vi")), ["anchor", "i"]).join(d.select("anchor", F.col("asset").alias("j"), F.col("v").alias("vj")), ["anchor", "j"])
    v = F.col("v") / F.sqrt(F.greatest("vi", F.lit(floor)) * F.greatest("vj", F.lit(floor)))
    if clipped:
        v = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)))
    return both.select("anchor", "i", "j", v.alias("v"))


def shrunk(cov: DataFrame, gamma: float) -> DataFrame:
    """(1 - gamma) * S + gamma * diag(S)."""
    return cov.withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v")).otherwise((1 - gamma) * F.col("v")))


def mix_weights(weights: dict[str, float], methods: list[str], fallback: str = "shrink") -> dict[str, float]:
    """Floored at 0 and normalised; the fallback alone if none is left."""
    w = {k: max(0.0, weights.get(k, 0.0)) for k in methods}
    total = sum(w.values())
    return {k: x / total for k, x in w.items()} if total > 0 else {k: float(k == fallback) for k in methods}


def mixed(methods: dict[str, DataFrame], weights: dict[str, float], fallback: str = "shrink") -> DataFrame:
    """Weighted sum of covariances; weights are floored at 0 and normalised, the fallback alone counts if none is left."""
    w = mix_weights(weights, list(methods), fallback)
    out = None
    for k, cov in methods.items():
        one = cov.select("anchor", "i", "j", (w[k] * F.col("v")).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("anchor", "i", "j").agg(F.sum("v").alias("v"))


def trace(cov: DataFrame) -> DataFrame:
    return cov.where("i = j").groupBy("anchor").agg(F.sum("v").alias("trace"))


def guarded(model: DataFrame, base: DataFrame, fallback: DataFrame, low: float, high: float, mode: str = "invalid_only") -> DataFrame:
    """anchor, ratio (trace of the model over the base's), scale (that brings it into [low, high]), triggered, reason; with the guarded matrix in v.

    ratio_or_invalid replaces the model by the fallback where the ratio is out of range, invalid_only where it is no positive number."""
    if mode not in ("invalid_only", "ratio_or_invalid"):
        raise ValueError(f"unknown mode {mode!r}")
    t = trace(model).join(trace(base).withColumnRenamed("trace", "base"), "anchor")
    value = F.try_divide(F.col("trace"), F.col("base"))
    bad, out = value.isNull() | F.isnan(value) | (value <= 0), (value < low) | (value > high)
    reason = F.when(bad, "invalid").when(out & F.lit(mode == "ratio_or_invalid"), "ratio")
    scale = F.when(bad, 1.0).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)) / value)
    t = t.select("anchor", value.alias("ratio"), scale.alias("scale"), reason.isNotNull().alias("triggered"), F.coalesce(reason, F.lit("none")).alias("reason"))
    both = model.join(t, "anchor").join(fallback.select("anchor", "i", "j", F.col("v").alias("f")), ["anchor", "i", "j"])
    return both.withColumn("v", F.when(F.col("triggered"), F.col("f")).otherwise(F.col("v") * F.col("scale"))).drop("f")


def confidence_blend(model: DataFrame, persistent: DataFrame, alpha: DataFrame, strength: float = 0.35, threshold: float = 0.75, power: float = 2.0) -> DataFrame:
    """Blend towards persistence where the regime is unsure: lambda = 1 - strength * unc, unc = ((threshold - conf) / threshold) ** power, conf = (max alpha - 1/K) / (1 - 1/K)."""
    k = F.size("alpha")
    conf = F.try_divide(F.array_max("alpha") - 1 / k, 1 - 1 / k)
    conf = F.least(F.greatest(F.coalesce(conf, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    unc = F.when(conf < threshold, F.pow((threshold - conf) / threshold, F.lit(power))).otherwise(0.0)
    lam = alpha.select("anchor", conf.alias("confidence"), (1 - strength * unc).alias("lambda"))
    both = model.join(lam, "anchor").join(persistent.select("anchor", "i", "j", F.col("v").alias("p")), ["anchor", "i", "j"])
    return both.withColumn("v", F.col("lambda") * F.col("v") + (1 - F.col("lambda")) * F.col("p")).drop("p")


#: Sums that a covariance is made of: dates, dates with both assets, their products and sums, and each asset's own dates and sum.
_SUMS = ("n", "both", "xy", "x", "y", "ni", "xi", "nj", "yj")


def comoments(panel: DataFrame, width: int, offset: int = 0, value: str = "r") -> DataFrame:
    """pane, i, j (i <= j) and _SUMS over the dates t with floor((t - offset) / width) = pane.

    A date's pairs are made next to its values and summed before they are shuffled; nothing is repeated for the windows that a pane is in."""
    pane = F.floor((F.col("t") - offset) / width).cast("int")
    rows = panel.groupBy(pane.alias("pane"), "t").agg(F.array_sort(F.collect_list(F.struct("asset", F.col(value).alias("r")))).alias("a"))
    pairs = F.flatten(F.transform("a", lambda p, k: F.transform(F.slice("a", k + 1, F.size("a") - k), lambda q: F.struct(p["asset"].alias("i"), q["asset"].alias("j"), p["r"].alias("u"), q["r"].alias("v")))))
    there = F.col("u").isNotNull() & F.col("v").isNotNull()
    total = lambda x, cond=None: F.coalesce(F.sum(x if cond is None else F.when(cond, x)), F.lit(0.0))
    return rows.select("pane", F.inline(pairs)).groupBy("pane", "i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(there).alias("both"), total(F.col("u") * F.col("v")).alias("xy"), total(F.col("u"), there).alias("x"), total(F.col("v"), there).alias("y"),
        F.count("u").alias("ni"), total(F.col("u")).alias("xi"), F.count("v").alias("nj"), total(F.col("v")).alias("yj"),
    )


def rolling_covariances(panel: DataFrame, spans: dict[str, tuple[int, int]], first: int, stride: int, last: int, value: str = "r", ddof: int = 1, ridge: float = RIDGE) -> DataFrame:
    """anchor, i, j and a covariance for each span (name: first and last date, counted from the anchor), for the anchors first, first + stride, ... <= last.

    Dates are summed in panes that all spans are made of, and a span's sums are those of its panes, by one window over a pair's panes. A
    missing value is imputed with its window's mean: with m the means of what is there, the sum of products is
    xy - m_i * y - m_j * x + both * m_i * m_j."""
    begin, end = min(a for a, _ in spans.values()), max(b for _, b in spans.values())
    width = math.gcd(stride, *[a - begin for a, _ in spans.values()], *[b - a + 1 for a, b in spans.values()])
    offset = (first + begin) % width
    by = Window.partitionBy("i", "j").orderBy("pane")

    def covariance_of(a: int, b: int) -> Column:
        over = by.rowsBetween(-((end - a + 1) // width) + 1, -((end - b) // width))
        n, both, xy, x, y, ni, xi, nj, yj = (F.sum(c).over(over) for c in _SUMS)
        mi, mj = (F.coalesce(F.try_divide(total, count), F.lit(0.0)) for total, count in ((xi, ni), (yj, nj)))
        return (xy - mi * y - mj * x + both * mi * mj) / F.greatest(F.lit(1), n - ddof) + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)

    # a row of a pane stands for the anchor whose last span ends with it
    anchor = (F.col("pane") * width + (offset + width - 1 - end)).cast("int")
    cov = comoments(panel, width, offset, value).select(anchor.alias("anchor"), "i", "j", *[covariance_of(a, b).alias(name) for name, (a, b) in spans.items()])
    cov = cov.where((F.col("anchor") >= first) & (F.col("anchor") <= last) & ((F.col("anchor") - first) % stride == 0))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return cov.select("anchor", F.inline(both), *spans)


def rolling_covariance(panel: DataFrame, lookback: int, stride: int, last: int) -> DataFrame:
    """anchor, i, j, v: the covariances of the past windows of past()."""
    return rolling_covariances(panel, {"v": (1 - lookback, 0)}, lookback - 1, stride, last)


def kind_covariances(panel: DataFrame, lookback: int, horizon: int, stride: int, last: int) -> DataFrame:
    """anchor, i, j, roll, pers, truth: the covariances of the past window, of its last horizon dates and of the next ones, side by side."""
    return rolling_covariances(panel, {"roll": (1 - lookback, 0), "pers": (1 - horizon, 0), "truth": (1, horizon)}, lookback - 1, stride, last)


def kind_log_vols(panel: DataFrame, lookback: int, horizon: int, stride: int, last: int, floor: float = 1e-12) -> DataFrame:
    """anchor, asset, roll, pers, truth: log volatilities of the three windows side by side, by one aggregation.

    A missing value is imputed with its window's mean, so it adds nothing to the sum of squares."""
    rows = past(panel, lookback + horizon, stride, last + horizon, lookback + horizon - 1).withColumn("anchor", F.col("anchor") - horizon)
    parts = {"roll": F.col("t") <= F.col("anchor"), "pers": (F.col("t") <= F.col("anchor")) & (F.col("t") > F.col("anchor") - horizon), "truth": F.col("t") > F.col("anchor")}
    v = lambda cond: F.coalesce(F.var_pop(F.when(cond, F.col("r"))) * F.count(F.when(cond, F.col("r"))), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if(cond) - 1) + RIDGE
    return rows.groupBy("anchor", "asset").agg(*[(0.5 * F.log(F.greatest(v(cond), F.lit(floor)))).alias(name) for name, cond in parts.items()])


def log_vol(cov: DataFrame, floor: float = 1e-12) -> DataFrame:
    """anchor, asset, v: half the log of the variance."""
    return diagonal(cov).withColumn("v", 0.5 * F.log(F.greatest("v", F.lit(floor))))


def vol_to_mean(vol: DataFrame, gamma: float) -> DataFrame:
    """Shrunk towards the mean over assets."""
    mean = vol.groupBy("anchor").agg(F.avg("v").alias("m"))
    return vol.join(mean, "anchor").select("anchor", "asset", ((1 - gamma) * F.col("v") + gamma * F.col("m")).alias("v"))


def damped(knn: DataFrame, roll: DataFrame, shrink: DataFrame, a: float, b: float) -> DataFrame:
    """(1 - min(1, a + b)) * knn + a * roll + b * shrink."""
    keys = ["anchor", "asset"]
    both = knn.join(roll.select(*keys, F.col("v").alias("x")), keys).join(shrink.select(*keys, F.col("v").alias("y")), keys)
    return both.select(*keys, ((1 - min(1.0, a + b)) * F.col("v") + a * F.col("x") + b * F.col("y")).alias("v"))


def vol_mixed(model: DataFrame, shrink: DataFrame, weight: float) -> DataFrame:
    """weight * model + (1 - weight) * shrink."""
    keys = ["anchor", "asset"]
    return model.join(shrink.select(*keys, F.col("v").alias("x")), keys).select(*keys, (weight * F.col("v") + (1 - weight) * F.col("x")).alias("v"))


def vol_statistics(windows: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Ten numbers of each window: mean, deviation, quantiles and range of log volatilities, their change between halves, concentration."""
    full = imputed(windows)
    span = full.groupBy("anchor").agg(F.min("t").alias("t0"), F.count_distinct("t").alias("n"))
    full = full.join(span, "anchor").withColumn("late", F.col("t") - F.col("t0") >= F.floor(F.col("n") / 2))
    sd = lambda x: F.greatest(F.coalesce(F.stddev_samp(x), F.lit(0.0)), F.lit(floor))
    per = full.groupBy("anchor", "asset").agg(sd(F.col("r")).alias("s"), sd(F.when(~F.col("late"), F.col("r"))).alias("s1"), sd(F.when(F.col("late"), F.col("r"))).alias("s2"), F.first("n").alias("n"))
    q = lambda p: F.percentile(F.log("s"), p)
    return per.groupBy("anchor").agg(
        F.avg(F.log("s")).alias("mean"), F.coalesce(F.stddev_samp(F.log("s")), F.lit(0.0)).alias("sd"), q(0.05).alias("q05"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), q(0.95).alias("q95"),
        (q(0.75) - q(0.25)).alias("iqr"), F.when(F.max("n") >= 4, F.avg(F.log("s2")) - F.avg(F.log("s1"))).otherwise(0.0).alias("change"),
        (F.sum(F.pow("s", F.lit(2.0))) / F.pow(F.sum("s") + floor, F.lit(2.0))).alias("hhi"),
    )


def frobenius(one: DataFrame, two: DataFrame, off_diagonal: bool = False) -> DataFrame:
    both = one.join(two.select("anchor", "i", "j", F.col("v").alias("w")), ["anchor", "i", "j"])
    both = both.where("i <> j") if off_diagonal else both
    return both.groupBy("anchor").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("w"), F.lit(2.0)))).alias("value"))


def spearman(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rank correlation of the upper triangles; ties get their mean rank."""
    both = one.where("i < j").join(two.select("anchor", "i", "j", F.col("v").alias("w")), ["anchor", "i", "j"])

    def ranked(c: str) -> Column:
        own = Window.partitionBy("anchor")
        return F.rank().over(own.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("anchor", c)) - 1) / 2

    return both.withColumns({"a": ranked("v"), "b": ranked("w")}).groupBy("anchor").agg(F.corr("a", "b").alias("value"))


def vol_metrics(forecast: DataFrame, truth: DataFrame) -> DataFrame:
    """anchor, mse, mae, rmse, qlike, r2 of log volatilities."""
    return vol_losses(forecast.join(truth.select("anchor", "asset", F.col("v").alias("y")), ["anchor", "asset"]), "anchor")


def vol_losses(both: DataFrame, *keys: str) -> DataFrame:
    """keys, mse, mae, qlike, r2, rmse of forecasts v beside truths y, in one aggregation."""
    e, variance = F.col("v") - F.col("y"), F.greatest(F.exp(2 * F.col("v")), F.lit(1e-12))
    per = both.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.log(variance) + F.exp(2 * F.col("y")) / variance).alias("qlike"), (1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("y"))).alias("r2")
    )
    return per.withColumn("rmse", F.sqrt("mse"))
