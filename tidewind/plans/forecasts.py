"""Queries on covariances, volatilities, neighbours, regimes and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import entropy, one_hot, smoothed, softmax_by_distance
from ..operators import knn, portfolio, regime, windows
from ..sources import panels as src
from .catalog import FLAGS, HOURS, STATUS, VECTORS, query, sql_cov, sql_windows
from .panels import flags_panel, hours_panel, last_anchor, status_panel

L, H, STRIDE = 50, 20, 5


def _past_future(spark, d, panel=flags_panel, lookback=L, horizon=H, stride=STRIDE):
    p = panel(spark, d)
    last = last_anchor(p, horizon)
    return windows.past(p, lookback, stride, last), windows.future(p, lookback, horizon, stride, last)


def covs(spark, d, panel=flags_panel):
    """Rolling covariance, persistence (last H rows) and truth (next H rows) of each anchor."""
    own = kinds(spark, d, panel)
    return tuple(own.select("anchor", "i", "j", F.col(name).alias("v")) for name in ("roll", "pers", "truth"))


_COV = f"{FLAGS}, {sql_windows('panel', L, STRIDE, H)}, {sql_cov('w', 'roll')}"
_PERS = sql_cov(f"(SELECT * FROM w WHERE t > anchor - {H})", "pers")
_ALL = f"{_COV}, {_PERS}, {sql_cov('f', 'truth')}"
_CORR = "SELECT s.anchor, s.i, s.j, s.v / sqrt(greatest(a.v, 1e-12) * greatest(b.v, 1e-12)) AS v FROM {0} s JOIN {0} a ON a.anchor = s.anchor AND a.i = s.i AND a.j = s.i JOIN {0} b ON b.anchor = s.anchor AND b.i = s.j AND b.j = s.j"
_SCALED = "v * 1e6 AS v"


def kinds(spark, d, panel=flags_panel, made=windows.kind_covariances):
    """Rolling, persistence and truth side by side, in one pass over the panel."""
    p = panel(spark, d)
    return made(p, L, H, STRIDE, last_anchor(p, H))


def big(df, c="v"):
    """Variances are of the order of 1e-4: results are compared in millionths."""
    return df.withColumn(c, F.col(c) * 1e6)


@query("cov_long", f"WITH {_COV} SELECT anchor, i, j, {_SCALED} FROM roll", "v", "anchor")
def _(spark, d):
    p = flags_panel(spark, d)
    return big(windows.rolling_covariance(p, L, STRIDE, last_anchor(p, H)))


@query("corr_long", f"WITH {_COV} {_CORR.format('roll')}", "v", "anchor")
def _(spark, d):
    return windows.correlation(covs(spark, d)[0])


@query("corr_clipped", f"WITH {_COV} SELECT anchor, i, j, CASE WHEN i = j THEN 1 ELSE least(greatest(v, -1), 1) END AS v FROM ({_CORR.format('roll')})", "v", "anchor")
def _(spark, d):
    return windows.correlation(covs(spark, d)[0], clipped=True)


@query("cov_shrink", f"WITH {_COV} SELECT anchor, i, j, 1e6 * v * CASE WHEN i = j THEN 1 ELSE 0.7 END AS v FROM roll", "v", "anchor")
def _(spark, d):
    return big(windows.shrunk(covs(spark, d)[0], 0.3))


@query("cov_mix", f"WITH {_ALL} SELECT anchor, i, j, 1e6 * (0.25 * roll.v + 0.35 * roll.v * CASE WHEN i = j THEN 1 ELSE 0.7 END + 0.4 * pers.v) AS v FROM roll JOIN pers USING (anchor, i, j)", "v", "anchor")
def _(spark, d):
    w = windows.mix_weights({"model": 0.25, "shrink": 0.35, "pers": 0.4}, ["model", "shrink", "pers"])
    shrink = F.when(F.col("i") == F.col("j"), F.col("roll")).otherwise(0.7 * F.col("roll"))
    v = w["model"] * F.col("roll") + w["shrink"] * shrink + w["pers"] * F.col("pers")
    return big(kinds(spark, d).select("anchor", "i", "j", v.alias("v")))


_TRACE = "(SELECT anchor, sum(v) AS trace FROM {} WHERE i = j GROUP BY anchor)"
_GUARD = f"""{_ALL}, g AS (SELECT anchor, p.trace / r.trace AS ratio FROM {_TRACE.format('pers')} p JOIN {_TRACE.format('roll')} r USING (anchor)),
gs AS (SELECT anchor, ratio, least(greatest(ratio, 0.8), 1.2) / ratio AS scale, ratio < 0.8 OR ratio > 1.2 AS triggered, CASE WHEN ratio < 0.8 OR ratio > 1.2 THEN 'ratio' ELSE 'none' END AS reason FROM g)"""


@query("cov_trace_guardrail", f"WITH {_GUARD} SELECT anchor, i, j, 1e6 * CASE WHEN triggered THEN roll.v * CASE WHEN i = j THEN 1 ELSE 0.7 END ELSE pers.v * scale END AS v, ratio, scale, triggered, reason FROM pers JOIN roll USING (anchor, i, j) JOIN gs USING (anchor)", "v ratio scale", "anchor")
def _(spark, d):
    roll, pers, _ = covs(spark, d)
    return big(windows.guarded(pers, roll, windows.shrunk(roll, 0.3), 0.8, 1.2, "ratio_or_invalid"))


@query("vol_target", f"WITH {_ALL} SELECT anchor, i AS asset, 0.5 * ln(greatest(v, 1e-12)) AS v FROM truth WHERE i = j", "v", "anchor")
def _(spark, d):
    return windows.log_vol(windows.variances(_past_future(spark, d)[1]))


_VOLS = f"""{_ALL}, vr AS (SELECT anchor, i AS asset, 0.5 * ln(greatest(v, 1e-12)) AS v FROM roll WHERE i = j), vp AS (SELECT anchor, i AS asset, 0.5 * ln(greatest(v, 1e-12)) AS v FROM pers WHERE i = j),
vt AS (SELECT anchor, i AS asset, 0.5 * ln(greatest(v, 1e-12)) AS v FROM truth WHERE i = j), vs AS (SELECT anchor, asset, 0.7 * v + 0.3 * avg(v) OVER (PARTITION BY anchor) AS v FROM vr),
vd AS (SELECT anchor, asset, 0.35 * vp.v + 0.5 * vr.v + 0.15 * vs.v AS v FROM vp JOIN vr USING (anchor, asset) JOIN vs USING (anchor, asset))"""


def vols(spark, d):
    """method, anchor, asset, v, y: the baselines beside the truth; one pass over the panel, the methods made of its columns."""
    from pyspark.sql import Window

    own = kinds(spark, d, made=windows.kind_log_vols).withColumn("shrink", 0.7 * F.col("roll") + 0.3 * F.avg("roll").over(Window.partitionBy("anchor")))
    own = own.withColumn("damped", (1 - min(1.0, 0.5 + 0.15)) * F.col("pers") + 0.5 * F.col("roll") + 0.15 * F.col("shrink"))
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("v")) for m in ("roll", "pers", "shrink", "damped")])
    return own.select("anchor", "asset", F.col("truth").alias("y"), F.inline(methods))


@query("vol_baselines", f"WITH {_VOLS} SELECT 'roll' AS method, * FROM vr UNION ALL SELECT 'pers', * FROM vp UNION ALL SELECT 'shrink', * FROM vs UNION ALL SELECT 'damped', * FROM vd", "v", "anchor")
def _(spark, d):
    return vols(spark, d).select("method", "anchor", "asset", "v")


_METRIC = """SELECT '{0}' AS method, anchor, avg((h.v - t.v) ** 2) AS mse, avg(abs(h.v - t.v)) AS mae, avg(ln(greatest(exp(2 * h.v), 1e-12)) + exp(2 * t.v) / greatest(exp(2 * h.v), 1e-12)) AS qlike,
1 - sum((h.v - t.v) ** 2) / nullif(var_pop(t.v) * count(*), 0) AS r2, sqrt(avg((h.v - t.v) ** 2)) AS rmse FROM {1} h JOIN vt t USING (anchor, asset) GROUP BY anchor"""


@query("vol_metrics", f"WITH {_VOLS} {' UNION ALL '.join(_METRIC.format(m, 'v' + m[0]) for m in ('roll', 'pers', 'shrink', 'damped'))}", "mse mae qlike r2 rmse", "anchor")
def _(spark, d):
    return windows.vol_losses(vols(spark, d), "method", "anchor")


@query("cov_fro", f"WITH {_ALL} SELECT anchor, 1e6 * sqrt(sum((roll.v - truth.v) ** 2)) AS value FROM roll JOIN truth USING (anchor, i, j) GROUP BY anchor", "value", "anchor")
def _(spark, d):
    gap = F.pow(F.col("roll") - F.col("truth"), F.lit(2.0))
    return big(kinds(spark, d).groupBy("anchor").agg(F.sqrt(F.sum(gap)).alias("value")), "value")


@query("cov_corr_offdiag", f"WITH {_ALL}, a AS ({_CORR.format('roll')}), b AS ({_CORR.format('truth')}) SELECT anchor, sqrt(sum((a.v - b.v) ** 2)) AS value FROM a JOIN b USING (anchor, i, j) WHERE i <> j GROUP BY anchor", "value", "anchor")
def _(spark, d):
    roll, _, truth = covs(spark, d)
    return windows.frobenius(windows.correlation(roll, clipped=True), windows.correlation(truth, clipped=True), off_diagonal=True)


@query(
    "cov_spearman",
    f"""WITH {_ALL}, a AS ({_CORR.format('roll')}), b AS ({_CORR.format('truth')}),
k AS (SELECT anchor, rank() OVER (PARTITION BY anchor ORDER BY a.v) + (count(*) OVER (PARTITION BY anchor, a.v) - 1) / 2.0 AS x, rank() OVER (PARTITION BY anchor ORDER BY b.v) + (count(*) OVER (PARTITION BY anchor, b.v) - 1) / 2.0 AS y
  FROM a JOIN b USING (anchor, i, j) WHERE i < j) SELECT anchor, corr(x, y) AS value FROM k GROUP BY anchor""",
    "value", "anchor",
)
def _(spark, d):
    roll, _, truth = covs(spark, d)
    return windows.spearman(windows.correlation(roll), windows.correlation(truth))


@query(
    "vol_stats_embedding",
    f"""WITH {FLAGS}, {sql_windows("panel", L, STRIDE, H)},
x AS (SELECT anchor, asset, t - anchor + {L} - 1 >= {L // 2} AS late, coalesce(r, avg(r) OVER (PARTITION BY anchor, asset), 0) AS r FROM w),
s AS (SELECT anchor, asset, greatest(stddev_samp(r), 1e-12) AS s, greatest(stddev_samp(r) FILTER (NOT late), 1e-12) AS s1, greatest(stddev_samp(r) FILTER (late), 1e-12) AS s2 FROM x GROUP BY ALL)
SELECT anchor, avg(ln(s)) AS mean, stddev_samp(ln(s)) AS sd, quantile_cont(ln(s), 0.05) AS q05, quantile_cont(ln(s), 0.25) AS q25, quantile_cont(ln(s), 0.5) AS q50, quantile_cont(ln(s), 0.75) AS q75, quantile_cont(ln(s), 0.95) AS q95,
  quantile_cont(ln(s), 0.75) - quantile_cont(ln(s), 0.25) AS iqr, avg(ln(s2)) - avg(ln(s1)) AS change, sum(s * s) / (sum(s) + 1e-12) ** 2 AS hhi FROM s GROUP BY anchor""",
    "mean sd q05 q25 q50 q75 q95 iqr change hhi", "anchor",
)
def _(spark, d):
    return windows.vol_statistics(_past_future(spark, d)[0])


# neighbours --------------------------------------------------------------------------------------------------------------------------

K = 5
_DIST = {
    "l1": "list_sum(list_transform(list_zip(a.z, b.z), lambda p: abs(p[1] - p[2])))",
    "l2": "list_distance(a.z, b.z)",
    "lp3": "list_sum(list_transform(list_zip(a.z, b.z), lambda p: abs(p[1] - p[2]) ** 3)) ** (1.0 / 3)",
    "chebyshev": "list_max(list_transform(list_zip(a.z, b.z), lambda p: abs(p[1] - p[2])))",
    "cosine": "1 - least(greatest(list_dot_product(a.z, b.z) / greatest(sqrt(list_dot_product(a.z, a.z)) * sqrt(list_dot_product(b.z, b.z)), 1e-12), -1), 1)",
    "angular": "acos(least(greatest(list_dot_product(a.z, b.z) / greatest(sqrt(list_dot_product(a.z, a.z)) * sqrt(list_dot_product(b.z, b.z)), 1e-12), -1), 1))",
}


#: Queries that ask for every vector's neighbours; the others ask for those of every twentieth. The index is all vectors for either.
WHOLE = ("l2", "l1", "angular")


def _near_sql(name: str, k: int = K, whole: bool = False) -> str:
    asked = "" if whole else " WHERE a.id % 20 = 0"
    return f"{VECTORS}, pairs AS (SELECT a.id AS q, b.id, {_DIST[name]} AS dist FROM v a JOIN v b ON a.id <> b.id{asked}), near AS (SELECT q, id, dist, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rank FROM pairs QUALIFY rank <= {k})"


def near(spark, d, name="l2", k=K, whole=False):
    v = src.vectors(spark, d)
    return knn.neighbours(v if whole else v.where("id % 20 = 0"), v, k, "lp" if name == "lp3" else name, 3.0 if name == "lp3" else None)


for _name in _DIST:

    @query(f"knn_{_name}", f"WITH {_near_sql(_name, whole=_name in WHOLE)} SELECT q, id, dist, rank FROM near", "dist", "rank")
    def _(spark, d, name=_name):
        return near(spark, d, name, whole=name in WHOLE)


@query(
    "knn_eligible",
    f"WITH {_near_sql('l2', 25, whole=True)} SELECT q, id, dist, k AS rank FROM (SELECT q, id, dist, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS k FROM near WHERE id <= q - 20 - 10) WHERE k <= 5",
    "dist", "rank",
)
def _(spark, d):
    return knn.eligible(near(spark, d, k=5 * K, whole=True), K, 20, 10)


for _name, _sql in (("kernel", "exp(-dist / 2.0)"), ("inverse", "1.0 / (dist + 1e-8)"), ("rank", "1.0 / rank")):

    @query(f"{_name}_weights", f"WITH {_near_sql('l2')} SELECT q, id, {_sql} / sum({_sql}) OVER (PARTITION BY q) AS kappa FROM near", "kappa")
    def _(spark, d, name=_name):
        n = near(spark, d)
        return {"kernel": lambda: knn.kernel_weights(n, 2.0), "inverse": lambda: knn.inverse_weights(n), "rank": lambda: knn.rank_weights(n)}[name]().select("q", "id", "kappa")


#: Memberships of three regimes, made of a vector's label: four parts for its own, one for each other one.
_PI = "pi AS (SELECT id, [CASE WHEN label % 3 = k THEN 4.0 ELSE 1.0 END / 6.0 FOR k IN range(3)] AS p FROM v)"


def pi(spark, d):
    return src.vectors(spark, d).select(F.col("id").alias("anchor"), F.array(*[F.when(F.col("label") % 3 == k, 4.0).otherwise(1.0) / 6.0 for k in range(3)]).alias("p"))


def _regimes_sql(whole: bool = False) -> str:
    return f"{_near_sql('l2', whole=whole)}, {_PI}, kw AS (SELECT q, id, exp(-dist / 2.0) / sum(exp(-dist / 2.0)) OVER (PARTITION BY q) AS kappa FROM near), ex AS (SELECT q, id, kappa, unnest(range(3)) AS k, unnest(p) AS pk FROM kw JOIN pi USING (id)), rw AS (SELECT q, id, k, kappa, pk, kappa * pk / greatest(sum(kappa * pk) OVER (PARTITION BY q, k), 1e-12) AS w FROM ex)"


_RW = _regimes_sql()


def _regime_weights(spark, d, whole=False):
    return knn.regime_weights(knn.kernel_weights(near(spark, d, whole=whole), 2.0), pi(spark, d))


@query("regime_weights", f"WITH {_regimes_sql(whole=True)} SELECT * FROM rw", "kappa pk w", "k")
def _(spark, d):
    return _regime_weights(spark, d, whole=True)


_FORECAST = f"{_RW}, y AS (SELECT q, k, dim, sum(w * x) AS y FROM rw JOIN (SELECT id, unnest(z) AS x, unnest(range(len(z))) AS dim FROM v) USING (id) GROUP BY ALL)"


def _targets(spark, d):
    return src.vectors(spark, d).select("id", F.posexplode("z").alias("dim", "v"))


@query("euclidean_forecast", f"WITH {_FORECAST} SELECT q, dim, sum(y * p[k + 1]) AS v FROM y JOIN pi ON pi.id = q GROUP BY ALL", "v", "dim")
def _(spark, d):
    per = knn.euclidean_mean(_regime_weights(spark, d), _targets(spark, d), ["dim"])
    return knn.regime_mix(per, pi(spark, d).withColumnRenamed("p", "alpha"), ["dim"])


@query("neighbour_export", f"WITH {_RW} SELECT q, id, q - id AS lag, dist, rank, total_weight FROM near JOIN (SELECT q, rw.id, sum(w * p[k + 1]) AS total_weight FROM rw JOIN pi ON pi.id = q GROUP BY ALL) USING (q, id)", "dist total_weight", "rank lag")
def _(spark, d):
    return knn.exported(_regime_weights(spark, d), near(spark, d), pi(spark, d).withColumnRenamed("p", "alpha"))


@query(
    "prototype_softmax",
    f"""WITH {VECTORS}, c AS (SELECT k, dim, avg(x) AS c FROM (SELECT label % 3 AS k, unnest(z) AS x, unnest(range(len(z))) AS dim FROM v) GROUP BY ALL),
e AS (SELECT id, k, sum((x - c) ** 2) AS d2 FROM (SELECT id, unnest(z) AS x, unnest(range(len(z))) AS dim FROM v) JOIN c USING (dim) GROUP BY ALL)
SELECT id, k, exp(-d2) / sum(exp(-d2)) OVER (PARTITION BY id) AS p FROM (SELECT id, k, d2 - min(d2) OVER (PARTITION BY id) AS d2 FROM e)""",
    "p", "k",
)
def _(spark, d):
    v = src.vectors(spark, d)
    means = v.select((F.col("label") % 3).alias("k"), F.posexplode("z").alias("dim", "x")).groupBy("k", "dim").agg(F.avg("x").alias("c"))
    centres = means.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("c")).select("k", F.col("c.c").alias("c"))
    centres = centres.agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("centres"))
    d2 = F.transform("centres", lambda s: F.aggregate(F.zip_with("z", s["c"], lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x))
    return v.crossJoin(F.broadcast(centres)).select("id", F.posexplode(softmax_by_distance(d2, 1.0)).alias("k", "p"))


@query(
    "two_stage_outlier_flag",
    f"""WITH {VECTORS}, m AS (SELECT dim, avg(x) AS m FROM (SELECT unnest(z) AS x, unnest(range(len(z))) AS dim FROM v) GROUP BY dim),
e AS (SELECT id, sum((x - m) ** 2) AS d2 FROM (SELECT id, unnest(z) AS x, unnest(range(len(z))) AS dim FROM v) JOIN m USING (dim) GROUP BY id)
SELECT id, d2, d2 >= (SELECT quantile_cont(d2, 0.9) FROM e) AS outlier FROM e""",
    "d2",
)
def _(spark, d):
    x = src.vectors(spark, d).select("id", F.posexplode("z").alias("dim", "x"))
    e = x.join(F.broadcast(x.groupBy("dim").agg(F.avg("x").alias("m"))), "dim").groupBy("id").agg(F.sum(F.pow(F.col("x") - F.col("m"), F.lit(2.0))).alias("d2"))
    return e.crossJoin(F.broadcast(e.agg(F.percentile("d2", 0.9).alias("q")))).select("id", "d2", (F.col("d2") >= F.col("q")).alias("outlier"))


# a volatility forecast from embedding to losses, without a fit: neighbours of the window's statistics, dampened and mixed ------------------

_STATISTICS = "mean sd q05 q25 q50 q75 q95 iqr change hhi".split()


@query(
    "vol_knn_dampened",
    f"""WITH {_VOLS},
sx AS (SELECT anchor, asset, t - anchor + {L} - 1 >= {L // 2} AS late, coalesce(r, avg(r) OVER (PARTITION BY anchor, asset), 0) AS r FROM w),
sd AS (SELECT anchor, asset, greatest(stddev_samp(r), 1e-12) AS s, greatest(stddev_samp(r) FILTER (NOT late), 1e-12) AS s1, greatest(stddev_samp(r) FILTER (late), 1e-12) AS s2 FROM sx GROUP BY ALL),
e AS (SELECT anchor AS id, [avg(ln(s)), stddev_samp(ln(s)), quantile_cont(ln(s), 0.05), quantile_cont(ln(s), 0.25), quantile_cont(ln(s), 0.5), quantile_cont(ln(s), 0.75), quantile_cont(ln(s), 0.95),
  quantile_cont(ln(s), 0.75) - quantile_cont(ln(s), 0.25), avg(ln(s2)) - avg(ln(s1)), sum(s * s) / (sum(s) + 1e-12) ** 2] AS z FROM sd GROUP BY anchor),
pool AS (SELECT a.id AS q, b.id, list_distance(a.z, b.z) AS dist FROM e a JOIN e b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.z, b.z), b.id) <= 75),
near AS (SELECT q, id, dist FROM pool WHERE id <= q - {H} - 10 QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, id) <= 15),
kw AS (SELECT q, id, exp(-dist / 2.0) / sum(exp(-dist / 2.0)) OVER (PARTITION BY q) AS kappa FROM near),
vk AS (SELECT q AS anchor, asset, sum(kappa * v) AS v FROM kw JOIN vt ON vt.anchor = kw.id GROUP BY ALL),
vm AS (SELECT anchor, asset, 0.35 * vk.v + 0.5 * vr.v + 0.15 * vs.v AS v FROM vk JOIN vr USING (anchor, asset) JOIN vs USING (anchor, asset)),
vx AS (SELECT anchor, asset, 0.2 * vm.v + 0.8 * vs.v AS v FROM vm JOIN vs USING (anchor, asset))
{' UNION ALL '.join(_METRIC.format(m, v) for m, v in (('model', 'vm'), ('mix', 'vx')))}""",
    "mse mae qlike r2 rmse", "anchor",
)
def _(spark, d):
    p = flags_panel(spark, d)
    last = last_anchor(p, H)
    e = windows.vol_statistics(windows.past(p, L, STRIDE, last)).select(F.col("anchor").alias("id"), F.array(*_STATISTICS).alias("z"))
    near = knn.eligible(knn.neighbours(e, e, 75, "l2"), 15, H, 10)
    own = windows.kind_log_vols(p, L, H, STRIDE, last)
    one = lambda name: own.select("anchor", "asset", F.col(name).alias("v"))
    weighted = knn.kernel_weights(near, 2.0).select("q", "id", "kappa").join(one("truth").withColumnRenamed("anchor", "id"), "id")
    model = weighted.groupBy(F.col("q").alias("anchor"), "asset").agg(F.sum(F.col("kappa") * F.col("v")).alias("v"))
    shrink = windows.vol_to_mean(one("roll"), 0.3)
    model = windows.damped(model, one("roll"), shrink, 0.5, 0.15)
    mix = windows.vol_mixed(model, shrink, 0.2)
    both = model.withColumn("method", F.lit("model")).unionByName(mix.withColumn("method", F.lit("mix")))
    return windows.vol_losses(both.join(one("truth").withColumnRenamed("v", "y"), ["anchor", "asset"]), "method", "anchor")


# regimes -----------------------------------------------------------------------------------------------------------------------------

#: Memberships of three regimes by hour: shares of three event types' mean values (1 where one is missing).
_MEMBER = f"{HOURS}, pi AS (SELECT t AS anchor, [c / (c + v + s), v / (c + v + s), s / (c + v + s)] AS p FROM (SELECT t, coalesce(max(x) FILTER (asset = 'click'), 1) AS c, coalesce(max(x) FILTER (asset = 'view'), 1) AS v, coalesce(max(x) FILTER (asset = 'signup'), 1) AS s FROM hours GROUP BY t))"
_STATES = "states AS (SELECT anchor, list_position(p, list_max(p)) - 1 AS state FROM pi)"
_GRID = "g AS (SELECT i, j FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j))"


def memberships(spark, d):
    """One pass over the events: an hour's row has its three means side by side, without the grid of hours by event types."""
    x = lambda name: F.coalesce(F.when(F.col("date").isNotNull(), F.avg(F.when(F.col("event_type") == name, F.col("value")))), F.lit(1.0))
    rows = src.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("date")).agg(x("click").alias("a"), x("view").alias("b"), x("signup").alias("c"))
    s = F.col("a") + F.col("b") + F.col("c")
    return src.placed(rows, 3600).select(F.col("t").alias("anchor"), F.array(F.col("a") / s, F.col("b") / s, F.col("c") / s).alias("p"))


_HARD = f"{_MEMBER}, {_STATES}, {_GRID}, n AS (SELECT i, j, count(*) AS n FROM (SELECT lag(state) OVER (ORDER BY anchor) AS i, state AS j FROM states) WHERE i IS NOT NULL GROUP BY ALL), hard AS (SELECT i, j, (coalesce(n, 0) + {{0}}) / nullif(sum(coalesce(n, 0) + {{0}}) OVER (PARTITION BY i), 0) AS a FROM g LEFT JOIN n USING (i, j))"


@query("transition_hard", f"WITH {_HARD.format('10.0')} SELECT * FROM hard", "a", "i j")
def _(spark, d):
    return regime.transition_hard(regime.assigned(memberships(spark, d)), 3)


@query("transition_empirical", f"WITH {_HARD.format('0.0')} SELECT i, j, coalesce(a, 0) AS a FROM hard", "a", "i j")
def _(spark, d):
    return regime.transition_hard(regime.assigned(memberships(spark, d)), 3, 0.0, empty_uniform=False)


_SOFT = f"{_MEMBER}, {_GRID}, st AS (SELECT lag(p) OVER (ORDER BY anchor) AS b, p AS a FROM pi), sn AS (SELECT i, j, sum(b[i + 1] * a[j + 1]) + 10.0 AS n FROM st, g WHERE b IS NOT NULL GROUP BY ALL), soft AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS a FROM sn)"


@query("transition_soft", f"WITH {_SOFT} SELECT * FROM soft", "a", "i j")
def _(spark, d):
    return regime.transition_soft(memberships(spark, d), 3)


@query("transition_given_switch", f"WITH {_SOFT} SELECT i, j, a / sum(a) OVER (PARTITION BY i) AS a FROM soft WHERE i <> j", "a", "i j")
def _(spark, d):
    return regime.given_switch(regime.transition_soft(memberships(spark, d), 3))


_U = "(p[{0}] * (x[1] * m[1][{0}] + x[2] * m[2][{0}] + x[3] * m[3][{0}]))"
_S = " + ".join(_U.format(k) for k in (1, 2, 3))
_FILTER = f"""{_SOFT}, tm AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(a ORDER BY j) AS r FROM soft GROUP BY i)),
fw AS (SELECT anchor, p AS x FROM pi WHERE anchor = 0 UNION ALL SELECT pi.anchor, [{', '.join(f'{_U.format(k)} / ({_S})' for k in (1, 2, 3))}] FROM fw JOIN pi ON pi.anchor = fw.anchor + 1, tm)"""


def held(spark, d):
    """Memberships for several passes, in as many parts as there are cores: each task of a pass tells the driver something."""
    return memberships(spark, d).coalesce(spark.sparkContext.defaultParallelism).persist()


def filtered(spark, d):
    p = held(spark, d)  # for the transitions and both passes of the scan
    return regime.forward_filter(p, regime.as_matrix(regime.transition_soft(p, 3)))


@query("forward_filter", f"WITH RECURSIVE {_FILTER} SELECT anchor, unnest(range(3)) AS k, unnest(x) AS alpha FROM fw", "alpha", "anchor k")
def _(spark, d):
    return filtered(spark, d).select("anchor", F.posexplode("alpha").alias("k", "alpha"))


@query("asof_alpha", f"WITH RECURSIVE {_FILTER}, q AS (SELECT anchor FROM pi) SELECT q.anchor, unnest(range(3)) AS k, unnest(s.x) AS alpha FROM q ASOF JOIN fw s ON s.anchor < q.anchor", "alpha", "anchor k")
def _(spark, d):
    found = regime.as_of(held(spark, d).select("anchor"), filtered(spark, d))
    return found.select("anchor", F.posexplode("alpha").alias("k", "alpha"))


@query("alpha_smooth_hard", f"WITH {_MEMBER} SELECT anchor, unnest(range(3)) AS k, unnest([0.92 * x + 0.08 / 3 FOR x IN p]) AS smooth, unnest([CASE WHEN i = list_position(p, list_max(p)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range(1, 4)]) AS hard FROM pi", "smooth hard", "anchor k")
def _(spark, d):
    both = memberships(spark, d).select("anchor", F.arrays_zip(smoothed(F.col("p"), 0.08).alias("smooth"), one_hot(F.col("p")).alias("hard")).alias("z"))
    return both.select("anchor", F.posexplode("z").alias("k", "s")).select("anchor", "k", "s.smooth", "s.hard")


@query("regime_entropy", f"WITH {_MEMBER}, {_STATES} SELECT anchor, state, -list_sum([x * ln(x) FOR x IN p]) AS entropy FROM pi JOIN states USING (anchor)", "entropy", "anchor state")
def _(spark, d):
    return regime.diagnostics(memberships(spark, d)).select("anchor", "state", "entropy")


@query("regime_counts", f"WITH {_MEMBER}, {_STATES} SELECT state, count(*) AS n, min(list_sum(p)) AS least, max(list_sum(p)) AS most FROM pi JOIN states USING (anchor) GROUP BY state", "least most", "state n")
def _(spark, d):
    p = memberships(spark, d)
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return p.join(regime.assigned(p), "anchor").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min(total).alias("least"), F.max(total).alias("most"))


# portfolios --------------------------------------------------------------------------------------------------------------------------

_W = f"{FLAGS}, {sql_windows('panel', L, STRIDE, H)}, wt AS (SELECT anchor, asset, method, CASE method WHEN 'equal' THEN 1.0 / n ELSE rk / (n * (n + 1) / 2) END AS w FROM (SELECT anchor, asset, n, CASE WHEN anchor // {STRIDE} % 2 = 0 THEN rk ELSE n + 1 - rk END AS rk FROM ends, (SELECT asset, row_number() OVER (ORDER BY asset) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT asset FROM panel))), (VALUES ('equal'), ('tilted')) m(method))"


def fixed_weights(spark, d):
    """Equal weights, and weights tilted by the assets' names, upwards and downwards in turn."""
    from pyspark.sql import Window

    past, ahead = _past_future(spark, d)
    assets = past.select("asset").distinct().withColumn("rk", F.row_number().over(Window.orderBy("asset")))
    n = assets.count()
    rows = past.select("anchor").distinct().crossJoin(F.broadcast(assets))
    rk = F.when(F.floor(F.col("anchor") / STRIDE) % 2 == 0, F.col("rk")).otherwise(n + 1 - F.col("rk"))
    equal = rows.select("anchor", "asset", F.lit("equal").alias("method"), F.lit(1.0 / n).alias("w"))
    return equal.unionByName(rows.select("anchor", "asset", F.lit("tilted").alias("method"), (rk / (n * (n + 1) / 2)).alias("w"))), ahead, n


@query(
    "portfolio_stats",
    f"""WITH {_W}, rp AS (SELECT anchor, method, t, CASE WHEN count(r) = (SELECT count(DISTINCT asset) FROM panel) THEN sum(w * r) END AS rp FROM wt JOIN f USING (anchor, asset) GROUP BY ALL),
s AS (SELECT anchor, method, count(rp) AS days, product(1 + rp) - 1 AS cumret, avg(rp) AS mean, 1e3 * var_samp(rp) AS var, stddev_samp(rp) AS vol FROM rp GROUP BY ALL)
SELECT *, mean / (vol + 1e-12) * sqrt(252.0) AS sharpe FROM s""",
    "cumret mean var vol sharpe", "anchor days",
)
def _(spark, d):
    w, ahead, n = fixed_weights(spark, d)
    return portfolio.hold_stats(w, ahead, n).withColumn("var", 1e3 * F.col("var"))


@query("turnover", f"WITH {_W}, x AS (SELECT anchor, method, abs(w - lag(w) OVER (PARTITION BY method, asset ORDER BY anchor)) AS d FROM wt) SELECT anchor, method, sum(d) AS turnover FROM x GROUP BY ALL", "turnover", "anchor")
def _(spark, d):
    return portfolio.turnover(fixed_weights(spark, d)[0])


@query("weight_concentration", f"WITH {_W} SELECT anchor, method, sum(w * w) AS hhi, max(abs(w)) AS max_abs, sum(abs(w)) AS l1 FROM wt GROUP BY ALL", "hhi max_abs l1", "anchor")
def _(spark, d):
    return portfolio.concentration(fixed_weights(spark, d)[0])


@query("portfolio_variance", f"WITH {_W}, {sql_cov('f', 'truth')} SELECT a.anchor, a.method, 1e6 * sum(a.w * v * b.w) AS variance FROM truth JOIN wt a ON a.anchor = truth.anchor AND a.asset = i JOIN wt b ON b.anchor = truth.anchor AND b.asset = j AND b.method = a.method GROUP BY ALL", "variance", "anchor")
def _(spark, d):
    w, _, _ = fixed_weights(spark, d)
    return big(portfolio.portfolio_variance(w, covs(spark, d)[2]), "variance")


# what the model adds to them ----------------------------------------------------------------------------------------------------------

_CONF = "least(greatest((list_max(p) - 1.0 / 3) / (1 - 1.0 / 3), 0), 1)"
_BLEND = f"""{_ALL}, {_MEMBER}, lm AS (SELECT anchor, {_CONF} AS confidence, 1 - 0.35 * greatest(0.75 - {_CONF}, 0) ** 2 / 0.75 ** 2 AS lam FROM pi)"""


def _blended(spark, d):
    k = kinds(spark, d)
    one = lambda name: k.select("anchor", "i", "j", F.col(name).alias("v"))
    return windows.confidence_blend(one("roll"), one("pers"), memberships(spark, d).withColumnRenamed("p", "alpha"))


@query("confidence_blend", f"WITH {_BLEND} SELECT anchor, i, j, 1e6 * (lam * roll.v + (1 - lam) * pers.v) AS v, confidence, lam FROM roll JOIN pers USING (anchor, i, j) JOIN lm USING (anchor)", "v confidence lam", "anchor")
def _(spark, d):
    return big(_blended(spark, d)).select("anchor", "i", "j", "v", "confidence", F.col("lambda").alias("lam"))


@query("blend_stats", f"WITH {_BLEND} SELECT 100.0 * avg((lam < 0.999999)::INT) AS blended_pct, avg(lam) AS lambda_mean, min(lam) AS lambda_min, avg(confidence) AS confidence_mean, count(*) AS n FROM lm WHERE anchor IN (SELECT anchor FROM ends)", "blended_pct lambda_mean lambda_min confidence_mean", "n")
def _(spark, d):
    from ..operators import analytics

    return analytics.blend_stats(_blended(spark, d).select("anchor", "confidence", "lambda").distinct())


@query("guardrail_reasons", f"WITH {_GUARD} SELECT reason, count(*) AS n FROM gs GROUP BY reason", "", "n")
def _(spark, d):
    from ..operators import analytics

    roll, pers, _ = covs(spark, d)
    return analytics.reason_counts(windows.guarded(pers, roll, windows.shrunk(roll, 0.3), 0.8, 1.2, "ratio_or_invalid").select("anchor", "reason").distinct())


@query("neighbour_regime_parts", f"WITH {_RW} SELECT q, rw.id, k, kappa, pk, w, p[k + 1] AS ak, w * p[k + 1] AS part FROM rw JOIN pi ON pi.id = q", "kappa pk w ak part", "k")
def _(spark, d):
    return knn.regime_parts(_regime_weights(spark, d), near(spark, d), pi(spark, d).withColumnRenamed("p", "alpha"))


@query("regime_top3", f"WITH {_MEMBER} SELECT anchor, place, k FROM (SELECT anchor, row_number() OVER (PARTITION BY anchor ORDER BY x DESC, k) AS place, k FROM (SELECT anchor, unnest(p) AS x, unnest(range(3)) AS k FROM pi))", "", "anchor place k")
def _(spark, d):
    found = regime.diagnostics(memberships(spark, d)).select("anchor", F.posexplode("best").alias("place", "k"))
    return found.select("anchor", (F.col("place") + 1).alias("place"), "k")


@query("prob_normalised", f"WITH {HOURS}, s AS (SELECT t AS anchor, list(coalesce(x, 0) - 50 ORDER BY asset) AS x FROM hours GROUP BY t) SELECT anchor, unnest(range(len(x))) AS k, unnest(CASE WHEN list_sum(x) > 0 THEN [v / list_sum(x) FOR v IN x] ELSE [1.0 / len(x) FOR v IN x] END) AS p FROM s", "p", "anchor k")
def _(spark, d):
    from ..functions.vectors import normalised

    rows = hours_panel(spark, d).groupBy(F.col("t").alias("anchor")).agg(F.array_sort(F.collect_list(F.struct("asset", "x"))).alias("x"))
    x = F.transform(F.col("x.x"), lambda v: F.coalesce(v, F.lit(0.0)) - 50)
    return rows.select("anchor", F.posexplode(normalised(x)).alias("k", "p"))
