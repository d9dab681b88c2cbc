"""Queries on the spectral operators. On panels of two assets closed forms say in SQL what the general code computes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linalg, portfolio
from . import backtest, walkforward
from .catalog import FLAGS, SQL, STATUS, query, sql_cov, sql_windows
from .forecasts import H, L, STRIDE, covs
from .panels import flags_panel, hours_panel, status_panel
from ..sources import panels as src

_PERS = sql_cov(f"(SELECT * FROM w WHERE t > anchor - {H})", "pers")
_TWO = "(SELECT anchor, max(v) FILTER (i = 'F' AND j = 'F') AS a, max(v) FILTER (i = 'F' AND j = 'O') AS b, max(v) FILTER (i = 'O' AND j = 'O') AS d FROM {} GROUP BY anchor)"
_EIG = "SELECT anchor, a, b, d, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS hi, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS lo FROM {}"
#: CTEs e_<name>: entries and eigenvalues; l_<name>: entries of the logarithm.
_LOG = "SELECT anchor, (ln(hi) + ln(lo)) / 2 + k * (a - d) / 2 AS a, k * b AS b, (ln(hi) + ln(lo)) / 2 - k * (a - d) / 2 AS d FROM (SELECT *, (ln(hi) - ln(lo)) / nullif(hi - lo, 0) AS k FROM e_{})"


def _two(name: str) -> str:
    return f"e_{name} AS ({_EIG.format(_TWO.format(name))}), l_{name} AS ({_LOG.format(name)})"


_BASE = f"{STATUS}, {sql_windows('panel', L, STRIDE, H)}, {sql_cov('w', 'roll')}, {_PERS}, {sql_cov('f', 'truth')}, {_two('roll')}, {_two('pers')}, {_two('truth')}"
_LONG = "SELECT anchor, 'F' AS i, 'F' AS j, {0} * a AS v FROM {1} UNION ALL SELECT anchor, 'F', 'O', {0} * b FROM {1} UNION ALL SELECT anchor, 'O', 'F', {0} * b FROM {1} UNION ALL SELECT anchor, 'O', 'O', {0} * d FROM {1}"


def two(spark, d):
    """Packed roll, pers and truth of the panel of two assets."""
    return [linalg.packed(c, "anchor") for c in covs(spark, d, status_panel)]


@query("spd_project_2", f"WITH {_BASE} {_LONG.format('1e6', 'e_roll')}", "v", "anchor")
def _(spark, d):
    out = linalg.mapped(two(spark, d)[0], ["anchor"], linalg.project_spd)
    return linalg.unpacked(out, ["anchor"]).withColumn("v", 1e6 * F.col("v"))


@query("logm_2", f"WITH {_BASE} {_LONG.format('1', 'l_roll')}", "v", "anchor")
def _(spark, d):
    return linalg.unpacked(linalg.mapped(two(spark, d)[0], ["anchor"], linalg.logm), ["anchor"])


@query("eigenvalues_2", f"WITH {_BASE} SELECT anchor, 1e6 * hi AS hi, 1e6 * lo AS lo FROM e_roll", "hi lo", "anchor")
def _(spark, d):
    import numpy as np

    out = linalg.mapped(two(spark, d)[0], ["anchor"], lambda a: np.linalg.eigvalsh(linalg.sym(a)), "w array<double>", "w")
    return out.select("anchor", (1e6 * F.element_at("w", 2)).alias("hi"), (1e6 * F.element_at("w", 1)).alias("lo"))


_MEAN = """lm AS (SELECT anchor, 0.4 * x.a + 0.6 * y.a AS a, 0.4 * x.b + 0.6 * y.b AS b, 0.4 * x.d + 0.6 * y.d AS d FROM l_roll x JOIN l_pers y USING (anchor)),
le AS (SELECT anchor, (exp(hi) + exp(lo)) / 2 + k * (a - d) / 2 AS a, k * b AS b, (exp(hi) + exp(lo)) / 2 - k * (a - d) / 2 AS d FROM (SELECT *, (exp(hi) - exp(lo)) / nullif(hi - lo, 0) AS k FROM (""" + _EIG.format("lm") + ")))"


@query("logeuc_mean_2", f"WITH {_BASE}, {_MEAN} {_LONG.format('1e6', 'le')}", "v", "anchor")
def _(spark, d):
    roll, pers, _ = covs(spark, d, status_panel)
    # the logarithm of each matrix is made once; means of logarithms are relational
    logs = [linalg.unpacked(linalg.mapped(linalg.packed(c, "anchor"), ["anchor"], linalg.logm), ["anchor"]) for c in (roll, pers)]
    mean = logs[0].withColumn("v", 0.4 * F.col("v")).unionByName(logs[1].withColumn("v", 0.6 * F.col("v"))).groupBy("anchor", "i", "j").agg(F.sum("v").alias("v"))
    out = linalg.mapped(linalg.packed(mean, "anchor"), ["anchor"], lambda a: linalg.project_spd(linalg.expm(a)))
    return linalg.unpacked(out, ["anchor"]).withColumn("v", 1e6 * F.col("v"))


_DET = "(({0}.a + 1e-10) * ({0}.d + 1e-10) - {0}.b * {0}.b)"
_TR = f"(((s.d + 1e-10) * (y.a + 1e-10) - 2 * s.b * y.b + (s.a + 1e-10) * (y.d + 1e-10)) / {_DET.format('s')})"
_LOSSES = f"""WITH {_BASE} SELECT s.anchor, 0.5 * ({_TR} - 2 + ln({_DET.format('s')}) - ln({_DET.format('y')})) AS kl, {_TR} - ln({_DET.format('y')} / {_DET.format('s')}) - 2 AS stein,
sqrt((ls.a - ly.a) ** 2 + 2 * (ls.b - ly.b) ** 2 + (ls.d - ly.d) ** 2) AS logeuc, ((ln(s.hi) - ln(y.hi)) ** 2 + (ln(s.lo) - ln(y.lo)) ** 2) / 2 AS eig_mse, s.hi / s.lo AS cond, s.hi / s.lo / (y.hi / y.lo) AS cond_ratio
FROM e_roll s JOIN e_truth y USING (anchor) JOIN l_roll ls ON ls.anchor = s.anchor JOIN l_truth ly ON ly.anchor = s.anchor"""

for _name, _columns in (("kl_2", ["kl"]), ("stein_2", ["stein"]), ("logeuc_dist_2", ["logeuc"]), ("eig_mse_2", ["eig_mse"]), ("cond_2", ["cond", "cond_ratio"])):

    @query(_name, f"SELECT anchor, {', '.join(_columns)} FROM ({_LOSSES})", " ".join(_columns), "anchor")
    def _(spark, d, columns=_columns):
        roll, _, truth = two(spark, d)
        return linalg.losses(roll, truth, ["anchor"]).select("anchor", *columns)


@query(
    "nll_2",
    f"""WITH {_BASE}, x AS (SELECT anchor, t, max(r) FILTER (asset = 'F') AS x, max(r) FILTER (asset = 'O') AS y FROM f GROUP BY ALL HAVING count(r) = 2)
SELECT anchor, avg(0.5 * (2 * ln(2 * pi()) + ln({_DET.format('s')}) + ((s.d + 1e-10) * x * x - 2 * s.b * x * y + (s.a + 1e-10) * y * y) / {_DET.format('s')})) AS nll FROM x JOIN e_roll s USING (anchor) GROUP BY anchor HAVING count(*) = {H}""",
    "nll", "anchor",
)
def _(spark, d):
    import numpy as np
    import pandas as pd

    from .forecasts import _past_future

    ahead = _past_future(spark, d, status_panel)[1]
    rows = ahead.groupBy("anchor", "t").agg(F.array_sort(F.collect_list(F.struct("asset", "r"))).alias("x")).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("t", F.col("x.r").alias("x")))).alias("x"))
    both = linalg.packed(covs(spark, d, status_panel)[0], "anchor").join(rows.select("anchor", F.col("x.x").alias("x")), "anchor").select("anchor", "m", "x")

    def run(batches):
        for pdf in batches:
            if len(pdf):
                s = linalg.stack(pdf["m"])
                yield pd.DataFrame({"anchor": pdf["anchor"], "nll": [linalg.nll(a, np.array([list(r) for r in x], float)) for a, x in zip(s, pdf["x"], strict=True)]})

    return both.mapInPandas(run, "anchor int, nll double").where("nll IS NOT NULL AND NOT isnan(nll)")


@query("gmvp_2", f"WITH {_BASE} SELECT anchor, 'F' AS asset, (d + 1e-8 - b) / (a + d + 2e-8 - 2 * b) AS w FROM e_roll UNION ALL SELECT anchor, 'O', (a + 1e-8 - b) / (a + d + 2e-8 - 2 * b) FROM e_roll", "w", "anchor")
def _(spark, d):
    out = linalg.mapped(two(spark, d)[0], ["anchor"], linalg.gmvp, "w array<double>", "w")
    return out.select("anchor", F.explode(F.arrays_zip("assets", "w")).alias("z")).select("anchor", F.col("z.assets").alias("asset"), "z.w")


_INV = "((a + 1e-8) * (d + 1e-8) - b * b)"


@query("precision_2", f"WITH {_BASE}, p AS (SELECT anchor, (d + 1e-8) / {_INV} AS a, -b / {_INV} AS b, (a + 1e-8) / {_INV} AS d FROM e_roll) {_LONG.format('1e-4', 'p')}", "v", "anchor")
def _(spark, d):
    out = linalg.mapped(two(spark, d)[0], ["anchor"], linalg.precision)
    return linalg.unpacked(out, ["anchor"]).withColumn("v", 1e-4 * F.col("v"))


@query("precision_weights_2", f"WITH {_BASE} SELECT anchor, 'F' AS asset, (d + 1e-8 - b) / (a + d + 2e-8 - 2 * b) AS w FROM e_roll UNION ALL SELECT anchor, 'O', (a + 1e-8 - b) / (a + d + 2e-8 - 2 * b) FROM e_roll", "w", "anchor")
def _(spark, d):
    return portfolio.precision_weights(linalg.unpacked(linalg.mapped(two(spark, d)[0], ["anchor"], linalg.precision), ["anchor"]))


#: The steps of the projected gradient on two assets: the first one's weight moves by half of the step times the gradients' difference, within 0 and 1.
_STEPS = f"""WITH RECURSIVE {_BASE}, g AS (
  SELECT anchor, a + 1e-8 AS a, b, d + 1e-8 AS d, 0 AS k, 0.5::DOUBLE AS w, 'inf'::DOUBLE AS last, 0.5::DOUBLE AS step, FALSE AS done FROM e_roll
  UNION ALL
  SELECT anchor, a, b, d, k + 1, CASE WHEN abs(last - now) < 1e-10 OR now <= last THEN new ELSE w END, CASE WHEN abs(last - now) < 1e-10 OR now <= last THEN now ELSE last END,
    CASE WHEN abs(last - now) < 1e-10 OR now <= last THEN step ELSE step / 2 END, abs(last - now) < 1e-10 OR (now > last AND step / 2 < 1e-12)
  FROM (SELECT *, a * new * new + 2 * b * new * (1 - new) + d * (1 - new) * (1 - new) AS now
        FROM (SELECT *, least(greatest(w - step * ((a - b) * w + (b - d) * (1 - w)), 0), 1) AS new FROM g WHERE NOT done AND k < 500)))
SELECT anchor, arg_max(w, k) AS w FROM g GROUP BY anchor"""


@query("gmvp_long_only_2", f"WITH x AS ({_STEPS}) SELECT anchor, 'F' AS asset, w FROM x UNION ALL SELECT anchor, 'O', 1 - w FROM x", "w", "anchor")
def _(spark, d):
    out = linalg.mapped(two(spark, d)[0], ["anchor"], linalg.gmvp_long_only, "w array<double>", "w")
    return out.select("anchor", F.explode(F.arrays_zip("assets", "w")).alias("z")).select("anchor", F.col("z.assets").alias("asset"), "z.w")


_FLOOR = f"(SELECT anchor, a + 1.5e-3 AS a, b, d + 1.5e-3 AS d FROM e_roll)"


@query("spd_floor_2", f"WITH {_BASE} {_LONG.format('1e3', _FLOOR)}", "v", "anchor")
def _(spark, d):
    import numpy as np

    out = linalg.mapped(two(spark, d)[0], ["anchor"], lambda a: linalg.project_spd(a + 1.5e-3 * np.eye(2)))
    return linalg.unpacked(out, ["anchor"]).withColumn("v", 1e3 * F.col("v"))


@query("diag_shrink_2", f"WITH {_BASE}, x AS (SELECT anchor, a, 0.88 * b AS b, d FROM e_roll) {_LONG.format('1e6', 'x')}", "v", "anchor")
def _(spark, d):
    import numpy as np

    half = lambda a: linalg.project_spd(0.88 * a + 0.12 * a * np.eye(2), 1e-12)
    return linalg.unpacked(linalg.mapped(two(spark, d)[0], ["anchor"], half), ["anchor"]).withColumn("v", 1e6 * F.col("v"))


@query("corr_target_2", f"WITH {_BASE}, x AS (SELECT anchor, 1.0 AS a, b / sqrt(a * d) AS b, 1.0 AS d FROM e_truth) {_LONG.format('1', 'x')}", "v", "anchor")
def _(spark, d):
    out = linalg.mapped(two(spark, d)[2], ["anchor"], lambda a: linalg.project_spd(linalg.correlation(linalg.project_spd(a))))
    return linalg.unpacked(out, ["anchor"])


@query("spd_mean_2", f"WITH {_BASE}, x AS (SELECT anchor, 0.4 * r.a + 0.6 * p.a AS a, 0.4 * r.b + 0.6 * p.b AS b, 0.4 * r.d + 0.6 * p.d AS d FROM e_roll r JOIN e_pers p USING (anchor)) {_LONG.format('1e6', 'x')}", "v", "anchor")
def _(spark, d):
    roll, pers, _ = covs(spark, d, status_panel)
    mean = roll.withColumn("v", 0.4 * F.col("v")).unionByName(pers.withColumn("v", 0.6 * F.col("v"))).groupBy("anchor", "i", "j").agg(F.sum("v").alias("v"))
    return linalg.unpacked(linalg.mapped(linalg.packed(mean, "anchor"), ["anchor"], linalg.project_spd), ["anchor"]).withColumn("v", 1e6 * F.col("v"))


_GW = "(SELECT anchor, (d + 1e-8 - b) / (a + d + 2e-8 - 2 * b) AS wf, (a + 1e-8 - b) / (a + d + 2e-8 - 2 * b) AS wo FROM x)"


@query("gmvp_shrink_blend_2", f"WITH {_BASE}, x AS (SELECT anchor, r.a + 1.5e-3 AS a, 0.6 * r.b + 0.4 * 0.7 * r.b AS b, r.d + 1.5e-3 AS d FROM e_roll r), g AS {_GW} SELECT anchor, 'F' AS asset, wf AS w FROM g UNION ALL SELECT anchor, 'O', wo FROM g", "w", "anchor")
def _(spark, d):
    """Weights of the matrix blended with the shrunk one (by 0.4), then floored."""
    import numpy as np

    eye = np.eye(2)
    blend = lambda a: linalg.project_spd(0.6 * a + 0.4 * (0.7 * a + 0.3 * a * eye))
    out = linalg.mapped(two(spark, d)[0], ["anchor"], lambda a: linalg.gmvp(linalg.project_spd(blend(a) + 1.5e-3 * eye)), "w array<double>", "w")
    return out.select("anchor", F.explode(F.arrays_zip("assets", "w")).alias("z")).select("anchor", F.col("z.assets").alias("asset"), "z.w")


# embeddings: on two assets they have closed forms ---------------------------------------------------------------------------------------


def _embedded(name, panel, columns=None, **options):
    def run(spark, d):
        out = walkforward.embedded(panel(spark, d), name, L, H, STRIDE, options)
        return out.select("anchor", F.posexplode("z").alias("dim", "v")) if columns is None else out.select("anchor", *[F.element_at("z", k + 1).alias(c) for c, k in columns.items()])

    return run


_STATS = "mean sd q05 q25 q50 q75 q95 iqr change hhi".split()
query("vol_stats_embed", f"SELECT anchor, {', '.join(_STATS)} FROM ({SQL['vol_stats_embedding']})")(_embedded("vol_stats", flags_panel, {c: k for k, c in enumerate(_STATS)}))
for _name, _short in (("pca", "pca_embed"), ("corr_eigen", "corr_eig_embed"), ("hybrid", "hybrid_embed")):
    query(_short)(_embedded(_name, flags_panel, k=5))

query("corr_eig_embed_2", f"WITH {_BASE} SELECT anchor, ln(1 + abs(b) / sqrt(a * d)) AS first, ln(greatest(1 - abs(b) / sqrt(a * d), 1e-12)) AS second FROM e_roll", "first second", "anchor")(_embedded("corr_eigen", status_panel, {"first": 0, "second": 1}, k=2))

#: Imputed rows of each window side by side (x: F, y: O), and sums of squares and products of what is left without the means.
_PAIRED = f"""{STATUS}, {sql_windows('panel', L, STRIDE, H)},
im AS (SELECT anchor, t, asset, coalesce(r, avg(r) OVER (PARTITION BY anchor, asset), 0) AS r FROM w),
xy AS (SELECT anchor, t, max(r) FILTER (asset = 'F') AS x, max(r) FILTER (asset = 'O') AS y FROM im GROUP BY ALL),
ss AS (SELECT anchor, var_pop(x) * count(*) AS a, covar_pop(x, y) * count(*) AS b, var_pop(y) * count(*) AS d, stddev_samp(x) AS vx, stddev_samp(y) AS vy FROM xy GROUP BY anchor),
sv AS (SELECT *, sqrt((a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b)) AS s1, sqrt(greatest((a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b), 0)) AS s2, b / (({L} - 1) * (vx + 1e-12) * (vy + 1e-12)) AS c FROM ss),
sh AS (SELECT *, s1 * s1 / (s1 * s1 + s2 * s2 + 1e-12) AS e1, s2 * s2 / (s1 * s1 + s2 * s2 + 1e-12) AS e2 FROM sv)"""

_TAIL = {"e1": 5, "e2": 6, "l1": 10, "l2": 11, "m1": 15, "m2": 16, "d1": 20, "d2": 21, "pad": 24}
query("pca_window_2", f"WITH {_PAIRED} SELECT anchor, e1, e2, ln(s1 + 1e-12) AS l1, ln(s2 + 1e-12) AS l2, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS m2, s1 / sqrt({L} - 1) AS d1, s2 / sqrt({L} - 1) AS d2, 0.0::DOUBLE AS pad FROM sh", " ".join(_TAIL), "anchor")(_embedded("pca", status_panel, _TAIL, k=5))

_HYBRID = "l1 l2 e1 e2 entropy vol_mean vol_sd q25 q50 q75 auto_mean auto_sd corr top gap abs_mean abs_sd".split()
query(
    "hybrid_embed_2",
    f"""WITH {_PAIRED}, lg AS (SELECT anchor, x, y, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM xy WINDOW o AS (PARTITION BY anchor ORDER BY t)),
ac AS (SELECT anchor, covar_pop(x, x1) / (sqrt(var_pop(x) * var_pop(x1)) + 1e-12 / count(*)) AS ax, covar_pop(y, y1) / (sqrt(var_pop(y) * var_pop(y1)) + 1e-12 / count(*)) AS ay FROM lg WHERE x1 IS NOT NULL GROUP BY anchor),
ab AS (SELECT anchor, avg(abs(r)) AS abs_mean, stddev_samp(abs(r)) AS abs_sd FROM im GROUP BY anchor)
SELECT anchor, ln(s1 + 1e-12) AS l1, ln(s2 + 1e-12) AS l2, e1, e2, -e1 * ln(e1 + 1e-12) - e2 * ln(e2 + 1e-12) AS entropy, (vx + vy) / 2 AS vol_mean, abs(vx - vy) / sqrt(2) AS vol_sd,
  least(vx, vy) + 0.25 * abs(vx - vy) AS q25, (vx + vy) / 2 AS q50, least(vx, vy) + 0.75 * abs(vx - vy) AS q75, (ax + ay) / 2 AS auto_mean, abs(ax - ay) / sqrt(2) AS auto_sd, c AS corr, 1 + abs(c) AS top, 2 * abs(c) AS gap, abs_mean, abs_sd
FROM sh JOIN ac USING (anchor) JOIN ab USING (anchor)""",
    " ".join(_HYBRID), "anchor",
)(_embedded("hybrid", status_panel, {c: k for k, c in enumerate(_HYBRID)}, k=2))


@query("window_spectrum_2", f"WITH {STATUS}, {sql_windows('panel', L, STRIDE, H)}, x AS (SELECT anchor, t, max(r) FILTER (asset = 'F') AS x, max(r) FILTER (asset = 'O') AS y FROM w GROUP BY ALL HAVING count(r) = 2), c AS (SELECT anchor, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM x GROUP BY anchor HAVING count(*) = {L}), e AS ({_EIG.format('c')}) SELECT anchor, 1e6 * hi AS hi, 1e6 * lo AS lo FROM e", "hi lo", "anchor")
def _(spark, d):
    """Eigenvalues of the plain covariance of windows without gaps."""
    import numpy as np

    from ..operators import windows
    from .forecasts import _past_future

    past = _past_future(spark, d, status_panel)[0]
    full = past.groupBy("anchor").agg(F.count("r").alias("n")).where(F.col("n") == 2 * L).select("anchor")
    cov = windows.covariance(past.join(full, "anchor", "left_semi"), ridge=0.0)
    out = linalg.mapped(linalg.packed(cov, "anchor"), ["anchor"], lambda a: np.linalg.eigvalsh(linalg.sym(a)), "w array<double>", "w")
    return out.select("anchor", (1e6 * F.element_at("w", 2)).alias("hi"), (1e6 * F.element_at("w", 1)).alias("lo"))


# fits -----------------------------------------------------------------------------------------------------------------------------------

_FITS = {"gmm": "gmm_fit", "kmeans_soft": "kmeans_fit", "fuzzy_cmeans": "fcm_fit", "agglomerative_ward": "ward_fit", "spectral_rbf": "spectral_fit", "spectral_knn": "spectral_knn_fit", "signed_knn_spectral": "signed_spectral_fit", "modified_two_stage": "two_stage_fit"}


def _fit(name):
    def run(spark, d):
        return backtest.fitted(src.vectors(spark, d), name, 4, backtest.OPTIONS.get(name, {})).select("id", F.posexplode("p").alias("k", "p"))

    return run


for _name, _short in _FITS.items():
    query(_short)(_fit(_name))


#: How far the vectors of a label are moved along their label's axis, so that ten groups stand apart.
APART = 6.0
_OUTLIERS = f"""z AS (SELECT vec_id AS id, label, [x + CASE WHEN i - 1 = label THEN {APART} ELSE 0 END FOR x, i IN embedding::DOUBLE[]] AS z FROM (SELECT vec_id, label, embedding FROM embeddings)),
e AS (SELECT id, unnest(z) AS x, unnest(range(len(z))) AS dim FROM z), m AS (SELECT dim, avg(x) AS m FROM e GROUP BY dim), q AS (SELECT id, sum((x - m) ** 2) AS d2 FROM e JOIN m USING (dim) GROUP BY id)"""


def separated(spark, d):
    v = src.vectors(spark, d)
    return v.withColumn("z", F.transform("z", lambda x, k: x + F.when(k == F.col("label"), APART).otherwise(0.0)))


#: Ten groups want several starts of the mixture, and less fuzziness.
_GROUP_OPTIONS = {"spectral_rbf": {"gamma": 0.02}, "gmm": {"n_init": 25}, "fuzzy_cmeans": {"m": 1.2}}


def _partition(name, k):
    def run(spark, d):
        """id and the smallest id of its group."""
        v = separated(spark, d)
        p = backtest.fitted(v, name, k, _GROUP_OPTIONS.get(name, {}))
        group = p.select("id", (F.array_position("p", F.array_max("p"))).alias("g"))
        return group.join(group.groupBy("g").agg(F.min("id").alias("first")), "g").select("id", "first")

    return run


for _name, _short in _FITS.items():
    if _name != "modified_two_stage":
        query(_short.replace("_fit", "_groups"), "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings", "", "id first")(_partition(_name, 10))


@query(
    "two_stage_groups",
    f"WITH {_OUTLIERS}, o AS (SELECT id, label, d2 >= (SELECT quantile_cont(d2, 0.98) FROM q) AS outlier FROM q JOIN z USING (id)) SELECT id, outlier, min(id) OVER (PARTITION BY outlier, CASE WHEN NOT outlier THEN label END) AS first FROM o",
    "", "id first",
)
def _(spark, d):
    v = separated(spark, d)
    p = backtest.fitted_labels(v, "modified_two_stage", 11, quantile=0.98)
    return p.join(p.groupBy("label").agg(F.min("id").alias("first")), "label").select("id", (F.col("label") == 0).alias("outlier"), "first")


# a fit is a fixed point of its own step: the step is made relationally, from the memberships that the fit gives


def _long(v):
    return v.select("id", F.posexplode("z").alias("dim", "x"))


def _weighted_means(p, x, w):
    """k, dim, c: means of x weighted by w, a column of p."""
    return p.join(x, "id").groupBy("k", "dim").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("c"))


_STILL = "SELECT vec_id AS id, 0.0::DOUBLE AS drift FROM embeddings"


def _drift(one, two):
    both = one.join(two.withColumnRenamed("p", "now"), ["id", "k"])
    return both.groupBy("id").agg(F.round(F.max(F.abs(F.col("p") - F.col("now"))), 3).alias("drift"))


@query("kmeans_fixed_point", _STILL, "drift", "id")
def _(spark, d):
    """Means of the fit's groups, and each vector's nearest of them: it is in that group again."""
    v = src.vectors(spark, d)
    x, p = _long(v), backtest.fitted_labels(v, "kmeans_soft", 4).withColumnRenamed("label", "k")
    c = x.join(p, "id").groupBy("k", "dim").agg(F.avg("x").alias("c"))
    far = x.join(F.broadcast(c), "dim").groupBy("id", "k").agg(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2.0))).alias("d2"))
    near = far.groupBy("id").agg(F.min_by("k", F.struct("d2", "k")).alias("now"))
    return p.join(near, "id").select("id", (F.col("k") != F.col("now")).cast("double").alias("drift"))


@query("fcm_fixed_point", _STILL, "drift", "id")
def _(spark, d):
    """Centres of the fit's memberships (squared), and memberships of those centres: the same again."""
    v = src.vectors(spark, d)
    x, p = _long(v), _fit("fuzzy_cmeans")(spark, d)
    c = _weighted_means(p, x, F.pow("p", F.lit(2.0)))
    far = x.join(F.broadcast(c), "dim").groupBy("id", "k").agg(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2.0))).alias("d2"))
    total = far.groupBy("id").agg(F.sum(1 / F.col("d2")).alias("s"))
    return _drift(p, far.join(total, "id").select("id", "k", (1 / F.col("d2") / F.col("s")).alias("p")))


@query("gmm_fixed_point", _STILL, "drift", "id")
def _(spark, d):
    """Weights, means and variances of the fit's memberships, and memberships of those: the same again."""
    v = separated(spark, d)
    x, p = _long(v), backtest.fitted(v, "gmm", 10, _GROUP_OPTIONS["gmm"]).select("id", F.posexplode("p").alias("k", "p"))
    mu = p.join(x, "id").groupBy("k", "dim").agg((F.sum(F.col("p") * F.col("x")) / F.sum("p")).alias("c"), (F.sum(F.col("p") * F.col("x") * F.col("x")) / F.sum("p")).alias("xx"))
    mu = mu.withColumn("var", F.greatest(F.col("xx") - F.col("c") * F.col("c"), F.lit(0.0)) + 1e-3)
    weight = p.groupBy("k").agg(F.avg("p").alias("w"))
    far = x.join(F.broadcast(mu), "dim").groupBy("id", "k").agg(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2.0)) / F.col("var") + F.log(2 * F.pi() * F.col("var"))).alias("q"))
    log = far.join(F.broadcast(weight), "k").select("id", "k", (F.log("w") - 0.5 * F.col("q")).alias("l"))
    top = log.groupBy("id").agg(F.max("l").alias("top"))
    e = log.join(top, "id").select("id", "k", F.exp(F.col("l") - F.col("top")).alias("e"))
    return _drift(p, e.join(e.groupBy("id").agg(F.sum("e").alias("s")), "id").select("id", "k", (F.col("e") / F.col("s")).alias("p")))


# walk-forward ----------------------------------------------------------------------------------------------------------------------------

#: Anchors of windows that can be used.
_USABLE = """(SELECT anchor FROM (SELECT anchor, avg((r IS NULL)::INT) AS na, count(DISTINCT asset) FILTER (r IS NOT NULL)::DOUBLE / count(DISTINCT asset) AS assets, count(DISTINCT t) FILTER (r IS NOT NULL)::DOUBLE / count(DISTINCT t) AS dates FROM {} GROUP BY anchor)
WHERE na <= 0.3 AND assets >= 0.8 AND dates >= 0.5)"""
_WALK = f"""{FLAGS}, {sql_windows('panel', L, 1, H)}, ok AS (SELECT anchor FROM ends WHERE anchor >= {L + H + 252} AND (anchor - {L + H + 252}) % 5 = 0 AND anchor IN {_USABLE.format('w')} AND anchor IN {_USABLE.format('f')})"""


def _walk(windows, name):
    return f"{name}_w AS (SELECT * FROM {windows} WHERE anchor IN (SELECT anchor FROM ok)), {sql_cov(f'{name}_w', name)}"


_WALKED = f"{_WALK}, {_walk('w', 'roll')}, {_walk(f'(SELECT * FROM w WHERE t > anchor - {H})', 'pers')}, {_walk('f', 'truth')}, shrink AS (SELECT anchor, i, j, v * CASE WHEN i = j THEN 1 ELSE 0.7 END AS v FROM roll)"
_VOL = "v{0} AS (SELECT anchor, i AS asset, 0.5 * ln(greatest(v, 1e-12)) AS v FROM {1} WHERE i = j)"
_VOLS = f"{_WALKED}, {_VOL.format('r', 'roll')}, {_VOL.format('p', 'pers')}, {_VOL.format('t', 'truth')}, vs AS (SELECT anchor, asset, 0.7 * v + 0.3 * avg(v) OVER (PARTITION BY anchor) AS v FROM vr)"
_VOL_ROWS = """SELECT '{0}' AS method, anchor, avg((h.v - t.v) ** 2) AS mse, avg(abs(h.v - t.v)) AS mae, sqrt(avg((h.v - t.v) ** 2)) AS rmse,
avg(2 * h.v + exp(2 * t.v) / exp(2 * h.v)) AS qlike, 1 - sum((h.v - t.v) ** 2) / (var_pop(t.v) * count(*)) AS r2 FROM v{1} h JOIN vt t USING (anchor, asset) GROUP BY anchor"""


@query("backtest_cov")
def _(spark, d):
    return backtest.run(flags_panel(spark, d), backtest.Config()).select("anchor", "method", "metric", "value")


def _baselines(spark, d, config, metrics):
    rows = walkforward.baseline_runs(flags_panel(spark, d), config).where(F.col("metric").isin(list(metrics)))
    return rows.groupBy("method", "anchor").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(name) for m, name in metrics.items()])


@query("backtest_cov_baselines", f"WITH {_WALKED} {' UNION ALL '.join(f"SELECT '{m}' AS method, anchor, 1e6 * sqrt(sum((h.v - t.v) ** 2)) AS fro FROM {m} h JOIN truth t USING (anchor, i, j) GROUP BY anchor" for m in ('roll', 'pers', 'shrink'))}", "fro", "anchor")
def _(spark, d):
    return _baselines(spark, d, backtest.Config(), {"fro": "fro"}).withColumn("fro", 1e6 * F.col("fro"))


#: The bundle of losses on two assets, and of what the minimum-variance weights earn: closed forms for each method.
_BUNDLE = "fro kl stein logeuc eig_mse cond_ratio corr_offdiag nll gmvp_hhi gmvp_max_abs gmvp_cumret gmvp_mean gmvp_var gmvp_vol gmvp_sharpe".split()
_FIRST = L + H + 249  # an anchor of the windows above
_RHO = "least(greatest({0}.b / sqrt(greatest({0}.a, 1e-12) * greatest({0}.d, 1e-12)), -1), 1)"
_BUNDLED = f"""{_BASE}, e_shrink AS ({_EIG.format('(SELECT anchor, a, 0.7 * b AS b, d FROM e_roll)')}), l_shrink AS ({_LOG.format('shrink')}),
ok AS (SELECT anchor FROM ends WHERE anchor >= {_FIRST} AND anchor IN {_USABLE.format('w')} AND anchor IN {_USABLE.format('f')}),
every AS ({' UNION ALL '.join(f"SELECT '{m}' AS method, s.*, l.a AS la, l.b AS lb, l.d AS ld FROM e_{m} s JOIN l_{m} l USING (anchor)" for m in ('roll', 'pers', 'shrink'))}),
ahead AS (SELECT anchor, t, max(r) FILTER (asset = 'F') AS x, max(r) FILTER (asset = 'O') AS y, max(i) FILTER (asset = 'F') AS ix, max(i) FILTER (asset = 'O') AS iy
  FROM (SELECT anchor, t, asset, r, coalesce(r, avg(r) OVER (PARTITION BY anchor, asset), 0) AS i FROM f) GROUP BY ALL),
wt AS (SELECT method, anchor, (d + 1.5e-3 + 1e-8 - b) / (a + d + 3e-3 + 2e-8 - 2 * b) AS wf, (a + 1.5e-3 + 1e-8 - b) / (a + d + 3e-3 + 2e-8 - 2 * b) AS wo FROM every),
earned AS (SELECT method, anchor, wf, wo, product(1 + wf * x + wo * y) - 1 AS cumret, avg(wf * x + wo * y) AS mean, coalesce(var_samp(wf * x + wo * y), 0) AS var, count(x + y) AS n FROM wt JOIN ahead USING (anchor) GROUP BY ALL),
dense AS (SELECT s.method, s.anchor, avg(0.5 * (2 * ln(2 * pi()) + ln({_DET.format('s')}) + ((s.d + 1e-10) * ix * ix - 2 * s.b * ix * iy + (s.a + 1e-10) * iy * iy) / {_DET.format('s')})) AS nll FROM every s JOIN ahead USING (anchor) GROUP BY ALL)
SELECT s.method, s.anchor, 1e6 * sqrt((s.a - y.a) ** 2 + 2 * (s.b - y.b) ** 2 + (s.d - y.d) ** 2) AS fro, 0.5 * ({_TR} - 2 + ln({_DET.format('s')}) - ln({_DET.format('y')})) AS kl, {_TR} - ln({_DET.format('y')} / {_DET.format('s')}) - 2 AS stein,
  sqrt((s.la - ly.a) ** 2 + 2 * (s.lb - ly.b) ** 2 + (s.ld - ly.d) ** 2) AS logeuc, ((ln(s.hi) - ln(y.hi)) ** 2 + (ln(s.lo) - ln(y.lo)) ** 2) / 2 AS eig_mse, s.hi / s.lo / (y.hi / y.lo) AS cond_ratio,
  sqrt(2) * abs({_RHO.format('s')} - {_RHO.format('y')}) AS corr_offdiag, nll, wf * wf + wo * wo AS gmvp_hhi, greatest(abs(wf), abs(wo)) AS gmvp_max_abs, cumret AS gmvp_cumret, mean AS gmvp_mean, CASE WHEN n > 0 THEN 1e3 * var END AS gmvp_var,
  CASE WHEN n > 0 THEN sqrt(var) END AS gmvp_vol, CASE WHEN var > 0 THEN mean / (sqrt(var) + 1e-12) * sqrt(252.0) END AS gmvp_sharpe
FROM every s JOIN ok USING (anchor) JOIN e_truth y USING (anchor) JOIN l_truth ly USING (anchor) JOIN earned e ON e.anchor = s.anchor AND e.method = s.method JOIN dense n ON n.anchor = s.anchor AND n.method = s.method"""


@query("backtest_bundle_2", f"WITH {_BUNDLED}", " ".join(_BUNDLE), "anchor")
def _(spark, d):
    rows = walkforward.baseline_runs(status_panel(spark, d), backtest.Config(burn_in=249))
    out = rows.groupBy("method", "anchor").agg(*[F.max(F.when(F.col("metric") == m, F.nanvl("value", F.lit(None).cast("double")))).alias(m) for m in _BUNDLE])
    return out.withColumns({"fro": 1e6 * F.col("fro"), "gmvp_var": 1e3 * F.col("gmvp_var")})


VOL_CONFIG = backtest.Config(target="vol", embedder="vol_stats", embed_options={}, clusterer="gmm", metric="l2")


@query("backtest_vol_baselines", f"WITH {_VOLS} {' UNION ALL '.join(_VOL_ROWS.format(m, m[0]) for m in ('roll', 'pers', 'shrink'))}", "mse mae rmse qlike r2", "anchor")
def _(spark, d):
    return _baselines(spark, d, VOL_CONFIG, {f"vol_{m}": m for m in ("mse", "mae", "rmse", "qlike", "r2")})


@query("backtest_vol")
def _(spark, d):
    return backtest.run(flags_panel(spark, d), VOL_CONFIG).select("anchor", "method", "metric", "value")


@query("ablation_grid")
def _(spark, d):
    base = backtest.Config(target="vol", embedder="vol_stats", embed_options={})
    runs = backtest.grid(base, {"metric": ["l1", "l2"], "tau": [1.0, 2.0]})
    return backtest.ablation(flags_panel(spark, d), runs)
