"""The walk-forward backtest as tables: windows, features, fits, forecasts and losses.

Each table is made once and joined by what it depends on:

* windows (anchor, past, ahead) of all anchors that any run samples or evaluates;
* features (anchor, validity, what an embedder makes of the window alone, target): once for each kind of feature, not for each fit; the
  logarithm of a target is taken there;
* fits, keyed by features, embedder, clusterer, transition and refit date: a fit is made once, and all runs that share its key ask it. A row
  of the features names the fits that it belongs to, so there is no join of dates;
* forecasts: neighbours with their weights, joined with the neighbours' targets;
* losses: baselines once for each anchor, the model's for each run.

The panel is never collected. A fit's task gets the embeddings up to its refit date, and the panel's dates if the embedder itself is fitted."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import canonical
from ..operators import linalg
from ..operators.cluster import clusterer
from ..operators.embed import EMBEDDERS, covariance, imputed, valid


@dataclasses.dataclass(frozen=True)
class Size:
    dates: int
    assets: int


def days(panel: DataFrame) -> tuple[DataFrame, Size]:
    """t, x: the values of a date in the order of the assets' names, NaN where one is missing; and how many dates and assets there are."""
    values = F.array_sort(F.collect_list(F.struct("asset", "r")))
    rows = panel.groupBy("t").agg(values.alias("x")).select("t", F.transform(F.col("x.r"), lambda x: F.coalesce(x, F.lit(float("nan")))).alias("x"))
    size = rows.agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if size.n and (size.least != size.most or size.n != size.t + 1):
        raise ValueError("the panel is not dense: a date is missing or has not every asset once")
    return rows, Size(size.n, size.most or 0)


def starts(c, dates: int) -> tuple[int, int, int]:
    """(first, step, number) of the refit dates."""
    first, last = c.lookback + c.horizon + c.burn_in, dates - c.horizon - 1
    step = max(c.stride, -(-c.refit // c.stride) * c.stride)
    return first, step, max(0, (last - first) // step + 1)


def _multiples(low: Column, high: Column, first: int, stride: int, last: int) -> Column:
    """Those of first, first + stride, ... <= last that are between low and high."""
    k0 = F.greatest(F.ceil((low - first) / stride), F.lit(0))
    k1 = F.least(F.floor((high - first) / stride), F.lit((last - first) // stride))
    return F.when(k0 <= k1, F.transform(F.sequence(k0, k1), lambda k: (k * stride + first).cast("int"))).otherwise(F.array().cast("array<int>"))


def windows(rows: DataFrame, size: Size, lookback: int, horizon: int, grids: set[tuple[int, int]]) -> DataFrame:
    """anchor, past, ahead (date by date) of the anchors first, first + stride, ... of grids (first, stride) that have a whole horizon. A date names its anchors itself."""
    last = size.dates - horizon - 1
    low, high = F.col("t") - horizon, F.col("t") + lookback - 1
    named = [_multiples(low, high, first, stride, last) for first, stride in sorted(grids) if first <= last]
    anchors = F.array_distinct(F.flatten(F.array(*named))) if named else F.array().cast("array<int>")
    made = rows.select(F.explode(anchors).alias("anchor"), "t", "x").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("w"))
    part = lambda cond: F.flatten(F.transform(F.filter("w", cond), lambda s: s["x"]))
    return made.select("anchor", part(lambda s: s["t"] <= F.col("anchor")).alias("past"), part(lambda s: s["t"] > F.col("anchor")).alias("ahead"))


def grids(configs: list) -> set[tuple[int, int]]:
    """First anchors and strides of what the configs sample and evaluate."""
    return {(c.lookback - 1, c.sample_stride) for c in configs} | {(c.lookback + c.horizon + c.burn_in, c.stride) for c in configs}


def target_of(x: np.ndarray, kind: str) -> np.ndarray:
    s = covariance(x)
    if kind == "vol":
        return 0.5 * np.log(np.maximum(np.diag(s), 1e-12))
    s = linalg.project_spd(s)
    if kind == "precision":
        return linalg.precision(s)
    if kind == "corr":
        d = np.sqrt(np.maximum(np.diag(s), 1e-12))
        return linalg.project_spd(s / d[:, None] / d[None])
    return s


def feature_key(c) -> tuple:
    """What a window's features depend on."""
    return (c.lookback, c.horizon, c.embedder, tuple(sorted(c.embed_options.items())), c.target, c.target != "vol" and c.aggregator == "logeuc", c.max_na, c.min_assets, c.min_dates)


def fit_key(c) -> tuple:
    """What a fit depends on, besides its refit date."""
    return (feature_key(c), c.clusterer, tuple(sorted(c.cluster_options.items())), c.n_regimes, c.transition, c.trans_smooth, c.sample_stride, c.min_samples, c.stride, c.refit, c.burn_in)


def base_key(c) -> tuple:
    """What the losses of baselines depend on."""
    return (c.lookback, c.horizon, c.target, c.shrink_gamma, c.floor, c.long_only)


def features(made: DataFrame, c, size: Size) -> DataFrame:
    """anchor, ok (both windows can be used), own (what the embedder makes of the window alone), y (the target, or its logarithm)."""
    n, logs = size.assets, c.target != "vol" and c.aggregator == "logeuc"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = EMBEDDERS[c.embedder](**c.embed_options)
        for pdf in batches:
            rows = []
            for anchor, past, ahead in zip(pdf["anchor"], pdf["past"], pdf["ahead"], strict=True):
                past, ahead = np.asarray(past, float).reshape(-1, n), np.asarray(ahead, float).reshape(-1, n)
                if not all(valid(x, c.max_na, c.min_assets, c.min_dates) for x in (past, ahead)):
                    rows.append((anchor, False, None, None))
                    continue
                y = target_of(ahead, c.target)
                rows.append((anchor, True, make.own(past).tolist(), (linalg.logm(y) if logs else y).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["anchor", "ok", "own", "y"])

    return made.mapInPandas(run, "anchor int, ok boolean, own array<double>, y array<double>")


def distances(z: np.ndarray, q: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    d = np.abs(z - q)
    metric = canonical(metric)
    orders = {"l1": 1, "l2": 2, "lp": p, "chebyshev": np.inf}
    if metric in orders:
        o = orders[metric]
        return d.max(1) if o == np.inf else (d**o).sum(1) ** (1 / o)
    c = np.clip(z @ q / np.maximum(np.linalg.norm(z, axis=1) * np.linalg.norm(q), 1e-12), -1, 1)
    return 1 - c if metric == "cosine" else np.arccos(c)


class Regimes:
    """Clusters of embeddings z at anchors, transitions between them and the filtered memberships."""

    def __init__(self, c, anchors: np.ndarray, z: np.ndarray):
        self.anchors, self.z = anchors, z
        self.clusters = clusterer(c.clusterer, c.n_regimes, **c.cluster_options)
        self.pi = self.clusters.fit(z)
        k = c.n_regimes
        if len(self.pi) < 2:
            self.a = np.eye(k)
        else:
            rows = self.pi if c.transition == "soft" else np.eye(k)[self.pi.argmax(1)]
            self.a = rows[:-1].T @ rows[1:] + c.trans_smooth
            self.a /= self.a.sum(1, keepdims=True)
        self.alpha = [self.pi[0]]
        for p in self.pi[1:]:
            self.alpha.append(self.step(self.alpha[-1], p))

    def step(self, alpha: np.ndarray, p: np.ndarray) -> np.ndarray:
        q = (alpha @ self.a) * p
        return q / q.sum() if q.sum() > 1e-12 else p

    def ask(self, c, e: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Regime probabilities at an anchor with embedding e, the places of its neighbours, and their weights for each regime."""
        p = self.clusters.predict(e[None])[0]
        before = np.flatnonzero(self.anchors <= anchor - 1)
        alpha = {"filtered": self.step(self.alpha[before[-1]], p) if len(before) else p, "pi": p, "uniform": np.full(c.n_regimes, 1 / c.n_regimes)}[c.alpha_source]
        alpha = (1 - c.alpha_smooth) * alpha + c.alpha_smooth / c.n_regimes
        if c.alpha_hard:
            alpha = np.eye(c.n_regimes)[alpha.argmax()]
        d = distances(self.z, e, c.metric, c.p)
        order = np.lexsort((self.anchors, d))
        k = min(c.k_neighbors, len(order))
        order = order if c.strict else order[: min(c.overshoot * k, len(order))]
        near = order[self.anchors[order] <= anchor - c.horizon - max(c.gap, 0)][:k]
        if not len(near):
            raise ValueError("no neighbour is old enough")
        kappa = np.exp(-(d[near] - d[near].min()) / max(c.tau, 1e-12))
        w = (kappa / kappa.sum())[:, None] * self.pi[near]
        return alpha, near, w / np.maximum(w.sum(0, keepdims=True), 1e-12)


def combined(c, alpha: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The forecast: for each regime the mean of the neighbours' targets y by w, mixed by alpha. y holds logarithms where the config has them."""
    per = np.tensordot(w.T, y, 1)
    if c.target == "vol":
        return alpha @ per
    if c.aggregator == "logeuc":
        per = linalg.expm(per)
    s = linalg.project_spd(np.tensordot(alpha, linalg.project_spd(per), 1))
    if c.diag_shrink > 0:
        s = linalg.project_spd((1 - c.diag_shrink) * s + c.diag_shrink * np.diag(np.diag(s)), 1e-12)
    return s


def asked(rows: DataFrame, made: DataFrame, size: Size, named: dict) -> DataFrame:
    """run, anchor, alpha, near (anchors), w (neighbour by neighbour): what the fits of configs that share a fit_key say at each evaluation anchor. rows: days, made: features."""
    c = next(iter(named.values()))
    first, step, number = starts(c, size.dates)
    last = size.dates - c.horizon - 1
    fitted = hasattr(EMBEDDERS[c.embedder], "fit")
    # sampled windows whose future ends by the refit date belong to all later fits, evaluation anchors to the fit before them
    own = F.floor((F.col("anchor") - first) / step).cast("int")
    sampled = (F.col("anchor") - (c.lookback - 1)) % c.sample_stride == 0
    since = F.greatest(F.lit(0), F.ceil((F.col("anchor") + c.horizon - first) / step).cast("int"))
    fits = F.when(sampled & (since < number), F.sequence(since, F.lit(number - 1))).otherwise(F.array().cast("array<int>"))
    part = lambda kind, fits: F.struct(F.lit(kind).alias("kind"), fits.alias("fits"))
    asks = (F.col("anchor") >= first) & (F.col("anchor") <= last) & ((F.col("anchor") - first) % c.stride == 0)
    parts = F.array(part("sample", fits), part("ask", F.when(asks, F.array(own)).otherwise(F.array().cast("array<int>"))))
    told = made.where("ok").select("anchor", F.col("own").alias("x"), F.inline(parts)).select("kind", F.col("anchor").alias("t"), "x", F.explode("fits").alias("fit"))
    if fitted:
        since = F.greatest(F.lit(0), F.ceil((F.col("t") - step + 1 - first) / step).cast("int"))
        told = told.unionByName(rows.where(since < number).select(F.lit("day").alias("kind"), "t", "x", F.explode(F.sequence(since, F.lit(number - 1))).alias("fit")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, refit = [], first + step * int(pdf["fit"].iloc[0])
        pdf = pdf.sort_values("t")
        sample, ask, day = (pdf[pdf["kind"] == k] for k in ("sample", "ask", "day"))
        if len(sample) >= c.min_samples and len(ask):
            anchors, z, e = sample["t"].to_numpy(), np.stack(sample["x"]).astype(float), np.stack(ask["x"]).astype(float)
            if fitted:
                r = np.stack(day["x"]).astype(float)
                make = EMBEDDERS[c.embedder](**c.embed_options)
                every = np.moveaxis(np.lib.stride_tricks.sliding_window_view(r, c.lookback, axis=0), 2, 1)  # [k]: dates k to k + lookback - 1
                usable = [a - c.lookback for a in range(c.lookback, refit + 1) if valid(every[a - c.lookback], c.max_na, c.min_assets, c.min_dates)]
                make.fit(every, np.array(usable, int))
                at = lambda t: make.coordinates(every, np.asarray(t) - c.lookback + 1)
                z, e = np.hstack([at(anchors), z]), np.hstack([at(ask["t"]), e])
            found = Regimes(c, anchors, z)
            for t, x in zip(ask["t"], e, strict=True):
                for name, config in named.items():
                    try:
                        alpha, near, w = found.ask(config, x, int(t))
                    except ValueError:
                        continue
                    out.append((name, int(t), alpha.tolist(), anchors[near].tolist(), w.ravel().tolist()))
        return pd.DataFrame(out, columns=["run", "anchor", "alpha", "near", "w"])

    return told.groupBy("fit").applyInPandas(run, "run string, anchor int, alpha array<double>, near array<int>, w array<double>")


def targets_of(found: DataFrame, made: DataFrame) -> DataFrame:
    """run, anchor, alpha, near: the neighbours' weights (w) and targets (y), in their order."""
    k = F.size("alpha")
    rows = found.select("run", "anchor", "alpha", "w", F.posexplode("near").alias("place", "nbr"))
    rows = rows.select("run", "anchor", "alpha", "place", "nbr", F.slice("w", F.col("place") * k + 1, k).alias("w"))
    both = rows.join(made.where("ok").select(F.col("anchor").alias("nbr"), "y"), "nbr")
    return both.groupBy("run", "anchor").agg(F.first("alpha").alias("alpha"), F.array_sort(F.collect_list(F.struct("place", "w", "y"))).alias("near"))


# losses ----------------------------------------------------------------------------------------------------------------------------------


def vol_losses(c, v: np.ndarray, truth: np.ndarray) -> dict[str, float]:
    e, var = v - truth, np.maximum(np.exp(2 * v), 1e-12)
    sst = ((truth - truth.mean()) ** 2).sum()
    return {"vol_mse": (e**2).mean(), "vol_mae": np.abs(e).mean(), "vol_rmse": np.sqrt((e**2).mean()), "vol_qlike": (np.log(var) + np.exp(2 * truth) / var).mean(), "vol_r2": 1 - (e**2).sum() / sst if sst > 0 else np.nan}


def cov_losses(c, s: np.ndarray, truth: np.ndarray, ahead: np.ndarray, held: np.ndarray | None = None) -> dict[str, float]:
    """Losses of a covariance, and how its minimum-variance weights (or those of held) do over the horizon."""
    held = s if held is None else held
    floored = linalg.project_spd(held + c.floor * np.eye(len(s))) if c.floor > 0 else held
    weights = linalg.gmvp_long_only(floored) if c.long_only else linalg.gmvp(floored)
    rp = ahead @ weights
    rp = rp[np.isfinite(rp)]
    out = {
        "fro": np.linalg.norm(s - truth), "kl": linalg.kl(s, truth), "stein": linalg.stein(s, truth), "logeuc": linalg.log_euclidean_distance(s, truth), "eig_mse": linalg.log_eigenvalue_mse(s, truth),
        "cond_ratio": linalg.condition(s) / linalg.condition(truth), "corr_offdiag": linalg.correlation_distance(s, truth), "corr_spearman": linalg.correlation_spearman(s, truth), "nll": linalg.nll(s, imputed(ahead)), "gmvp_hhi": (weights**2).sum(), "gmvp_max_abs": np.abs(weights).max(),
    }
    if len(rp):
        var = rp.var(ddof=1) if len(rp) > 1 else 0.0
        out |= {"gmvp_cumret": np.prod(1 + rp) - 1, "gmvp_mean": rp.mean(), "gmvp_var": var, "gmvp_vol": np.sqrt(var), "gmvp_sharpe": rp.mean() / (np.sqrt(var) + 1e-12) * np.sqrt(252) if var > 0 else np.nan}
    return out | {f"w_{i}": x for i, x in enumerate(weights)}


def baselines(c, past: np.ndarray, ahead: np.ndarray) -> dict[str, np.ndarray]:
    """truth, and the baselines roll, pers and shrink."""
    if c.target == "vol":
        truth, roll, pers = (target_of(x, "vol") for x in (ahead, past, past[-c.horizon :]))
        return {"truth": truth, "roll": roll, "pers": pers, "shrink": (1 - c.shrink_gamma) * roll + c.shrink_gamma * roll.mean()}
    truth, roll, pers = (linalg.project_spd(covariance(x)) for x in (ahead, past, past[-c.horizon :]))
    return {"truth": truth, "roll": roll, "pers": pers, "shrink": linalg.project_spd((1 - c.shrink_gamma) * roll + c.shrink_gamma * np.diag(np.diag(roll)))}


def baseline_rows(c, past: np.ndarray, ahead: np.ndarray) -> list[tuple[str, str, float]]:
    """(method, metric, value) of the baselines."""
    own = baselines(c, past, ahead)
    truth = own.pop("truth")
    return [(name, m, float(x)) for name, v in own.items() for m, x in (vol_losses(c, v, truth) if c.target == "vol" else cov_losses(c, v, truth, ahead)).items()]


def model_rows(c, model: np.ndarray, alpha: np.ndarray, past: np.ndarray, ahead: np.ndarray) -> list[tuple[str, str, float]]:
    """(method, metric, value) of the model and the mix, after guardrail and blends."""
    own = baselines(c, past, ahead)
    truth, roll, pers, shrink = own["truth"], own["roll"], own["pers"], own["shrink"]
    out = [("model", f"regime_prob_{k}", float(x)) for k, x in enumerate(alpha)]
    if c.target == "vol":
        model = (1 - min(1.0, c.vol_roll + c.vol_shrink)) * model + c.vol_roll * roll + c.vol_shrink * shrink
        methods = {"model": model, "mix": c.vol_mix * model + (1 - c.vol_mix) * shrink}
        return out + [(name, m, float(x)) for name, v in methods.items() for m, x in vol_losses(c, v, truth).items()]
    ratio = np.trace(model) / np.trace(roll) if np.trace(roll) > 0 else np.nan
    if np.isfinite(ratio) and ratio > 0:
        model = model * (np.clip(ratio, c.trace_lo, c.trace_hi) / ratio)
    bad = not np.isfinite(ratio) or c.guardrail == "ratio_or_invalid" and not c.trace_lo <= ratio <= c.trace_hi
    model = shrink if bad else model
    k = len(alpha)
    conf = float(np.clip((alpha.max() - 1 / k) / (1 - 1 / k), 0, 1)) if k > 1 else 1.0
    unc = max(0.0, (c.blend_threshold - conf) / c.blend_threshold) if c.blend_threshold > 0 else 1 - conf
    lam = 1 - c.blend_strength * unc**c.blend_power
    model = linalg.project_spd(lam * model + (1 - lam) * pers)
    methods = {"model": model, "roll": roll, "pers": pers, "shrink": shrink}
    w = {m: max(0.0, c.mix.get(m, 0.0)) for m in methods}
    total = sum(w.values())
    mix = linalg.project_spd(sum(w[m] / total * methods[m] for m in methods)) if total > 0 else shrink
    out += [("model", "guardrail_ratio", float(ratio)), ("model", "guardrail_triggered", float(bad)), ("model", "blend_lambda", lam), ("model", "confidence", conf)]
    held = linalg.project_spd((1 - c.gmvp_shrink_blend) * model + c.gmvp_shrink_blend * shrink) if c.gmvp_shrink_blend > 0 else None
    out += [("model", m, float(x)) for m, x in cov_losses(c, model, truth, ahead, held).items()]
    return out + [("mix", m, float(x)) for m, x in cov_losses(c, mix, truth, ahead).items()]


ROWS = "anchor int, method string, metric string, value double"


def baseline_losses(made: DataFrame, c, size: Size) -> DataFrame:
    """anchor, method, metric, value of the baselines of windows (anchor, past, ahead) that can be used."""
    n = size.assets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for anchor, past, ahead in zip(pdf["anchor"], pdf["past"], pdf["ahead"], strict=True):
                past, ahead = np.asarray(past, float).reshape(-1, n), np.asarray(ahead, float).reshape(-1, n)
                if all(valid(x, c.max_na, c.min_assets, c.min_dates) for x in (past, ahead)):
                    rows += [(anchor, *row) for row in baseline_rows(c, past, ahead)]
            yield pd.DataFrame(rows, columns=["anchor", "method", "metric", "value"])

    return made.mapInPandas(run, ROWS)


def model_losses(found: DataFrame, made: DataFrame, named: dict, size: Size) -> DataFrame:
    """run, anchor, method, metric, value of forecasts (run, anchor, alpha, near) on windows."""
    n = size.assets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                c, alpha = named[r.run], np.asarray(r.alpha, float)
                w, y = (np.stack([np.asarray(s[f], float) for s in r.near]) for f in ("w", "y"))
                model = combined(c, alpha, w, y if c.target == "vol" else y.reshape(-1, n, n))
                past, ahead = np.asarray(r.past, float).reshape(-1, n), np.asarray(r.ahead, float).reshape(-1, n)
                rows += [(r.run, r.anchor, *row) for row in model_rows(c, model, alpha, past, ahead)]
            yield pd.DataFrame(rows, columns=["run", "anchor", "method", "metric", "value"])

    return found.join(made, "anchor").select("run", "anchor", "alpha", "near", "past", "ahead").mapInPandas(run, f"run string, {ROWS}")


def by(configs: dict, key) -> list[dict]:
    """The configs, in groups that share a key."""
    out: dict[tuple, dict] = {}
    for name, c in configs.items():
        out.setdefault(key(c), {})[name] = c
    return list(out.values())


def evaluation_windows(made: DataFrame, c, size: Size) -> DataFrame:
    first = c.lookback + c.horizon + c.burn_in
    return made.where((F.col("anchor") >= first) & (F.col("anchor") <= size.dates - c.horizon - 1) & ((F.col("anchor") - first) % c.stride == 0))


def spread(made: DataFrame, size: Size) -> DataFrame:
    """Windows, dealt out to tasks of some hundred thousand cells each: the work on them is far more than their bytes."""
    return made.repartition(max(made.sparkSession.sparkContext.defaultParallelism, size.dates * size.assets**2 // 400_000), "anchor")


def runs(panel: DataFrame, configs: dict) -> DataFrame:
    """run, anchor, method, metric, value of all runs (weights are metrics w_<asset>)."""
    rows, size = days(panel)
    out = None
    for shared in by(configs, lambda c: (c.lookback, c.horizon)):
        c = next(iter(shared.values()))
        made = spread(windows(rows, size, c.lookback, c.horizon, grids(list(shared.values()))), size).persist()
        for alike in by(shared, feature_key):
            c = next(iter(alike.values()))
            own = features(made, c, size).persist()
            for one in by(alike, fit_key):
                found = asked(rows, own, size, one).persist()
                part = model_losses(targets_of(found, own), made, one, size)
                for same in by(one, lambda c: (base_key(c), c.max_na, c.min_assets, c.min_dates)):
                    b = next(iter(same.values()))
                    base = baseline_losses(evaluation_windows(made, b, size), b, size)
                    base = found.where(F.col("run").isin(list(same))).select("run", "anchor").join(base, "anchor")
                    part = part.unionByName(base.select(*part.columns))
                out = part if out is None else out.unionByName(part)
    return out


def baseline_runs(panel: DataFrame, c) -> DataFrame:
    """anchor, method, metric, value of the baselines alone: nothing is fitted for them."""
    rows, size = days(panel)
    made = windows(rows, size, c.lookback, c.horizon, {(c.lookback + c.horizon + c.burn_in, c.stride)})
    return baseline_losses(spread(made, size), c, size)


def embedded(panel: DataFrame, name: str, lookback: int, horizon: int, stride: int, options: dict) -> DataFrame:
    """anchor, z: embeddings of a panel's windows, in tasks. An embedder that is fitted gets the dates in one task, and is fitted on the windows of all of them, whatever the stride."""
    rows, size = days(panel)
    made, fitted = spread(windows(rows, size, lookback, horizon, {(lookback - 1, stride)}), size), hasattr(EMBEDDERS[name], "fit")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = EMBEDDERS[name](**options)
        for pdf in batches:
            yield pd.DataFrame({"anchor": pdf["anchor"], "z": [make.own(np.asarray(x, float).reshape(lookback, -1)) for x in pdf["past"]]})

    out = made.select("anchor", "past").mapInPandas(own, "anchor int, z array<double>")
    if not fitted:
        return out

    def coordinates(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.stack(pdf.sort_values("t")["x"]).astype(float)
        every = np.moveaxis(np.lib.stride_tricks.sliding_window_view(r, lookback, axis=0), 2, 1)
        at = np.arange(lookback - 1, len(r) - horizon, stride)
        make = EMBEDDERS[name](**options).fit(every, np.arange(len(r) - lookback))
        return pd.DataFrame({"anchor": at.astype("int32"), "c": list(make.coordinates(every, at - lookback + 1))})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(coordinates, "anchor int, c array<double>")
    return out.join(found, "anchor").select("anchor", F.concat("c", "z").alias("z"))
