"""Walk-forward backtests, ablations and fits: what they are configured by, and the forecaster on its own. walkforward.py runs them."""

from __future__ import annotations

import dataclasses
import itertools
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics, fits, linalg, spectra, ward
from ..operators.cluster import clusterer, softmax, squared
from ..operators.embed import EMBEDDERS, valid
from . import walkforward
from .walkforward import Regimes, combined, target_of

#: Rows up to which a fit that needs a matrix of rows by rows is made in one task, and what makes its groups beyond.
DENSE_ROWS = 4_000
BLOCKED = {**spectra.GROUPS, "agglomerative_ward": ward.ward}
#: Options of clusterers for the registered fits.
OPTIONS = {"spectral_rbf": {"gamma": 0.05}}


@dataclasses.dataclass(frozen=True)
class Config:
    target: str = "cov"  # cov, precision, corr or vol
    lookback: int = 50
    horizon: int = 20
    embedder: str = "pca"
    embed_options: dict = dataclasses.field(default_factory=lambda: {"k": 5})
    clusterer: str = "fuzzy_cmeans"
    cluster_options: dict = dataclasses.field(default_factory=dict)
    n_regimes: int = 4
    trans_smooth: float = 10.0
    transition: str = "soft"
    metric: str = "l1"
    p: float = 2.0
    tau: float = 2.0
    k_neighbors: int = 10
    gap: int = 10
    overshoot: int = 5
    strict: bool = False
    aggregator: str = "logeuc"
    alpha_source: str = "filtered"  # filtered, pi or uniform
    alpha_smooth: float = 0.08
    alpha_hard: bool = False
    diag_shrink: float = 0.12
    stride: int = 5
    sample_stride: int = 3
    refit: int = 20
    burn_in: int = 252
    min_samples: int = 50
    trace_lo: float = 0.5
    trace_hi: float = 2.5
    guardrail: str = "invalid_only"
    shrink_gamma: float = 0.3
    mix: dict = dataclasses.field(default_factory=lambda: {"model": 0.25, "shrink": 0.35, "pers": 0.4, "roll": 0.0})
    vol_mix: float = 0.2
    vol_roll: float = 0.5
    vol_shrink: float = 0.15
    blend_strength: float = 0.35
    blend_threshold: float = 0.75
    blend_power: float = 2.0
    gmvp_shrink_blend: float = 0.0  # share of the shrunk matrix in what the model's minimum-variance weights are made of
    floor: float = 1.5e-3
    long_only: bool = False
    max_na: float = 0.3
    min_assets: float = 0.8
    min_dates: float = 0.5


class RegimeModel:
    """Regimes on their own: fitted to embeddings, asked for memberships."""

    def __init__(self, name: str = "gmm", k: int = 4, **options: float):
        self.name, self.k, self.options, self.clusters = name, k, options, None

    def fit(self, z: np.ndarray) -> RegimeModel:
        self.clusters = clusterer(self.name, self.k, **self.options)
        self.pi = self.clusters.fit(z)
        return self

    def predict(self, z: np.ndarray) -> np.ndarray:
        if self.clusters is None:
            raise RuntimeError("fit() comes first")
        return self.clusters.predict(np.atleast_2d(z))


class Forecaster:
    """Fit on a matrix of dates by assets up to a date, then forecast from anchors after it."""

    def __init__(self, c: Config):
        self.c = c

    def _valid(self, x: np.ndarray) -> bool:
        return valid(x, self.c.max_na, self.c.min_assets, self.c.min_dates)

    def fit(self, r: np.ndarray) -> Forecaster:
        c = self.c
        self.embedder = EMBEDDERS[c.embedder](**c.embed_options)
        if hasattr(self.embedder, "fit"):
            # each window ends before its anchor, whatever the strides
            self.embedder.fit(np.stack([x for x in (r[a - c.lookback : a] for a in range(c.lookback, len(r))) if self._valid(x)]))
        anchors, z, y = [], [], []
        for a in range(c.lookback - 1, len(r) - c.horizon, c.sample_stride):
            past, ahead = r[a - c.lookback + 1 : a + 1], r[a + 1 : a + 1 + c.horizon]
            if self._valid(past) and self._valid(ahead):
                anchors.append(a), z.append(self.embedder.embed(past)), y.append(target_of(ahead, c.target))
        if len(z) < c.min_samples:
            raise ValueError(f"{len(z)} windows, {c.min_samples} needed")
        self.y = np.stack(y)
        if c.target != "vol" and c.aggregator == "logeuc":
            self.y = linalg.logm(self.y)  # once for each window, not for each forecast
        self.regimes = Regimes(c, np.array(anchors), np.stack(z))
        return self

    def predict(self, r: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """Forecast and regime probabilities at an anchor, of r up to it."""
        e = self.embedder.embed(r[anchor - self.c.lookback + 1 : anchor + 1])
        alpha, near, w = self.regimes.ask(self.c, e, anchor)
        return combined(self.c, alpha, w, self.y[near]), alpha


def schedule(n_dates: int, c: Config) -> list[tuple[int, int]]:
    """(anchor, refit anchor) of each evaluation: known before anything is fitted."""
    out, last = [], None
    for a in range(c.lookback + c.horizon + c.burn_in, n_dates - c.horizon, c.stride):
        if last is None or a - last >= c.refit:
            last = a
        out.append((a, last))
    return out


ROWS = "run string, anchor int, method string, metric string, value double"


def runs(panel: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """run, anchor, method, metric, value: all runs, which share the fits that they can."""
    out = walkforward.runs(panel, configs)
    return panel.sparkSession.createDataFrame([], ROWS) if out is None else with_turnover(out)


def with_turnover(rows: DataFrame) -> DataFrame:
    """Weights become turnovers: the sum of changes since the method's last anchor."""
    from pyspark.sql import Window

    weight = F.col("metric").startswith("w_")
    last = F.lag("value").over(Window.partitionBy("run", "method", "metric").orderBy("anchor"))
    turned = rows.where(weight).withColumn("d", F.abs(F.col("value") - last)).groupBy("run", "anchor", "method").agg(F.sum("d").alias("value"))
    return rows.where(~weight).unionByName(turned.where("value IS NOT NULL").select("run", "anchor", "method", F.lit("gmvp_turnover").alias("metric"), "value"))


def run(panel: DataFrame, c: Config) -> DataFrame:
    return runs(panel, {"run": c}).drop("run")


def grid(base: Config, axes: dict[str, list]) -> dict[str, Config]:
    """All combinations of the axes' choices, by a tag; a choice that is a mapping sets several fields."""
    out = {}
    for choice in itertools.product(*axes.values()):
        fields, tag = {}, []
        for axis, value in zip(axes, choice, strict=True):
            fields |= value if isinstance(value, dict) else {axis: value}
            tag.append(f"{axis}={value}")
        out[",".join(tag)] = dataclasses.replace(base, **fields)
    return out


def one_at_a_time(base: Config, axes: dict[str, list]) -> dict[str, Config]:
    out: dict[str, Config] = {}
    for axis, values in axes.items():
        out |= grid(base, {axis: values})
    return out


def ablation(panel: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """run, metric, mean: means of the model's metrics for each run."""
    return analytics.run_summary(runs(panel, configs), "model")


def fitted(vectors: DataFrame, name: str, k: int, options: dict) -> DataFrame:
    """id, p: memberships of a clusterer fitted to all vectors (id, z). What needs a matrix of rows by rows is fitted in one task up to DENSE_ROWS, in groups of blocks beyond."""
    if name in fits.ROUNDS:
        v = fits.Vectors(vectors)
        if v.n < k:
            raise ValueError(f"{v.n} rows for {k} regimes")
        return v.mapped(fits.ROUNDS[name](v, k, **options).predict, "p array<double>")
    if vectors.count() > DENSE_ROWS:
        options = dict(options)
        temperature = options.pop("temperature", 1.0)
        means = _means(vectors, _grouped(vectors, name, k, options), k)
        v = fits.Vectors(vectors)
        return v.mapped(lambda x: softmax(squared(x, means), temperature), "p array<double>")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        p = clusterer(name, k, **options).fit(np.stack(pdf["z"]).astype(float))
        return pd.DataFrame({"id": pdf["id"], "p": list(p)})

    return vectors.select("id", "z", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "id long, p array<double>")


def _grouped(vectors: DataFrame, name: str, k: int, options: dict) -> DataFrame:
    """id, label of all vectors, by groups of blocks of them."""
    if name not in BLOCKED:
        raise ValueError(f"{name} has no groups of its own")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("z")).alias("d")).first()
    more = {"neighbours" if o == "n" else o: v for o, v in options.items() if o != "affinity"}
    return BLOCKED[name](vectors.select("id", "z"), size.n, size.d, k, **more)


def _means(vectors: DataFrame, labels: DataFrame, k: int) -> np.ndarray:
    """Means of the groups in their order, that of all rows where there is none."""
    x = vectors.select("id", F.posexplode("z").alias("dim", "x")).join(labels, "id")
    rows = x.groupBy("label", "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # k rows of each dimension
    sums: dict[int, dict] = {}
    for r in rows:
        sums.setdefault(r.label, {})[r.dim] = (r.s, r.n)
    own = [np.array([c[i] for i in sorted(c)]) for c in sums.values()]
    means = sorted((o[:, 0] / o[:, 1]).tolist() for o in own)
    total = np.sum(own, axis=0)
    return np.array(means + [(total[:, 0] / total[:, 1]).tolist()] * (k - len(means)))


def fitted_labels(vectors: DataFrame, name: str, k: int, **options: float) -> DataFrame:
    """id, label: the groups that a clusterer with groups of its own (and prototypes of them) makes of all vectors (id, z)."""
    if name in fits.ROUNDS:
        v = fits.Vectors(vectors)
        labels = fits.ROUNDS[name](v, k, **options).labels
        if labels is None:
            raise ValueError(f"{name} has no groups of its own")
        return v.mapped(lambda x: labels(x).astype(np.int32), "label int")
    if vectors.count() > DENSE_ROWS:
        return _grouped(vectors, name, k, options)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"id": pdf["id"], "label": clusterer(name, k, **options).labels(np.stack(pdf["z"]).astype(float))})

    return vectors.select("id", "z", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "id long, label int")
