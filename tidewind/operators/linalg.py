"""Spectral operators: stacks of symmetric matrices through numpy, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sym(a: np.ndarray) -> np.ndarray:
    return (a + np.swapaxes(a, -1, -2)) / 2


def spectral(a: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """V f(w) V' of each matrix of a stack."""
    w, v = np.linalg.eigh(sym(a))
    return sym((v * f(w)[..., None, :]) @ np.swapaxes(v, -1, -2))


def project_spd(a: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return spectral(a, lambda w: np.maximum(w, eps))


def logm(a: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    return spectral(a, lambda w: np.log(np.maximum(w, eps)))


def expm(a: np.ndarray) -> np.ndarray:
    return spectral(a, np.exp)


def log_euclidean_mean(stack: np.ndarray, w: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """exp of the weighted mean of logs; stack [n, N, N], w [n]."""
    return project_spd(expm(np.tensordot(w, logm(project_spd(stack, eps)), 1)), eps)


def arithmetic_mean(stack: np.ndarray, w: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return project_spd(np.tensordot(w, stack, 1), eps)


def precision(a: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    eye = np.eye(a.shape[-1])
    try:
        return project_spd(np.linalg.solve(a + ridge * eye, np.broadcast_to(eye, a.shape)), 1e-8)
    except np.linalg.LinAlgError:
        return project_spd(np.linalg.pinv(a), 1e-8)


def _jittered(a: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    return sym(a) + eps * np.eye(a.shape[-1])


def kl(s: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Gaussian divergence of N(0, truth) from N(0, s)."""
    s, truth = _jittered(s), _jittered(truth)
    n = s.shape[-1]
    tr = np.trace(np.linalg.solve(s, truth), axis1=-2, axis2=-1)
    return 0.5 * (tr - n + np.linalg.slogdet(s)[1] - np.linalg.slogdet(truth)[1])


def stein(s: np.ndarray, truth: np.ndarray) -> np.ndarray:
    s, truth = _jittered(s), _jittered(truth)
    x = np.linalg.solve(s, truth)
    return np.trace(x, axis1=-2, axis2=-1) - np.linalg.slogdet(x)[1] - s.shape[-1]


def log_euclidean_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.norm(logm(a) - logm(b), axis=(-2, -1))


def log_eigenvalue_mse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    la, lb = (np.log(np.maximum(np.linalg.eigvalsh(sym(x)), 1e-12)) for x in (a, b))
    return ((la - lb) ** 2).mean(-1)


def correlation(a: np.ndarray) -> np.ndarray:
    """Clipped to [-1, 1], with ones on the diagonal."""
    d = np.sqrt(np.maximum(np.diagonal(a, axis1=-2, axis2=-1), 1e-12))
    c = np.clip(a / d[..., :, None] / d[..., None, :], -1, 1)
    return np.where(np.eye(a.shape[-1], dtype=bool), 1.0, c)


def correlation_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Frobenius distance of the correlations beside the diagonal."""
    d = correlation(a) - correlation(b)
    return np.sqrt((np.where(np.eye(a.shape[-1], dtype=bool), 0.0, d) ** 2).sum((-2, -1)))


def mean_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1; ties get their mean rank."""
    _, group, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[group]


def correlation_spearman(a: np.ndarray, b: np.ndarray) -> float:
    """Rank correlation of the correlations above the diagonal; NaN if one side has no order."""
    at = np.triu_indices(a.shape[-1], 1)
    x, y = mean_ranks(correlation(a)[at]), mean_ranks(correlation(b)[at])
    if len(x) < 2 or x.std() == 0 or y.std() == 0:
        return float("nan")
    return float(np.corrcoef(x, y)[0, 1])


def condition(a: np.ndarray) -> np.ndarray:
    w = np.maximum(np.linalg.eigvalsh(sym(a)), 1e-12)
    return w[..., -1] / w[..., 0]


def nll(s: np.ndarray, x: np.ndarray) -> float:
    """Mean Gaussian negative log likelihood of rows x under N(0, s); NaN if any value is missing."""
    s = _jittered(s)
    n = s.shape[-1]
    q = np.einsum("tn,tn->t", x, np.linalg.solve(s, x.T).T)
    return float(np.mean(0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + q)))


def gmvp(a: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    """Minimum-variance weights of each matrix; uniform where they have no finite sum."""
    n = a.shape[-1]
    one = np.ones((*a.shape[:-1], 1))
    try:
        w = np.linalg.solve(a + ridge * np.eye(n), one)[..., 0]
    except np.linalg.LinAlgError:
        w = (np.linalg.pinv(a) @ one)[..., 0]
    s = w.sum(-1, keepdims=True)
    ok = np.isfinite(s) & (np.abs(s) > 1e-12)
    return np.where(ok, w / np.where(ok, s, 1), 1 / n)


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest points with entries from 0 that sum to 1, of each row."""
    u = -np.sort(-v, axis=-1)
    above = (np.cumsum(u, axis=-1) - 1) / np.arange(1, v.shape[-1] + 1)
    k = (u > above).cumsum(-1).argmax(-1)[..., None]  # the last place that stays above its level
    return np.maximum(v - np.take_along_axis(above, k, -1), 0)


def gmvp_long_only(a: np.ndarray, ridge: float = 1e-8, iterations: int = 500, rate: float = 0.5, tol: float = 1e-10) -> np.ndarray:
    """Projected gradient on the simplex, of all matrices of a stack side by side: a step that raises the variance is halved and not taken, a change below tol ends a matrix.

    Steps and ends are absolute, so with variances of daily returns the iterations end well before the optimum, as they are meant to."""
    stack = a.reshape(-1, *a.shape[-2:]) + ridge * np.eye(a.shape[-1])
    n = stack.shape[-1]
    w, last, step = np.full((len(stack), n), 1 / n), np.full(len(stack), np.inf), np.full(len(stack), rate)
    live = np.arange(len(stack))
    for _ in range(iterations):
        if not len(live):
            break
        s, x = stack[live], w[live]
        new = simplex(x - step[live, None] * 2 * np.einsum("mij,mj->mi", s, x))
        now = np.einsum("mi,mij,mj->m", new, s, new)
        lost, done, worse = ~np.isfinite(now), np.abs(last[live] - now) < tol, now > last[live]
        w[live[lost]] = 1 / n
        taken = ~lost & (done | ~worse)
        w[live[taken]], last[live[taken]] = new[taken], now[taken]
        halved = live[~lost & ~done & worse]
        step[halved] /= 2
        live = live[~lost & ~done & (step[live] >= 1e-12)]
    return w.reshape(a.shape[:-1])


def packed(cov: DataFrame, *keys: str) -> DataFrame:
    """keys, assets, m (row-major values): one row for each matrix."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "v")))
    rows = cov.groupBy(*keys).agg(cells.alias("c"))
    return rows.select(*keys, F.array_distinct("c.i").alias("assets"), F.col("c.v").alias("m"))


def stack(column: pd.Series) -> np.ndarray:
    a = np.stack([np.asarray(x, float) for x in column])
    n = round(a.shape[1] ** 0.5)
    return a.reshape(-1, n, n)


def mapped(matrices: DataFrame, keys: list[str], f: Callable[[np.ndarray], np.ndarray], shape: str = "m array<double>", name: str = "m") -> DataFrame:
    """keys, assets and f of each matrix; f takes and gives stacks."""
    kinds = ", ".join(f"`{k}` {matrices.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = f(stack(pdf["m"]))
                yield pdf[[*keys, "assets"]].assign(**{name: list(out.reshape(len(pdf), -1)) if out.ndim > 1 else out})

    return matrices.select(*keys, "assets", "m").mapInPandas(run, f"{kinds}, assets array<string>, {shape}")


def unpacked(matrices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, v."""
    n = F.size("assets")
    rows = matrices.select(*keys, "assets", F.posexplode("m").alias("k", "v"))
    return rows.select(*keys, F.element_at("assets", F.floor(F.col("k") / n).cast("int") + 1).alias("i"), F.element_at("assets", (F.col("k") % n).cast("int") + 1).alias("j"), "v")


def losses(forecast: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """keys and kl, stein, logeuc, eig_mse, cond_ratio of packed matrices that share keys."""
    both = forecast.select(*keys, "m").join(truth.select(*keys, F.col("m").alias("y")), keys)
    kinds = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = project_spd(stack(pdf["m"])), project_spd(stack(pdf["y"]))
                yield pdf[keys].assign(kl=kl(a, b), stein=stein(a, b), logeuc=log_euclidean_distance(a, b), eig_mse=log_eigenvalue_mse(a, b), cond=condition(a), cond_ratio=condition(a) / condition(b))

    return both.mapInPandas(run, f"{kinds}, kl double, stein double, logeuc double, eig_mse double, cond double, cond_ratio double")
