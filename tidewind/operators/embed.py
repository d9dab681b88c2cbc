"""Embeddings of windows [T, N] as vectors, in numpy, for use inside grouped functions; vol_statistics of windows.py is the relational one."""

from __future__ import annotations

import numpy as np

FLOOR = 1e-12


def imputed(x: np.ndarray) -> np.ndarray:
    """Missing values become the asset's mean; 0 if it has none. Stacks [..., T, N] work too."""
    ok = np.isfinite(x)
    n = ok.sum(-2, keepdims=True)
    mean = np.where(ok, x, 0).sum(-2, keepdims=True) / np.maximum(n, 1)
    return np.where(ok, x, mean)


def covariance(x: np.ndarray, ddof: int = 1, ridge: float = 1e-8) -> np.ndarray:
    x = imputed(x)
    x = x - x.mean(-2, keepdims=True)
    return np.swapaxes(x, -1, -2) @ x / max(1, x.shape[-2] - ddof) + ridge * np.eye(x.shape[-1])


def valid(x: np.ndarray, most_na: float = 0.3, least_assets: float = 0.8, least_dates: float = 0.5) -> bool:
    ok = np.isfinite(x)
    return bool(x.size and (~ok).mean() <= most_na and ok.any(0).mean() >= least_assets and ok.any(1).mean() >= least_dates)


class Embedder:
    def embed(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def own(self, x: np.ndarray) -> np.ndarray:
        """What the window gives without the others: all of it, unless there is a fit."""
        return self.embed(x)


class CorrEigen(Embedder):
    """Logs of the k largest eigenvalues of the correlation matrix; zeros if there are fewer assets."""

    def __init__(self, k: int = 32):
        self.k = k

    def embed(self, x: np.ndarray) -> np.ndarray:
        s = covariance(x)
        d = np.sqrt(np.maximum(np.diag(s), FLOOR))
        if len(s) < self.k:
            return np.zeros(self.k)
        return np.log(np.maximum(np.linalg.eigvalsh(s / d[:, None] / d[None])[::-1][: self.k], FLOOR))


class VolStats(Embedder):
    def embed(self, x: np.ndarray) -> np.ndarray:
        x = imputed(x)
        t = len(x)
        sd = lambda y: np.maximum(y.std(0, ddof=min(1, max(0, len(y) - 1))), FLOOR)
        s = sd(x)
        log = np.log(s)
        q = np.quantile(log, [0.05, 0.25, 0.5, 0.75, 0.95])
        change = (np.log(sd(x[t // 2 :])) - np.log(sd(x[: t // 2]))).mean() if t >= 4 else 0.0
        return np.array([log.mean(), log.std(ddof=1) if len(log) > 1 else 0.0, *q, q[3] - q[1], change, ((s / (s.sum() + FLOOR)) ** 2).sum()])


def lag_correlation(x: np.ndarray) -> np.ndarray:
    """Each column's correlation of all rows but the last with all but the first."""
    one, two = (y - y.mean(0) for y in (x[:-1], x[1:]))
    return (one * two).sum(0) / (np.sqrt((one**2).sum(0) * (two**2).sum(0)) + FLOOR)


class HybridState(Embedder):
    """Spectrum, volatility, autocorrelation, correlation and size of a window: 2k + 13 numbers."""

    def __init__(self, k: int = 5):
        self.k = k

    def embed(self, x: np.ndarray) -> np.ndarray:
        x = imputed(x)
        c = x - x.mean(0)
        n = x.shape[1]
        sv = np.linalg.svd(c, compute_uv=False)
        share = sv**2 / ((sv**2).sum() + FLOOR)
        pad = lambda v: np.pad(v[: self.k], (0, max(0, self.k - len(v))))
        vol = x.std(0, ddof=1)
        spread = lambda v: v.std(ddof=1) if v.size > 1 else 0.0
        corr = (c / (vol + FLOOR)).T @ (c / (vol + FLOOR)) / (len(x) - 1 + FLOOR)
        w = np.linalg.eigvalsh(corr)[::-1]
        auto = lag_correlation(x)
        return np.array([
            *pad(np.log(sv + FLOOR)), *pad(share), -(share * np.log(share + FLOOR)).sum(), vol.mean(), spread(vol), *np.quantile(vol, [0.25, 0.5, 0.75]), auto.mean(), spread(auto),
            (corr.sum() - np.trace(corr)) / (n * (n - 1) + FLOOR), w[0], w[0] - w[1] if n > 1 else 0.0, np.abs(x).mean(), spread(np.abs(x).ravel()),
        ])


class PcaWindow(Embedder):
    """Principal coordinates of flattened windows, then of the window's own decomposition shares, log singular values and, over time, means
    and deviations of the scores of each component; each padded to k: 5k numbers.

    The decomposition is exact, with the sign that makes each axis' largest loading positive."""

    #: Windows that are flattened at once.
    PART = 512

    def __init__(self, k: int = 40):
        self.k = k

    def fit(self, windows: np.ndarray, rows: np.ndarray | None = None) -> PcaWindow:
        """From the windows [M, T, N], or those of the given rows. A view of a panel will do: it is taken part by part, and the largest matrix has the smaller of M and T * N rows."""
        rows = np.arange(len(windows)) if rows is None else rows
        parts = [rows[a : a + self.PART] for a in range(0, len(rows), self.PART)]
        n, d = len(rows), windows.shape[1] * windows.shape[2]
        total, square = np.zeros(d), np.zeros(d)
        for own in parts:
            total += self._flat(windows[own]).sum(0)
        self.mean = total / n
        for own in parts:
            square += ((self._flat(windows[own]) - self.mean) ** 2).sum(0)
        sd = np.sqrt(square / n)
        self.sd = np.where(sd > 0, sd, 1.0)
        wide = d > n
        if wide:  # asset by asset, each with all windows
            columns = [np.arange(windows.shape[1]) * windows.shape[2] + j for j in range(windows.shape[2])]
            of = lambda j: (self._flat(windows[rows][:, :, [j]]) - self.mean[columns[j]]) / self.sd[columns[j]]
            gram = sum((x := of(j)) @ x.T for j in range(windows.shape[2]))
        else:
            gram = sum((z := self._scaled(windows[own])).T @ z for own in parts)
        w, u = np.linalg.eigh(gram)
        order = np.argsort(w)[::-1][: min(max(self.k, 1), n - 1)]
        order = order[w[order] > 1e-10 * max(w.max(), FLOOR)]
        axes = u[:, order]
        if wide:
            axes = np.zeros((d, len(order)))
            for j, at in enumerate(columns):
                axes[at] = of(j).T @ u[:, order] / np.sqrt(w[order])
        self.axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
        return self

    @staticmethod
    def _flat(windows: np.ndarray) -> np.ndarray:
        x = imputed(windows)
        return (x - x.mean(-2, keepdims=True)).reshape(len(x), -1)

    def _scaled(self, windows: np.ndarray) -> np.ndarray:
        return (self._flat(windows) - self.mean) / self.sd

    def _padded(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v[..., : self.k], [(0, 0)] * (v.ndim - 1) + [(0, max(0, self.k - v.shape[-1]))])

    def coordinates(self, windows: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The principal coordinates of the windows of the given rows, padded to k."""
        parts = [self._scaled(windows[rows[a : a + self.PART]]) @ self.axes for a in range(0, len(rows), self.PART)]
        return self._padded(np.vstack(parts))

    def own(self, x: np.ndarray) -> np.ndarray:
        """What the window gives without the others."""
        c = imputed(x)
        u, sv, _ = np.linalg.svd(c - c.mean(0), full_matrices=False)
        scores = u[:, : self.k] * sv[: self.k]
        return np.concatenate([self._padded(v) for v in (sv**2 / ((sv**2).sum() + FLOOR), np.log(sv + FLOOR), scores.mean(0), scores.std(0, ddof=min(1, len(scores) - 1)))])

    def embed(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.coordinates(x[None], np.zeros(1, int))[0], self.own(x)])


EMBEDDERS = {"corr_eigen": CorrEigen, "vol_stats": VolStats, "hybrid": HybridState, "pca": PcaWindow}
