"""p-values without scipy."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_pvalue(t: float, df: float, alternative: str = "two-sided") -> float:
    """p of a t statistic; alternative: two-sided, less or greater."""
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return {"two-sided": 2 * tail, "greater": tail if t > 0 else 1 - tail, "less": tail if t < 0 else 1 - tail}[alternative]


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def wilcoxon_pvalue(w: float, n: int, ties: float = 0.0) -> float:
    """Two-sided p of the smaller rank sum w of n non-zero differences; ties: sum of t^3 - t. Exact up to 50 without ties."""
    if n == 0:
        return 1.0
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, 2 * normal_tail(abs(w - n * (n + 1) / 4) / math.sqrt(var)))
