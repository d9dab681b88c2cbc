"""Distances and vector algebra as higher-order array functions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def lp(p: float) -> Callable[[Column, Column], Column]:
    """Distance of order p; p = inf is the largest difference."""
    if not p > 0:
        raise ValueError("p must be positive")

    def distance(a: Column, b: Column) -> Column:
        d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
        if p == float("inf"):
            return F.array_max(d)
        if p == 1:
            return total(d)
        if p == 2:
            return F.sqrt(total(F.transform(d, lambda x: x * x)))
        return F.pow(total(F.transform(d, lambda x: F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))

    return distance


def cosine_similarity(a: Column, b: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))
    return F.least(F.greatest(dot(a, b) / norm, F.lit(-1.0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def angular(a: Column, b: Column) -> Column:
    return F.acos(cosine_similarity(a, b))


_L1, _L2, _LARGEST = lp(1), lp(2), lp(float("inf"))
#: Names of distances and their other names (fixed values).
METRICS = {
    "l1": _L1, "manhattan": _L1, "cityblock": _L1, "l2": _L2, "euclidean": _L2, "chebyshev": _LARGEST, "linf": _LARGEST,
    "l-inf": _LARGEST, "l_inf": _LARGEST, "infinity": _LARGEST, "cosine": cosine, "angular": angular,
}


def canonical(name: str) -> str:
    """lp, or the first of the names that a distance has."""
    name = name.strip().lower()
    if name == "lp":
        return name
    if name not in METRICS:
        raise ValueError(f"unknown distance {name!r}; known: lp, {', '.join(METRICS)}")
    return next(k for k in METRICS if METRICS[k] is METRICS[name])


def metric(name: str, p: float | None = None) -> Callable[[Column, Column], Column]:
    """The distance of that name; "lp" takes the order p."""
    name = name.strip().lower()
    if name == "lp":
        return lp(2.0 if p is None else p)
    if name not in METRICS:
        raise ValueError(f"unknown distance {name!r}; known: lp, {', '.join(METRICS)}")
    return METRICS[name]


def softmax_by_distance(squared: Column, beta: float) -> Column:
    """Memberships proportional to exp(-beta * d2), from an array of squared distances."""
    e = F.transform(squared, lambda d: F.exp(-beta * (d - F.array_min(squared))))
    return F.transform(e, lambda x: x / total(e))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def normalised(p: Column) -> Column:
    """Divided by its sum; uniform where that is not positive."""
    s = total(p)
    return F.when(s > 0, F.transform(p, lambda x: x / s)).otherwise(F.transform(p, lambda x: F.lit(1.0) / F.size(p)))


def one_hot(p: Column) -> Column:
    """1 at the first largest entry, else 0."""
    at = F.array_position(p, F.array_max(p))
    return F.transform(p, lambda x, k: F.when(k + 1 == at, 1.0).otherwise(0.0))


def smoothed(p: Column, eps: float) -> Column:
    """Moved towards the uniform distribution by eps."""
    return F.transform(p, lambda x: (1 - eps) * x + F.lit(eps) / F.size(p))
