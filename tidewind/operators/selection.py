"""Exact quantiles of any number of values, without a buffer of all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that may be gathered, and the accuracy of the sketches: each brackets a rank within a share of 1 / ACCURACY of the values.
GATHERED, ACCURACY = 4096, 10_000

#: A range of values, both ends left out; None: no end.
Range = tuple[float | None, float | None]


def _within(r: Range) -> Column:
    low, high = r
    inside = F.col("v").isNotNull()
    inside = inside if low is None else inside & (F.col("v") > F.lit(low))
    return inside if high is None else inside & (F.col("v") < F.lit(high))


def order_statistics(values: DataFrame, ranks: list[int], gathered: int = GATHERED, accuracy: int = ACCURACY) -> dict[int, float]:
    """The values with the given ranks (from 0) of the column v of values, which has no nulls.

    Of each range that holds ranks, sketches bracket them between two values; one pass counts what is below, on, between and above those, which
    says in which of the five parts a rank is. What is on a value is found; of the others the next range is some thousandth as full. A range
    of few values is gathered."""
    found: dict[int, float] = {}
    # range: (values below it, values in it, ranks in it)
    open_: dict[Range, tuple[int, int, set[int]]] = {(None, None): (0, values.count(), set(ranks))}
    while open_:
        for r, (below, n, own) in list(open_.items()):
            if n <= gathered:
                inside = sorted(x.v for x in values.where(_within(r)).select("v").collect())
                found |= {k: inside[k - below] for k in own}
                del open_[r]
        asked = [(r, k) for r, (_, _, own) in open_.items() for k in sorted(own)]
        if not asked:
            break
        near = lambda r, k: [min(1.0, max(0.0, (k - open_[r][0] + s) / open_[r][1] + s / accuracy)) for s in (-2, 2)]
        brackets = values.agg(*[F.percentile_approx(F.when(_within(r), F.col("v")), near(r, k), accuracy).alias(f"b{i}") for i, (r, k) in enumerate(asked)]).first()
        counts = []
        for i, (r, _) in enumerate(asked):
            low, high = brackets[i]
            parts = (_within((r[0], low)), F.col("v") == F.lit(low), _within((low, high)), (F.col("v") == F.lit(high)) & F.lit(high != low))
            counts += [F.count_if(p).alias(f"c{i}_{j}") for j, p in enumerate(parts)]
        told, later = values.agg(*counts).first(), {}
        for i, (r, k) in enumerate(asked):
            (low, high), (below, n, _) = brackets[i], open_[r]
            sizes = [told[f"c{i}_{j}"] for j in range(4)]
            sizes.append(n - sum(sizes))
            for part, size in zip(((r[0], low), low, (low, high), high, (high, r[1])), sizes, strict=True):
                if below <= k < below + size:
                    if isinstance(part, tuple):
                        later.setdefault(part, (below, size, set()))[2].add(k)
                    else:
                        found[k] = part
                below += size
        open_ = later
    return found


def quantiles(values: DataFrame, shares: list[float], **limits: int) -> list[float | None]:
    """The quantiles of the column v of values, between neighbours by straight lines; nulls don't count. None of no values."""
    values = values.select(F.col("v").cast("double").alias("v")).where("v IS NOT NULL").persist()
    try:
        n = values.count()
        if not n:
            return [None] * len(shares)
        places = [p * (n - 1) for p in shares]
        found = order_statistics(values, [k for x in places for k in (int(x), min(int(x) + 1, n - 1))], **limits)
        return [found[int(x)] + (x - int(x)) * (found[min(int(x) + 1, n - 1)] - found[int(x)]) for x in places]
    finally:
        values.unpersist()
