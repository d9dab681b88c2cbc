"""Scans along series of any length: rows in blocks, a fold of each block, a small scan over the blocks, and a second pass that fills in.

A block holds the rows of one range of SIZE anchors. Blocks are scanned in two levels, SIZE blocks at a time, so that no task gets more
than SIZE rows or one row for each SIZE * SIZE anchors of a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Anchors of a block, and blocks that are scanned together.
SIZE = 4096
#: Mass at which a filter starts anew.
LOST = 1e-12


def _floor(c: Column, size: int) -> Column:
    return F.floor(c / size).cast("long")


def latest_before(rows: DataFrame, value: str, name: str, keys: list[str], first: Column | None = None, size: int = SIZE) -> DataFrame:
    """rows (keys, anchor, value) with name: the last value that isn't null on a row before, in the series that keys name.

    first: what comes first among rows of one anchor (rows that have a value have an anchor of their own among those)."""
    order = [F.col("anchor"), *([first] if first is not None else [])]
    rows = rows.withColumn("block", _floor(F.col("anchor"), size))
    blocks = rows.groupBy(*keys, "block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("anchor"))).alias("end")).withColumn("group", _floor(F.col("block"), size))
    groups = blocks.groupBy(*keys, "group").agg(F.max_by("end", F.when(F.col("end").isNotNull(), F.col("block"))).alias("end"))
    groups = groups.withColumn("far", F.last("end", ignorenulls=True).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)))
    blocks = _carried(blocks, groups.select(*keys, "group", F.col("far").alias("end")), "end", "start", [*keys, "group"], ["block"])
    return _carried(rows, blocks.select(*keys, "block", F.col("start").alias(value)), value, name, [*keys, "block"], order).drop("block")


def _carried(rows: DataFrame, starts: DataFrame, value: str, name: str, keys: list[str], order: list) -> DataFrame:
    """rows with name: the last value before each among the rows of its keys, starts (keys, value) standing before the first of them. Both go through one shuffle; what is joined would go through the driver."""
    both = rows.withColumn("_own", F.lit(1)).unionByName(starts.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, F.last(value, ignorenulls=True).over(before)).where("_own = 1").drop("_own")


# the forward filter ----------------------------------------------------------------------------------------------------------------------


def _fold(a: np.ndarray, alpha0: np.ndarray | None):
    """A block's rows as what they make of any memberships: those of a start in regime i are r[i], with a likelihood of exp(s[i]); e: of a series that begins here."""
    low, high = a.min(0), a.max(0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = len(a)
        r, s, e, doubt = np.eye(k), np.zeros(k), None, False
        for p in np.stack(pdf.sort_values("anchor")["p"]).astype(float):
            e = _step(e, p, a)[0] if e is not None else p if alpha0 is None else alpha0
            if high @ p <= LOST:  # whatever the memberships were
                r, s = np.tile(p, (k, 1)), np.zeros(k)
                continue
            doubt |= bool(low @ p <= LOST)
            r = (r @ a) * p
            total = r.sum(1)
            with np.errstate(divide="ignore"):
                s = s + np.log(total)
            r = np.where(total[:, None] > 0, r / np.where(total > 0, total, 1)[:, None], 1 / k)
        return pd.DataFrame({"series": pdf["series"].iloc[:1], "block": pdf["block"].iloc[:1], "r": [r.ravel().tolist()], "s": [s.tolist()], "e": [e.tolist()], "doubt": [doubt], "end": [None]})

    return run


def _step(now: np.ndarray, p: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, bool]:
    """Memberships one step on, and whether they start anew."""
    q = (now @ a) * p
    total = q.sum()
    return (q / total, False) if total > LOST else (p, True)


def _after(now: np.ndarray | None, fold) -> np.ndarray:
    """Memberships after a block, from those before it; None: the series begins there."""
    if now is None:
        return np.asarray(fold.e, float)
    if fold.end is not None:  # it starts anew on the way
        return np.asarray(fold.end, float)
    s = np.asarray(fold.s, float) + np.log(np.maximum(now, 0), out=np.full(len(now), -np.inf), where=now > 0)
    if not np.isfinite(s.max()):
        return np.asarray(fold.e, float)
    x = np.exp(s - s.max()) @ np.asarray(fold.r, float).reshape(len(now), -1)
    return x / x.sum()


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a group as one."""
    pdf = pdf.sort_values("block")
    k = len(pdf["s"].iloc[0])
    r, s, e, end = np.eye(k), np.zeros(k), None, None
    for f in pdf.itertuples():
        e = _after(e, f)
        if f.end is not None:
            end, r, s = np.asarray(f.end, float), np.eye(k), np.zeros(k)
        elif end is not None:
            end = _after(end, f)
        else:
            step = np.asarray(f.s, float)
            top = step.max()
            x = r * np.exp(step - top) if np.isfinite(top) else r
            total = x.sum(1)
            with np.errstate(divide="ignore"):
                s = s + np.log(total) + (top if np.isfinite(top) else 0)
            r = np.where(total[:, None] > 0, x / np.where(total > 0, total, 1)[:, None], 1 / k) @ np.asarray(f.r, float).reshape(k, k)
    return pd.DataFrame({"series": pdf["series"].iloc[:1], "group": pdf["group"].iloc[:1], "r": [r.ravel().tolist()], "s": [s.tolist()], "e": [e.tolist()], "end": [None if end is None else end.tolist()]})


def _begun(pdf: pd.DataFrame) -> tuple[np.ndarray | None, pd.DataFrame]:
    """The start of a group's rows, and the rows without the one that says it."""
    if "begins" not in pdf:
        return None, pdf
    start = pdf.loc[pdf["begins"], "start"].iloc[0]
    return None if start is None else np.asarray(start, float), pdf[~pdf["begins"]]


def _beginning(rows: DataFrame, starts: DataFrame, order: str) -> DataFrame:
    """rows, and a row for each start among them; what is joined would go through the driver."""
    starts = starts.withColumns({"begins": F.lit(True), order: F.lit(0).cast(rows.schema[order].dataType)})
    return rows.withColumn("begins", F.lit(False)).unionByName(starts, allowMissingColumns=True)


def _scanned(order: str):
    """The start of each row of a group, in order; that of the first one stands in a row of its own, if there is one before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now, pdf = _begun(pdf)
        pdf, starts = pdf.sort_values(order), []
        for f in pdf.itertuples():
            starts.append(None if now is None else now.tolist())
            now = _after(now, f)
        return pd.DataFrame({"series": pdf["series"], order: pdf[order], "start": starts})

    return run


def _starts(folds: DataFrame, kind: str, size: int) -> DataFrame:
    """series, block, start: the memberships before each block; null before the first of a series."""
    shape = "r array<double>, s array<double>, e array<double>, end array<double>"
    blocks = folds.withColumn("group", _floor(F.col("block"), size))
    groups = blocks.groupBy("series", "group").applyInPandas(_composed, f"series {kind}, group long, {shape}")
    groups = groups.groupBy("series").applyInPandas(_scanned("group"), f"series {kind}, group long, start array<double>")
    return _beginning(blocks, groups, "block").groupBy("series", "group").applyInPandas(_scanned("block"), f"series {kind}, block long, start array<double>")


def _filled(a: np.ndarray, alpha0: np.ndarray | None, ends: bool):
    """Each row's memberships; ends: only the last one's, if the block starts anew where that depends on the memberships before."""
    high = a.max(0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now, pdf = _begun(pdf)
        pdf, out, anew = pdf.sort_values("anchor"), [], False
        for p in np.stack(pdf["p"]).astype(float):
            if now is None:
                now = p if alpha0 is None else alpha0
            else:
                now, lost = _step(now, p, a)
                anew |= lost and bool(high @ p > LOST)
            out.append(now.tolist())
        if ends:
            return pd.DataFrame({"series": pdf["series"].iloc[:1], "block": pdf["block"].iloc[:1], "now": [out[-1] if anew else None]})
        return pd.DataFrame({"series": pdf["series"], "anchor": pdf["anchor"], "alpha": out})

    return run


def forward_filter(pi: DataFrame, trans: list[list[float]], alpha0: list[float] | None = None, size: int = SIZE) -> DataFrame:
    """series, anchor, alpha of memberships (series, anchor, p) that sum to 1: alpha A (.) p, normalised, and p where the mass is lost. alpha0 stands at the first anchor instead of its p.

    Where every transition is possible no mass is ever lost. Where one isn't, blocks may start anew depending on what came before; such
    blocks get the end that they are found to have, until none changes."""
    a = np.array(trans, float)
    if alpha0 is not None:
        alpha0 = np.maximum(np.array(alpha0, float), LOST)
        alpha0 = alpha0 / alpha0.sum()
    kind, step = pi.schema["series"].dataType.simpleString(), pi.schema["anchor"].dataType.simpleString()
    rows = pi.select("series", "anchor", "p").withColumn("block", _floor(F.col("anchor"), size))
    shape = f"series {kind}, block long, r array<double>, s array<double>, e array<double>, doubt boolean, end array<double>"
    folds = rows.groupBy("series", "block").applyInPandas(_fold(a, alpha0), shape)
    while True:
        starts = _starts(folds, kind, size)
        begun = _beginning(rows, starts, "anchor").groupBy("series", "block")
        if a.min() > LOST:
            break
        folds = folds.persist()
        ends = begun.applyInPandas(_filled(a, alpha0, True), f"series {kind}, block long, now array<double>")
        now = folds.join(ends, ["series", "block"]).withColumn("now", F.when(F.col("doubt"), F.col("now"))).persist()
        if not now.where(~F.col("now").eqNullSafe(F.col("end"))).head(1):
            break
        folds = now.select("series", "block", "r", "s", "e", "doubt", F.col("now").alias("end"))
    return begun.applyInPandas(_filled(a, alpha0, False), f"series {kind}, anchor {step}, alpha array<double>")
