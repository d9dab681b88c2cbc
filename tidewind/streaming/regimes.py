"""Panels and regimes over streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def panel_stream(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start (date), asset, x: the average value of each window and event type; a window is final once events are later by the given delay."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("asset")).agg(F.avg("value").alias("x"), F.count(F.lit(1)).alias("n"))
    return x.select(F.col("w.start").alias("date"), "asset", "x", "n")


def filter_stream(pi: DataFrame, trans: list[list[float]]) -> DataFrame:
    """series, anchor, alpha: the forward filter of each series (series, anchor, p) as rows come in; the last alpha is the series' state.

    Rows of a series in one batch are taken in the order of their anchors; a row that is not later than the state's anchor is dropped as late."""
    a = np.array(trans)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, now = state.get if state.exists else (None, None)
        now = None if now is None else np.array(now)
        out = []
        for r in pd.concat(list(batches)).sort_values("anchor").itertuples():
            if last is not None and r.anchor <= last:
                continue
            p = np.asarray(r.p, float)
            if now is not None:
                q = (now @ a) * p
                p = q / q.sum() if q.sum() > 1e-12 else p
            last, now = int(r.anchor), p
            out.append((key[0], last, p.tolist()))
        if now is not None:
            state.update((last, now.tolist()))
        yield pd.DataFrame(out, columns=["series", "anchor", "alpha"])

    return pi.groupBy("series").applyInPandasWithState(run, "series int, anchor int, alpha array<double>", "last int, alpha array<double>", "append", GroupStateTimeout.NoTimeout)
