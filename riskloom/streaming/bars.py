"""Structured Streaming forms of the bar and evidence operators. Extensions: late data is counted as refused, not repaired."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.operators.sequential import log_e


def stream_bars(events: DataFrame, bar: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Closed bars of (event_id, ts, event_type, value) events; what comes after the watermark is refused."""
    order = F.struct("ts", "event_id")
    return (
        events.where("value > 0").withWatermark("ts", watermark)
        .groupBy(F.window("ts", bar), F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("n"))
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "n")
    )


def without_repeats(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Each (event_id) once within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def stream_evidence(returns: DataFrame, mean: float, sigma: float, tau: float, side: int) -> DataFrame:
    """(symbol, t, s, e) after each micro-batch of (symbol, r) rows: the state is a count and a sum per symbol."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, s = state.get if state.exists else (0, 0.0)
        for batch in batches:
            r = batch["r"].dropna().to_numpy(float)
            t, s = t + len(r), s + float((r - mean).sum())
        state.update((t, s))
        e = float(np.exp(log_e(np.array([s]), np.array([t * sigma**2]), tau, side))[0])
        yield pd.DataFrame({"symbol": [key[0]], "t": [t], "s": [s], "e": [e]})

    return returns.groupBy("symbol").applyInPandasWithState(
        step, "symbol string, t long, s double, e double", "t long, s double", "update", GroupStateTimeout.NoTimeout
    )
