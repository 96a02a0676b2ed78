"""Streaming forms: event counts and hopping sums with watermarks, and the rolling reference as a stateful operator."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gausstide.operators.references import RollingReference


def stream_counts(events: DataFrame, ts: str, key: str, late: str = "2 hours", unit: str = "1 hour") -> DataFrame:
    """(ts, k, n) per unit and key of a stream; records later than ``late`` are dropped, a unit is emitted once it is closed."""
    rows = events.select(F.col(ts).cast("timestamp").alias("at"), F.col(key).cast("string").alias("k")).dropna().withWatermark("at", late)
    return rows.groupBy(F.window("at", unit), "k").agg(F.count("*").alias("n")).select(F.col("window.start").alias("ts"), "k", "n")


def stream_hopping_counts(events: DataFrame, ts: str, key: str, window: str, step: str, late: str = "2 hours") -> DataFrame:
    """(start, end, k, n) of hopping windows. Windows that begin before the first record are partial: keep those from the first full start on."""
    rows = events.select(F.col(ts).cast("timestamp").alias("at"), F.col(key).cast("string").alias("k")).dropna().withWatermark("at", late)
    return rows.groupBy(F.window("at", window, step), "k").agg(F.count("*").alias("n")).select("window.start", "window.end", "k", "n")


def stream_references(states: DataFrame, length: int, refresh: int = 1, warm: int = 3, threshold: float = 1e-4) -> DataFrame:
    """(series, t, reference ...) of a stream of states (series, t, mean, cov).

    The state of a series is its last window and reference. States of a series must arrive in order of t without gaps
    from batch to batch; inside a batch they are sorted. A step back or a gap is an error.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, rolling = pickle.loads(state.get[0]) if state.exists else ([], RollingReference(length, refresh, warm, threshold))
        rows = pd.concat(list(frames)).sort_values("t")
        out = []
        for r in rows.itertuples():
            if held and r.t != held[-1][0] + 1:
                raise ValueError(f"series {key[0]}: step {r.t} after {held[-1][0]}")
            mean = np.asarray(r.mean)
            held = [*held, (int(r.t), mean, np.asarray(r.cov).reshape(len(mean), -1))][-length:]
            if len(held) == length:
                out.append({"series": key[0], **rolling.at(int(r.t), np.stack([h[1] for h in held]), np.stack([h[2] for h in held]))})
        state.update((pickle.dumps((held, rolling)),))
        if out:
            yield pd.DataFrame(out)

    kinds = "series string, t int, ref_mean array<double>, ref_cov array<double>, residual double, refreshed boolean, fallback boolean"
    return states.groupBy("series").applyInPandasWithState(run, kinds, "held binary", "append", GroupStateTimeout.NoTimeout)
