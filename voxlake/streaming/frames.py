"""Framewise displacement and flags over a stream of realignment rows.

State is the last frame of each run, so it is bounded by the number of open runs and expires with the event
time. A flag reaches to the next frame only: the frame before is already out when a movement shows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.motion import MM_PER_DEGREE

SIX = ["x", "y", "z", "pitch", "roll", "yaw"]
OUT = "run_id long, t int, fd double, flagged int"
STATE = "t int, x double, y double, z double, pitch double, roll double, yaw double, bad int"


def flagged_stream(rows: DataFrame, threshold: float = 1.0, idle: str = "10 minutes", time_col: str = "arrived_at") -> DataFrame:
    """run_id, t, fd, flagged of a stream with run_id, t, the six parameters in mm and degrees, and a time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("t").drop_duplicates("t", keep="last")
        last = state.get if state.exists else None
        if last is not None:
            pdf = pdf[pdf["t"] > last[0]]  # frames that are late behind the state were judged already
        if not len(pdf):
            return
        v = pdf[SIX].to_numpy(float)
        before = np.vstack([v[:1] if last is None else np.array(last[1:7], float)[None], v[:-1]])
        d = np.abs(v - before)
        fd = d[:, :3].sum(1) + d[:, 3:].sum(1) * MM_PER_DEGREE
        bad = (fd > threshold).astype(int)
        after = np.r_[0 if last is None else last[7], bad[:-1]]
        state.update((int(pdf["t"].iloc[-1]), *(float(c) for c in v[-1]), int(bad[-1])))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 600_000)
        yield pd.DataFrame({"run_id": key[0], "t": pdf["t"].astype("int32"), "fd": fd, "flagged": np.maximum(bad, after).astype("int32")})

    marked = rows.withWatermark(time_col, idle)
    return marked.groupBy("run_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_quality(metrics: DataFrame, time_col: str = "arrived_at", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Readings and mean fd per time window and run, late rows taken in until the watermark."""
    from pyspark.sql import functions as F

    m = metrics.withWatermark(time_col, late)
    return m.groupBy(F.window(time_col, window), "run_id").agg(F.count("*").alias("n"), F.avg("fd").alias("fd"))
