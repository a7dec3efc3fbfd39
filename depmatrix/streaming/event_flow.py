"""An extension: transitions between event types kept up to date from a stream (the surveyed capability set has no streaming)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _steps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    frame = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    kinds = frame["event_type"].tolist()
    before = [last, *kinds[:-1]]
    if kinds:
        state.update((kinds[-1],))
    pairs = [(a, b, t) for a, b, t in zip(kinds, before, frame["ts"], strict=True) if b is not None and a != b]
    yield pd.DataFrame(pairs, columns=["src", "dst", "ts"])


def transitions(events: DataFrame) -> DataFrame:
    """(src, dst, ts): each user's steps, one event of state a user. Events of one batch are put in order; later batches count as later."""
    return events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(
        _steps, "src string, dst string, ts timestamp", "last string", "append", GroupStateTimeout.NoTimeout
    )


def edge_stream(events: DataFrame) -> DataFrame:
    """Running edge table, in update or complete mode: (src, dst, w)."""
    return transitions(events).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def windowed_types(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of each event type in windows of time; what comes later than `late` is left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "n")
    )
