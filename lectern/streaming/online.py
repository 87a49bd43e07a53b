"""Segmentation of event streams while they come in: an extension, tested against its batch results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "user_id long, event_id long, is_change int, seg long"
_STATE = "value double, seg long"


def online_segments(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each video by gaps between events (events need a `ts` timestamp with zone)."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("peak"))


def online_islands(events: DataFrame, jump: float) -> DataFrame:
    """(user_id, event_id, is_change, seg): a segment begins where a value differs from the one before by more than `jump`.

    State is the last value and the segment's number, one small row a video. Rows of
    a micro-batch are taken in order of time; ones that come in a later batch count as later.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, seg = state.get if state.exists else (None, -1)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        before = rows["value"].shift()
        before.iloc[0] = float("nan") if last is None else last
        change = (before.isna() | ((rows["value"] - before).abs() > jump)).astype("int32")
        segs = seg + change.cumsum()
        state.update((float(rows["value"].iloc[-1]), int(segs.iloc[-1])))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "is_change": change, "seg": segs.astype("int64")})

    return events.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")
