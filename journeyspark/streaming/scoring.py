"""Streams: journeys kept per user as state, and scoring of what arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last_touch int, last_us bigint, t1 int, t2 int, t3 int, runs bigint"
OUT = "user_id bigint, ts timestamp, step1 int, step2 int, step3 int, runs bigint"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    touch, last, t1, t2, t3, runs = state.get if state.exists else (None, -1, None, None, None, 0)
    rows = pd.concat(list(batches)).sort_values(["us", "ord"])
    for us, now in zip(rows["us"].tolist(), rows["touch"].tolist(), strict=True):
        if us < last:
            continue
        last = us
        if now != touch:
            touch, t3, t2, t1, runs = now, t2, t1, now, runs + 1
    state.update((touch, last, t1, t2, t3, runs))
    if t3 is not None:
        yield pd.DataFrame({"user_id": [key[0]], "ts": [pd.Timestamp(last, unit="us")], "step1": [t1], "step2": [t2], "step3": [t3], "runs": [runs]})


def journey_stream(clicks: DataFrame) -> DataFrame:
    """From a stream of clicks, each user's newest three runs whenever they change; rows older than the user's last are late and left out."""
    rows = clicks.select("user_id", F.unix_micros("ts").alias("us"), "touch", "ord")
    return rows.groupBy("user_id").applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def session_counts(clicks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream or table, by user."""
    return clicks.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("clicks"))


def touch_counts(clicks: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return clicks.withWatermark("ts", late).groupBy(F.window("ts", window), "touch").agg(F.count("*").alias("n"))


def score_stream(rows: DataFrame, score) -> DataFrame:
    """Any stateless scoring function of a DataFrame works on a stream as it is."""
    return score(rows)
