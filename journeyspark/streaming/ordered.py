"""Journeys from a stream whose rows come out of order: rows wait until the watermark has passed them, and idle users are forgotten."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id bigint, ts timestamp, step1 int, step2 int, step3 int, runs bigint"
#: Keyed state with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"


class Journeys(StatefulProcessor):
    """Per user: pending rows by (microseconds, ord) in a map, what is settled in a value, and timers at the times that wait.

    A timer at a row's time settles all rows up to it, in order; one at the last settled row's time plus the idle limit
    clears the user, unless rows have come since.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "us bigint, ord bigint", "touch int")
        self.settled = handle.getValueState("settled", "touch int, us bigint, runs bigint, newest array<struct<us:bigint,ord:bigint,touch:int>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        waits = set()
        for r in rows:
            self.pending.updateValue((r["us"], r["ord"]), (r["touch"],))
            waits.add(-(-r["us"] // 1000))
        for ms in waits:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((k[0], k[1], v[0]) for k, v in self.pending.iterator() if k[0] <= now * 1000) if self.pending.exists() else []
        if not ready:
            if self.settled.exists() and not self.pending.exists() and now >= -(-self.settled.get()[1] // 1000) + self.idle_ms:
                self.settled.clear()
            return
        touch, last, runs, newest = self.settled.get() if self.settled.exists() else (None, -1, 0, [])
        newest = [tuple(r) for r in newest]
        for us, ord_, now_touch in ready:
            self.pending.removeKey((us, ord_))
            last = max(last, us)
            if now_touch != touch:
                touch, runs = now_touch, runs + 1
                # Of equal times the earlier row counts as the newer step.
                newest = sorted([*newest, (us, ord_, now_touch)], key=lambda r: (-r[0], r[1]))[:3]
        self.settled.update((touch, last, runs, newest))
        self.handle.registerTimer(-(-last // 1000) + self.idle_ms)
        if len(newest) == 3:
            yield Row(user_id=key[0], ts=_time(last), step1=newest[0][2], step2=newest[1][2], step3=newest[2][2], runs=runs)

    def close(self) -> None:
        pass


def _time(us: int):
    from datetime import datetime, timedelta

    return (datetime(1970, 1, 1) + timedelta(microseconds=us)).replace(tzinfo=_UTC).astimezone().replace(tzinfo=None)


def _utc():
    from datetime import timezone

    return timezone.utc


_UTC = _utc()


def ordered_journey_stream(clicks: DataFrame, late: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """From a stream of clicks (user_id, ts, touch, ord) in any order, each user's newest three runs whenever the watermark settles more of them.

    Rows wait for `late` behind the newest event time and are then taken in the order of (ts, ord), so the last row of a
    user is the batch's window, whatever the order of arrival. Rows later than that are dropped, as by any watermark. A
    user without rows for `idle_ms` of event time leaves the state; should they return, their journey starts anew.
    """
    spark = clicks.sparkSession
    if not spark.conf.get(SETTING, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(SETTING, STORE)
    rows = clicks.where("touch is not null").select("user_id", "ts", F.unix_micros("ts").alias("us"), F.col("touch").cast("int").alias("touch"), F.col("ord").cast("long").alias("ord")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithState(statefulProcessor=Journeys(idle_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
