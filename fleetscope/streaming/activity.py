"""Continuous churn and burst alerts over a stream of commit events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from fleetscope.operators.history import BURST_EVENTS, BURST_SECONDS, CHURN_DAYS


def streaming_churn(
    touches: DataFrame,
    keys: Sequence[str] = ("repo", "path"),
    ts: str = "ts",
    days: int = CHURN_DAYS,
    slide: str = "1 day",
    late: str = "1 day",
) -> DataFrame:
    """Touches per key in sliding windows; the watermark bounds the kept state."""
    return (
        touches.withWatermark(ts, late)
        .groupBy(F.window(ts, f"{days} days", slide), *keys)
        .agg(F.count(F.lit(1)).alias("changes"))
        .select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "changes")
    )


#: The state store that :func:`streaming_bursts` needs, as a session setting.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


class _Bursts(StatefulProcessor):
    """Per key a map from time slots, as long as a burst may be, to times in them, in microseconds.

    Of a slot at most ``minimum - 1`` first and as many last times are kept: a burst around a new time takes
    a run of times up to it from one side and from it on the other, so no more of a slot can count. A slot is
    dropped by its timer once the watermark leaves no event that could reach it.
    """

    def __init__(self, key: str, width: int, minimum: int) -> None:
        self.key, self.width, self.most = key, width, minimum - 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "times array<long>")

    def _bounded(self, times: list[int]) -> list[int]:
        times = sorted(times)
        return times if len(times) <= 2 * self.most else times[: self.most] + times[len(times) - self.most :]

    def _stored(self, slot: int) -> list[int]:
        return list(self.slots.getValue((slot,))[0]) if self.slots.containsKey((slot,)) else []

    def _expiry(self, slot: int) -> int:
        """Milliseconds from which on no event that still counts is within reach of the slot."""
        return (slot + 2) * self.width // 1000 + 1

    def _hit(self, time: int, times: list[int]) -> bool:
        """Whether ``time``, one of the sorted ``times``, is one of enough of them within the width."""
        at = times.index(time)
        return any(
            times[i + self.most] - times[i] <= self.width for i in range(max(0, at - self.most), min(at, len(times) - 1 - self.most) + 1)
        )

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh: dict[int, list[int]] = {}
        dense: dict[int, int] = {}  # slots with a burst of new times alone, and the newest of these
        for batch in rows:
            times = batch["event_time"].astype("datetime64[us]").astype("int64")
            for slot, group in times.groupby(times // self.width):
                held = [*fresh.get(slot, []), *group.tolist()]
                if len(held) > self.most:
                    dense[slot] = max(dense.get(slot, held[0]), max(held))
                fresh[slot] = self._bounded(held)
        near = {n: self._bounded(self._stored(n) + fresh.get(n, [])) for n in {slot + step for slot in fresh for step in (-1, 0, 1)}}
        hits = list(dense.values())
        for slot, times in fresh.items():
            around = sorted(time for step in (-1, 0, 1) for time in near[slot + step])
            hits += [time for time in times if time in around and self._hit(time, around)]
            if slot not in dense and len(near[slot]) > self.most:
                hits.append(max(times))  # the slot as a whole is a burst
        for slot in fresh:
            if self._expiry(slot) > timerValues.getCurrentWatermarkInMs():
                self.slots.updateValue((slot,), (near[slot],))
                self.handle.registerTimer(self._expiry(slot))
        if hits:
            yield pd.DataFrame({self.key: [key[0]], "burst_end": [pd.Timestamp(max(hits), unit="us")]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        for slot in [(at - 1) * 1000 // self.width - 2 + step for step in (0, 1)]:
            if self._expiry(slot) <= at and self.slots.containsKey((slot,)):
                self.slots.removeKey((slot,))
        yield from ()

    def close(self) -> None:
        pass


def streaming_bursts(
    events: DataFrame,
    key: str = "repo",
    ts: str = "ts",
    seconds: int = BURST_SECONDS,
    minimum: int = BURST_EVENTS,
    late: str = "10 minutes",
) -> DataFrame:
    """One alert row per key and micro-batch in which a new event is one of ``minimum`` within ``seconds``;
    ``burst_end`` is the newest such event.

    Exact for equal, unordered and late times, as late as ``late`` allows. The state of a key is a few times for
    each slot of ``seconds`` that the watermark can still reach, whatever the number of events. Needs the settings
    in :data:`STATE_STORE`.
    """
    if minimum < 2:
        raise ValueError("minimum must be at least 2")
    key_type = events.schema[key].dataType.simpleString()
    return (
        events.select(F.col(key), F.col(ts).cast("timestamp").alias("event_time"))
        .withWatermark("event_time", late)
        .groupBy(key)
        .transformWithStateInPandas(
            _Bursts(key, seconds * 1_000_000, minimum),
            outputStructType=f"{key} {key_type}, burst_end timestamp",
            outputMode="append",
            timeMode="eventTime",
        )
    )
