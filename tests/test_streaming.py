"""Streaming variants on a file source, against the batch forms."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetscope.operators import history
from fleetscope.streaming.activity import STATE_STORE, _Bursts, streaming_bursts, streaming_churn

START = datetime(2026, 1, 1)


def stream_of(spark, tmp_path, batches, schema):
    source = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b={n}"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(str(source / "b=*"))


def drain(stream, name, mode, tmp_path):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@pytest.fixture(autouse=True)
def rocks(spark):
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)


def test_churn(spark, tmp_path):
    schema = "repo string, path string, ts timestamp"
    batches = [[("r", "a", START + timedelta(hours=h)) for h in range(5)], [("r", "b", START + timedelta(days=3))], [("r", "b", START + timedelta(days=90))]]
    stream = stream_of(spark, tmp_path, batches, schema)
    drain(streaming_churn(stream, days=2, slide="1 day"), "churned", "append", tmp_path)
    got = {(r.path, r.window_start.day, r.window_start.month, r.changes) for r in spark.table("churned").collect()}
    assert ("a", 1, 1, 5) in got and ("b", 3, 1, 1) in got


def test_bursts(spark, tmp_path):
    schema = "repo string, ts timestamp"
    minute = lambda m: START + timedelta(minutes=m)
    batches = [
        [("quick", minute(0)), ("quick", minute(10)), ("slow", minute(0)), ("split", minute(0))],
        [("quick", minute(29)), ("slow", minute(20)), ("split", minute(15))],
        [("slow", minute(41)), ("split", minute(30))],
    ]
    stream = stream_of(spark, tmp_path, batches, schema)
    drain(streaming_bursts(stream, late="1 hour"), "alerts", "append", tmp_path)
    alerts = {r.repo for r in spark.table("alerts").collect()}
    batch = spark.createDataFrame([row for rows in batches for row in rows], schema)
    assert alerts == {r.repo for r in history.bursts(batch).filter(F.col("burst")).collect()} == {"quick", "split"}


class Handle:
    """A state store and timers in a dictionary, for the processor alone."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getMapState(self, *_):
        return self

    def containsKey(self, key):
        return key in self.values

    def getValue(self, key):
        return self.values[key]

    def updateValue(self, key, value):
        self.values[key] = value

    def removeKey(self, key):
        del self.values[key]

    def registerTimer(self, at):
        self.timers.add(at)


class Moment:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


@pytest.mark.parametrize("minimum", [2, 3, 5])
def test_burst_state_against_brute_force(minimum):
    """Equal, late and out-of-order times: the newest new event in a burst, and few times kept."""
    rng, width, found = random.Random(minimum), 1_800_000_000, 0
    for _ in range(120):
        handle, processor = Handle(), _Bursts("repo", width, minimum)
        processor.init(handle)
        seen, newest, watermark = [], 0, 0
        spread = rng.choice([60, 4000, 30000, 90000])
        for step in range(6):
            watermark = max(watermark, newest - 3600_000_000)
            base = step * spread // 2
            fresh = [rng.randrange(max(base - spread, 0), base + spread) * 1_000_000 for _ in range(rng.choice([0, 1, 2, 9, 40]))]
            fresh = [t for t in fresh + fresh[:1] if t >= watermark]
            for at in sorted(t for t in handle.timers if t * 1000 <= watermark):
                handle.timers.remove(at)
                list(processor.handleExpiredTimer(("r",), Moment(watermark // 1000), Moment(at)))
            seen += fresh
            frames = [pd.DataFrame({"event_time": pd.to_datetime(part, unit="us")}) for part in (fresh[:3], fresh[3:]) if part]
            if not frames:
                continue
            got = [row for out in processor.handleInputRows(("r",), iter(frames), Moment(watermark // 1000)) for row in out["burst_end"]]
            times = sorted(seen)
            want = [t for t in fresh if any(a <= t <= b and b - a <= width for a, b in zip(times, times[minimum - 1 :], strict=False))]
            assert got == ([pd.Timestamp(max(want), unit="us")] if want else [])
            found += bool(want)
            newest = max(newest, *fresh)
            assert all(len(v[0]) <= 2 * (minimum - 1) for v in handle.values.values())
            assert all((slot + 2) * width >= watermark for (slot,) in handle.values)
    assert found > 40


def test_bursts_with_equal_and_late_times(spark, tmp_path):
    schema = "repo string, ts timestamp"
    minute = lambda m: START + timedelta(minutes=m)
    batches = [
        [("equal", minute(5)), ("late", minute(100)), ("back", minute(90)), ("none", minute(0))], [("equal", minute(5)), ("equal", minute(5)), ("late", minute(160))],
        [("late", minute(130)), ("back", minute(75)), ("back", minute(105)), ("none", minute(100))], [("late", minute(101)), ("none", minute(131))],
    ]
    stream = stream_of(spark, tmp_path, batches, schema)
    drain(streaming_bursts(stream, late="3 hours"), "unordered", "append", tmp_path)
    got = sorted((r.repo, r.burst_end) for r in spark.table("unordered").collect())
    batch = spark.createDataFrame([row for rows in batches for row in rows], schema)
    assert {r[0] for r in got} == {r.repo for r in history.bursts(batch).filter(F.col("burst")).collect()}
    assert got == [("back", minute(105)), ("equal", minute(5)), ("late", minute(101))]
    with pytest.raises(ValueError):
        streaming_bursts(stream, minimum=1)
