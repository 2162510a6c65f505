"""The watched feed: what an encode costs, and long minutes against short ones."""

import random

import pytest
from pyspark.sql import functions as F

from mediacairn.streaming import progress as sp

ENCODES = "encode_id bigint, start_ms bigint, timeout_s bigint, duration_seconds double, source_size bigint"
FEED = "encode_id bigint, t_ms bigint, seq bigint, line string, out_size bigint"


class Calls:
    """A handle and a value state that keep one encode, and count the messages to the JVM."""

    def __init__(self):
        self.n, self.value, self.timers = 0, None, set()

    def getValueState(self, *_):
        return self

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "listTimers", "registerTimer", "deleteTimer"):
            self.n += 1
        return super().__getattribute__(name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def row(*lines, start=0, limit=0, duration=None, size=None):
    """A minute as the stream passes it; lines: (ts_ms, out_seconds, frames, ended, out_size)."""
    return {"minute": [start, limit, duration, size] + [v for column in zip(*lines) for v in column]}


def given(watch, clock, *rows):
    return [(r.alarm, r.at_ms, r.anchor_ms) for r in watch.handleInputRows((7,), iter(rows), Clock(clock))]


def test_an_encode_costs_few_messages_and_no_timer_round():
    handle, watch = Calls(), sp.EncodeWatch()
    watch.init(handle)
    minute = lambda n, frames: row((n * 60_000 + 5, None, frames, 0.0, None))
    # new: looked up, stored, one timer
    assert given(watch, 120_000, minute(1, 9.0), minute(0, 5.0)) == [] and handle.n == 3
    assert handle.timers == {60_005 + 300_000 + 60_000}
    # moved on: the timer is put off without a listing of timers
    assert given(watch, 240_000, minute(3, 12.0)) == [] and handle.n == 3 + 4
    assert handle.timers == {180_005 + 300_000 + 60_000}
    # says nothing new: neither stored nor another timer
    assert given(watch, 360_000, minute(5, 12.0)) == [] and handle.n == 7 + 1
    # time is up by the watermark: the alarm comes at once, once
    assert given(watch, 900_000, minute(6, 12.0)) == [("stall", 480_005, 180_005)]
    assert handle.timers == {480_005 + sp.FORGET_MS}
    assert given(watch, 960_000, minute(15, 99.0)) == [] and handle.timers == {900_005 + sp.FORGET_MS}


def test_long_minutes_end_like_short_ones(monkeypatch):
    rng = random.Random(5)
    seen = set()
    for _ in range(300):
        limit, duration, size = rng.choice([0, 0, 300, 421]), rng.choice([None, 100.0]), rng.choice([None, 100_000.0])
        rows, t, pos = [], 0, 0.0
        for minute in range(rng.randint(1, 8)):
            t, lines = max(t, minute * 60_000), []
            while t < minute * 60_000 + 60_000 and (not lines or rng.random() > .003):
                pos = max(0.0, pos + rng.choice([0, 0, 0, 1, 1, -3] + [30] * (rng.random() < .01)))
                lines.append((float(t), rng.choice([None, pos]), rng.choice([None, pos * 2]), float(rng.random() < .0005), rng.choice([None, 0.0, pos * rng.choice([500, 800, 1100])])))
                t += rng.choice([1, 5, 300, 1500])
            if lines:
                rows.append(row(*lines, limit=limit, duration=duration, size=size))
            if rng.random() < .1:
                t += rng.choice([150_000, 400_000])
        got = []
        for short in (10**9, -1, sp.SHORT):
            with monkeypatch.context() as m:
                m.setattr(sp, "SHORT", short)
                handle, watch = Calls(), sp.EncodeWatch(stall_ms=120_000)
                watch.init(handle)
                alarms = given(watch, 0, *rng.sample(rows, len(rows)))
                got.append((alarms, handle.value[2:6], handle.value[8], handle.timers))
        assert got[0] == got[1] == got[2]
        seen.add(got[0][0][0][0] if got[0][0] else None)
    assert seen == {None, "stall", "timeout", "bloat"}


@pytest.mark.parametrize("late, files", [(0, 1), (0, 2), (1, 2)])
def test_time_is_up_when_the_watermark_is_there(spark, table, tmp_path, late, files):
    """Just there or a millisecond short of it; found by a timer (a file a batch) or with the lines (two files a batch)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    sp.watch_settings(spark)
    try:
        up = 300_000 + sp.MINUTE_MS  # of an encode that starts at 0
        last = up + 600_000 - late
        for part in ([(1, 0, 0, "frame= 0", None), (3, 0, 0, "frame= 0", None), (2, 700_000, 1, "frame= 1", None)], [(2, last, 2, "frame= 2", None)]):
            (spark.createDataFrame(part, FEED).select("encode_id", F.timestamp_millis("t_ms").alias("ts"), "seq", "line", "out_size")
             .coalesce(1).write.mode("append").parquet(str(tmp_path / "in")))
        stream = spark.readStream.schema("encode_id bigint, ts timestamp, seq bigint, line string, out_size bigint").option(
            "maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
        encodes = table(ENCODES, *[(e, 0 if e != 2 else 700_000, 0, None, None) for e in (1, 2, 3)])
        name = f"up{late}{files}"
        q = (sp.watch(stream, encodes).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        q.awaitTermination()
        got = {(r.encode_id, r.alarm, r.at_ms) for r in spark.table(name).collect()}
        assert got == (set() if late else {(1, "stall", 300_000), (3, "stall", 300_000)})
    finally:
        spark.conf.set(key, before)
