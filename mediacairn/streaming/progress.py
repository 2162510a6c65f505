"""Encode watch as a stream: stall, time limit and size overrun per encode.

Two stateful steps. The first gathers the lines of an encode in a minute and closes the minute by the watermark;
the second keeps one small state per encode and takes whole minutes at a time, each as one array of numbers. Needs the
RocksDB state store; see `watch_settings`. Unlike the batch form, which looks only when a line arrives, timers also find
an encode that has gone silent. Files of a feed come in the order of time; what is later than the watermark is dropped.
"""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from ..operators.progress import progress_parse, progress_windows
from ..session import importable

WATERMARK = "10 minutes"
MINUTE_MS = 60_000
SHORT = 150  # a minute of so many lines is walked line by line, a longer one by arrays: the same results, each where it is faster
FORGET_MS = 24 * 3600 * 1000  # a finished encode is remembered this long, then dropped
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALARM = "encode_id bigint, alarm string, at_ms bigint, anchor_ms bigint"
#: A minute comes as one array: the encode's values, then each value of all lines. What a row costs in Python goes by its columns.
ENCODE = ("start_ms", "timeout_s", "duration_seconds", "source_size")
LINE = ("ts_ms", "out_seconds", "frames", "ended", "out_size")


def watch_settings(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def known(value) -> bool:
    return value is not None and value == value


def unpacked(values: list) -> dict:
    """A minute by the names of its values; lists if it is short, else numpy arrays, a quarter as large."""
    at, n = len(ENCODE), (len(values) - len(ENCODE)) // len(LINE)
    m = dict(zip(ENCODE, values))
    if n > SHORT:
        values = np.asarray(values, float)
    m.update((c, values[at + i * n:at + (i + 1) * n]) for i, c in enumerate(LINE))
    return m


def filled(values: np.ndarray, before: float) -> np.ndarray:
    """Each null (NaN) takes the last value before it."""
    at = np.maximum.accumulate(np.where(~np.isnan(values), np.arange(len(values)), -1))
    return np.where(at >= 0, values[np.maximum(at, 0)], before)


def moved(x, y, ts, o, f, anchor):
    """(o, f, anchor) after lines of positions x and frames y; see operators.progress.chunk_map for why this needs no walk."""
    if not len(x) or not (x.max() > o or y.max() > f):
        return o, f, anchor
    most = [np.append(np.maximum.accumulate(v[::-1])[::-1][1:], -np.inf) for v in (x, y)]
    i = int(((x >= most[0]) & (y >= most[1])).argmax())
    return float(x[i]), float(y[i]), int(ts[i])


class EncodeWatch(StatefulProcessor):
    """State per encode: last values, the pair that last moved on and when, checkpoints used."""

    def __init__(self, stall_ms=fixed.STALL_SECONDS * 1000, threshold=fixed.BLOAT_RATIO,
                 checkpoints=tuple(fixed.BLOAT_CHECKPOINTS)):
        if stall_ms < MINUTE_MS:
            raise ValueError("a stall is a minute at least")
        self.stall_ms, self.threshold, self.checkpoints = stall_ms, threshold, checkpoints

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "encode", "out double, frames double, o double, f double, "
                      "anchor bigint, start bigint, limit_ms bigint, used int, done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        # one row per minute of the encode; minutes of a batch come in any order. Each call of the state or a timer is a
        # message to the JVM and back, and most encodes have few lines, so there are as few calls as will do
        minutes = sorted((unpacked(r["minute"]) for r in rows), key=lambda m: m["ts_ms"][0])
        before = self.state.get()
        if before is None:
            m = minutes[0]
            start = int(m["start_ms"] if known(m["start_ms"]) else m["ts_ms"][0])
            limit = int(m["timeout_s"]) * 1000 if known(m["timeout_s"]) else 0
            state, timers = [0.0, 0.0, 0.0, 0.0, start, start, limit, 0, False], []
        else:
            state = list(before)
            timers = list(self.handle.listTimers()) if state[8] else [self._wake(state)]
        alarm = None
        for m in minutes:
            if state[8]:
                break
            state, alarm = self.take(state, m)
        timer = int(minutes[-1]["ts_ms"][-1]) + FORGET_MS if state[8] else self._wake(state)
        if not state[8] and timer <= timerValues.getCurrentWatermarkInMs():  # what the timer would do later in this batch
            at, kind = self._due(*state[4:7])
            state[8], alarm, timer = True, (kind, at), at + FORGET_MS
        if before is None or tuple(state) != tuple(before):
            self.state.update(tuple(state))
        if timers != [timer]:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timer)
        if alarm:
            yield self._row(key, *alarm, state[4])

    def take(self, state, m):
        """(state after a minute, (alarm, when) or None). What comes first in time ends the watch."""
        return (self.take_lines if len(m["ts_ms"]) <= SHORT else self.take_arrays)(state, m)

    def take_lines(self, state, m):
        """`take`, line by line."""
        out, frames, o, f, anchor, start, limit, used, _ = state
        duration = m["duration_seconds"] if known(m["duration_seconds"]) else 0.0
        source = m["source_size"] if known(m["source_size"]) else 0.0
        marks = self.checkpoints if duration > 0 and source > 0 else ()
        due, kind = self._due(anchor, start, limit)
        for t, x, y, ended, size in zip(map(int, m["ts_ms"]), *(m[c] for c in LINE[1:])):
            if t > due:
                return [out, frames, o, f, anchor, start, limit, used, True], (kind, due)
            out, frames = x if known(x) else out, y if known(y) else frames
            if ended:
                out = max(out, duration)
            if out > o or frames > f:
                o, f, anchor = out, frames, t
                due, kind = self._due(anchor, start, limit)
            if used < len(marks) and out / duration >= marks[used]:
                used, done = used + 1, out / duration
                if known(size) and size > 0 and done >= 0.01 and size / done >= source * self.threshold:
                    return [out, frames, o, f, anchor, start, limit, used, True], ("bloat", t)
            if ended:
                return [out, frames, o, f, anchor, start, limit, used, True], None
        return [out, frames, o, f, anchor, start, limit, used, False], None

    def take_arrays(self, state, m):
        """`take`, over the whole minute at a time."""
        out, frames, o, f, anchor, start, limit, used, _ = state
        ts = np.asarray(m["ts_ms"], np.int64)
        x, y = filled(np.asarray(m["out_seconds"], float), out), filled(np.asarray(m["frames"], float), frames)
        size, last = np.asarray(m["out_size"], float), int(ts[-1])
        ended = np.flatnonzero(np.asarray(m["ended"], bool))
        timed = known(m["duration_seconds"]) and m["duration_seconds"] > 0
        if len(ended):
            n = int(ended[0]) + 1
            ts, x, y, size, last = ts[:n], x[:n].copy(), y[:n], size[:n], int(ts[n - 1])
            x[-1] = max(x[-1], m["duration_seconds"] if timed else 0.0)
        # line by line, and before each line: is the time up?
        moving = np.flatnonzero((x > o) | (y > f))
        due, kind = self._due(anchor, start, limit)
        if len(moving) and ts[moving[0]] <= due:  # the clock was set anew; inside a minute only the limit can run out
            due, kind = (start + limit, "timeout") if limit > 0 else (last, "")
        at = due if kind and last > due else None
        bloat = None
        if timed and known(m["source_size"]) and m["source_size"] > 0:
            ratio, i = x / m["duration_seconds"], 0
            while used < len(self.checkpoints):
                past = np.flatnonzero(ratio[i:] >= self.checkpoints[used])
                if not len(past) or at is not None and ts[i + past[0]] > at:
                    break
                i, used = i + int(past[0]) + 1, used + 1
                done = ratio[i - 1]
                if size[i - 1] > 0 and done >= 0.01 and size[i - 1] / done >= m["source_size"] * self.threshold:
                    bloat = i
                    break
        if bloat is not None:
            n, alarm = bloat, ("bloat", int(ts[bloat - 1]))
        elif at is not None:
            n, alarm = int(np.searchsorted(ts, at, side="right")), (kind, at)
        else:
            n, alarm = len(ts), None
        o, f, anchor = moved(x[:n], y[:n], ts[:n], o, f, anchor)
        if len(x):
            out, frames = float(x[-1]), float(y[-1])
        return [out, frames, o, f, anchor, start, limit, used, alarm is not None or len(ended) > 0], alarm

    def _due(self, anchor, start, limit):
        """(when the encode's time is up, why)."""
        stall = anchor + self.stall_ms
        return (start + limit, "timeout") if 0 < limit and start + limit < stall else (stall, "stall")

    def _wake(self, state):
        """A timer looks once the minute in which time is up has closed, so that all its lines are in."""
        return self._due(*state[4:7])[0] + MINUTE_MS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.state.get()
        if state is None:
            return
        if state[8]:
            self.state.clear()
            return
        at, kind = self._due(*state[4:7])
        self.state.update((*state[:8], True))
        self.handle.registerTimer(at + FORGET_MS)
        yield self._row(key, kind, at, state[4])

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, alarm, at, anchor):
        return Row(encode_id=key[0], alarm=alarm, at_ms=at, anchor_ms=anchor)


def minutes(lines: DataFrame) -> DataFrame:
    """The lines of each encode, minute by minute, in the order of time: each value of all lines, one after the other."""
    rows = progress_parse(lines.withWatermark("ts", WATERMARK)).withColumn("ts_ms", F.unix_millis("ts"))
    rows = rows.withColumn("ended", F.coalesce("ended", F.lit(False)))
    line = F.struct("ts_ms", "seq", *[F.col(c).cast("double").alias(c) for c in LINE[1:]])
    each = rows.groupBy("encode_id", F.window("ts", f"{MINUTE_MS} milliseconds")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return each.select("encode_id", F.concat(*[F.col("lines")[c].cast("array<double>") for c in LINE]).alias("minute"))


def watch(lines: DataFrame, encodes: DataFrame, **options) -> DataFrame:
    """Alarms over a stream of encode_id, ts, seq, line and out_size.

    encodes: a table of encode_id, start_ms, timeout_s, duration_seconds, source_size.
    """
    importable(lines.sparkSession)
    rows = minutes(lines).join(encodes.select("encode_id", F.array(*[F.col(c).cast("double") for c in ENCODE]).alias("encode")), "encode_id", "left")
    encode = F.coalesce("encode", F.array(*[F.lit(None).cast("double") for _ in ENCODE]))
    return rows.select("encode_id", F.concat(encode, "minute").alias("minute")).groupBy("encode_id").transformWithState(
        statefulProcessor=EncodeWatch(**options), outputStructType=ALARM,
        outputMode="Append", timeMode="EventTime")


def windows(lines: DataFrame) -> DataFrame:
    """Throughput per encode and 30 s window of a stream; late lines are dropped."""
    return progress_windows(progress_parse(lines.withWatermark("ts", WATERMARK)))
