import random

import pytest
from pyspark.sql import Window as W, functions as F

from mediacairn.operators import audit as au, ledger as lg, progress as pg
from mediacairn.operators.hotkeys import latest_per_key, running
from mediacairn.streaming import jobs, progress as sp, scan


def test_running_equals_plain_window_on_a_hot_key(spark):
    random.seed(3)
    rows = [("hot" if random.random() < .7 else f"k{random.randint(0, 9)}", i, random.choice([None, random.randint(0, 50)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, v int").withColumn("c", F.floor(F.col("o") / 100))
    got = running(df, ["k"], "c", ["o"], row_number="rn", sums={"s": "v"}, maxes={"m": "v", "mp": "v"}, lasts={"l": "v"}, previous_only=["mp"])
    w = W.partitionBy("k").orderBy("o")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = df.select("*", F.row_number().over(w).cast("long").alias("rn"), F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"),
                     F.max("v").over(before).alias("mp"), F.last("v", True).over(upto).alias("l"))
    cols = ["k", "o", "rn", "s", "m", "mp", "l"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    latest = latest_per_key(df, ["k"], ["o"])
    assert latest.filter("k = 'hot'").first().o == max(o for k, o, _ in rows if k == "hot")


def test_mark_refuses_wrong_path(table):
    ledger = table("id bigint, path string, status string, output_path string, actual_savings_mb double, error string, run_id bigint",
                   (1, "/a", "pending", None, None, None, 1), (2, "/b", "pending", None, None, None, 1))
    ups = table("id bigint, expected_path string, status string, output_path string, actual_savings_mb double, error string, run_id bigint",
                (1, "/a", "completed", "/o", 5.0, None, 9), (2, "/other", "failed", None, None, "x", 9), (3, None, "failed", None, None, "x", 9))
    done, rejected = lg.mark_decision(ledger, ups)
    assert [(r.id, r.status, r.run_id) for r in done.orderBy("id").collect()] == [(1, "completed", 9), (2, "pending", 1)]
    assert sorted(r.id for r in rejected.collect()) == [2, 3]


def test_orphan_marks_and_groups(table):
    names = ["Foo (2024).Remux-2160p.HEVC+H.265.mkv", "Foo (2024).Remux-2160p.AV1.REENCODE.mkv", "Foo (2024).Remux-2160p.x264.mp4",
             "Bar.AV1.REENCODE.mkv", "Foo (2024).Remux-2160p.HEVC.nfo"]
    listing = table("path string, size bigint", *[("/m/" + x, 10) for x in names], ("/@Recycle/Bar.HEVC.mkv", 1), ("/n/Bar.HEVC.mkv", 1))
    assert [(r.path, r.n_originals, r.originals_bytes) for r in au.orphan_pairs(listing).collect()] == [("/m/" + names[1], 2, 20)]
    assert sorted(r.path for r in au.orphan_originals(listing).collect()) == sorted("/m/" + x for x in (names[0], names[2]))


ENC = "encode_id bigint, start_s bigint, duration_seconds double, source_fps double, source_size bigint, timeout_s bigint"


def brute_stall(rows, start, limit=300):
    """The watchdog as it reads a feed: both remembered values change on any advance."""
    o = f = 0
    anchor = start
    for t, seq, out, frames in rows:
        if out > o or frames > f:
            o, f, anchor = out, frames, t
        if t - anchor > limit:
            return t, seq, anchor
    return None


def test_stall_follows_last_advancing_line(spark, table):
    random.seed(11)
    feeds, want = [], {}
    for e in range(40):
        t, frames, rows = 0, 0, []
        for seq in range(60):
            t += random.choice([20, 60, 90])
            frames = max(0, frames + random.choice([0, 0, 0, 0, 7, 0, 0, -5] if e % 2 else [0, 0, 0, 0, 7]))  # every second counter falls at times
            rows.append((t, seq, float(random.choice([0, 3, 5, 5, 5, 8])), frames))  # position may fall back
        feeds += [(e, *r) for r in rows]
        hit = brute_stall(rows, 0)
        if hit:
            want[e] = hit
    state = spark.createDataFrame(feeds, "encode_id bigint, t_s bigint, seq bigint, current_seconds double, frames bigint")
    encodes = table(ENC, *[(e, 0, 1.0, 24.0, 1, 0) for e in range(40)])
    for chunk in (200, 100000):
        got = {r.encode_id: (r.t_s, r.seq, r.anchor_s) for r in pg.stall_watchdog(state, encodes, chunk_seconds=chunk).collect()}
        assert got == want and 0 < len(want) < 40


def test_chunk_maps_compose_to_the_walk(spark):
    """Random chunks, many of them: the pair before each chunk is that of a walk over all lines."""
    random.seed(7)
    feeds = []
    for e in range(6):
        low = random.choice([-30, 0])
        feeds.append([(e, c, n, float(max(0, random.randint(low, 9))), max(0, random.randint(low, 9)) + (3 * c if e % 2 else 0)) for c in range(230) for n in range(random.randint(1, 4))])
    rows = [r for f in feeds for r in f]
    df = spark.createDataFrame(rows, "e int, c int, n int, o double, f int")
    line = F.struct((F.col("c") * 10 + F.col("n")).alias("t_s"), F.col("n").alias("seq"), "o", "f")
    chunks = df.groupBy("e", "c").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    maps = chunks.groupBy("e").agg(F.array_sort(F.collect_list(F.struct(F.col("c").alias("chunk"), pg.chunk_map(F.col("lines")).alias("m")))).alias("maps"))
    start = F.struct(F.lit(0.0).alias("o"), F.lit(0).alias("f"), F.lit(-1).alias("since"))
    for block in (100, 7):
        got = {(r.e, r.chunk): (r.pair.o, r.pair.f, r.pair.since) for r in maps.select("e", F.inline(pg.before_each(F.col("maps"), start, block))).collect()}
        want = {}
        for feed in feeds:
            pair = (0.0, 0, -1)
            for e, c, n, o, f in feed:
                want.setdefault((e, c), pair)
                if o > pair[0] or f > pair[1]:
                    pair = (o, f, c * 10 + n)
        assert got == want


def test_stall_in_a_feed_that_falls_at_every_second_line(spark, table):
    lines = spark.range(60_000).selectExpr("1L AS encode_id", "id AS t_s", "id AS seq", "double(if(id % 2 = 1, 0, id)) AS current_seconds", "0L AS frames")
    quiet = lines.unionByName(spark.createDataFrame([(1, 60_000 + 100 * n, 60_000 + n, 0.0, 0) for n in range(6)], lines.schema))
    got = pg.stall_watchdog(quiet, table(ENC, (1, 0, 1.0, 24.0, 1, 0))).collect()
    assert [(r.t_s, r.seq, r.anchor_s) for r in got] == [(60_300, 60_003, 59_998)]


def brute_bloat(rows, duration, size, marks=(0.1, 0.2, 0.3, 0.5), threshold=0.9):
    left = list(marks)
    for t, seq, cur, out in rows:
        ratio = cur / duration
        if not left or ratio < left[0]:
            continue
        mark = left.pop(0)
        if out > 0 and ratio >= 0.01 and out / ratio >= size * threshold:
            return t, seq, mark
    return None


def test_bloat_uses_one_checkpoint_per_line(spark, table):
    random.seed(5)
    feeds, want = [], {}
    for e in range(60):
        cur, rows = 0.0, []
        for seq in range(12):
            cur = max(0.0, cur + random.choice([1, 4, 9, 25, -6]))
            rows.append((seq * 10, seq, cur, int(cur * random.choice([500, 700, 880, 950]) if random.random() > .1 else 0)))
        feeds += [(e, *r) for r in rows]
        hit = brute_bloat(rows, 100.0, 100_000)
        if hit:
            want[e] = hit
    feed = spark.createDataFrame(feeds, "encode_id bigint, t_s bigint, seq bigint, current_seconds double, out_size bigint")
    encodes = table(ENC, *[(e, 0, 100.0, 24.0, 100_000, 0) for e in range(60)])
    got = {r.encode_id: (r.t_s, r.seq, r.checkpoint) for r in pg.bloat_projection(feed, encodes).collect()}
    assert got == want and 0 < len(want) < 60


def test_first_alarm_is_the_earliest(table):
    a = table("encode_id bigint, t_s bigint, seq bigint", (1, 500, 5), (2, 100, 1))
    b = table("encode_id bigint, t_s bigint, seq bigint", (1, 400, 4), (2, 100, 1))
    got = {r.encode_id: r.alarm for r in pg.first_alarm(("stall", a), ("timeout", b)).collect()}
    assert got == {1: "timeout", 2: "stall"}


def test_parse_lines(table):
    rows = pg.progress_parse(table("line string", ("frame=  900\n",), ("fps=58.1",), ("out_time_ms=1500000",), ("speed=2.42x",),
                                   ("out_time_ms=N/A",), ("progress=end",), ("fps=1.2.3",))).collect()
    assert [r.frames for r in rows][0] == 900 and rows[1].fps == 58.1 and rows[2].out_seconds == 1.5 and rows[3].speed == 2.42
    assert rows[4].out_seconds is None and rows[5].ended and rows[6].fps is None


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    sp.watch_settings(spark)
    yield
    spark.conf.set(key, before)


def test_stream_watch_finds_silent_slow_and_bloated(spark, table, tmp_path, rocks):
    """Encode 1 goes silent, 2 ends well, 3 flatlines, 4 passes its limit, 5 projects too large."""
    def line(e, t, text, size=None):
        return (e, t, t, text, size)
    feed = [line(1, 10, "frame= 5"), line(2, 10, "frame= 5"), line(2, 20, "progress=end")]
    feed += [line(3, t, "frame= 9") for t in range(10, 700, 50)]
    feed += [line(4, t, f"frame= {t}") for t in range(10, 700, 50)]
    feed += [line(5, 10, "out_time_ms=20000000", 19500), line(6, 5000, "frame= 1")]  # 6 moves the clock
    src = tmp_path / "in"
    for i, part in enumerate((feed, [line(6, 9000, "frame= 2")])):
        (spark.createDataFrame(part, "encode_id bigint, t bigint, seq bigint, line string, out_size bigint")
         .select("encode_id", F.timestamp_seconds("t").alias("ts"), "seq", "line", "out_size")
         .coalesce(1).write.mode("append").parquet(str(src)))
    stream = spark.readStream.schema("encode_id bigint, ts timestamp, seq bigint, line string, out_size bigint").option(
        "maxFilesPerTrigger", 1).parquet(str(src))
    encodes = table("encode_id bigint, start_ms bigint, timeout_s bigint, duration_seconds double, source_size bigint",
                    *[(e, 4900000 if e == 6 else 0, 400 if e == 4 else 0, 100.0, 100000) for e in range(1, 7)])
    q = (sp.watch(stream, encodes).writeStream.format("memory").queryName("alarms").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.encode_id, r.alarm, r.at_ms) for r in spark.table("alarms").collect() if r.encode_id != 6}
    assert got == {(1, "stall", 310000), (3, "stall", 310000), (4, "timeout", 400000), (5, "bloat", 10000)}


def walk(feed, stall, start, limit, duration, size, marks, threshold):
    """The watch line by line: (alarm, at, anchor), ended."""
    out = frames = o = f = 0
    anchor, left = start, list(marks)
    for t, x, y, end, weight in feed:
        due, kind = (start + limit, "timeout") if limit and start + limit < anchor + stall else (anchor + stall, "stall")
        if t > due:
            return (kind, due, anchor), False
        out, frames = out if x is None else x, frames if y is None else y
        if end:
            out = max(out, duration or 0)
        if out > o or frames > f:
            o, f, anchor = out, frames, t
        if duration and left and out / duration >= left[0]:
            left.pop(0)
            if weight and out / duration >= 0.01 and weight / (out / duration) >= size * threshold:
                return ("bloat", t, anchor), False
        if end:
            return None, True
    return None, False


def test_minutes_of_the_watch_are_the_walk_line_by_line():
    rng = random.Random(2)
    seen = set()
    for _ in range(1500):
        limit, duration = rng.choice([0, 0, 300_000, 421_000]), rng.choice([None, 100.0])
        t, feed, pos = 0, [], 0
        for n in range(rng.randint(1, 60)):
            t += rng.choice([500, 2000, 15_000, 55_000] if rng.random() < .97 else [90_000, 200_000])
            pos = max(0, pos + rng.choice([0, 0, 1, 1, 2, 30, -3]))
            feed.append((t, rng.choice([None, float(pos)]), rng.choice([None, None, pos * 2 + rng.choice([0, 0, 9, -9])]), rng.random() < .01, rng.choice([None, 0, int(pos * rng.choice([500, 800, 1200]))])))
        want = walk(feed, 120_000, 0, limit, duration, 100_000, (0.1, 0.2, 0.3, 0.5), 0.9)
        watch = sp.EncodeWatch(stall_ms=120_000, threshold=0.9, checkpoints=(0.1, 0.2, 0.3, 0.5))
        state, alarm = [0.0, 0.0, 0.0, 0.0, 0, 0, limit, 0, False], None
        null = lambda values: [float("nan") if v is None else v for v in values]
        for minute in sorted({r[0] // 60_000 for r in feed}):
            part = [r for r in feed if r[0] // 60_000 == minute]
            m = {"ts_ms": [r[0] for r in part], "out_seconds": null(r[1] for r in part), "frames": null(r[2] for r in part), "ended": [r[3] for r in part],
                 "out_size": null(r[4] for r in part), "first_ms": part[0][0], "last_ms": part[-1][0], "duration_seconds": duration, "source_size": 100_000}
            state, alarm = watch.take(state, m)
            if state[8]:
                break
        assert (alarm and (*alarm, state[4])) == want[0], feed
        assert state[8] == (want[0] is not None or want[1])
        seen.add(alarm and alarm[0])
    assert seen == {None, "stall", "timeout", "bloat"}


def test_streams_over_a_table_of_several_files(spark, tmp_path):
    """events.parquet as a folder of files in the order of time, read in more than one micro-batch."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for part in range(3):
        events.filter(f"event_id % 1000 >= {part * 400} AND event_id % 1000 < {part * 400 + 400}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    whole = str("/root/testdata/sf0.001")
    before, jobs.BATCH_BYTES = jobs.BATCH_BYTES, 1
    try:
        for run in (jobs.windows_over_events, jobs.latest_over_events, jobs.watch_over_events):
            got = sorted(map(str, run(spark, str(tmp_path)).collect()))
            assert got and got == sorted(map(str, run(spark, whole).collect()))
    finally:
        jobs.BATCH_BYTES = before


def test_stream_scan_merges_into_touched_partitions(spark, tmp_path):
    ddl = "path string, size bigint, ts timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    # the third batch is far behind the others: a file that only it names is not lost, an old row of /a doesn't win
    for rows in ([("/a", 1, 100000), ("/a", 1, 100000)], [("/b", 1, 100100), ("/a", 2, 100200)], [("/old", 1, 50), ("/a", 7, 60)], [("/b", 9, 100300)]):
        (spark.createDataFrame(rows, "path string, size bigint, t bigint").select("path", "size", F.timestamp_seconds("t").alias("ts"))
         .coalesce(1).write.mode("append").parquet(src))
        feed = spark.readStream.schema(ddl).parquet(src)
        q = scan.start_scan(feed, out, str(tmp_path / "state"), {"availableNow": True}, "path", ["ts", "size"], parts=32)
        q.awaitTermination()
        seen.append({str(f) for f in (tmp_path / "out").rglob("part-*.parquet")})
    assert {(r.path, r.size) for r in scan.latest(spark, out, feed.schema, "path", parts=32).collect()} == {("/a", 2), ("/b", 9), ("/old", 1)}
    # the last batch replaced the partition of /b and nothing else
    assert len(seen[3] & seen[2]) == len(seen[2]) - 1
