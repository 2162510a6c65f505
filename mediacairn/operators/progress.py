"""Progress feeds of encodes, batch form.

Feed rows: encode_id, t_s (seconds), seq (order inside an encode), line.
Encode rows: encode_id, start_s, duration_seconds, source_fps, source_size,
timeout_s. Long feeds are cut into time chunks; see `hotkeys.running`.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from .hotkeys import first_rows, running

CHUNK_SECONDS = 3600


def progress_parse(lines: DataFrame) -> DataFrame:
    """Add out_seconds, frames, fps, speed and ended; null where a line says nothing."""
    text = F.btrim(F.col("line"), F.lit(" \t\r\n"))

    def value(pattern):
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return (lines
            .withColumn("out_seconds", value(r"^out_time_ms=(\d+)\z").try_cast("double") / 1e6)
            .withColumn("frames", value(r"^frame=\s*(\d+)\z").try_cast("long"))
            .withColumn("fps", value(r"^fps=\s*([\d.]+)\z").try_cast("double"))
            .withColumn("speed", value(r"^speed=\s*([\d.]+)x\z").try_cast("double"))
            .withColumn("ended", text == "progress=end"))


def progress_state(parsed: DataFrame, encodes: DataFrame, chunk_seconds=CHUNK_SECONDS) -> DataFrame:
    """After each line: the last value of every field. `end` lifts the position."""
    rows = (parsed.withColumn("__chunk", F.floor(F.col("t_s") / chunk_seconds))
            .withColumn("__moves", F.when(F.col("out_seconds").isNotNull(), False)
                        .when(F.col("ended"), True)))
    rows = rows.select("encode_id", "t_s", "seq", "__chunk", "out_seconds", "frames", "fps",
                       "speed", "__moves")
    rows = running(rows, ["encode_id"], "__chunk", ["t_s", "seq"], lasts={
        "__o": "out_seconds", "__f": "frames", "__fps": "fps", "__sp": "speed", "__end": "__moves"},
        attributes=encodes.select("encode_id", "duration_seconds", "source_fps"))
    at = F.coalesce("__o", F.lit(0.0))
    return rows.select(
        "encode_id", "t_s", "seq",
        F.when(F.col("__end"), F.greatest(at, F.coalesce("duration_seconds", F.lit(0.0))))
        .otherwise(at).alias("current_seconds"),
        F.coalesce("__f", F.lit(0)).alias("frames"), F.coalesce("__fps", F.lit(0.0)).alias("fps"),
        F.coalesce("__sp", F.lit(0.0)).alias("speed"), "duration_seconds", "source_fps")


def progress_position(state: DataFrame) -> DataFrame:
    """Add `position`: muxed time or frames over source fps, whichever is ahead."""
    by_frames = F.when((F.col("source_fps") > 0) & (F.col("frames") > 0),
                       F.col("frames") / F.col("source_fps"))
    return state.withColumn("position", F.greatest("current_seconds", by_frames))


def progress_speed_eta(state: DataFrame) -> DataFrame:
    """Add position, eff_speed, fraction and eta_s (null when it cannot be known)."""
    rows = progress_position(state).withColumn("eff_speed", F.when(
        (F.col("source_fps") > 0) & (F.col("fps") > 0), F.col("fps") / F.col("source_fps"))
        .otherwise(F.col("speed")))
    left = F.col("duration_seconds") - F.col("position")
    return (rows.withColumn("fraction", F.when(
                F.col("duration_seconds") > 0, F.col("position") / F.col("duration_seconds"))
                .otherwise(F.lit(0.0)))
            .withColumn("eta_s", F.when((F.col("eff_speed") > 0) & (left > 0), left / F.col("eff_speed"))))


def passes(o, f, pair):
    """Does a line, or a chunk's largest values, move on from the remembered pair?"""
    return (o > pair["o"]) | (f > pair["f"])


def chunk_map(lines):
    """What a chunk makes of the pair (position, frames) remembered before it: struct of mo, mf, exit.

    A line moves on if it passes the pair in either value; then its own pair is remembered, even where one value fell.
    Whatever pair comes in: if no value of the chunk passes it, it stays. Else the first line that does comes no later
    than the first line that no later one passes (that line holds a maximum of all that follow), and no move jumps over
    such a line, since behind it nothing passes. So the pair that leaves is that line's, and a chunk is five numbers.
    """
    def step(acc, x):  # from the end to the start
        holds = acc["exit"].isNull() | (x["o"] >= acc["mo"]) & (x["f"] >= acc["mf"])
        return F.struct(F.greatest(acc["mo"], x["o"]).alias("mo"), F.greatest(acc["mf"], x["f"]).alias("mf"),
                        F.when(holds, x).otherwise(acc["exit"]).alias("exit"))
    line = F.element_at(lines, 1)
    none = F.when(F.lit(False), line)
    return F.aggregate(F.reverse(lines), F.struct(none["o"].alias("mo"), none["f"].alias("mf"), none.alias("exit")), step)


def composed(a, b):
    """The map of chunk a followed by chunk b."""
    holds = (a["exit"]["o"] >= b["mo"]) & (a["exit"]["f"] >= b["mf"])
    return F.struct(F.greatest(a["mo"], b["mo"]).alias("mo"), F.greatest(a["mf"], b["mf"]).alias("mf"),
                    F.when(holds, a["exit"]).otherwise(b["exit"]).alias("exit"))


def after(m, pair):
    """The pair (o, f, since) that a chunk leaves behind."""
    e = m["exit"]
    return F.when(passes(m["mo"], m["mf"], pair), F.struct(e["o"].alias("o"), e["f"].alias("f"), e["t_s"].alias("since"))).otherwise(pair)


def before_each(maps, pair, block=100):
    """(chunk, pair before it) of an array of (chunk, m): composed over blocks first, then chunk by chunk in each block."""
    def scan(items, m_of, start):
        def step(acc, x):
            return F.struct(after(m_of(x), acc["pair"]).alias("pair"),
                            F.array_append(acc["found"], F.struct(x.alias("x"), acc["pair"].alias("pair"))).alias("found"))
        none = F.filter(F.transform(items, lambda x: F.struct(x.alias("x"), start.alias("pair"))), lambda _: F.lit(False))
        return F.aggregate(items, F.struct(start.alias("pair"), none.alias("found")), step)["found"]

    def whole(parts):
        return F.aggregate(F.slice(parts, 2, block), F.element_at(parts, 1)["m"], lambda acc, x: composed(acc, x["m"]))
    blocks = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(maps) - 1) / block).cast("int")),
                         lambda i: F.slice(maps, i * block + 1, F.lit(block)))
    outer = scan(blocks, whole, pair)
    return F.flatten(F.transform(outer, lambda b: F.transform(
        scan(b["x"], lambda c: c["m"], b["pair"]), lambda c: F.struct(c["x"]["chunk"].alias("chunk"), c["pair"].alias("pair")))))


def stall_watchdog(state: DataFrame, encodes: DataFrame, stall_seconds=fixed.STALL_SECONDS,
                   chunk_seconds=CHUNK_SECONDS) -> DataFrame:
    """First stall alarm per encode: a line more than stall_seconds after the last one that moved on.

    Checked when a line arrives, as the feed is read; the clock starts with the encode, and both values may fall. Lines
    are gathered per (encode, chunk of time) and reduced to the chunk's map; only maps meet per encode, and the pair
    before each chunk goes back to where its lines are. So a feed is exchanged once and walked in chunks side by side.
    """
    kinds = dict(state.dtypes)
    zero = F.lit(0)
    line = F.struct("t_s", "seq", F.coalesce("current_seconds", zero.cast(kinds["current_seconds"])).alias("o"),
                    F.coalesce("frames", zero.cast(kinds["frames"])).alias("f"))
    # nothing is null here, so that no filter is inferred for one reader of the chunks only
    chunk = F.coalesce(F.floor(F.col("t_s") / chunk_seconds), F.lit(0)).alias("chunk")
    chunks = state.filter("encode_id IS NOT NULL").groupBy("encode_id", chunk).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    maps = chunks.groupBy("encode_id").agg(F.array_sort(F.collect_list(F.struct("chunk", chunk_map(F.col("lines")).alias("m")))).alias("maps"))
    start = F.struct(zero.cast(kinds["current_seconds"]).alias("o"), zero.cast(kinds["frames"]).alias("f"), F.col("start_s").cast(kinds["t_s"]).alias("since"))
    carried = maps.join(encodes.select("encode_id", "start_s"), "encode_id").select("encode_id", F.inline(before_each(F.col("maps"), start)))

    def step(acc, x):
        moves = passes(x["o"], x["f"], acc["pair"])
        pair = F.when(moves, F.struct(x["o"].alias("o"), x["f"].alias("f"), x["t_s"].alias("since"))).otherwise(acc["pair"])
        late = acc["alarm"].isNull() & ~moves & (x["t_s"] - acc["pair"]["since"] > stall_seconds)
        found = F.struct(x["t_s"].alias("t_s"), x["seq"].alias("seq"), acc["pair"]["since"].alias("anchor_s"))
        return F.struct(pair.alias("pair"), F.when(late, found).otherwise(acc["alarm"]).alias("alarm"))
    none = F.lit(None).cast(f"struct<t_s:{kinds['t_s']},seq:{kinds['seq']},anchor_s:{kinds['t_s']}>")
    alarm = F.aggregate("lines", F.struct(F.col("pair"), none.alias("alarm")), step)["alarm"]
    return (chunks.join(carried, ["encode_id", "chunk"]).select("encode_id", alarm.alias("alarm")).filter("alarm IS NOT NULL")
            .groupBy("encode_id").agg(F.min("alarm").alias("a")).select("encode_id", "a.t_s", "a.seq", "a.anchor_s"))


def encode_deadline(feed: DataFrame, encodes: DataFrame) -> DataFrame:
    """First line after the time limit, per encode with a limit."""
    limits = encodes.filter("timeout_s > 0").select("encode_id", "start_s", "timeout_s")
    return (feed.join(limits, "encode_id")
            .filter(F.col("t_s") - F.col("start_s") > F.col("timeout_s"))
            .groupBy("encode_id").agg(F.min(F.struct("t_s", "seq")).alias("a"))
            .select("encode_id", "a.t_s", "a.seq"))


def bloat_projection(feed: DataFrame, encodes: DataFrame, checkpoints=None,
                     threshold=fixed.BLOAT_RATIO) -> DataFrame:
    """First size-overrun alarm per encode.

    feed: encode_id, t_s, seq, current_seconds, out_size. A line at or past the
    next checkpoint uses it up, one per line even if several were passed.
    Checkpoint j goes to one of the first j lines at or past it, so those few
    lines per encode are all that is gathered; each task cuts to them before
    the shuffle.
    """
    marks = sorted(c for c in (checkpoints or fixed.BLOAT_CHECKPOINTS) if 0 < c < 1)
    known = encodes.filter("duration_seconds > 0 AND source_size > 0").select(
        "encode_id", "duration_seconds", "source_size")
    rows = (feed.join(known, "encode_id")
            .withColumn("ratio", F.col("current_seconds") / F.col("duration_seconds"))
            .filter(F.col("ratio") >= marks[0]))
    rows = rows.select("encode_id", "t_s", "seq", "ratio", "out_size", "source_size", F.explode(
        F.filter(F.array(*[F.when(F.col("ratio") >= m, F.lit(i + 1)) for i, m in enumerate(marks)]),
                 lambda x: x.isNotNull())).alias("mark"))
    few = first_rows(rows, ["encode_id", "mark"], ["t_s", "seq"], len(marks))
    line = F.struct("t_s", "seq", "ratio", "out_size", "source_size")
    lines = few.groupBy("encode_id").agg(F.array_sort(F.collect_set(line)).alias("lines"))
    mark_list = F.array(*[F.lit(float(m)) for m in marks])

    def step(acc, ev):
        used, alarm = acc["used"], acc["alarm"]
        due = alarm.isNull() & (used < len(marks)) & (ev["ratio"] >= F.get(mark_list, used))
        judged = due & (ev["ratio"] >= 0.01) & (F.coalesce(ev["out_size"], F.lit(0)) > 0)
        over = judged & (ev["out_size"] / ev["ratio"] >= ev["source_size"] * threshold)
        hit = F.struct(ev["t_s"].alias("t_s"), ev["seq"].alias("seq"),
                       F.get(mark_list, used).alias("checkpoint"),
                       (ev["out_size"] / ev["ratio"]).alias("projected_size"))
        return F.struct((used + F.when(due, 1).otherwise(0)).alias("used"),
                        F.when(over, hit).otherwise(alarm).alias("alarm"))
    kinds = dict(feed.dtypes)
    zero = F.struct(F.lit(0).alias("used"), F.lit(None).cast(
        f"struct<t_s:{kinds['t_s']},seq:{kinds['seq']},checkpoint:double,projected_size:double>").alias("alarm"))
    return (lines.withColumn("a", F.aggregate("lines", zero, step)["alarm"])
            .filter(F.col("a").isNotNull())
            .select("encode_id", "a.t_s", "a.seq", "a.checkpoint", "a.projected_size"))


def first_alarm(*alarms) -> DataFrame:
    """Earliest alarm per encode. Pass (name, DataFrame) in the order they are checked."""
    rows = None
    for place, (name, df) in enumerate(alarms):
        part = df.select("encode_id", F.col("t_s").cast("double").alias("t_s"),
                         F.col("seq").cast("long").alias("seq"),
                         F.lit(place).alias("__place"), F.lit(name).alias("alarm"))
        rows = part if rows is None else rows.unionByName(part)
    return (rows.groupBy("encode_id").agg(F.min(F.struct("t_s", "seq", "__place", "alarm")).alias("a"))
            .select("encode_id", "a.t_s", "a.seq", "a.alarm"))


def progress_windows(parsed: DataFrame, ts="ts", width="30 seconds") -> DataFrame:
    """Largest value of each field per encode and tumbling window. Batch or stream."""
    return (parsed.groupBy("encode_id", F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("frames").alias("frames"),
        F.max("out_seconds").alias("out_seconds"), F.max("fps").alias("fps"),
        F.max("speed").alias("speed"))
        .select("encode_id", F.col("w.start").alias("window_start"), "n_lines", "frames",
                "out_seconds", "fps", "speed"))
