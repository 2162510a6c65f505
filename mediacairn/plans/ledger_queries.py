"""Ledger, report, audit and progress queries."""

import uuid

from pyspark.sql import functions as F

from ..functions import fixed, outcomes as oc
from ..operators import audit as au, ledger as lg, progress as pg
from ..operators.hotkeys import running
from ..session import shared_dir
from ..sources import reports
from ..streaming import jobs
from .planning_queries import CODEC, FIRM, FLAGS, GATE_NEEDS, SAVED, gate_sql
from .registry import query

D = "fx_decisions"


def _ledger(t):
    return t.get("fx_decisions")


CLASS = ("CASE WHEN status = 'completed' AND coalesce(output_path, '') <> '' THEN 'ok' WHEN status = 'failed' THEN 'fail' "
         "WHEN status = 'skipped' THEN 'skip' WHEN status = 'pending' THEN 'dry' ELSE 'other' END")
TOKEN = ("CASE WHEN error IS NULL THEN 'ffmpeg_failed' "
         + " ".join(f"WHEN lower(error) LIKE '%{a}%' THEN '{b}'" for a, b in fixed.ERROR_TOKENS)
         + " ELSE 'ffmpeg_failed' END")

# updates by arithmetic: half name an id that exists, some name the wrong path, some skip the check
UPDATES = """SELECT d.id * 2 AS id, CASE WHEN d.id % 5 = 0 THEN 'elsewhere' WHEN d.id % 5 = 1 THEN NULL ELSE x.path END AS expected_path,
  'completed' AS status, concat('/new/', d.id) AS output_path, d.id AS actual_savings_mb, CAST(NULL AS STRING) AS error,
  CASE WHEN d.id % 3 = 0 THEN NULL ELSE CAST(900 AS BIGINT) END AS run_id
FROM {fx_decisions} d LEFT JOIN {fx_decisions} x ON x.id = d.id * 2"""
U = UPDATES.format(fx_decisions="fx_decisions")


def _updates(t):
    return t.spark.sql(UPDATES, fx_decisions=_ledger(t))


HIT = "(u.expected_path IS NULL OR u.expected_path = d.path)"


@query("mark_decision", D, f"""
, u AS ({U}) SELECT d.id, CASE WHEN u.id IS NULL THEN d.status ELSE u.status END AS status,
  CASE WHEN u.id IS NULL THEN d.output_path ELSE u.output_path END AS output_path,
  CASE WHEN u.id IS NULL THEN d.actual_savings_mb ELSE u.actual_savings_mb END AS actual_savings_mb,
  coalesce(u.run_id, d.run_id) AS run_id, FALSE AS rejected FROM fx_decisions d LEFT JOIN u ON u.id = d.id AND {HIT}
UNION ALL SELECT u.id, u.status, u.output_path, u.actual_savings_mb, u.run_id, TRUE FROM u
WHERE NOT EXISTS (SELECT 1 FROM fx_decisions d WHERE d.id = u.id AND {HIT})""")
def mark_decision(t):
    return lg.marked(_ledger(t), _updates(t)).select(
        "id", "status", "output_path", "actual_savings_mb", "run_id", "rejected")


@query("stamp_run", D, f"""
, u AS ({U}) SELECT d.id, d.status, coalesce(u.run_id, d.run_id) AS run_id FROM fx_decisions d
LEFT JOIN u ON u.id = d.id AND {HIT} AND u.run_id IS NOT NULL""")
def stamp_run(t):
    return lg.stamp_run(_ledger(t), _updates(t).select("id", "expected_path", "run_id"))[0].select("id", "status", "run_id")


EVENTS = "SELECT CAST(floor(id / 3) AS BIGINT) AS id, path, status, run_id, id AS event_at FROM {fx_decisions}"


@query("decisions_latest", D, f"""
SELECT id, path, status, run_id, event_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_at DESC) AS rn
  FROM ({EVENTS.format(fx_decisions='fx_decisions')}) e) q WHERE rn = 1""")
def decisions_latest(t):
    return lg.decisions_latest(t.spark.sql(EVENTS, fx_decisions=_ledger(t)))


@query("decisions_for_run", D, """
SELECT id, path, status, output_path, actual_savings_mb, error FROM fx_decisions WHERE run_id = 7
ORDER BY coalesce(actual_savings_mb, -1) DESC, id""")
def decisions_for_run(t):
    return lg.decisions_for_run(_ledger(t), 7)


def _runs(t):
    return t.get("fx_runs")


@query("get_run", "fx_runs", "SELECT run_id, started_at, ended_at, applied FROM fx_runs WHERE run_id = 7")
def get_run(t):
    return lg.get_run(_runs(t), 7).select("run_id", "started_at", "ended_at", "applied")


@query("recent_runs", "fx_runs", """
SELECT run_id, started_at, ended_at - started_at AS duration_s FROM fx_runs ORDER BY started_at DESC, run_id DESC LIMIT 10""")
def recent_runs(t):
    return lg.recent_runs(_runs(t), 10).select("run_id", "started_at", "duration_s")


@query("run_lifecycle", "fx_runs", """
SELECT run_id, 'apply' AS kind, concat('/lib', run_id % 4) AS root, CAST(run_id AS VARCHAR) AS arg_limit, started_at, CASE WHEN run_id % 4 <> 0 THEN ended_at END AS ended_at,
  CASE WHEN run_id % 4 <> 0 THEN applied END AS applied FROM fx_runs""")
def run_lifecycle(t):
    """Start and end events to one row per run; every fourth run never ended."""
    none, text = F.lit(None).cast("map<string,bigint>"), F.lit(None).cast("string")
    run_id = F.col("run_id").cast("string")
    start = _runs(t).select("run_id", F.lit("start").alias("event"), F.lit("apply").alias("kind"),
                            F.col("started_at").alias("at"), none.alias("summary"),
                            F.concat(F.lit("/lib"), F.col("run_id") % 4).alias("root"), F.create_map(F.lit("limit"), run_id).alias("args"))
    ends = F.when(F.col("run_id") % 4 == 0, "lost").otherwise("end")
    end = _runs(t).select("run_id", ends.alias("event"), F.lit(None).cast("string").alias("kind"),
                          F.col("ended_at").alias("at"), F.create_map(F.lit("applied"), "applied").alias("summary"),
                          text.alias("root"), F.lit(None).cast("map<string,string>").alias("args"))
    rows = lg.run_lifecycle(start.unionByName(end))
    return rows.select("run_id", "kind", "root", F.col("args")["limit"].alias("arg_limit"), "started_at", "ended_at",
                       F.col("summary")["applied"].alias("applied"))


@query("latest_run_completed", "fx_runs fx_decisions", """
SELECT r.run_id FROM fx_runs r WHERE r.run_id IN (SELECT run_id FROM fx_decisions WHERE status = 'completed')
ORDER BY started_at DESC, run_id DESC LIMIT 1""")
def latest_run_completed(t):
    return lg.latest_run_completed(_runs(t), _ledger(t))


@query("replace_list", D, """
SELECT path, count(*) AS fails, max(decided_at) AS last_failed_at FROM fx_decisions
WHERE status = 'failed' AND error ILIKE '%encoder stalled%' GROUP BY path HAVING count(*) >= 2""")
def replace_list(t):
    return lg.replace_list(_ledger(t))


@query("error_token", D, f"SELECT id, {TOKEN} AS token FROM fx_decisions")
def error_token(t):
    return _ledger(t).select("id", oc.error_token(F.col("error")).alias("token"))


@query("classify_decision", D, f"SELECT id, {CLASS} AS class FROM fx_decisions")
def classify_decision(t):
    return lg.with_class(_ledger(t)).select("id", "class")


@query("run_report", D, f"""
SELECT run_id, count(*) FILTER (WHERE c = 'ok') AS encoded, count(*) FILTER (WHERE c = 'fail') AS failed,
  count(*) FILTER (WHERE c = 'skip') AS skipped, count(*) FILTER (WHERE c = 'dry') AS dry_run,
  CAST(coalesce(sum(actual_savings_mb) FILTER (WHERE c = 'ok'), 0) AS BIGINT) AS saved_mb
FROM (SELECT *, {CLASS} AS c FROM fx_decisions) q GROUP BY run_id""")
def run_report(t):
    return lg.run_report(_ledger(t))


LINE = f"""CASE {CLASS} WHEN 'ok' THEN concat('OK', chr(9), coalesce(actual_savings_mb, 0), chr(9), output_path, chr(9), path)
  WHEN 'fail' THEN concat('FAIL', chr(9), {TOKEN}, chr(9), path) WHEN 'skip' THEN concat('SKIP', chr(9), {TOKEN}, chr(9), path)
  ELSE concat('DRY', chr(9), 'dry-run', chr(9), path) END"""


SECTION = f"CASE {CLASS} WHEN 'ok' THEN 0 WHEN 'fail' THEN 1 WHEN 'skip' THEN 2 ELSE 3 END"


@query("write_run_report", D, f"""
SELECT run_id, {LINE} AS line, row_number() OVER (PARTITION BY run_id ORDER BY {SECTION}, coalesce(actual_savings_mb, -1) DESC, id) AS place
FROM fx_decisions WHERE {CLASS} <> 'other'""")
def write_run_report(t):
    """Write the text reports, one directory per run, and read them back with the place of every line."""
    where = f"{shared_dir(t.spark)}/report-{uuid.uuid4().hex}"
    reports.write_run_report(_ledger(t), where)
    lines = t.spark.read.schema("value string, run_id bigint").text(where).select(
        "run_id", F.col("value").alias("line"), "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    rows = running(lines, ["run_id"], "file_name", ["file_name", "file_block_start", "at"], row_number="place")
    return rows.select("run_id", "line", "place")


TOKENS = sorted({b for _, b in fixed.ERROR_TOKENS} | {fixed.ERROR_TOKEN_DEFAULT})


@query("failure_breakdown", D, "SELECT run_id, " + ", ".join(
    f"count(*) FILTER (WHERE token = '{x}') AS {x}" for x in TOKENS)
    + f" FROM (SELECT run_id, {TOKEN} AS token FROM fx_decisions WHERE status = 'failed') q GROUP BY run_id")
def failure_breakdown(t):
    return lg.failure_breakdown(_ledger(t))


@query("pending_status", D, """
SELECT id, path, projected_savings_mb, (SELECT count(*) FROM fx_decisions WHERE status = 'pending') AS n_pending
FROM fx_decisions WHERE status = 'pending' ORDER BY coalesce(projected_savings_mb, 0) DESC, id LIMIT 10""")
def pending_status(t):
    return lg.pending_status(_ledger(t), 10).select("id", "path", "projected_savings_mb", "n_pending")


OUTPUTS = """SELECT concat(dir, '/t', CAST(k AS STRING), '.AV1.REENCODE.mkv') AS path, k % 11 <> 0 AS parsed, k % 13 <> 0 AS has_video,
  duration_seconds * (90 + k % 17) / CAST(100 AS DOUBLE) AS duration_seconds,
  CASE WHEN k % 9 = 0 THEN size + 5 WHEN k % 9 = 1 THEN NULL ELSE CAST(floor(size / 3) AS BIGINT) END AS size
FROM {fx_probes} WHERE NOT (st = 'P' AND prio = '5-LOW')"""


@query("validate_outputs", "fx_probes fx_decisions", f"""
, o AS ({OUTPUTS.format(fx_probes='fx_probes')}),
j AS (SELECT d.id, CASE WHEN o.path IS NULL OR NOT o.parsed THEN 'unreadable output' WHEN NOT o.has_video THEN 'no video stream'
  WHEN p.duration_seconds <= 0 THEN NULL
  WHEN o.duration_seconds / p.duration_seconds < 95e-2 OR o.duration_seconds / p.duration_seconds > 105e-2 THEN 'duration mismatch'
  WHEN o.size IS NULL THEN 'no output size' WHEN o.size >= p.size THEN 'output not smaller' END AS reason, p.size AS ps, o.size AS os
  FROM fx_decisions d JOIN fx_probes p ON p.path = d.path LEFT JOIN o ON o.path = d.output_path WHERE d.status = 'completed')
SELECT id, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN (ps - coalesce(os, 0)) / 1048576e0 END AS saved_mb FROM j""")
def validate_outputs(t):
    outputs = t.spark.sql(OUTPUTS, fx_probes=t.probes())
    jobs_done = _ledger(t).filter("status = 'completed'")
    return lg.validate_outputs(jobs_done, t.probes(), outputs).select("id", "valid", "reason", "saved_mb")


@query("actual_savings", "fx_probes fx_listing", """
SELECT p.path, (p.size - l.size) / 1048576e0 AS saved_mb FROM fx_probes p
JOIN fx_listing l ON l.path = concat(p.dir, '/t', p.k, '.AV1.REENCODE.mkv') AND p.name LIKE '%.HEVC.mkv'""")
def actual_savings(t):
    out = t.get("fx_listing").select(F.col("path").alias("__o"), F.col("size").alias("out_size"))
    sources = t.probes().filter(F.col("name").endswith(".HEVC.mkv")).withColumn(
        "__w", F.concat("dir", F.lit("/t"), F.col("k").cast("string"), F.lit(".AV1.REENCODE.mkv")))
    return sources.join(out, F.col("__w") == F.col("__o")).select(
        "path", lg.actual_savings(F.col("size"), F.col("out_size")).alias("saved_mb"))


@query("bloat_after_encode", "fx_probes", """
SELECT path, height >= 1440 AND quality < 21 AND NOT retried AND output_size >= size * 9e-1 AS bloated
FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 21 ELSE 15 END AS quality, k % 10 = 3 AS retried,
  CAST(floor(size * (80 + k % 20) / 100) AS BIGINT) AS output_size FROM fx_probes) q""")
def bloat_after_encode(t):
    rows = t.probes().selectExpr(
        "path", "height", "CASE WHEN k % 4 = 0 THEN 21 ELSE 15 END AS quality", "k % 10 = 3 AS retried",
        "size AS input_size", "CAST(floor(size * (80 + k % 20) / 100) AS BIGINT) AS output_size")
    return lg.bloat_after_encode(rows).select("path", "bloated")


GUARD = """
SELECT d.id, d.run_id, CASE WHEN d.output_path IS NULL THEN 'no output_path recorded' WHEN d.output_path = d.path THEN 'output_path == source_path'
  WHEN o.path IS NULL THEN 'output missing' WHEN o.size <= 0 THEN 'output zero-byte' WHEN s.path IS NULL THEN 'source already removed' END AS reason, s.size AS ssize
FROM fx_decisions d LEFT JOIN fx_listing o ON o.path = d.output_path LEFT JOIN fx_listing s ON s.path = d.path WHERE d.status = 'completed'"""


@query("cleanup_guard", "fx_decisions fx_listing",
       f"SELECT id, reason, CASE WHEN reason IS NULL THEN ssize ELSE 0 END AS source_size FROM ({GUARD}) g")
def cleanup_guard(t):
    return lg.cleanup_guard(_ledger(t), t.get("fx_listing")).select("id", "reason", "source_size")


@query("cleanup_summary", "fx_decisions fx_listing fx_runs", f"""
SELECT run_id, count(*) FILTER (WHERE reason IS NULL) AS cleanable, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped,
  CAST(sum(CASE WHEN reason IS NULL THEN ssize ELSE 0 END) AS BIGINT) AS reclaimable_bytes FROM ({GUARD}) g
WHERE run_id = (SELECT r.run_id FROM fx_runs r WHERE r.run_id IN (SELECT run_id FROM fx_decisions WHERE status = 'completed')
  ORDER BY started_at DESC, run_id DESC LIMIT 1) GROUP BY run_id""")
def cleanup_summary(t):
    return lg.cleanup_summary(_ledger(t), t.get("fx_listing"), _runs(t))


ORPHANS = r""", f AS (SELECT path, size, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS name FROM fx_listing),
a AS (SELECT *, replace(name, '.AV1.REENCODE.mkv', '') AS release_stem FROM f WHERE name LIKE '%.AV1.REENCODE.mkv'),
b AS (SELECT *, replace(name, '.HEVC.mkv', '') AS release_stem FROM f WHERE name LIKE '%.HEVC.mkv')
"""


@query("orphan_pairs", "fx_listing", ORPHANS + """
SELECT a.path, count(*) AS n_originals, CAST(sum(b.size) AS BIGINT) AS originals_bytes FROM a JOIN b ON b.dir = a.dir AND b.release_stem = a.release_stem GROUP BY a.path""")
def orphan_pairs(t):
    return au.orphan_pairs(t.get("fx_listing")).select("path", "n_originals", "originals_bytes")


@query("orphan_originals", "fx_listing", ORPHANS + """
SELECT b.path, b.size, count(*) AS n_outputs FROM a JOIN b ON b.dir = a.dir AND b.release_stem = a.release_stem GROUP BY b.path, b.size""")
def orphan_originals(t):
    return au.orphan_originals(t.get("fx_listing")).select("path", "size", "n_outputs")


@query("orphan_totals", "fx_listing", ORPHANS + """
SELECT count(DISTINCT a.path) AS pairs, count(*) AS pair_originals, CAST(sum(b.size) AS BIGINT) AS pair_bytes,
  count(DISTINCT b.path) AS distinct_originals,
  (SELECT CAST(sum(size) AS BIGINT) FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.dir = b.dir AND a.release_stem = b.release_stem)) AS distinct_bytes
FROM a JOIN b ON b.dir = a.dir AND b.release_stem = a.release_stem""")
def orphan_totals(t):
    return au.orphan_totals(t.get("fx_listing"))


@query("ledger_reconcile", "fx_decisions fx_runs", """
SELECT coalesce(r.run_id, l.run_id) AS run_id, r.applied, r.failed, l.a AS ledger_applied, l.f AS ledger_failed,
  coalesce(r.applied, 0) = coalesce(l.a, 0) AND coalesce(r.failed, 0) = coalesce(l.f, 0) AND coalesce(r.skipped, 0) = coalesce(l.s, 0) AS agrees
FROM fx_runs r FULL JOIN (SELECT run_id, count(*) FILTER (WHERE status = 'completed') AS a, count(*) FILTER (WHERE status = 'failed') AS f,
  count(*) FILTER (WHERE status = 'skipped') AS s FROM fx_decisions GROUP BY run_id) l ON l.run_id = r.run_id""")
def ledger_reconcile(t):
    return lg.ledger_reconcile(_ledger(t), _runs(t)).select(
        "run_id", "applied", "failed", "ledger_applied", "ledger_failed", "agrees")


@query("library_audit", GATE_NEEDS, f"""
SELECT GROUPING(codec, tier) AS level, codec, tier, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE gate <> 'ok') AS skipped, count(*) FILTER (WHERE gate = 'ok' AND firm <> '') AS candidates,
  CAST(floor(coalesce(sum(saved) FILTER (WHERE gate = 'ok' AND firm <> ''), 0)) AS BIGINT) AS savings_mb
FROM (SELECT {CODEC} AS codec, CASE WHEN height >= 1440 THEN 'UHD' WHEN height >= 720 THEN 'HD' ELSE 'SD' END AS tier,
  size, gate, {FIRM} AS firm, {SAVED} AS saved FROM ({gate_sql()}) g) q GROUP BY CUBE (codec, tier)""")
def library_audit(t):
    rows = au.library_audit(t.probes(), t.get("fx_listing"), _ledger(t), **FLAGS)
    return rows.withColumn("savings_mb", F.floor("savings_mb"))


@query("audit_histogram", "fx_probes", f"""
SELECT {CODEC} AS codec, CASE WHEN height >= 1440 THEN 'UHD' WHEN height >= 720 THEN 'HD' ELSE 'SD' END AS tier,
  CASE WHEN mb >= 50000 THEN 50000 WHEN mb >= 20000 THEN 20000 WHEN mb >= 10000 THEN 10000 WHEN mb >= 5000 THEN 5000 WHEN mb >= 2000 THEN 2000
    WHEN mb >= 1000 THEN 1000 WHEN mb >= 500 THEN 500 WHEN mb >= 100 THEN 100 ELSE 0 END AS from_mb, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
FROM (SELECT *, size / 1048576e0 AS mb FROM fx_probes) q GROUP BY ALL""")
def audit_histogram(t):
    return au.size_histogram(t.probes())


@query("audit_quantiles", "fx_probes", f"""
SELECT {CODEC} AS codec, a AS "at", count(*) AS files, TRUE AS close FROM fx_probes, (SELECT unnest([1e-1, 5e-1, 9e-1]) AS a) q GROUP BY ALL""")
def audit_quantiles(t):
    """Quantiles of sketches that were made of four parts and added up, and whether their ranks are within 3 % of the exact ones."""
    probes = t.probes()
    parts = None
    for i in range(4):
        one = au.size_sketches(probes.filter(F.pmod(F.xxhash64("path"), F.lit(4)) == i))
        parts = one if parts is None else parts.unionByName(one)
    found = au.size_quantiles(au.merged_sketches(parts, ["codec"]), (0.1, 0.5, 0.9)).withColumnRenamed("codec", "c").withColumnRenamed("size", "q")
    ranks = (probes.select(F.lower("video_codec").alias("codec"), "size").join(found, F.col("codec") == F.col("c"))
             .groupBy("codec", "at", "files").agg(F.count_if(F.col("size") < F.col("q")).alias("below"), F.count_if(F.col("size") <= F.col("q")).alias("upto")))
    slack = 0.03 * F.col("files") + 1
    close = (F.col("below") <= F.col("at") * F.col("files") + slack) & (F.col("upto") >= F.col("at") * F.col("files") - slack)
    return ranks.select("codec", "at", "files", close.alias("close"))


# ---------------------------------------------------------------- progress

PARSED = r""", ln AS (SELECT *, CAST(nullif(regexp_extract(line, '^out_time_ms=(\d+)$', 1), '') AS DOUBLE) / 1e6 AS o,
  CAST(nullif(regexp_extract(line, '^frame=\s*(\d+)$', 1), '') AS BIGINT) AS f,
  TRY_CAST(nullif(regexp_extract(line, '^fps=\s*([\d.]+)$', 1), '') AS DOUBLE) AS p,
  TRY_CAST(nullif(regexp_extract(line, '^speed=\s*([\d.]+)x$', 1), '') AS DOUBLE) AS s, line = 'progress=end' AS ended FROM fx_lines)
"""
STATE = PARSED + """, st AS (SELECT encode_id, t_s, seq,
    last_value(o IGNORE NULLS) OVER w AS lo, last_value(f IGNORE NULLS) OVER w AS lf, last_value(p IGNORE NULLS) OVER w AS lp,
    last_value(s IGNORE NULLS) OVER w AS ls, last_value(CASE WHEN o IS NOT NULL THEN FALSE WHEN ended THEN TRUE END IGNORE NULLS) OVER w AS le
  FROM ln WINDOW w AS (PARTITION BY encode_id ORDER BY t_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
state AS (SELECT encode_id, t_s, seq, CASE WHEN le THEN greatest(coalesce(lo, 0e0), 6600e0) ELSE coalesce(lo, 0e0) END AS current_seconds,
  coalesce(lf, 0) AS frames, coalesce(lp, 0e0) AS fps, coalesce(ls, 0e0) AS speed FROM st)
"""


def _parsed(t):
    return pg.progress_parse(t.get("fx_lines"))


def _encodes(t):
    return t.get("fx_encodes")


def _state(t):
    return pg.progress_state(_parsed(t), _encodes(t))


@query("progress_parse", "fx_lines", PARSED + "SELECT encode_id, seq, o AS out_seconds, f AS frames, p AS fps, s AS speed, ended FROM ln")
def progress_parse(t):
    return _parsed(t).select("encode_id", "seq", "out_seconds", "frames", "fps", "speed", "ended")


@query("progress_state", "fx_lines", STATE + "SELECT * FROM state")
def progress_state(t):
    return _state(t).select("encode_id", "t_s", "seq", "current_seconds", "frames", "fps", "speed")


POSITION = "CASE WHEN frames > 0 THEN greatest(current_seconds, frames / 24e0) ELSE current_seconds END"


@query("progress_position", "fx_lines", STATE + f"SELECT encode_id, seq, {POSITION} AS position FROM state")
def progress_position(t):
    return pg.progress_position(_state(t)).select("encode_id", "seq", "position")


@query("progress_speed_eta", "fx_lines", STATE + f"""
SELECT encode_id, seq, sp AS eff_speed, position / 6600e0 AS fraction,
  CASE WHEN sp > 0 AND 6600e0 - position > 0 THEN (6600e0 - position) / sp END AS eta_s
FROM (SELECT *, {POSITION} AS position, CASE WHEN fps > 0 THEN fps / 24e0 ELSE speed END AS sp FROM state) q""")
def progress_speed_eta(t):
    return pg.progress_speed_eta(_state(t)).select("encode_id", "seq", "eff_speed", "fraction", "eta_s")


@query("stall_watchdog", "fx_signals", """
SELECT encode_id, t_s, anchor_s FROM (
  WITH RECURSIVE r AS (SELECT DISTINCT encode_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS o, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS anchor_s, CAST(0 AS BIGINT) AS t_s FROM fx_signals
    UNION ALL SELECT s.encode_id, s.seq, CASE WHEN moves THEN s.current_seconds ELSE o END, CASE WHEN moves THEN s.frames ELSE f END, CASE WHEN moves THEN s.t_s ELSE anchor_s END, s.t_s
    FROM r JOIN fx_signals s ON s.encode_id = r.encode_id AND s.seq = r.seq + 1, LATERAL (SELECT s.current_seconds > o OR s.frames > f AS moves) m
    WHERE r.t_s - anchor_s <= 300)
  SELECT * FROM r WHERE t_s - anchor_s > 300) q""")
def stall_watchdog(t):
    """Positions and frames, both with falls, against a line-by-line walk."""
    return pg.stall_watchdog(t.get("fx_signals"), _encodes(t)).select("encode_id", "t_s", "anchor_s")


@query("encode_deadline", "fx_progress fx_encodes", """
SELECT p.encode_id, min(t_s) AS t_s, min(seq) AS seq FROM fx_progress p JOIN fx_encodes e ON e.encode_id = p.encode_id
WHERE t_s - start_s > timeout_s GROUP BY p.encode_id""")
def encode_deadline(t):
    return pg.encode_deadline(t.get("fx_progress"), _encodes(t))


RATIO = "(frames / 24e0 / 6600e0)"
MARKS = ", r AS (SELECT *, " + RATIO + " AS ratio FROM fx_progress)"
_prev = None
for _i, _m in enumerate(("1e-1", "2e-1", "3e-1", "5e-1")):
    _after = "" if _prev is None else f" JOIN {_prev} p ON p.encode_id = r.encode_id AND r.seq > p.seq"
    MARKS += f", m{_i} AS (SELECT r.encode_id, min(r.seq) AS seq, {_m} AS mark FROM r{_after} WHERE ratio >= {_m} GROUP BY r.encode_id)"
    _prev = f"m{_i}"
MARKS += ", m AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"


@query("bloat_projection", "fx_progress", MARKS + """
SELECT encode_id, min(seq) AS seq, arg_min(mark, seq) AS checkpoint FROM (
  SELECT r.encode_id, r.seq, m.mark FROM r JOIN m ON m.encode_id = r.encode_id AND m.seq = r.seq
  WHERE r.out_size / r.ratio >= 70000000 * 9e-1) q GROUP BY encode_id""")
def bloat_projection(t):
    feed = t.get("fx_progress").withColumn("current_seconds", F.col("frames") / F.lit(24.0))
    return pg.bloat_projection(feed, _encodes(t)).select("encode_id", "seq", "checkpoint")


@query("progress_windows", "fx_lines", PARSED + """
SELECT encode_id, CAST(floor(t_s / 30) AS BIGINT) * 30 AS start_s, count(*) AS n_lines, max(f) AS frames, max(o) AS out_seconds
FROM ln GROUP BY 1, 2""")
def progress_windows(t):
    rows = _parsed(t).withColumn("ts", F.timestamp_seconds("t_s"))
    return pg.progress_windows(rows).select(
        "encode_id", F.unix_seconds("window_start").alias("start_s"), "n_lines", "frames", "out_seconds")


# ---------------------------------------------------------------- streams, run to the end of their input


@query("progress_windows_stream", "", """
SELECT user_id AS encode_id, CAST(floor(epoch(ts) / 30) AS BIGINT) * 30 AS start_s, count(*) AS n_lines, max(event_id) AS frames
FROM events GROUP BY 1, 2""")
def progress_windows_stream(t):
    return jobs.windows_over_events(t.spark, t.dir)


@query("incremental_scan_stream", "", """
SELECT user_id AS file_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id""")
def incremental_scan_stream(t):
    return jobs.latest_over_events(t.spark, t.dir)


@query("probe_scan_stream", "fx_doc_files", """
SELECT path, CASE WHEN k % 37 = 0 THEN 'not json' WHEN k % 41 = 0 THEN 'no video stream' ELSE 'ok' END AS outcome,
  CASE WHEN k % 37 <> 0 AND k % 41 <> 0 THEN video_codec END AS video_codec FROM fx_doc_files""")
def probe_scan_stream(t):
    """Probe documents as a stream, parsed, normalised and latest-wins; bad ones on the error side."""
    rows = jobs.probes_over_documents(t.spark, lambda feed: t.over(orders=feed).probe_docs(), t.given("orders"))
    return rows.select("path", F.coalesce("reason", F.lit("ok")).alias("outcome"), F.when(F.col("reason").isNull(), F.col("video_codec")).alias("video_codec"))


@query("stall_watchdog_stream", "", """
WITH RECURSIVE l AS (SELECT user_id AS encode_id, event_id, event_type, event_id % 97 * 1000000 AS size,
    CAST(floor((epoch_us(ts) - 1704067200000000) / 1000e0) AS BIGINT) + 1704067200000000 AS us FROM events),
e AS (SELECT encode_id, CAST(floor(min(us) / 1000e0) AS BIGINT) AS start_ms, encode_id % 5 = 0 AS limited, encode_id % 4 = 0 AS known FROM l GROUP BY encode_id),
mark AS (SELECT max(us) // 1000 - 600000 AS ms FROM l),
n AS (SELECT encode_id, us // 1000 AS t, size, row_number() OVER (PARTITION BY encode_id ORDER BY us // 1000, event_id) AS i,
    CASE WHEN event_type = 'purchase' THEN CAST(event_id % 5000 AS DOUBLE) END AS x,
    CASE WHEN event_type NOT IN ('purchase', 'error') THEN CASE WHEN event_id % 3 = 0 THEN event_id // 2 ELSE event_id END END AS y
  FROM l, mark WHERE us // 1000 < mark.ms // 60000 * 60000),
r AS (SELECT encode_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS DOUBLE) AS o, CAST(0 AS BIGINT) AS f, start_ms AS anchor,
    0 AS used, CAST(NULL AS VARCHAR) AS alarm, CAST(NULL AS BIGINT) AS at_ms, start_ms, limited, known FROM e WHERE encode_id IN (SELECT encode_id FROM n)
  UNION ALL SELECT encode_id, i, CASE WHEN late THEN x ELSE nx END, CASE WHEN late THEN y ELSE ny END,
    CASE WHEN moves THEN nx ELSE o END, CASE WHEN moves THEN ny ELSE f END, CASE WHEN moves THEN t ELSE anchor END, used + CASE WHEN crossed THEN 1 ELSE 0 END,
    CASE WHEN late THEN CASE WHEN due < anchor + 300000 THEN 'timeout' ELSE 'stall' END WHEN crossed AND size > 0 AND nx / 6600 >= 1e-2 AND size / (nx / 6600) >= 120000000 * 9e-1 THEN 'bloat' END,
    CASE WHEN late THEN due ELSE t END, start_ms, limited, known
  FROM (SELECT *, NOT late AND (nx > o OR ny > f) AS moves, NOT late AND known AND used < 4 AND nx / 6600 >= [1e-1, 2e-1, 3e-1, 5e-1, 9e0][used + 1] AS crossed
    FROM (SELECT r.* EXCLUDE (i), n.i, n.t, n.size, coalesce(n.x, r.x) AS nx, coalesce(n.y, r.y) AS ny,
        CASE WHEN limited THEN least(anchor + 300000, start_ms + 1200000) ELSE anchor + 300000 END AS due, n.t > due AS late
      FROM r JOIN n ON n.encode_id = r.encode_id AND n.i = r.i + 1 WHERE r.alarm IS NULL) p) q),
z AS (SELECT *, CASE WHEN limited THEN least(anchor + 300000, start_ms + 1200000) ELSE anchor + 300000 END AS due FROM r
  QUALIFY row_number() OVER (PARTITION BY encode_id ORDER BY i DESC) = 1)
SELECT encode_id, coalesce(alarm, CASE WHEN due < anchor + 300000 THEN 'timeout' ELSE 'stall' END) AS alarm,
  CASE WHEN alarm IS NULL THEN due ELSE at_ms END AS at_ms, anchor AS anchor_ms
FROM z, mark WHERE alarm IS NOT NULL OR due + 60000 <= mark.ms""")
def stall_watchdog_stream(t):
    """Alarms of stalled, slow and overlarge encodes over the event feed, against a line-by-line walk."""
    return jobs.watch_over_events(t.spark, t.dir)
