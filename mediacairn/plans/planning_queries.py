"""Gate, rule, candidate and queue queries."""

import uuid

from pyspark.sql import functions as F

from ..functions import fixed, gate as g, paths as p, rules as r
from ..operators import bands as bn, imports as im, planning as pl
from ..session import shared_dir
from ..sources import reports
from ..sources.state import KeyedTable
from .registry import query, sql_case, sql_list

BUCKET = ("CASE WHEN height <= 0 THEN 'unknown' WHEN height <= 480 THEN '480p' WHEN height <= 720 THEN '720p' "
          "WHEN height <= 1080 THEN '1080p' WHEN height <= 1440 THEN '1440p' ELSE '2160p' END")


def _double(table, pick=lambda v: v):
    return {k: f"CAST({pick(v)} AS DOUBLE)" for k, v in table.items()}


TARGET = sql_case(BUCKET, _double(fixed.BITRATE_MBPS, lambda v: v[0]))
FLAG = sql_case(BUCKET, _double(fixed.BITRATE_MBPS, lambda v: v[1]))
RATE = sql_case(BUCKET, _double(fixed.OUTPUT_MB_PER_HOUR))
MBPS = "(video_bitrate / 1e6)"
CODEC = "lower(video_codec)"
LOW = f"coalesce(video_bitrate > 0 AND {MBPS} < {TARGET}, FALSE)"
SIZE_MB = "(size / 1048576e0)"

# one nullable savings value per rule
RULE_MB = {
    "over_bitrate": f"CASE WHEN duration_seconds > 0 AND video_bitrate > 0 AND {MBPS} > {FLAG} THEN "
                    f"greatest((video_bitrate - CAST({TARGET} * 1000000 AS BIGINT)) * duration_seconds / 8e0 / 1048576e0, 0e0) END",
    "legacy_codec": f"CASE WHEN {CODEC} IN {sql_list(fixed.LEGACY_CODECS)} THEN size * 5e-1 / 1048576e0 END",
    "hd_non_av1": f"CASE WHEN {CODEC} <> 'av1' AND height >= 720 AND height < 1440 THEN size * 25e-2 / 1048576e0 END",
    "uhd_non_av1": f"CASE WHEN {CODEC} <> 'av1' AND height >= 1440 AND height < 1000000 THEN size * 25e-2 / 1048576e0 END",
    "sd_non_av1": f"CASE WHEN {CODEC} <> 'av1' AND height >= 1 AND height < 720 THEN size * 25e-2 / 1048576e0 END",
    "container_migration": f"CASE WHEN container IN {sql_list(fixed.LEGACY_CONTAINERS)} THEN size * 2e-2 / 1048576e0 END",
}
SEVERITY = {
    "over_bitrate": f"CASE WHEN {MBPS} > 2 * {FLAG} THEN 'high' ELSE 'medium' END",
    "legacy_codec": "'high'", "hd_non_av1": "'medium'", "uhd_non_av1": "'high'",
    "sd_non_av1": "'medium'", "container_migration": "'low'",
}
# Mbps with one decimal, ties to the even digit, in whole numbers
TENTHS = "(video_bitrate // 100000 + CASE WHEN video_bitrate % 100000 > 50000 OR video_bitrate % 100000 = 50000 AND video_bitrate // 100000 % 2 = 1 THEN 1 ELSE 0 END)"
REASON = {
    "over_bitrate": f"concat({TENTHS} // 10, '.', {TENTHS} % 10, ' Mbps of ', {BUCKET}, ': more than ', {FLAG}, ', where ', {TARGET}, ' would do')",
    "legacy_codec": f"concat({CODEC}, ' is outdated: half the space is enough')",
    "hd_non_av1": f"concat('HD file still in ', {CODEC})", "uhd_non_av1": f"concat('UHD file still in ', {CODEC})",
    "sd_non_av1": f"concat('SD file still in ', {CODEC})",
    "container_migration": "concat('streams can leave the ', container, ' container as they are')",
}
NOTES = {
    "over_bitrate": {"resolution_class": BUCKET, "target_mbps": TARGET, "flag_mbps": FLAG},
    "legacy_codec": {"codec": CODEC}, "hd_non_av1": {"codec": CODEC, "height": "height"}, "uhd_non_av1": {"codec": CODEC, "height": "height"},
    "sd_non_av1": {"codec": CODEC, "height": "height"}, "container_migration": {"container": "container"},
}
FIRM = "concat_ws(',', " + ", ".join(f"CASE WHEN ({e}) IS NOT NULL THEN '{n}' END" for n, e in RULE_MB.items()) + ")"
ALL_FIRED = f"concat_ws(',', nullif({FIRM}, ''), CASE WHEN is_hdr THEN 'hdr_advisory' END)"
BEST = "greatest(" + ", ".join(f"coalesce({e}, 0e0)" for e in RULE_MB.values()) + ")"
# greatest and least skip nulls: an unknown bucket must give null, not 0
SAVED = (f"least({BEST}, CASE WHEN duration_seconds > 0 AND ({RATE}) IS NOT NULL THEN "
         f"greatest({SIZE_MB} - duration_seconds / 3600e0 * ({RATE}), 0e0) END, {SIZE_MB} * 95e-2)")
REMUX = f"({FIRM} = 'container_migration' AND {CODEC} IN {sql_list(fixed.MODERN_CODECS)})"

TAGGED = "name LIKE '%.AV1.REENCODE.mkv'"
WANT = "concat(dir, '/t', k, '.AV1.REENCODE.mkv')"
STRIKES = "(SELECT path, count(*) AS n FROM fx_decisions WHERE status = 'failed' AND error ILIKE '%encoder stalled%' GROUP BY path)"


def gate_sql():
    return f"""SELECT p.*, CASE WHEN l.path IS NULL THEN 'missing' WHEN s.n >= 2 THEN 'stalled'
      WHEN dv_profile = 5 THEN 'dv' WHEN {TAGGED} THEN 'reencoded' WHEN o.path IS NOT NULL THEN 'existing_output'
      WHEN {CODEC} = 'av1' THEN 'av1_source' WHEN {CODEC} = 'vp9' THEN 'skipped_codec'
      WHEN {LOW} THEN 'low_bitrate' WHEN name LIKE '%-trailer.mkv' THEN 'extras' ELSE 'ok' END AS gate
    FROM (SELECT *, {WANT} AS want FROM fx_probes) p
    LEFT JOIN (SELECT DISTINCT path FROM fx_listing) l ON l.path = p.path
    LEFT JOIN {STRIKES} s ON s.path = p.path
    LEFT JOIN (SELECT DISTINCT path FROM fx_listing) o ON o.path = p.want AND name LIKE '%.HEVC.mkv'"""


GATE_NEEDS = "fx_probes fx_listing fx_decisions"
FLAGS = dict(skip_codecs=("vp9",))


def _gate_args(t):
    return t.probes(), t.get("fx_listing"), t.get("fx_decisions")


@query("path_scope", "fx_probes", "SELECT path, size FROM fx_probes WHERE path LIKE '/lib1/d1/%'")
def path_scope(t):
    """Component-wise: /lib1/d1 takes nothing of /lib1/d10."""
    return pl.path_scope(t.probes(), "/lib1/d1").select("path", "size")


@query("is_reencoded_name", "fx_tree", r"""
SELECT path, regexp_matches(path, '\bREENCODE\b[^/]*$', 'i') AND path LIKE '%.%' AS tagged FROM fx_tree""")
def is_reencoded_name(t):
    rows = p.with_path_parts(t.get("fx_tree"))
    return rows.select("path", p.has_reencode_word(F.col("stem")).alias("tagged"))


@query("stall_strikes", "fx_probes fx_decisions",
       f"SELECT p.path, coalesce(s.n, 0) AS strikes, coalesce(s.n, 0) >= 2 AS blocked FROM fx_probes p LEFT JOIN {STRIKES} s ON s.path = p.path")
def stall_strikes(t):
    strikes = pl.stall_strikes(t.get("fx_decisions")).select(F.col("path").alias("__p"), "strikes")
    n = F.coalesce("strikes", F.lit(0).cast("long"))
    return (t.probes().join(strikes, F.col("path") == F.col("__p"), "left")
            .select("path", n.alias("strikes"), (n >= fixed.STALL_LIMIT).alias("blocked")))


@query("existing_output", "fx_probes fx_listing", f"""
SELECT path, {WANT} AS expected_path FROM fx_probes
WHERE name LIKE '%.HEVC.mkv' AND {WANT} IN (SELECT path FROM fx_listing)""")
def existing_output(t):
    return pl.existing_output(t.probes(), t.get("fx_listing")).select("path", "expected_path")


@query("below_target_bitrate", "fx_probes", f"SELECT path, {LOW} AS low FROM fx_probes")
def below_target_bitrate(t):
    return t.probes().select("path", g.below_target_bitrate(
        F.col("video_bitrate"), F.col("height")).alias("low"))


@query("dv_strategy", "fx_probes", """
SELECT path, dv_profile, CASE dv_profile WHEN 7 THEN 'p8_strip' WHEN 8 THEN 'p8_strip' END AS plain,
  CASE dv_profile WHEN 7 THEN 'p7_convert' WHEN 8 THEN 'p8_strip' END AS convert_on,
  CASE dv_profile WHEN 8 THEN 'p8_strip' END AS convert_no_tools FROM fx_probes""")
def dv_strategy(t):
    d = F.col("dv_profile")
    return t.probes().select(
        "path", "dv_profile", g.dv_strategy(d).alias("plain"),
        g.dv_strategy(d, True, True).alias("convert_on"),
        g.dv_strategy(d, True, False).alias("convert_no_tools"))


@query("plan_gate", GATE_NEEDS, f"SELECT path, gate FROM ({gate_sql()}) q")
def plan_gate(t):
    return pl.plan_gate(*_gate_args(t), **FLAGS).select("path", "gate")


@query("plan_skip_counts", GATE_NEEDS, f"""
SELECT gate, count(*) AS n FROM ({gate_sql()}) q WHERE gate <> 'ok' AND path LIKE '/lib1/%' GROUP BY gate
UNION ALL SELECT 'out_of_scope', count(*) FROM fx_probes WHERE path NOT LIKE '/lib1/%'""")
def plan_skip_counts(t):
    return pl.plan_skip_counts(*_gate_args(t), scope="/lib1", **FLAGS)


@query("height_band", "fx_probes fx_decisions", """
SELECT d.id, d.path FROM fx_decisions d LEFT JOIN fx_probes p ON p.path = d.path AND p.st <> 'F'
WHERE p.path IS NULL OR p.height BETWEEN 720 AND 1439""")
def height_band(t):
    """A third of the files have no probe here: their decisions stay."""
    probes = t.probes().filter("st <> 'F'")
    return pl.height_band(t.get("fx_decisions"), probes, 720, 1439).select("id", "path")


DENOISE = f"((height > 0 AND height < 720) OR ({CODEC} = 'h264' AND height < 1440 AND {LOW}))"
TIMEOUT = "CASE WHEN duration_seconds <= 0 THEN 3600 ELSE greatest(3600, CAST(floor(duration_seconds * 6) AS BIGINT)) END"


@query("denoise_flag", "fx_probes", f"SELECT path, {DENOISE} AS denoise FROM fx_probes")
def denoise_flag(t):
    return pl.job_flags(t.probes()).select("path", "denoise")


@query("hw_decode_flag", "fx_probes", f"""
SELECT path, height >= 1440 AS hw_decode, height >= 1440 OR (NOT {DENOISE} AND {CODEC} = 'vc1') AS hw_with_vc1 FROM fx_probes""")
def hw_decode_flag(t):
    rows = pl.job_flags(t.probes())
    return rows.select("path", "hw_decode", g.hw_decode_flag(
        F.col("hw_decode"), F.col("video_codec"), F.col("denoise"), ["vc1"]).alias("hw_with_vc1"))


@query("encode_timeout", "fx_probes",
       f"SELECT path, CAST({TIMEOUT} AS BIGINT) AS timeout_s, CAST(120 AS BIGINT) AS given, CAST(0 AS BIGINT) AS switched_off FROM fx_probes")
def encode_timeout(t):
    d = F.col("duration_seconds")
    return t.probes().select("path", g.encode_timeout(d).alias("timeout_s"),
                             g.encode_timeout(d, 120).alias("given"),
                             g.encode_timeout(d, 0).alias("switched_off"))


# ---------------------------------------------------------------- rules


def _rule(name, mb, severity):
    @query("rule_" + name, "fx_probes",
           f"SELECT path, '{name}' AS rule, {severity} AS severity, {mb} AS savings_mb, {REASON[name]} AS reason, "
           + "concat_ws(' ', " + ", ".join(f"concat('{k}=', {v})" for k, v in NOTES[name].items()) + f") AS notes FROM fx_probes WHERE ({mb}) IS NOT NULL")
    def run(t):
        rows = r.evaluate_rules(t.probes(), [name]).select("path", F.explode("fired").alias("v"))
        notes = F.concat_ws(" ", *[F.concat(F.lit(k + "="), F.col("v.notes")[k]) for k in NOTES[name]])
        return rows.select("path", "v.rule", "v.severity", F.col("v.projected_savings_mb").alias("savings_mb"), "v.reason", notes.alias("notes"))
    return run


for _name, _mb in RULE_MB.items():
    _rule(_name, _mb, SEVERITY[_name])


@query("rule_hdr_advisory", "fx_probes",
       "SELECT path, 'hdr_advisory' AS rule, 'medium' AS severity, CAST(NULL AS DOUBLE) AS savings_mb, 'has HDR, which an AV1 file keeps' AS reason, color_transfer, color_primaries FROM fx_probes WHERE is_hdr")
def rule_hdr_advisory(t):
    rows = r.evaluate_rules(t.probes(), ["hdr_advisory"]).select("path", F.explode("fired").alias("v"))
    notes = [F.col("v.notes")[c].alias(c) for c in ("color_transfer", "color_primaries")]
    return rows.select("path", "v.rule", "v.severity", F.col("v.projected_savings_mb").alias("savings_mb"), "v.reason", *notes)


@query("evaluate_rules", "fx_probes", f"SELECT path, {ALL_FIRED} AS fired FROM fx_probes")
def evaluate_rules(t):
    """Names of all fired rules in order, '' where none fired."""
    return r.evaluate_rules(t.probes()).select("path", F.array_join("fired.rule", ",").alias("fired"))


@query("candidates", "fx_probes", f"SELECT path, {FIRM} AS rules, {ALL_FIRED} AS fired FROM fx_probes WHERE {FIRM} <> ''")
def candidates(t):
    return pl.candidates(t.probes()).select(
        "path", F.array_join("rules_fired", ",").alias("rules"), F.array_join("fired.rule", ",").alias("fired"))


@query("remux_only", "fx_probes", f"SELECT path, {REMUX} AS remux_only FROM fx_probes WHERE {FIRM} <> ''")
def remux_only(t):
    return pl.queue_candidates(t.probes()).select("path", "remux_only")


@query("projected_savings", "fx_probes", f"SELECT path, {SAVED} AS projected_savings_mb FROM fx_probes WHERE {FIRM} <> ''")
def projected_savings(t):
    return pl.candidates(t.probes()).select("path", "projected_savings_mb")


@query("rank_queue", "fx_probes", f"""
SELECT path, projected_savings_mb, rules FROM (SELECT path, {SAVED} AS projected_savings_mb, {FIRM} AS rules FROM fx_probes) q
WHERE rules <> '' ORDER BY projected_savings_mb DESC, path LIMIT 100""")
def rank_queue(t):
    """Probes to the 100 files with the largest projected savings."""
    pending = pl.pending_rows(pl.queue_candidates(t.probes()), 1, 0.0)
    return pl.rank_queue(pending, 100).select(
        "path", "projected_savings_mb", F.array_join("rules_fired", ",").alias("rules"))


@query("pending_replace", "fx_probes fx_decisions", f"""
SELECT id, path, status, run_id FROM fx_decisions WHERE status <> 'pending'
UNION ALL SELECT row_number() OVER (ORDER BY path) + (SELECT max(id) FROM fx_decisions), path, 'pending', CAST(77 AS BIGINT) FROM fx_probes WHERE {FIRM} <> ''""")
def pending_replace(t):
    columns = ["id", "path", "status", "run_id"]
    fresh = pl.pending_rows(pl.queue_candidates(t.probes()), 77, 0.0).select(columns)
    return pl.pending_replace(t.get("fx_decisions").select(columns), fresh)


@query("apply_queue", "fx_probes fx_decisions", """
SELECT d.id, d.path, d.projected_savings_mb FROM fx_decisions d JOIN fx_probes p ON p.path = d.path
WHERE d.status = 'pending' AND p.height BETWEEN 720 AND 1439
ORDER BY coalesce(d.projected_savings_mb, 0) DESC, d.path, d.id LIMIT 50""")
def apply_queue(t):
    """Band filter before the limit, so the limit counts files in the band."""
    return pl.apply_queue(t.get("fx_decisions"), t.probes(), 720, 1439, 50).select("id", "path", "projected_savings_mb")


@query("plan_summary", GATE_NEEDS, f"""
SELECT CASE WHEN gate <> 'ok' THEN gate WHEN {FIRM} <> '' THEN 'candidate' ELSE 'no_rule' END AS outcome, count(*) AS n
FROM ({gate_sql()}) q GROUP BY 1
UNION ALL SELECT 'cleared_pending', count(*) FROM fx_decisions WHERE status = 'pending'""")
def plan_summary(t):
    return pl.plan_summary(*_gate_args(t), **FLAGS)


RULE_UNION = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, {SAVED} AS s FROM fx_probes WHERE ({e}) IS NOT NULL" for n, e in RULE_MB.items())


@query("rule_mix", "fx_probes", f"""
SELECT rule, count(*) AS n_candidates, CAST(floor(sum(s)) AS BIGINT) AS savings_mb FROM ({RULE_UNION}
  UNION ALL SELECT 'hdr_advisory', {SAVED} FROM fx_probes WHERE is_hdr AND {FIRM} <> '') u GROUP BY rule""")
def rule_mix(t):
    return pl.rule_mix(t.probes()).select(
        "rule", "n_candidates", F.floor("savings_mb").alias("savings_mb"))


@query("preset_resolve", "fx_probes", """
SELECT path, CASE WHEN height >= 1440 THEN 'UHD' WHEN height >= 720 THEN 'HD' ELSE 'SD' END AS preset,
  CASE WHEN height >= 1440 THEN 15 WHEN height >= 720 THEN 21 ELSE 24 END AS quality, 'veryslow' AS encoder_preset,
  'en,und' AS keep_langs, CASE WHEN height >= 1440 THEN 1440 WHEN height >= 720 THEN 720 END AS min_height,
  CASE WHEN height >= 1440 THEN NULL WHEN height >= 720 THEN 1439 ELSE 719 END AS max_height, height >= 1440 AS hw_decode,
  18 AS film_quality FROM fx_probes""")
def preset_resolve(t):
    columns = ["preset", "quality", "encoder_preset", "keep_langs", "min_height", "max_height", "hw_decode"]
    rows = pl.preset_resolve(t.probes()).withColumn("plain", F.struct(*columns))
    film = pl.preset_resolve(rows.drop(*columns), film=True, quality=18)
    return film.select("path", "plain.*", F.col("quality").alias("film_quality"))


BANDS = """SELECT n_name AS name, CAST(n_nationkey * 7 % 25 AS INT) AS place,
  CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey * 85 AS INT) END AS min_height,
  CASE WHEN n_nationkey % 7 <> 0 THEN CAST(n_nationkey * 85 + 60 + n_nationkey % 3 * 400 AS INT) END AS max_height,
  CAST(15 + n_nationkey % 9 AS INT) AS quality FROM {nation}"""


@query("preset_bands", "fx_probes", f"""
, b AS ({BANDS.format(nation='nation')}), h AS (SELECT path, CAST(height + k % 200 - 90 AS INT) AS height FROM fx_probes),
best AS (SELECT path, height, arg_min(b, struct_pack(p := place, n := name)) AS w FROM h JOIN b ON height >= coalesce(min_height, -1000000) AND height <= coalesce(max_height, 1000000) GROUP BY ALL)
SELECT h.path, h.height, w.name AS preset, w.min_height, w.max_height, w.quality FROM h LEFT JOIN best ON best.path = h.path""")
def preset_bands(t):
    """Overlapping and open height bands out of a table; the band with the smallest place wins."""
    bands = t.spark.sql(BANDS, nation=t.spark.read.parquet(f"{t.dir}/nation.parquet"))
    rows = t.probes().selectExpr("path", "CAST(height + k % 200 - 90 AS INT) AS height")
    return bn.with_band(rows, bands).select("path", "height", "preset", "min_height", "max_height", "quality")


ROOTS = """SELECT DISTINCT root, length(root) * 10 AS run FROM (SELECT dir AS root FROM {fx_probes} WHERE k % 50 = 1
  UNION ALL SELECT concat('/', split_part(path, '/', 2)) FROM {fx_probes} WHERE k % 3 = 1
  UNION ALL SELECT substring(path, 1, length(path) - 3) FROM {fx_probes} WHERE k % 40 = 2 UNION ALL SELECT path FROM {fx_probes} WHERE k % 40 = 3) r"""


@query("path_scope_roots", "fx_probes", f"""
, r AS ({ROOTS.format(fx_probes='fx_probes')})
SELECT path, root, run FROM (SELECT path, root, CAST(run AS INT) AS run, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS i
  FROM fx_probes JOIN r ON path = root OR starts_with(path, concat(root, '/'))) q WHERE i = 1""")
def path_scope_roots(t):
    """Many roots, nested ones too: each file belongs to the deepest that holds it."""
    roots = t.spark.sql(ROOTS, fx_probes=t.probes())
    return pl.covering_roots(t.probes().select("path"), roots)


ARRIVALS = """SELECT path, CAST(k % 1000 AS DOUBLE) AS seen_at, CAST(NULL AS STRING) AS replaces, k FROM {fx_probes} WHERE k % 2 = 0"""
UPGRADES = """SELECT path, CAST(2000 + k % 1000 AS DOUBLE) AS seen_at, CASE WHEN k % 12 = 0 THEN path END AS replaces, k FROM {fx_probes} WHERE k % 3 = 0
  UNION ALL SELECT path, CAST(k % 1000 AS DOUBLE), NULL, k FROM {fx_probes} WHERE k % 4 = 0"""
WORTH = f"(({RULE_MB['over_bitrate']}) IS NOT NULL OR ({RULE_MB['legacy_codec']}) IS NOT NULL)"


def _drained(rows, limit):
    """SQL of a queue after one drain."""
    return f"""SELECT path, seen_at, replaces, CASE WHEN gate = 'take' AND i <= {limit} THEN 'taken' WHEN gate = 'left' THEN 'left' ELSE status END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY seen_at, path) AS i FROM (
    SELECT q.*, CASE WHEN status <> 'pending' THEN 'held' WHEN p.path IS NULL THEN 'unprobed' WHEN worth THEN 'take' ELSE 'left' END AS gate
    FROM {rows} q LEFT JOIN known p ON p.path = q.path) a) b"""


@query("import_queue", "fx_probes", f"""
, known AS (SELECT path, {WORTH} AS worth FROM fx_probes WHERE st <> 'F'),
first AS (SELECT path, seen_at, replaces, 'pending' AS status FROM ({ARRIVALS.replace('STRING', 'VARCHAR').format(fx_probes='fx_probes')}) a),
one AS ({_drained('first', 500)}),
fresh AS (SELECT path, max(seen_at) AS seen_at, arg_max(replaces, seen_at) FILTER (seen_at >= 2000) AS replaces FROM ({UPGRADES.format(fx_probes='fx_probes')}) u GROUP BY path),
merged AS (SELECT coalesce(f.path, o.path) AS path, CASE WHEN f.seen_at > coalesce(o.seen_at, -1) THEN f.seen_at ELSE o.seen_at END AS seen_at,
    CASE WHEN f.seen_at > coalesce(o.seen_at, -1) THEN f.replaces ELSE o.replaces END AS replaces, CASE WHEN f.seen_at > coalesce(o.seen_at, -1) THEN 'pending' ELSE o.status END AS status
  FROM one o FULL JOIN fresh f ON f.path = o.path)
SELECT * FROM ({_drained("merged", 800)}) z""")
def import_queue(t):
    """Arrivals, a drain, upgrades and repeats, and another drain, over a table that is merged into."""
    probes = t.probes().filter("st <> 'F'")
    table = KeyedTable(t.spark, f"{shared_dir(t.spark)}/imports-{uuid.uuid4().hex}", im.QUEUE, "path", parts=8)
    for arrivals, limit in ((ARRIVALS, 500), (UPGRADES, 800)):
        table.update(t.spark.sql(arrivals, fx_probes=t.probes()).drop("k"), im.merge_arrivals)
        table.update(im.drain(table.read(), probes, limit), im.settle)
    return table.read()


@query("tier_time_estimate", "fx_probes fx_decisions", """
SELECT coalesce(tier, 'total') AS tier, CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(n * s) AS BIGINT) AS seconds FROM (
  SELECT CASE WHEN p.height >= 1440 THEN 'UHD' WHEN p.height >= 720 THEN 'HD' ELSE 'SD' END AS tier, 1 AS n,
    CASE WHEN p.height >= 1440 THEN 3600 WHEN p.height >= 720 THEN 900 ELSE 300 END AS s
  FROM fx_decisions d LEFT JOIN fx_probes p ON p.path = d.path AND p.st <> 'F' WHERE d.status = 'pending') q
GROUP BY ROLLUP (tier)""")
def tier_time_estimate(t):
    return pl.tier_time_estimate(t.get("fx_decisions"), t.probes().filter("st <> 'F'"))


@query("write_candidates_json", "fx_probes", f"""
SELECT path, round_even({SIZE_MB}, 2) AS size_mb, {BUCKET} AS resolution, round_even({MBPS}, 2) AS video_bitrate_mbps,
  {REMUX} AS remux_only, {ALL_FIRED} AS fired, CAST(k % 6 AS INTEGER) AS n_audio,
  count(*) OVER () AS candidate_count, CAST(floor(sum({SAVED}) OVER ()) AS BIGINT) AS total_savings_mb FROM fx_probes WHERE {FIRM} <> ''""")
def write_candidates_json(t):
    """Write the candidate items and the totals and read both back."""
    where = f"{shared_dir(t.spark)}/candidates-{uuid.uuid4().hex}"
    reports.write_candidates_json(pl.candidates(t.nested_probes()), where)
    items = t.spark.read.schema(
        "path string, size_mb double, resolution string, video_bitrate_mbps double, remux_only boolean, "
        "fired_rules array<struct<rule:string>>, audio_tracks array<struct<codec:string>>").json(where + "/items")
    totals = t.spark.read.schema("candidate_count bigint, total_projected_savings_mb double").json(where + "/summary").first()
    return items.select("path", "size_mb", "resolution", "video_bitrate_mbps", "remux_only",
                        F.array_join("fired_rules.rule", ",").alias("fired"),
                        F.size("audio_tracks").alias("n_audio"), F.lit(totals.candidate_count).cast("long").alias("candidate_count"),
                        F.floor(F.lit(totals.total_projected_savings_mb)).alias("total_savings_mb"))
