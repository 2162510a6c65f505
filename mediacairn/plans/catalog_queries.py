"""Listing, probe and incremental queries."""

import uuid

from pyspark.sql import functions as F

from ..functions import fixed, paths as p, probe as pr
from ..operators import incremental as inc
from ..session import shared_dir
from ..sources import buckets, listing as ls, probe_json as pj, tree
from ..sources.state import TABLES, State
from .registry import query, sql_list

ROOT = "/lib"
IN_ROOT = "(path = '/lib' OR path LIKE '/lib/%')"
NAME = r"regexp_extract(path, '[^/]*$')"
EXT = rf"lower(regexp_extract({NAME}, '^.+(\.[^.]+)$', 1))"
REL = r"regexp_extract(path, '^/lib/(.*)/[^/]*$', 1)"
STEM = rf"CASE WHEN {EXT} = '' THEN {NAME} ELSE left({NAME}, length({NAME}) - length({EXT})) END"
EXTRA_NAME = rf"regexp_matches(lower({STEM}), '-({'|'.join(fixed.EXTRAS_SUFFIXES)})$')"


def _dirs(names, lower=False):
    arr = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"list_has_any(string_split({'lower(' + REL + ')' if lower else REL}, '/'), {arr})"


def _walk(t):
    return t.get("fx_tree")


def _in_root(t):
    return _walk(t).filter(p.under_root(F.col("path"), ROOT))


@query("scan_listing", "fx_tree", f"""
SELECT path, size, mtime FROM fx_tree WHERE {IN_ROOT} AND size > 0
  AND {EXT} IN {sql_list(fixed.VIDEO_EXTENSIONS)} AND NOT {_dirs(fixed.SYSTEM_DIRS)}
  AND NOT {_dirs(fixed.EXTRAS_DIRS, True)} AND NOT {EXTRA_NAME}""")
def scan_listing(t):
    return ls.scan_listing(_walk(t), ROOT)


@query("listing_extension_filter", "fx_tree",
       f"SELECT path, size FROM fx_tree WHERE {EXT} IN {sql_list(fixed.VIDEO_EXTENSIONS)}")
def listing_extension_filter(t):
    return ls.keep_supported(_walk(t)).select("path", "size")


@query("listing_system_dir_filter", "fx_tree",
       f"SELECT path, size FROM fx_tree WHERE {IN_ROOT} AND NOT {_dirs(fixed.SYSTEM_DIRS)}")
def listing_system_dir_filter(t):
    return ls.drop_system_dirs(_in_root(t), ROOT).select("path", "size")


@query("listing_extras_dir_filter", "fx_tree",
       f"SELECT path, size FROM fx_tree WHERE {IN_ROOT} AND NOT {_dirs(fixed.EXTRAS_DIRS, True)}")
def listing_extras_dir_filter(t):
    return ls.drop_extras_dirs(_in_root(t), ROOT).select("path", "size")


@query("listing_extras_name_filter", "fx_tree", f"SELECT path, size FROM fx_tree WHERE NOT {EXTRA_NAME}")
def listing_extras_name_filter(t):
    return ls.drop_extras_names(_walk(t)).select("path", "size")


@query("listing_usable_filter", "fx_tree", "SELECT path, size FROM fx_tree WHERE size > 0")
def listing_usable_filter(t):
    return ls.keep_usable(_walk(t)).select("path", "size")


@query("path_parts", "fx_tree", rf"""
SELECT path, name, suffix, CASE WHEN suffix = '' THEN name ELSE left(name, length(name) - length(suffix)) END AS stem,
  dir, array_to_string(list_slice(string_split(ltrim(path, '/'), '/'), -2, -1), '/') AS tail
FROM (SELECT path, {NAME} AS name, regexp_extract({NAME}, '^.+(\.[^.]+)$', 1) AS suffix,
  regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM fx_tree) q""")
def path_parts(t):
    rows = p.with_path_parts(_walk(t))
    return rows.select("path", "name", "suffix", "stem", "dir",
                       p.last_two_parts(F.col("path")).alias("tail"))


# ---------------------------------------------------------------- probe documents

GOOD = "k % 37 <> 0 AND k % 41 <> 0"
DEPTH = "CASE k % 6 WHEN 1 THEN 10 WHEN 2 THEN 12 WHEN 3 THEN 10 ELSE 8 END"
HDR = f"(k % 7 IN (0, 1) OR ({DEPTH} >= 10 AND (k % 3 = 0 OR k % 10 IN (0, 1))))"
BOX = "CASE k % 3 WHEN 0 THEN 'mkv' WHEN 2 THEN 'mpegts' ELSE CASE WHEN k % 11 = 0 THEN 'vid' ELSE 'matroska' END END"
DV = "CASE WHEN k % 5 = 0 THEN 5 + k % 4 END"
RATE = ("CASE k % 5 WHEN 0 THEN CAST(24000 AS DOUBLE) / CAST(1001 AS DOUBLE) WHEN 1 THEN CAST(25 AS DOUBLE) "
        "WHEN 3 THEN CAST(50 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")
SIZE = "CASE WHEN k % 5 = 0 THEN size ELSE size + 7 END"
DUR = "CASE WHEN k % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE duration_seconds END"
KNOWN = " + ".join(f"CASE WHEN {i} < k % 6 AND (k + {i}) % 2 = 0 THEN {100000 * (i + 1)} ELSE 0 END" for i in range(5))
BPS = f"""CASE k % 4 WHEN 0 THEN 1000000 + k WHEN 1 THEN 3000000 + k - ({KNOWN}) WHEN 2 THEN 100
  ELSE CASE WHEN {DUR} > 0 THEN CAST(floor(({SIZE}) * 8 / ({DUR})) AS BIGINT) ELSE 0 END END"""
CREATED = """CASE k % 5 WHEN 0 THEN epoch(TIMESTAMP '2020-03-04 05:06:07') WHEN 1 THEN epoch(TIMESTAMP '2019-02-03 04:05:06')
  WHEN 2 THEN epoch(TIMESTAMP '2018-01-02 01:04:05') END"""


def _docs(t):
    return pj.split_probe_errors(pj.parse_probe_text(t.probe_docs()))


def _normal(t):
    return pr.normalize(_docs(t)[0])


@query("read_probe_json", "fx_doc_files", """
SELECT path, CASE WHEN k % 37 = 0 THEN 'not json' WHEN k % 41 = 0 THEN 'no video stream' ELSE 'ok' END AS outcome,
  CASE WHEN k % 37 <> 0 AND k % 41 <> 0 THEN 1 + k % 6 + least(k % 4, 3) END AS n_streams FROM fx_doc_files""")
def read_probe_json(t):
    tagged = pj.tag_probe_errors(pj.parse_probe_text(t.probe_docs()))
    return tagged.select("path", F.coalesce("reason", F.lit("ok")).alias("outcome"),
                         F.when(F.col("reason").isNull(), F.size("streams").cast("long")).alias("n_streams"))


def _probe_column(name, expr, pick):
    @query(name, "fx_doc_files", f"SELECT path, {expr} FROM fx_doc_files WHERE {GOOD}")
    def run(t):
        return _normal(t).select("path", *pick())
    return run


_probe_column("probe_primary_video", "video_codec, CASE WHEN height >= 1440 THEN 3840 ELSE 1920 END AS width, height",
              lambda: ["video_codec", "width", "height"])
_probe_column("probe_bit_depth", f"{DEPTH} AS bit_depth", lambda: ["bit_depth"])
_probe_column("probe_container", f"{BOX} AS container", lambda: ["container"])
_probe_column("probe_dv_profile", f"CAST({DV} AS INTEGER) AS dv_profile", lambda: ["dv_profile"])
_probe_column("probe_hdr", f"{HDR} AS is_hdr", lambda: ["is_hdr"])
_probe_column("probe_creation_time", f"CAST({CREATED} AS BIGINT) AS created_s",
              lambda: [F.unix_seconds("creation_time").alias("created_s")])
_probe_column("probe_frame_rate", f"{RATE} AS frame_rate", lambda: ["frame_rate"])
_probe_column("probe_video_bitrate", f"CAST({BPS} AS BIGINT) AS video_bitrate", lambda: ["video_bitrate"])
_probe_column(
    "probe_normalize",
    f"""{SIZE} AS size, mtime, {DUR} AS duration_seconds, {BOX} AS container, video_codec, height,
    {RATE} AS frame_rate, {DEPTH} AS bit_depth, CAST({BPS} AS BIGINT) AS video_bitrate, {HDR} AS is_hdr,
    CAST(k % 6 AS INTEGER) AS n_audio, CAST(k % 4 AS INTEGER) AS n_subs, CAST({DV} AS INTEGER) AS dv_profile""",
    lambda: ["size", "mtime", "duration_seconds", "container", "video_codec", "height", "frame_rate",
             "bit_depth", "video_bitrate", "is_hdr", F.size("audio_tracks").alias("n_audio"),
             F.size("subtitle_tracks").alias("n_subs"), "dv_profile"])


@query("probe_audio_tracks", "fx_audio_rows fx_doc_files", f"""
SELECT d.path, CAST(a.pos AS INTEGER) AS pos, CAST(a.pos + 1 AS INTEGER) AS stream_index, a.codec, a.lang, a.channels, a.title, a.is_default,
  CASE WHEN (a.k + a.pos) % 2 = 0 THEN CAST(100000 * (a.pos + 1) AS BIGINT) END AS bitrate
FROM fx_audio_rows a JOIN fx_doc_files d ON d.k = a.k WHERE a.k % 37 <> 0 AND a.k % 41 <> 0""")
def probe_audio_tracks(t):
    rows = _normal(t).select("path", F.posexplode("audio_tracks").alias("pos", "a"))
    return rows.select("path", "pos", F.col("a.index").alias("stream_index"), "a.codec",
                       F.col("a.language").alias("lang"), "a.channels", "a.title",
                       F.col("a.default").alias("is_default"), "a.bitrate")


@query("probe_subtitle_tracks", "fx_sub_rows fx_doc_files", """
SELECT d.path, CAST(a.pos AS INTEGER) AS pos, CAST(a.pos + 6 AS INTEGER) AS stream_index, a.codec, a.lang,
  (a.k + a.pos) % 5 = 0 AS forced
FROM fx_sub_rows a JOIN fx_doc_files d ON d.k = a.k WHERE a.k % 37 <> 0 AND a.k % 41 <> 0""")
def probe_subtitle_tracks(t):
    rows = _normal(t).select("path", F.posexplode("subtitle_tracks").alias("pos", "a"))
    return rows.select("path", "pos", F.col("a.index").alias("stream_index"), "a.codec",
                       F.col("a.language").alias("lang"), "a.forced")


@query("probe_roundtrip", "fx_doc_files", f"""
SELECT path, {SIZE} AS size, video_codec, CAST(k % 6 AS INTEGER) AS n_audio, CAST({CREATED} AS BIGINT) AS created_s, TRUE AS same
FROM fx_doc_files WHERE {GOOD}""")
def probe_roundtrip(t):
    """Probes to JSON text and back; `same` compares the text of both."""
    rows = pj.probes_from_json(pj.probes_to_json(_normal(t)), keep=["probe_json"])
    again = F.to_json(F.struct(*[c for c in rows.columns if c != "probe_json"]))
    return rows.select("path", "size", "video_codec", F.size("audio_tracks").alias("n_audio"),
                       F.unix_seconds("creation_time").alias("created_s"), (again == F.col("probe_json")).alias("same"))


@query("resolution_class", "fx_probes", """
SELECT CASE WHEN height <= 0 THEN 'unknown' WHEN height <= 480 THEN '480p' WHEN height <= 720 THEN '720p'
  WHEN height <= 1080 THEN '1080p' WHEN height <= 1440 THEN '1440p' ELSE '2160p' END AS resolution,
  count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM fx_probes GROUP BY 1""")
def resolution_class(t):
    return t.probes().groupBy(pr.resolution_class(F.col("height")).alias("resolution")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("tier_of_height", "fx_probes", """
SELECT CASE WHEN height >= 1440 THEN 'UHD' WHEN height >= 720 THEN 'HD' ELSE 'SD' END AS tier,
  count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM fx_probes GROUP BY 1""")
def tier_of_height(t):
    return t.probes().groupBy(pr.tier_of_height(F.col("height")).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


# ---------------------------------------------------------------- incremental

MIN = 5000000000


def _listing(t):
    return t.get("fx_listing")


def _known(t):
    return t.probes().select("path", "size", "mtime")


@query("size_gate", "fx_listing", f"""
SELECT CASE WHEN size < {MIN} THEN 'skip' ELSE 'take' END AS side, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes
FROM fx_listing GROUP BY 1""")
def size_gate(t):
    take, skip = inc.size_gate(_listing(t), MIN)
    both = take.withColumn("side", F.lit("take")).unionByName(skip.withColumn("side", F.lit("skip")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("probe_cache_lookup", "fx_listing fx_probes", """
SELECT l.path, l.size, p.path IS NOT NULL AS cache_hit FROM fx_listing l
LEFT JOIN fx_probes p ON p.path = l.path AND p.size = l.size AND p.mtime = l.mtime""")
def probe_cache_lookup(t):
    return inc.probe_cache_lookup(_listing(t), _known(t)).select("path", "size", "cache_hit")


@query("probe_delta", "fx_listing fx_probes", """
SELECT path, size, mtime FROM fx_listing l WHERE NOT EXISTS (
  SELECT 1 FROM fx_probes p WHERE p.path = l.path AND p.size = l.size AND p.mtime = l.mtime)""")
def probe_delta(t):
    return inc.probe_delta(_listing(t), _known(t)).select("path", "size", "mtime")


@query("probe_delta_bucketed", "fx_listing fx_probes", """
SELECT path, size, mtime FROM fx_listing l WHERE NOT EXISTS (
  SELECT 1 FROM fx_probes p WHERE p.path = l.path AND p.size = l.size AND p.mtime = l.mtime)""")
def probe_delta_bucketed(t):
    """The same over tables that are kept in buckets of path: the join needs no exchange."""
    listing, known = (buckets.bucketed(df, name, buckets=8) for df, name in ((_listing(t), "listing"), (_known(t), "probes")))
    return inc.probe_delta(listing, known).select("path", "size", "mtime")


@query("probe_upsert", "fx_listing fx_probes", """
SELECT path, size, mtime, last_probed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_probed_at DESC) AS rn FROM (
    SELECT path, size, mtime, CAST(100 AS DOUBLE) AS last_probed_at FROM fx_probes
    UNION ALL SELECT path, size, mtime, CAST(200 AS DOUBLE) FROM fx_listing) u) v WHERE rn = 1""")
def probe_upsert(t):
    return inc.probe_upsert(_known(t).withColumn("last_probed_at", F.lit(100.0)),
                            _listing(t).withColumn("last_probed_at", F.lit(200.0)))


@query("skip_upsert_evict", "fx_listing fx_probes fx_decisions fx_skipped", f"""
WITH_PLACE
SELECT 'probes' AS tbl, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM fx_probes WHERE path NOT IN (SELECT path FROM small)
UNION ALL SELECT 'decisions', count(*), CAST(sum(id) AS BIGINT) FROM fx_decisions WHERE path NOT IN (SELECT path FROM small)
UNION ALL SELECT 'skipped', count(*), CAST(sum(last_seen_at) AS BIGINT) FROM (
  SELECT path, max(last_seen_at) AS last_seen_at FROM (
    SELECT path, last_seen_at FROM fx_skipped UNION ALL SELECT path, CAST(999999 AS DOUBLE) FROM small) u GROUP BY path) v
""".replace("WITH_PLACE", f", small AS (SELECT path FROM fx_listing WHERE size < {MIN})"))
def skip_upsert_evict(t):
    """Sizes of the three tables after small files are set aside."""
    small = inc.size_gate(_listing(t), MIN)[1]
    probes, decisions, skipped = inc.skip_upsert_evict(
        _known(t), t.get("fx_decisions"), t.get("fx_skipped"), small, 999999.0)

    def size(df, name, col):
        return df.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"),
                      F.sum(col).cast("long").alias("total"))
    return size(probes, "probes", "size").unionByName(size(decisions, "decisions", "id")).unionByName(
        size(skipped, "skipped", "last_seen_at"))


@query("skip_clear", "fx_listing fx_skipped", f"""
SELECT path, size, last_seen_at FROM fx_skipped WHERE path NOT IN (SELECT path FROM fx_listing WHERE size >= {MIN})""")
def skip_clear(t):
    return inc.skip_clear(t.get("fx_skipped"), inc.size_gate(_listing(t), MIN)[0]).select(
        "path", "size", "last_seen_at")


@query("skip_lookup_count", "fx_listing fx_skipped", """
SELECT count(*) AS n_listed, (SELECT count(*) FROM fx_skipped) AS n_skipped
FROM fx_listing WHERE path IN (SELECT path FROM fx_skipped)""")
def skip_lookup_count(t):
    skipped = t.get("fx_skipped")
    return inc.skip_lookup(_listing(t), skipped).agg(F.count(F.lit(1)).alias("n_listed")).withColumn(
        "n_skipped", inc.skip_count(skipped).scalar())


@query("stale_prune", "fx_listing fx_probes fx_decisions", """
SELECT 'probes' AS tbl, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM fx_probes WHERE path IN (SELECT path FROM fx_listing)
UNION ALL SELECT 'decisions', count(*), CAST(sum(id) AS BIGINT) FROM fx_decisions WHERE path IN (SELECT path FROM fx_listing)""")
def stale_prune(t):
    probes = inc.stale_prune(t.probes(), _listing(t)).agg(
        F.lit("probes").alias("tbl"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))
    decisions = inc.stale_prune(t.get("fx_decisions"), _listing(t)).agg(
        F.lit("decisions").alias("tbl"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    return probes.unionByName(decisions)


@query("scan_summary", "fx_listing fx_probes", f"""
SELECT count(*) AS seen, count(*) FILTER (WHERE l.size >= {MIN} AND NOT hit AND NOT failed) AS probed,
  count(*) FILTER (WHERE l.size >= {MIN} AND hit) AS cache_hits, count(*) FILTER (WHERE l.size < {MIN}) AS size_skipped,
  count(*) FILTER (WHERE l.size >= {MIN} AND NOT hit AND failed) AS errors
FROM (SELECT l.size, p.path IS NOT NULL AS hit, e.path IS NOT NULL AS failed FROM fx_listing l
  LEFT JOIN fx_probes p ON p.path = l.path AND p.size = l.size AND p.mtime = l.mtime
  LEFT JOIN (SELECT path FROM fx_probes WHERE st = 'F') e ON e.path = l.path) l""")
def scan_summary(t):
    failed = t.probes().filter("st = 'F'").select("path")
    return inc.scan_summary(_listing(t), _known(t), failed, MIN)


@query("scan_tree", "", """
SELECT concat('/event_type=', event_type, '/part=', user_id % 8) AS dir, CAST(1 AS BIGINT) AS n_files, CAST(0 AS BIGINT) AS n_empty, CAST(0 AS BIGINT) AS n_underscore
FROM events GROUP BY ALL UNION ALL SELECT '', 1, 1, 1""")
def scan_tree(t):
    """A tree of files that Spark writes, one for each kind of event and share of users, listed with its empty marker."""
    where = f"{shared_dir(t.spark)}/tree-{uuid.uuid4().hex}"
    rows = t.given("events").withColumn("part", F.col("user_id") % 8)
    rows.repartition("event_type", "part").write.partitionBy("event_type", "part").parquet(where)
    listing, _ = tree.split_errors(tree.read_tree(t.spark, where, parts=16))
    name, root = F.element_at(F.split("path", "/"), -1), where.removeprefix("file://")
    inner = F.expr(f"substring(path, {len(root) + 1})").alias("inner")
    rows = listing.filter(~name.startswith(".")).select(inner, "size", name.alias("name"))  # checksums are there on local disks only
    return rows.groupBy(F.regexp_replace("inner", "/[^/]*$", "").alias("dir")).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("size") == 0).alias("n_empty"), F.count_if(F.col("name").startswith("_")).alias("n_underscore"))


@query("read_write_state", "fx_listing fx_probes fx_decisions fx_skipped fx_runs", """
SELECT 'probes' AS tbl, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM (
  SELECT p.path, CASE WHEN l.path IS NULL THEN p.size ELSE l.size END AS size FROM fx_probes p FULL JOIN fx_listing l ON l.path = p.path) u
UNION ALL SELECT 'decisions', count(*), CAST(sum(id) AS BIGINT) FROM fx_decisions
UNION ALL SELECT 'runs', count(*), CAST(sum(started_at) AS BIGINT) FROM fx_runs
UNION ALL SELECT 'skipped_files', count(*), CAST(sum(size) AS BIGINT) FROM fx_skipped""")
def read_write_state(t):
    """Write the four state tables, upsert the probes once more, read all back."""
    state = State(t.spark, f"{shared_dir(t.spark)}/state-{uuid.uuid4().hex}", parts=16)
    state.write("probes", _state_probes(t.nested_probes(), 1.0))
    fresh = _state_probes(_listing(t), 2.0)
    state.update("probes", fresh, inc.probe_upsert)
    state.write("decisions", t.get("fx_decisions").select(
        "id", "path", "decided_at", F.array().cast("array<string>").alias("rules_fired"),
        F.lit("av1+mkv").alias("target"), F.col("projected_savings_mb").cast("double").alias("projected_savings_mb"),
        "status", "output_path", F.col("actual_savings_mb").cast("double").alias("actual_savings_mb"), "error", "run_id"))
    state.write("runs", t.get("fx_runs").select(
        F.col("run_id").alias("id"), F.lit("apply").alias("kind"), "started_at", "ended_at",
        F.lit(None).cast("string").alias("root"), F.lit(None).cast("map<string,string>").alias("args"),
        F.create_map(F.lit("applied"), "applied", F.lit("failed"), "failed").alias("summary")))
    state.write("skipped_files", t.get("fx_skipped"))
    out = None
    for name, col in (("probes", "size"), ("decisions", "id"), ("runs", "started_at"), ("skipped_files", "size")):
        part = state.read(name).agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"),
                                    F.sum(col).cast("long").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def _state_probes(df, at):
    """Fill the columns a projection lacks, in table order."""
    fields = df.sparkSession.createDataFrame([], TABLES["probes"][0]).schema.fields
    have = set(df.columns)
    return df.select(*[
        F.lit(at).alias("last_probed_at") if f.name == "last_probed_at"
        else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields])
