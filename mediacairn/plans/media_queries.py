"""Track, naming, rename and recycle queries."""

import re

from pyspark.sql import functions as F

from ..functions import fixed, naming as n, tracks as tf
from ..operators import renames as rn, tracks as tk
from .registry import query, sql_case, sql_list

LANGS = ["en", "und"]
WANT = ["en", "eng", "und"]

# ---------------------------------------------------------------- tracks, as rows

RANK = sql_case("codec", fixed.CODEC_RANK, "10")
LOSSLESS = "(codec IN ('truehd', 'mlp', 'flac') OR codec LIKE 'pcm_%' OR (codec = 'dts' AND channels >= 6))"


def eligible_sql(table):
    return f"""
  SELECT * FROM (SELECT *, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS any_hit,
      min(CASE WHEN plain THEN pos END) OVER (PARTITION BY k) AS first_plain
    FROM (SELECT *, plain AND (coalesce(lower(lang), '') IN {sql_list(WANT)} OR (NOT any_def AND pos = 0)) AS hit
      FROM (SELECT *, NOT coalesce(lower(title) LIKE '%commentary%', FALSE) AS plain,
          bool_or(is_default) OVER (PARTITION BY k) AS any_def, {RANK} AS rnk, {LOSSLESS} AS loss FROM {table}) a) b) c
  WHERE CASE WHEN any_hit = 1 THEN hit ELSE pos = coalesce(first_plain, 0) END"""


BEST = "loss DESC, rnk DESC, channels DESC, is_default DESC, pos"


def ladder_ctes(table):
    return f"""
, el AS ({eligible_sql(table)}),
s0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {BEST}) AS rn FROM el) q WHERE rn = 1),
rest AS (SELECT el.* FROM el JOIN s0 ON s0.k = el.k AND s0.pos <> el.pos),
s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {BEST}) AS rn FROM rest WHERE channels = 6) q WHERE rn = 1),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {BEST}) AS rn FROM rest WHERE channels = 2) q WHERE rn = 1),
slots AS (
  SELECT k, 0 AS ord, 'copy' AS kind, pos AS src_pos, codec, channels, lang, title FROM s0
  UNION ALL SELECT s0.k, 1, CASE WHEN s1.k IS NULL THEN 'opus51' ELSE 'copy' END, coalesce(s1.pos, s0.pos),
    coalesce(s1.codec, s0.codec), coalesce(s1.channels, s0.channels), CASE WHEN s1.k IS NULL THEN s0.lang ELSE s1.lang END,
    CASE WHEN s1.k IS NULL THEN s0.title ELSE s1.title END
    FROM s0 LEFT JOIN s1 ON s1.k = s0.k WHERE s1.k IS NOT NULL OR s0.channels >= 6
  UNION ALL SELECT s0.k, 2, CASE WHEN s2.k IS NULL THEN 'aac20' ELSE 'copy' END, coalesce(s2.pos, s0.pos),
    coalesce(s2.codec, s0.codec), coalesce(s2.channels, s0.channels), CASE WHEN s2.k IS NULL THEN s0.lang ELSE s2.lang END,
    CASE WHEN s2.k IS NULL THEN s0.title ELSE s2.title END
    FROM s0 LEFT JOIN s2 ON s2.k = s0.k WHERE s2.k IS NOT NULL OR s0.channels > 2 OR s0.loss),
ladder AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY ord) - 1 AS INTEGER) AS slot, kind, CAST(src_pos AS INTEGER) AS src_pos,
  codec, channels, lang, title FROM slots)
"""


def _tracks(t):
    return t.get("fx_tracks")


@query("expand_languages", "fx_audio_rows", """
SELECT k, pos, CASE lower(lang) WHEN 'eng' THEN 'en,eng' WHEN 'fre' THEN 'fr,fre' WHEN 'en' THEN 'en,eng'
  WHEN 'spa' THEN 'es,spa' WHEN 'jpn' THEN 'ja,jpn' WHEN 'und' THEN 'und' ELSE '' END AS codes FROM fx_audio_rows""")
def expand_languages(t):
    rows = t.nested_probes().select("k", F.posexplode("audio_tracks").alias("pos", "a"))
    langs = F.when(F.col("a.language").isNull(), F.array().cast("array<string>")).otherwise(F.array("a.language"))
    return rows.select("k", "pos", F.array_join(tf.expand_languages_column(langs), ",").alias("codes"))


@query("eligible_tracks", "fx_tracks", ", el AS (" + eligible_sql("fx_tracks") + ") SELECT k, pos, codec, channels FROM el")
def eligible_tracks(t):
    return tk.eligible_tracks(_tracks(t), LANGS).select("k", "pos", "codec", "channels")


@query("track_quality", "fx_tracks", f"SELECT k, pos, {LOSSLESS} AS lossless, CAST({RANK} AS INTEGER) AS rank, channels, is_default FROM fx_tracks")
def track_quality(t):
    return tk.track_quality(_tracks(t)).select("k", "pos", "lossless", "rank", "channels", "is_default")


@query("audio_ladder", "fx_tracks", ladder_ctes("fx_tracks") + "SELECT k, slot, kind, src_pos, codec, channels FROM ladder")
def audio_ladder(t):
    """From one row per track: aggregates and joins on per-file summaries."""
    return tk.audio_ladder(_tracks(t), LANGS).select("k", "slot", "kind", "src_pos", "codec", "channels")


@query("audio_ladder_nested", "fx_audio_rows",
       ladder_ctes("fx_audio_rows") + "SELECT k, slot, kind, src_pos, codec, channels FROM ladder")
def audio_ladder_nested(t):
    """From track arrays inside the probe: no shuffle."""
    return tk.ladder_rows(t.nested_probes(), LANGS, key="k").select(
        "k", "slot", "kind", "src_pos", "codec", "channels")


@query("audio_best_only", "fx_tracks", ladder_ctes("fx_tracks") + "SELECT k, CAST(src_pos AS INTEGER) AS src_pos, codec FROM slots WHERE ord = 0")
def audio_best_only(t):
    return tk.audio_ladder(_tracks(t), LANGS, add_compat=False).select("k", "src_pos", "codec")


@query("ladder_settings", "fx_audio_rows", ladder_ctes("fx_audio_rows") + """
SELECT k, slot, kind, src_pos, CASE kind WHEN 'copy' THEN 'copy' WHEN 'opus51' THEN 'libopus' ELSE 'aac' END AS out_codec,
  CASE kind WHEN 'opus51' THEN 384 WHEN 'aac20' THEN 256 END AS bitrate_k,
  CAST(CASE kind WHEN 'copy' THEN channels WHEN 'opus51' THEN 6 ELSE 2 END AS INTEGER) AS out_channels,
  coalesce(lower(lang), 'und') AS out_language,
  CASE kind WHEN 'copy' THEN title WHEN 'opus51' THEN 'Opus 5.1 (compat)' ELSE 'AAC 2.0 (compat)' END AS out_title,
  slot = 0 AS is_default_out FROM ladder""")
def ladder_settings(t):
    rows = tk.ladder_settings(tk.ladder_rows(t.nested_probes(), LANGS, key="k"))
    return rows.select("k", "slot", "kind", "src_pos", "out_codec", "bitrate_k", "out_channels",
                       "out_language", "out_title", "is_default_out")


SUB_OK = f"coalesce(lower(lang), '') IN {sql_list(WANT)}"


@query("subtitle_selection", "fx_sub_rows", f"""
SELECT k, CAST(row_number() OVER (PARTITION BY box, k ORDER BY pos) - 1 AS INTEGER) AS out_idx, CAST(pos AS INTEGER) AS src_pos, codec,
  coalesce(lower(lang), 'und') AS out_language, box, CASE box WHEN 'mkv' THEN 'copy' ELSE 'mov_text' END AS out_codec
FROM (SELECT *, 'mkv' AS box FROM fx_sub_rows UNION ALL SELECT *, 'mp4' FROM fx_sub_rows) s
WHERE {SUB_OK} AND NOT (box = 'mp4' AND codec IN {sql_list(fixed.IMAGE_SUBTITLE_CODECS)})""")
def subtitle_selection(t):
    probes = t.nested_probes()
    mkv = tk.subtitle_selection(probes, LANGS, "mkv", key="k").withColumn("box", F.lit("mkv"))
    mp4 = tk.subtitle_selection(probes, LANGS, "mp4", key="k").withColumn("box", F.lit("mp4"))
    return mkv.unionByName(mp4)


KEPT = ladder_ctes("fx_audio_rows") + f""", kept AS (
  SELECT DISTINCT k, 'audio' AS kind, src_pos AS pos FROM ladder
  UNION ALL SELECT k, 'sub', CAST(pos AS INTEGER) FROM fx_sub_rows WHERE {SUB_OK}),
every AS (SELECT k, 'audio' AS kind, CAST(pos AS INTEGER) AS pos FROM fx_audio_rows UNION ALL SELECT k, 'sub', CAST(pos AS INTEGER) FROM fx_sub_rows)
"""


def _usage(t, audio, subs):
    def of(kind, column):
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("pos")))
    rows = tk.stream_usage(t.nested_probes(), LANGS)
    return rows.select("k", F.inline(F.concat(of("audio", audio), of("sub", subs))))


@query("kept_streams", "fx_audio_rows fx_sub_rows", KEPT + "SELECT k, kind, pos FROM kept")
def kept_streams(t):
    return _usage(t, "kept_audio", "kept_subs")


@query("discarded_streams", "fx_audio_rows fx_sub_rows", KEPT + """
SELECT e.k, e.kind, e.pos FROM every e WHERE NOT EXISTS (
  SELECT 1 FROM kept s WHERE s.k = e.k AND s.kind = e.kind AND s.pos = e.pos)""")
def discarded_streams(t):
    return _usage(t, "dropped_audio", "dropped_subs")


@query("track_stats", "fx_tracks", """
SELECT codec, coalesce(lang, 'und') AS lang, channels, count(*) AS n_tracks FROM fx_tracks GROUP BY 1, 2, 3""")
def track_stats(t):
    return tk.track_stats(_tracks(t))


# ---------------------------------------------------------------- names

# Stems are made of titles of the tables and of tokens, spelled from the fixed patterns and drawn by row number; the check
# puts the expected name together from the same parts.


def spelled(pattern):
    """One plain spelling of a token's pattern."""
    for regex, text in ((r"\\\.\?", "."), (r"\[\. _-\]\?", "."), (r"-\?", "-"), (r"\(\?:video\)\?", "video"), (r"\[0-9\]\?", "3"), (r"\\\+", "+")):
        pattern = re.sub(regex, text, pattern)
    return pattern


def drawn(values, number):
    """SQL: the value that a row's number draws."""
    arms = " ".join(f"WHEN {i} THEN {_quote(v)}" for i, v in enumerate(values))
    return f"CASE CAST(floor({number}) AS BIGINT) % {len(values)} {arms} END"


def _quote(s):
    return "'" + s.replace("'", "''") + "'"


def token_stems(codec):
    """SQL columns over `orders` joined to a title of `part`: title, joint, and the drawn tokens."""
    foreign = [spelled(x) for x in fixed.FOREIGN_TOKENS[codec]]
    lost = [spelled(x) for x in fixed.LOST_METADATA_TOKENS["av1"]]
    return (f"o_orderkey AS k, p_name AS title, CASE o_orderkey % 3 WHEN 0 THEN '.' WHEN 1 THEN ' ' ELSE '_' END AS joint, "
            f"{drawn(foreign, 'o_orderkey / 3e0')} AS one, {drawn(foreign, 'o_orderkey / 7e0')} AS two, {drawn(lost, 'o_orderkey / 5e0')} AS lost, "
            f"CAST(floor(o_orderkey / 11e0) AS BIGINT) % 7 AS shape, CAST(1950 + o_custkey % 70 AS STRING) AS year")


#: shape -> parts of a stem, joined by the row's joint; and of the name it becomes, joined by dots.
SHAPES = {
    0: (["title", "one"], ["title"]),
    1: (["title", "year", "concat(one, '+', two)"], ["title", "year"]),
    2: (["title", "concat('[', two, ']')", "'5.1'"], ["title", "'5.1'"]),
    3: (["title", "lost", "one", "'DTS'"], ["title", "kept", "'DTS'"]),
    4: (["concat(title, ' (', year, ')')", "'HDR'", "lost", "concat(one, '-', 'Crew')"], ["concat(title, ' (', year, ')')", "named"]),
    5: (["title", "year"], ["title", "year"]),
    6: (["title", "lost", "lost", "two", "'Opus'"], ["title", "twice", "'Opus'"]),
}


def _joined(side, joint):
    arms = " ".join(f"WHEN {i} THEN concat_ws({joint}, {', '.join(parts[side])})" for i, parts in SHAPES.items())
    return f"CASE shape {arms} END"


def name_check(codec, token):
    """What the parts must become: spaces and underscores are dots, the codec's token comes last."""
    av1 = codec == "av1"
    kept, named = ("'HDR10'", "'HDR-Crew'") if av1 else ("lost", "concat('HDR.', lost, '-Crew')")
    twice = "'HDR10'" if av1 else "concat(lost, '.', lost)"
    body = _joined(1, "'.'")
    return f"""
SELECT k, stem, concat(regexp_replace(replace(body, ' ', '.'), '_', '.', 'g'), '.{token}') AS new_stem
FROM (SELECT k, {_joined(0, 'joint')} AS stem, {body} AS body
      FROM (SELECT *, {kept} AS kept, {named} AS named, {twice} AS twice
            FROM (SELECT {token_stems(codec)} FROM orders JOIN part ON p_partkey = o_orderkey % 200) a) b) c"""


def _token_stems(t, codec):
    rows = t.given("orders").join(t.spark.read.parquet(f"{t.dir}/part.parquet"), F.expr("p_partkey = o_orderkey % 200"))
    return t.spark.sql(f"SELECT k, {_joined(0, 'joint')} AS stem FROM (SELECT {token_stems(codec)} FROM {{rows}}) a", rows=rows)


STRIPPED = [
    ("Amber.Mill.480p.x264-JAY", "Amber.Mill.480p.-JAY"), ("A.HEVC+H.265", "A.+"),
    ("HEVCX.8", "HEVCX.8"), ("B.MPEG-2.AC3", "B..AC3"), ("C.WMV9.h264.D", "C...D"), ("D.MPEG 2video", "D."),
]
HDR_NAMES = [
    ("M.DV.HDR10Plus.X", "M.HDR10..X"), ("M.HDR10.DV", "M.HDR10."), ("M.HDR10+.X", "M.HDR10.X"),
    ("M.Dolby Vision.DoVi", "M.HDR10."), ("M.SDR.DVD", "M.SDR.DVD"), ("M.hdr.dv.X", "M.hdr..X"),
]
CLEANED = [
    ("A..B", "A.B"), ("A  B", "A B"), ("A [ ] B", "A  B"), ("A - B", "A- B"), ("A.-B", "A-B"),
    ("A.+.B", "A.B"), ("A(  )", "A"), ("A . B", "A. B"), ("A_+", "A"), ("A+B", "A+B"),
]


def _pick(pairs, side, col="k"):
    arms = " ".join(f"WHEN {i} THEN {_quote(x[side])}" for i, x in enumerate(pairs))
    return f"concat('T', CAST({col} AS STRING), '.', CASE {col} % {len(pairs)} {arms} END)"


def _stems(t, pairs):
    return t.given("orders").selectExpr("o_orderkey AS k", _pick(pairs, 0, "o_orderkey") + " AS stem")


def _golden_check(pairs, out):
    return f"SELECT o_orderkey AS k, {_pick(pairs, 0, 'o_orderkey')} AS stem, {_pick(pairs, 1, 'o_orderkey')} AS {out} FROM orders"


@query("rewrite_name", "", name_check("av1", "AV1"))
def rewrite_name(t):
    return n.rewrite_name(_token_stems(t, "av1"), "stem", "new_stem")


@query("rewrite_name_hevc", "", name_check("hevc", "HEVC"))
def rewrite_name_hevc(t):
    return n.rewrite_name(_token_stems(t, "hevc"), "stem", "new_stem", "hevc")


@query("strip_foreign_tokens", "", _golden_check(STRIPPED, "out"))
def strip_foreign_tokens(t):
    return _stems(t, STRIPPED).withColumn("out", n.strip_foreign_tokens(F.col("stem"), "av1"))


@query("substitute_hdr_tokens", "", _golden_check(HDR_NAMES, "out"))
def substitute_hdr_tokens(t):
    return _stems(t, HDR_NAMES).withColumn("out", n.substitute_hdr_tokens(F.col("stem"), "av1"))


@query("cleanup_separators", "", _golden_check(CLEANED, "out"))
def cleanup_separators(t):
    return _stems(t, CLEANED).withColumn("out", n.cleanup_separators(F.col("stem")))


STYLES = [("A B_C", ""), ("A.B.C", ""), ("A.B C D", ""), ("plain", ""), ("x__y  .z.", "")]


def _style_check(expr, out):
    return f"SELECT k, {expr} AS {out} FROM (SELECT o_orderkey AS k, {_pick(STYLES, 0, 'o_orderkey')} AS stem FROM orders) q"


DOTTED = r"(length(stem) - length(replace(stem, '.', '')) > length(stem) - length(regexp_replace(stem, '\s', '', 'g')) AND stem LIKE '%.%')"


@query("looks_dotted", "", _style_check(DOTTED, "dotted"))
def looks_dotted(t):
    return _stems(t, STYLES).select("k", n.looks_dotted(F.col("stem")).alias("dotted"))


@query("to_dotted", "", _style_check(
    r"trim(regexp_replace(regexp_replace(stem, '[\s_]+', '.', 'g'), '\.{2,}', '.', 'g'), '.')", "out"))
def to_dotted(t):
    return _stems(t, STYLES).select("k", n.to_dotted(F.col("stem")).alias("out"))


@query("append_token", "", _style_check(
    f"concat(stem, CASE WHEN {DOTTED} THEN '.' ELSE ' ' END, 'REENCODE')", "out"))
def append_token(t):
    return _stems(t, STYLES).select("k", n.append_token(F.col("stem"), "REENCODE").alias("out"))


@query("output_path", "fx_probes", """
SELECT path, concat(dir, '/', fin) AS beside, concat('/out', CASE WHEN dir LIKE '/lib1/%' THEN substr(dir, 6) ELSE dir END, '/', fin) AS side,
  concat(dir, '/', left(name, length(name) - 4), '.mp4') AS plain_mp4
FROM (SELECT *, CASE WHEN name LIKE '%.AV1.REENCODE.mkv' THEN concat('t', k, '.AV1.REENCODE.REENCODE.mkv')
    WHEN name LIKE '%-trailer.mkv' THEN concat('t', k, '-trailer.AV1.REENCODE.mkv') ELSE concat('t', k, '.AV1.REENCODE.mkv') END AS fin
  FROM fx_probes) q""")
def output_path(t):
    rows = rn.output_path(t.probes()).withColumnRenamed("output_path", "beside")
    rows = rn.output_path(rows, mode="side", source_root="/lib1", output_root="/out").withColumnRenamed("output_path", "side")
    rows = rn.output_path(rows, target="hevc+mp4", rewrite=False, tag=False)
    return rows.select("path", "beside", "side", F.col("output_path").alias("plain_mp4"))


# ---------------------------------------------------------------- renames

TREE = r"""
, tree AS MATERIALIZED (SELECT path FROM fx_tree),
files AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS name FROM tree),
parts AS (SELECT *, regexp_extract(name, '^.+(\.[^.]+)$', 1) AS ext FROM files),
stems AS (SELECT *, left(name, length(name) - length(ext)) AS stem FROM parts),
cleaned AS (SELECT *, replace(replace(replace(replace(replace(replace(stem, '.DV.HDR10Plus.+.AV1', '.HDR10.AV1'),
    '.VC-1.AV1', '.AV1'), 'Qux_2011.HEVC.AV1', 'Qux.2011.AV1'), '.H.265+x264.AV1', '.AV1'),
    'Foo.2024.DV.AV1', 'Foo.2024.HDR10.AV1'), 'Foo.2024.HDR10Plus.AV1', 'Foo.2024.HDR10.AV1') AS new_stem FROM stems),
tagged AS MATERIALIZED (SELECT *, concat(dir, '/', new_stem, ext) AS new_path FROM cleaned
  WHERE stem LIKE '%.REENCODE' AND lower(ext) IN ('.mkv', '.mp4') AND new_stem <> stem
    AND NOT list_has_any(string_split(dir, '/'), ['@Recycle', '.@__thumb'])),
planned AS MATERIALIZED (SELECT * FROM tagged g WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.path = g.new_path)),
moves AS (SELECT DISTINCT s.path, concat(s.dir, '/', p.new_stem, s.ext) AS new_path FROM stems s JOIN planned p ON p.dir = s.dir AND p.stem = s.stem)
"""


@query("rename_plan", "fx_tree", TREE + "SELECT path, new_path FROM planned")
def rename_plan(t):
    return rn.rename_plan(t.get("fx_tree")).select("path", "new_path")


@query("rename_collisions", "fx_tree", TREE + "SELECT path, new_path FROM tagged g WHERE EXISTS (SELECT 1 FROM tree t WHERE t.path = g.new_path)")
def rename_collisions(t):
    return rn.rename_collisions(t.get("fx_tree"))


@query("rename_sidecars", "fx_tree", TREE + "SELECT path, new_path, EXISTS (SELECT 1 FROM tree t WHERE t.path = m.new_path) AS blocked FROM moves m")
def rename_sidecars(t):
    return rn.rename_sidecars(t.get("fx_tree"))


@query("rename_conflicts", "fx_tree", TREE + """
SELECT path, new_path, n_claims FROM (SELECT *, count(*) OVER (PARTITION BY new_path) AS n_claims FROM moves) q WHERE n_claims > 1""")
def rename_conflicts(t):
    return rn.rename_conflicts(t.get("fx_tree"))


SOURCES = """SELECT k AS turn, concat(dir, '/', CAST(k AS STRING), '/clip', CAST(k % 50 AS STRING), '.mkv') AS path FROM {fx_probes}"""
HELD = """SELECT DISTINCT concat('/recycle/clip', CAST(k % 50 AS STRING),
  CASE WHEN floor(k / 50) = 0 THEN '' ELSE concat('_recycled', CAST(CAST(floor(k / 50) AS BIGINT) AS STRING)) END, '.mkv') AS path
FROM {fx_probes} WHERE st = 'P'"""


@query("recycle_destination", "fx_probes", f"""
, src AS (SELECT turn, path, regexp_extract(path, '[^/]*$') AS name FROM ({SOURCES.format(fx_probes='fx_probes')}) a),
held AS ({HELD.format(fx_probes='fx_probes')}),
names AS (SELECT name, count(*) AS n FROM src GROUP BY name),
slots AS (SELECT name, i AS slot, CASE WHEN i = 0 THEN concat('/recycle/', name) ELSE concat('/recycle/', replace(name, '.mkv', ''), '_recycled', i, '.mkv') END AS dst
  FROM names, LATERAL (SELECT unnest(range(0, 3 * n + 100)) AS i) u),
free AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY slot) AS rn FROM slots WHERE dst NOT IN (SELECT path FROM held)),
asks AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY turn, path) AS rn FROM src)
SELECT asks.turn, asks.path, free.dst AS destination FROM asks JOIN free ON free.name = asks.name AND free.rn = asks.rn""")
def recycle_destination(t):
    """Fifty wanted names for all files, each wanted by very many; some sources are named like a numbered slot."""
    probes = t.probes()
    sources = t.spark.sql(SOURCES, fx_probes=probes)
    held = t.spark.sql(HELD, fx_probes=probes)
    return rn.recycle_destination(sources, held, "/recycle").select("turn", "path", "destination")
