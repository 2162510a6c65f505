"""Catalog-shaped tables projected from the given tables.

Each text runs unchanged in Spark SQL and in the SQL engine used for checking.
`{orders}`, `{events}` and `{fx_...}` stand for tables. Numbers are chosen by
arithmetic on keys so that every case of an operator occurs.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.hotkeys import running

SQL = {}

SQL["fx_probes"] = """
SELECT k, concat(dir, '/', name) AS path, dir, name, video_codec, height, container,
  CAST(duration_i AS DOUBLE) AS duration_seconds, size,
  CASE WHEN duration_i = 0 THEN CAST(0 AS BIGINT)
       ELSE CAST(floor(size * 8 / duration_i) AS BIGINT) END AS video_bitrate,
  CASE WHEN height >= 1440 AND k % 3 = 0 THEN TRUE ELSE FALSE END AS is_hdr,
  CASE WHEN height >= 1440 AND k % 3 = 0 THEN CASE k % 2 WHEN 0 THEN 'smpte2084' ELSE 'arib-std-b67' END END AS color_transfer,
  CASE WHEN height >= 1440 AND k % 5 < 4 THEN 'bt2020' END AS color_primaries,
  CASE WHEN height >= 1440 AND k % 13 = 0 THEN 5 WHEN height >= 1440 AND k % 13 = 1 THEN 7
       WHEN height >= 1440 AND k % 13 = 2 THEN 8 END AS dv_profile,
  CAST(k % 1000 AS DOUBLE) AS mtime, st, prio
FROM (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS prio,
    concat('/lib', CAST(o_custkey % 4 AS STRING), '/d', CAST(o_orderkey % 500 AS STRING)) AS dir,
    concat('t', CAST(o_orderkey AS STRING),
      CASE WHEN o_orderkey % 17 = 0 THEN '-trailer' WHEN o_orderkey % 19 = 0 THEN '.AV1.REENCODE'
           ELSE '.HEVC' END, '.mkv') AS name,
    CASE o_orderkey % 8 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'av1' WHEN 3 THEN 'vc1'
      WHEN 4 THEN 'mpeg2video' WHEN 5 THEN 'vp9' WHEN 6 THEN 'H264' ELSE 'hevc' END AS video_codec,
    CASE o_orderkey % 7 WHEN 0 THEN 480 WHEN 1 THEN 576 WHEN 2 THEN 720 WHEN 3 THEN 1080
      WHEN 4 THEN 1440 WHEN 5 THEN 2160 ELSE 0 END AS height,
    CASE o_orderkey % 5 WHEN 0 THEN 'mkv' WHEN 1 THEN 'mp4' WHEN 2 THEN 'avi' WHEN 3 THEN 'wmv'
      ELSE 'mpegts' END AS container,
    (o_custkey % 11) * 900 AS duration_i,
    CAST(floor(o_totalprice) AS BIGINT) * 100000 AS size
  FROM {orders}) a
"""

# On disk now: some files are gone, some changed, some finished outputs exist.
SQL["fx_listing"] = """
SELECT path, CASE WHEN k % 23 = 0 THEN size + 1 ELSE size END AS size, mtime
FROM {fx_probes} WHERE NOT (st = 'P' AND prio = '5-LOW')
UNION ALL
SELECT concat(dir, '/t', CAST(k AS STRING), '.AV1.REENCODE.mkv') AS path,
  CASE WHEN k % 31 = 1 THEN CAST(0 AS BIGINT) ELSE CAST(floor(size / 2) AS BIGINT) END AS size, mtime
FROM {fx_probes} WHERE name LIKE '%.HEVC.mkv' AND prio = '1-URGENT'
"""

# A walked tree: system and extras directories, sidecars, odd names, empty files.
SQL["fx_tree"] = """
SELECT concat(dir, '/', stem, ext) AS path, size, CAST(k % 1000 AS DOUBLE) AS mtime
FROM (
  SELECT k, dir, stem, CASE k % 6 WHEN 0 THEN '.MKV' WHEN 1 THEN '.mp4' ELSE '.mkv' END AS ext,
    CASE WHEN k % 29 = 0 THEN CAST(0 AS BIGINT) ELSE size END AS size FROM {fx_titles}
  UNION ALL SELECT k, dir, stem, CASE prio WHEN '1-URGENT' THEN '.srt' ELSE '.nfo' END, CAST(4096 AS BIGINT)
    FROM {fx_titles} WHERE prio IN ('1-URGENT', '2-HIGH')
  UNION ALL SELECT k, dir, concat(stem, '.en'), '.srt', CAST(2048 AS BIGINT)
    FROM {fx_titles} WHERE prio = '1-URGENT'
  UNION ALL SELECT k, dir, clean_stem, CASE k % 6 WHEN 0 THEN '.MKV' WHEN 1 THEN '.mp4' ELSE '.mkv' END, size
    FROM {fx_titles} WHERE clean_stem <> stem AND st = 'P' AND prio = '5-LOW'
  UNION ALL SELECT k, dir, concat('T', CAST(k AS STRING), '.Foo.2024.DV.AV1.REENCODE'), '.mkv', size
    FROM {fx_titles} WHERE st = 'O' AND prio = '3-MEDIUM'
  UNION ALL SELECT k, dir, concat('T', CAST(k AS STRING), '.Foo.2024.HDR10Plus.AV1.REENCODE'), '.mkv', size
    FROM {fx_titles} WHERE st = 'O' AND prio = '3-MEDIUM'
  UNION ALL SELECT k, dir, '', '.mkv', size FROM {fx_titles} WHERE st = 'F' AND prio = '4-NOT SPECIFIED'
) f
"""

# Titles with the name they should have after the clean-up; `tagged` = carries REENCODE.
SQL["fx_titles"] = """
SELECT k, dir, concat('T', CAST(k AS STRING), '.', CASE k % 9
    WHEN 0 THEN 'Foo.2024.DV.HDR10Plus.+.AV1.REENCODE' WHEN 1 THEN 'Bar.1999.VC-1.AV1.REENCODE'
    WHEN 2 THEN 'Baz.2010.AV1.REENCODE' WHEN 3 THEN 'Qux_2011.HEVC.AV1.REENCODE'
    WHEN 4 THEN 'Plain.2012.HEVC' WHEN 5 THEN 'Cut-trailer' WHEN 6 THEN 'Trailer Park'
    WHEN 7 THEN 'Old.2001.PREENCODER' ELSE 'Duo.H.265+x264.AV1.REENCODE' END) AS stem,
  concat('T', CAST(k AS STRING), '.', CASE k % 9
    WHEN 0 THEN 'Foo.2024.HDR10.AV1.REENCODE' WHEN 1 THEN 'Bar.1999.AV1.REENCODE'
    WHEN 2 THEN 'Baz.2010.AV1.REENCODE' WHEN 3 THEN 'Qux.2011.AV1.REENCODE'
    WHEN 4 THEN 'Plain.2012.HEVC' WHEN 5 THEN 'Cut-trailer' WHEN 6 THEN 'Trailer Park'
    WHEN 7 THEN 'Old.2001.PREENCODER' ELSE 'Duo.AV1.REENCODE' END) AS clean_stem,
  k % 9 IN (0, 1, 2, 3, 8) AS tagged, dir_kind, st, prio, size
FROM (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS prio, o_custkey % 12 AS dir_kind,
    CAST(floor(o_totalprice) AS BIGINT) * 100000 AS size,
    CASE o_custkey % 12 WHEN 0 THEN '/lib/a/@Recycle' WHEN 1 THEN '/lib/a/Movie X/Trailers'
      WHEN 2 THEN '/lib/b/.@__thumb/x' WHEN 3 THEN '/lib/b/Behind The Scenes'
      WHEN 4 THEN '/lib' WHEN 5 THEN '/library2/c'
      ELSE concat('/lib/c/d', CAST(CAST(floor(o_orderkey / 20) AS BIGINT) AS STRING)) END AS dir
  FROM {orders}) a
"""

SQL["fx_decisions"] = """
SELECT event_id AS id, p.k, p.path, CAST(event_id * 60 AS DOUBLE) AS decided_at, event_id % 40 AS run_id,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
    WHEN 'view' THEN 'skipped' ELSE 'pending' END AS status,
  CASE WHEN event_type <> 'purchase' OR event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN p.path
    ELSE concat(p.dir, '/t', CAST(p.k AS STRING), '.AV1.REENCODE.mkv') END AS output_path,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100) AS BIGINT) END AS actual_savings_mb,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Encoder Stalled - no progress for 300s'
       WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'ffmpeg exited 234'
       WHEN event_type = 'error' THEN 'timeout after 3600s'
       WHEN event_type = 'view' THEN 'user declined' END AS error,
  CASE WHEN event_type IN ('click', 'signup') THEN CAST(floor(value * 50) AS BIGINT) END AS projected_savings_mb
FROM {events} e JOIN {fx_probes} p ON p.k = e.user_id
"""

SQL["fx_runs"] = """
SELECT event_id % 45 AS run_id, CAST(min(event_id) * 60 AS DOUBLE) AS started_at, CAST(max(event_id) * 60 + 30 AS DOUBLE) AS ended_at,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS applied,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS skipped
FROM {events} GROUP BY event_id % 45
"""

# Nested tracks by arithmetic: file k has k % 6 audio tracks and k % 4 subtitles.
AUDIO_SLOTS = 5
SUB_SLOTS = 3
TRACK_SQL = {
    "codec": """CASE (k + i * 3) % 9 WHEN 0 THEN 'truehd' WHEN 1 THEN 'dts' WHEN 2 THEN 'ac3'
        WHEN 3 THEN 'eac3' WHEN 4 THEN 'aac' WHEN 5 THEN 'flac' WHEN 6 THEN 'pcm_s16le'
        WHEN 7 THEN 'mp3' ELSE 'vorbis' END""",
    "lang": """CASE (k + i * 5) % 7 WHEN 0 THEN 'eng' WHEN 1 THEN 'fre' WHEN 2 THEN 'EN'
        WHEN 3 THEN 'spa' WHEN 4 THEN 'jpn' WHEN 5 THEN 'und' END""",
    "channels": "CASE (k + i) % 4 WHEN 0 THEN 2 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 2 END",
    "is_default": "((k % 3 = 0 AND i = 1) OR k % 10 = 0)",
    "title": """CASE WHEN (k + i) % 8 = 0 THEN 'Director COMMENTARY' WHEN (k + i) % 8 = 1 THEN NULL
        ELSE 'Main' END""",
    "sub_codec": """CASE (k + i) % 5 WHEN 0 THEN 'subrip' WHEN 1 THEN 'hdmv_pgs_subtitle'
        WHEN 2 THEN 'ass' WHEN 3 THEN 'dvd_subtitle' ELSE 'mov_text' END""",
}


def _unnested(n_expr, fields, slots):
    rows = " UNION ALL ".join(f"SELECT {i} AS i" for i in range(slots))
    cols = ", ".join(f"{e} AS {n}" for n, e in fields)
    return f"SELECT k, path, i AS pos, {cols} FROM (SELECT * FROM {{fx_probes}} p JOIN ({rows}) s ON s.i < {n_expr}) q"


# The same tracks as rows, for the checking engine.
SQL["fx_audio_rows"] = _unnested("p.k % 6", [(n, TRACK_SQL[n]) for n in (
    "codec", "lang", "channels", "is_default", "title")], AUDIO_SLOTS)
SQL["fx_sub_rows"] = _unnested("p.k % 4", [("codec", TRACK_SQL["sub_codec"]), ("lang", TRACK_SQL["lang"])], SUB_SLOTS)

# Tracks from line items: one row per track.
SQL["fx_tracks"] = """
SELECT l_orderkey AS k,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS pos,
  CASE l_partkey % 6 WHEN 0 THEN 'truehd' WHEN 1 THEN 'dts' WHEN 2 THEN 'ac3' WHEN 3 THEN 'eac3' WHEN 4 THEN 'aac' ELSE 'flac' END AS codec,
  CASE l_suppkey % 5 WHEN 0 THEN 'eng' WHEN 1 THEN 'fre' WHEN 2 THEN 'eng' WHEN 3 THEN 'spa' ELSE NULL END AS lang,
  CASE l_linenumber % 4 WHEN 0 THEN 2 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 2 END AS channels,
  l_returnflag = 'A' AS is_default,
  CASE WHEN l_linestatus = 'O' AND l_partkey % 7 = 0 THEN 'Director Commentary' ELSE 'Main' END AS title
FROM {lineitem}
"""

SQL["fx_progress"] = """
SELECT encode_id, seq, seq * 90 AS t_s,
  CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 2400 END) OVER (PARTITION BY encode_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS frames,
  CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY encode_id ORDER BY seq ROWS UNBOUNDED PRECEDING) * (800000 + encode_id % 7 * 100000) AS BIGINT) AS out_size
FROM (SELECT user_id AS encode_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM {events}) e
"""

# The same feed as positions and frames that both fall at times, for some encodes at every second line.
SQL["fx_signals"] = """
SELECT encode_id, seq, t_s, greatest(0, frames - CASE WHEN (encode_id + seq) % 11 = 0 THEN 6000 ELSE 0 END) AS frames,
  CAST(floor(frames / 9600e0) * 100 - CASE WHEN encode_id % 3 = 0 AND seq % 2 = 1 THEN 60 ELSE 0 END AS DOUBLE) AS current_seconds
FROM {fx_progress} p
"""

SQL["fx_encodes"] = """
SELECT DISTINCT user_id AS encode_id, CAST(0 AS BIGINT) AS start_s, CAST(6600 AS DOUBLE) AS duration_seconds,
  CAST(24 AS DOUBLE) AS source_fps, CAST(70000000 AS BIGINT) AS source_size,
  5000 + user_id % 7 * 500 AS timeout_s
FROM {events}
"""

SQL["fx_skipped"] = """
SELECT path, size, mtime, 'below_min_size' AS reason, CAST(k AS DOUBLE) AS last_seen_at
FROM {fx_probes} WHERE st = 'O'
"""

# Where a probe document says its file is; unknown and mixed-case extensions occur.
SQL["fx_doc_files"] = """
SELECT k, CASE k % 3 WHEN 0 THEN path WHEN 1 THEN replace(path, '.mkv', '.Vid')
    ELSE replace(path, '.mkv', '.M2TS') END AS path, size, mtime, duration_seconds, height, video_codec
FROM {fx_probes}
"""

# Five feed lines per progress row.
SQL["fx_lines"] = """
SELECT encode_id, t_s, seq * 5 + i AS seq, CASE i
    WHEN 0 THEN concat('frame= ', CAST(frames AS STRING))
    WHEN 1 THEN concat('fps=', CAST(20 + encode_id % 5 AS STRING), '.5')
    WHEN 2 THEN CASE WHEN seq % 7 = 3 THEN 'out_time_ms=N/A' ELSE concat('out_time_ms=', CAST(frames * 40000 AS STRING)) END
    WHEN 3 THEN CASE WHEN seq % 5 = 2 THEN 'speed=1.2.3x' ELSE concat('speed=', CAST(seq % 4 AS STRING), '.25x') END
    ELSE CASE WHEN seq % 97 = 50 THEN 'progress=end' ELSE 'progress=continue' END END AS line
FROM {fx_progress} p CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) n
"""

GIVEN = ["orders", "lineitem", "events"]


def _needs(text):
    return [n for n in list(SQL) + GIVEN if "{" + n + "}" in text]


def with_clause(*names) -> str:
    """WITH text that defines the named projections over the given tables."""
    done: list[str] = []

    def add(n):
        if n in GIVEN or n in done:
            return
        for m in _needs(SQL[n]):
            add(m)
        done.append(n)
    for n in names:
        add(n)
    plain = {n: n for n in list(SQL) + GIVEN}
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].format(**plain)})" for n in done) + " "


class Tables:
    """Projections over one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str, **instead):
        self.spark, self.dir, self.instead = spark, sf_dir.rstrip("/"), instead

    def over(self, **instead) -> "Tables":
        """The same projections with other tables, or streams, in place of given ones."""
        return Tables(self.spark, self.dir, **instead)

    def given(self, name) -> DataFrame:
        if name in self.instead:
            return self.instead[name]
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def get(self, name) -> DataFrame:
        if name in GIVEN:
            return self.given(name)
        special = getattr(self, "_" + name, None)
        if special is not None:
            return special()
        return self.spark.sql(SQL[name], **{n: self.get(n) for n in _needs(SQL[name])})

    # -- the windowed projections, cut into chunks so that a hot key is no problem

    def _fx_progress(self) -> DataFrame:
        rows = (self.given("events").withColumn("__hour", F.date_trunc("hour", "ts"))
                .withColumn("__f", F.when(F.col("event_type") == "error", 0).otherwise(2400))
                .withColumn("__s", F.when(F.col("event_type") == "error", 0).otherwise(1)))
        rows = running(rows, ["user_id"], "__hour", ["ts", "event_id"], row_number="seq",
                       sums={"frames": "__f", "steps": "__s"})
        return rows.selectExpr(
            "user_id AS encode_id", "seq", "seq * 90 AS t_s", "frames",
            "steps * (800000 + user_id % 7 * 100000) AS out_size")

    def _fx_tree(self) -> DataFrame:
        # one read of the titles: the files of a title come from an array in its row
        ext = "CASE k % 6 WHEN 0 THEN '.MKV' WHEN 1 THEN '.mp4' ELSE '.mkv' END"
        alias = "concat('T', CAST(k AS STRING), '{}')"
        dup = "st = 'O' AND prio = '3-MEDIUM'"
        files = [
            ("stem", ext, "CASE WHEN k % 29 = 0 THEN CAST(0 AS BIGINT) ELSE size END", "true"),
            ("stem", "CASE prio WHEN '1-URGENT' THEN '.srt' ELSE '.nfo' END", "4096L", "prio IN ('1-URGENT', '2-HIGH')"),
            ("concat(stem, '.en')", "'.srt'", "2048L", "prio = '1-URGENT'"),
            ("clean_stem", ext, "size", "clean_stem <> stem AND st = 'P' AND prio = '5-LOW'"),
            (alias.format(".Foo.2024.DV.AV1.REENCODE"), "'.mkv'", "size", dup),
            (alias.format(".Foo.2024.HDR10Plus.AV1.REENCODE"), "'.mkv'", "size", dup),
            ("''", "'.mkv'", "size", "st = 'F' AND prio = '4-NOT SPECIFIED'"),
        ]
        rows = ", ".join(f"named_struct('p', concat(dir, '/', {s}, {e}), 'z', {z}, 'keep', {c})" for s, e, z, c in files)
        return self.spark.sql(
            "SELECT p AS path, z AS size, CAST(k % 1000 AS DOUBLE) AS mtime FROM {fx_titles} "
            f"LATERAL VIEW inline(filter(array({rows}), f -> f.keep)) v AS p, z, keep",
            fx_titles=self.get("fx_titles"))

    def _fx_lines(self) -> DataFrame:
        # five lines per row come from an array, not from a join
        text = SQL["fx_lines"]
        cut = text.index("FROM {fx_progress}")
        return self.spark.sql(
            text[:cut] + "FROM {fx_progress} LATERAL VIEW explode(array(0, 1, 2, 3, 4)) n AS i",
            fx_progress=self.get("fx_progress"))

    # -- nested and typed forms

    def probes(self) -> DataFrame:
        return self.get("fx_probes")

    def nested_probes(self) -> DataFrame:
        """Probes with track arrays, built in the row: no shuffle."""
        def expr(name):
            return TRACK_SQL[name].replace("\n", " ")
        audio = f"""transform(filter(sequence(0, {AUDIO_SLOTS - 1}), i -> i < k % 6), i -> named_struct(
            'index', cast(i + 1 as int), 'codec', {expr('codec')}, 'language', {expr('lang')},
            'channels', {expr('channels')}, 'channel_layout', cast(null as string),
            'bitrate', cast(null as bigint), 'title', {expr('title')}, 'default', {expr('is_default')}))"""
        subs = f"""transform(filter(sequence(0, {SUB_SLOTS - 1}), i -> i < k % 4), i -> named_struct(
            'index', cast(i + 6 as int), 'codec', {expr('sub_codec')}, 'language', {expr('lang')},
            'forced', false, 'default', false, 'title', cast(null as string)))"""
        return (self.probes().withColumn("audio_tracks", F.expr(audio))
                .withColumn("subtitle_tracks", F.expr(subs)))

    def probe_docs(self) -> DataFrame:
        """Probe documents as JSON text, with broken ones and ones without video.

        Titles are spread over all tasks before the wide work, however few row groups hold them.
        """
        titles = self.given("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice")
        # by number, since adaptive execution would put titles this narrow back into a few tasks
        titles = titles.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
        return self.spark.sql("""
          SELECT k, path, size AS stat_size, mtime,
            CASE WHEN k % 37 = 0 THEN concat('{{"format": {{"duration": "', k, '"') ELSE doc END AS doc
          FROM (SELECT k, path, size, mtime, to_json(named_struct(
            'format', named_struct(
              'format_name', CASE WHEN k % 11 = 0 THEN NULL ELSE 'matroska,webm' END,
              'duration', CASE WHEN k % 13 = 0 THEN NULL ELSE concat(cast(cast(duration_seconds AS bigint) AS string), '.000000') END,
              'size', CASE WHEN k % 5 = 0 THEN NULL ELSE cast(size + 7 AS string) END,
              'bit_rate', CASE WHEN k % 4 = 1 THEN cast(3000000 + k AS string) WHEN k % 4 = 2 THEN '100' END,
              'tags', CASE k % 5 WHEN 0 THEN map('creation_time', '2020-03-04T05:06:07.000000Z')
                       WHEN 1 THEN map('date', '2019-02-03 04:05:06') WHEN 2 THEN map('creation_time', 'nonsense', 'CreationDate', '2018-01-02T03:04:05+0200')
                       WHEN 3 THEN map('date', '2017') END),
            'streams', filter(concat(
              array(CASE WHEN k % 41 = 0 THEN NULL ELSE named_struct('index', 0, 'codec_type', 'video', 'codec_name', video_codec,
                'width', cast(CASE WHEN height >= 1440 THEN 3840 ELSE 1920 END AS string), 'height', cast(height AS string),
                'pix_fmt', CASE k % 6 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'yuv420p10le' WHEN 2 THEN 'yuv422p12be' WHEN 3 THEN 'p010le' WHEN 4 THEN 'gray' END,
                'r_frame_rate', CASE k % 5 WHEN 0 THEN '24000/1001' WHEN 1 THEN '25/1' WHEN 2 THEN '30/0' WHEN 3 THEN '50' ELSE 'x/y' END,
                'bit_rate', CASE WHEN k % 4 = 0 THEN cast(1000000 + k AS string) WHEN k % 4 = 3 THEN 'N/A' END,
                'channels', cast(NULL AS string), 'channel_layout', cast(NULL AS string),
                'color_primaries', CASE k % 3 WHEN 0 THEN 'bt2020' WHEN 1 THEN 'bt709' END,
                'color_transfer', CASE k % 7 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'arib-std-b67' WHEN 2 THEN 'bt709' END,
                'color_space', CASE k % 10 WHEN 0 THEN 'bt2020nc' WHEN 1 THEN 'bt2020c' WHEN 2 THEN 'bt709' END,
                'side_data_list', CASE k % 5 WHEN 0 THEN array(named_struct('side_data_type', 'Other', 'dv_profile', '4'),
                     named_struct('side_data_type', 'DOVI configuration record', 'dv_profile', cast(5 + k % 4 AS string)))
                   WHEN 1 THEN array(named_struct('side_data_type', 'DOVI configuration record', 'dv_profile', 'bad')) END,
                'tags', named_struct('language', cast(NULL AS string), 'title', cast(NULL AS string)),
                'disposition', named_struct('default', 1, 'forced', 0)) END),
              transform(filter(sequence(0, 4), i -> i < k % 6), i -> named_struct('index', cast(i + 1 AS int), 'codec_type', 'audio',
                'codec_name', """ + TRACK_SQL["codec"] + """, 'width', cast(NULL AS string), 'height', cast(NULL AS string),
                'pix_fmt', cast(NULL AS string), 'r_frame_rate', '0/0', 'bit_rate', CASE WHEN (k + i) % 2 = 0 THEN cast(100000 * (i + 1) AS string) END,
                'channels', cast(""" + TRACK_SQL["channels"] + """ AS string), 'channel_layout', '5.1',
                'color_primaries', cast(NULL AS string), 'color_transfer', cast(NULL AS string), 'color_space', cast(NULL AS string),
                'side_data_list', cast(NULL AS array<struct<side_data_type:string, dv_profile:string>>),
                'tags', named_struct('language', """ + TRACK_SQL["lang"] + """, 'title', """ + TRACK_SQL["title"] + """),
                'disposition', named_struct('default', CASE WHEN """ + TRACK_SQL["is_default"] + """ THEN 1 ELSE 0 END, 'forced', 0))),
              transform(filter(sequence(0, 2), i -> i < k % 4), i -> named_struct('index', cast(i + 6 AS int), 'codec_type', 'subtitle',
                'codec_name', """ + TRACK_SQL["sub_codec"] + """, 'width', cast(NULL AS string), 'height', cast(NULL AS string),
                'pix_fmt', cast(NULL AS string), 'r_frame_rate', '0/0', 'bit_rate', cast(NULL AS string),
                'channels', cast(NULL AS string), 'channel_layout', cast(NULL AS string),
                'color_primaries', cast(NULL AS string), 'color_transfer', cast(NULL AS string), 'color_space', cast(NULL AS string),
                'side_data_list', cast(NULL AS array<struct<side_data_type:string, dv_profile:string>>),
                'tags', named_struct('language', """ + TRACK_SQL["lang"] + """, 'title', cast(NULL AS string)),
                'disposition', named_struct('default', 0, 'forced', CASE WHEN (k + i) % 5 = 0 THEN 1 ELSE 0 END)))),
              s -> s IS NOT NULL))) AS doc
            FROM {fx_doc_files}) d""", fx_doc_files=self.over(**self.instead | {"orders": titles}).get("fx_doc_files"))
