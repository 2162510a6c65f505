"""Track selection over an exploded track table.

Columns: file key, pos, codec, lang, channels, is_default, title. The nested
form in `functions.tracks` needs no shuffle and is the one to use when probes
carry their tracks as arrays; this one serves tables with one row per track.
Only aggregates and joins on per-file summaries, so no file's tracks gather.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions import tracks as t
from ..functions.let import let, once
from .hotkeys import first_rows


def eligible_tracks(tracks: DataFrame, langs, key="k") -> DataFrame:
    want = t.expand_languages(langs)
    rows = (tracks.withColumn("lang", F.lower(F.coalesce("lang", F.lit(""))))
            .withColumn("is_default", F.coalesce("is_default", F.lit(False)))
            .withColumn("__plain", ~t.is_commentary(F.col("title")))
            .withColumn("__lang", F.col("__plain") & F.col("lang").isin(want))
            .withColumn("__lead", F.col("__plain") & (F.col("pos") == 0)))
    facts = rows.groupBy(F.col(key).alias("__k")).agg(
        F.bool_or("is_default").alias("__any_default"),
        F.bool_or("__lang").alias("__has_lang"),
        F.bool_or("__lead").alias("__has_lead"),
        F.min(F.when(F.col("__plain"), F.col("pos"))).alias("__first_plain"))
    matched = F.col("__lang") | (~F.col("__any_default") & F.col("__lead"))
    any_match = F.col("__has_lang") | (~F.col("__any_default") & F.col("__has_lead"))
    keep = F.when(any_match, matched).otherwise(
        F.col("pos") == F.coalesce("__first_plain", F.lit(0)))
    return (rows.join(facts, F.col(key) == F.col("__k")).filter(keep)
            .select(*tracks.columns))


def track_quality(tracks: DataFrame) -> DataFrame:
    return (tracks.withColumn("lossless", t.is_lossless(F.col("codec"), F.col("channels")))
            .withColumn("rank", t.codec_rank(F.col("codec"))))


def _track_struct():
    return F.struct(
        t.quality_key(F.col("codec"), F.col("channels"), F.col("is_default"), F.col("pos")).alias("q"),
        F.struct("pos", "codec", "lang", "channels", "title").alias("t"))


def audio_ladder(tracks: DataFrame, langs, add_compat=True, key="k") -> DataFrame:
    """One row per output slot: key, slot, kind, source position and track fields.

    The slots are among the two best tracks with 6 channels, with 2 and with other counts. Each task cuts to those before
    the shuffle, so at most six rows of a file are gathered.
    """
    channels = F.when(F.col("channels").isin(6, 2), F.col("channels")).otherwise(0)
    pool = eligible_tracks(tracks, langs, key).select(key, channels.alias("__c"), _track_struct().alias("__t"))
    few = first_rows(pool, [key, "__c"], [F.col("__t.q").desc()], 2).groupBy(key).agg(F.collect_list("__t").alias("__few"))

    def best_other(x, n):
        return F.array_max(F.filter(x["few"], lambda e: (e["t"]["channels"] == n) & (e["t"]["pos"] != x["first"]["pos"])))["t"]

    def slots(x):
        first = x["first"]
        entry = lambda kind, track: F.struct(F.lit(kind).alias("kind"), track.alias("t"))
        if not add_compat:
            return F.array(entry("copy", first))
        wide, narrow = best_other(x, 6), best_other(x, 2)
        second = F.when(wide.isNotNull(), entry("copy", wide)).when(first["channels"] >= 6, entry("opus51", first))
        third = F.when(narrow.isNotNull(), entry("copy", narrow)).when(
            (first["channels"] > 2) | t.is_lossless(first["codec"], first["channels"]), entry("aac20", first))
        return F.array_compact(F.array(entry("copy", first), second, third))

    ladder = let(F.struct(F.col("__few").alias("few"), F.array_max("__few")["t"].alias("first")), slots)
    return (few.select(key, F.posexplode(ladder).alias("slot", "__e"))
            .select(key, "slot", F.col("__e.kind").alias("kind"), F.col("__e.t.pos").alias("src_pos"),
                    F.col("__e.t.codec").alias("codec"), F.col("__e.t.lang").alias("lang"),
                    F.col("__e.t.channels").alias("channels"), F.col("__e.t.title").alias("title")))


def ladder_rows(probes: DataFrame, langs, add_compat=True, key="path") -> DataFrame:
    """Same rows from probes with nested tracks; no shuffle."""
    ladder = t.audio_ladder(F.col("audio_tracks"), langs, add_compat)
    rows = probes.select(key, F.inline(ladder))
    return rows.select(
        key, "slot", "kind", F.col("track.pos").alias("src_pos"), F.col("track.codec").alias("codec"),
        F.col("track.lang").alias("lang"), F.col("track.channels").alias("channels"),
        F.col("track.title").alias("title"))


def ladder_settings(ladder: DataFrame) -> DataFrame:
    """What the encoder is told per slot. Copies keep their own title and channels."""
    synth = F.col("kind") != "copy"
    kind = F.col("kind")
    return (ladder.withColumn("out_codec", F.when(synth, t.setting(kind, "codec", "string")).otherwise("copy"))
            .withColumn("bitrate_k", t.setting(kind, "bitrate_k", "int"))
            .withColumn("out_channels", F.when(synth, t.setting(kind, "channels", "int")).otherwise(F.col("channels")))
            .withColumn("out_language", F.when(F.coalesce("lang", F.lit("")) == "", "und")
                        .otherwise(F.lower("lang")))
            .withColumn("out_title", F.when(synth, t.setting(kind, "title", "string"))
                        .otherwise(F.nullif(F.col("title"), F.lit(""))))
            .withColumn("is_default_out", F.col("slot") == 0))


def subtitle_selection(probes: DataFrame, langs, box="mkv", keep_all=False, key="path") -> DataFrame:
    """One row per kept subtitle: output index, source position, codec to write."""
    kept = t.kept_subtitles(F.col("subtitle_tracks"), langs, box, keep_all)
    return (probes.select(key, "subtitle_tracks", F.posexplode(kept).alias("out_idx", "src_pos"))
            .withColumn("__t", F.get("subtitle_tracks", "src_pos"))
            .select(key, "out_idx", "src_pos", F.col("__t.codec").alias("codec"),
                    F.lower(F.coalesce("__t.language", F.lit("und"))).alias("out_language"),
                    F.lit("copy" if box == "mkv" else "mov_text").alias("out_codec")))


def stream_usage(probes: DataFrame, langs, box="mkv", add_compat=True, keep_audio=False,
                 keep_subs=False) -> DataFrame:
    """Add kept_audio, dropped_audio, kept_subs, dropped_subs (source positions)."""
    def positions(name):
        return F.transform(name, lambda x, i: i.cast("int"))
    audio = positions("audio_tracks") if keep_audio else F.array_sort(F.array_distinct(
        F.transform(t.audio_ladder(F.col("audio_tracks"), langs, add_compat),
                    lambda e: e["track"]["pos"])))
    subs = t.kept_subtitles(F.col("subtitle_tracks"), langs, box, keep_subs)
    return (once(probes, kept_audio=audio, kept_subs=subs)
            .withColumn("dropped_audio", F.array_except(positions("audio_tracks"), F.col("kept_audio")))
            .withColumn("dropped_subs", F.array_except(positions("subtitle_tracks"), F.col("kept_subs"))))


def track_stats(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(
        "codec", F.coalesce("lang", F.lit("und")).alias("lang"), "channels").agg(
        F.count(F.lit(1)).alias("n_tracks"))


