"""Probe document -> typed probe columns, all built-in expressions.

Input columns follow `schemas.PROBE_DOC`: `format` struct and `streams` array.
"""

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from .paths import file_name, suffix


def _by_type(streams: Column, kind: str) -> Column:
    return F.filter(streams, lambda s: s["codec_type"] == kind)


def primary_video(streams: Column) -> Column:
    return F.get(_by_type(streams, "video"), F.lit(0))


def to_int(text: Column) -> Column:
    """Whole-number text -> long; anything else -> null."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))


def bit_depth(pix_fmt: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(pix_fmt, F.lit("")), r"p(\d+)(le|be)?$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(8))


def container(path: Column, format_name: Column) -> Column:
    ext = F.lower(suffix(file_name(path)))
    by_ext = F.create_map(*[F.lit(x) for kv in fixed.CONTAINER_BY_EXT.items() for x in kv])
    return F.coalesce(
        by_ext[ext],
        F.when(F.coalesce(format_name, F.lit("")) != "", F.split_part(format_name, F.lit(","), F.lit(1))),
        F.ltrim(ext, F.lit(".")))


def dv_profile(video: Column) -> Column:
    dovi = F.get(F.filter(video["side_data_list"],
                          lambda d: d["side_data_type"] == fixed.DV_SIDE_DATA), F.lit(0))
    return to_int(dovi["dv_profile"]).cast("int")


def is_hdr(transfer: Column, primaries: Column, space: Column, depth: Column) -> Column:
    wide = (F.coalesce(primaries == "bt2020", F.lit(False))
            | F.coalesce(space.isin(fixed.HDR_SPACES), F.lit(False)))
    return (F.coalesce(transfer.isin(fixed.HDR_TRANSFERS), F.lit(False))
            | (F.coalesce(depth >= 10, F.lit(False)) & wide))


def creation_time(tags: Column) -> Column:
    """First parseable of three tags. With a `T` it is ISO, else UTC date time."""
    def parse(raw):
        iso = F.when(raw.contains("T"), raw.try_cast("timestamp"))
        plain = F.when(~raw.contains("T"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")))
        return F.coalesce(iso, plain)
    return F.coalesce(*[parse(tags[k]) for k in ("creation_time", "date", "CreationDate")])


def frame_rate(rate: Column) -> Column:
    num = F.split_part(rate, F.lit("/"), F.lit(1)).try_cast("double")
    den = F.substring(rate, F.instr(rate, "/") + 1, F.length(rate)).try_cast("double")
    val = F.when(F.instr(rate, "/") > 0, F.try_divide(num, den)).otherwise(rate.try_cast("double"))
    return F.coalesce(val, F.lit(0.0))


def audio_tracks(streams: Column) -> Column:
    return F.transform(_by_type(streams, "audio"), lambda s: F.struct(
        F.coalesce(s["index"], F.lit(-1)).alias("index"),
        F.coalesce(s["codec_name"], F.lit("")).alias("codec"),
        s["tags"]["language"].alias("language"),
        F.coalesce(to_int(s["channels"]).cast("int"), F.lit(0)).alias("channels"),
        s["channel_layout"].alias("channel_layout"),
        to_int(s["bit_rate"]).alias("bitrate"),
        s["tags"]["title"].alias("title"),
        F.coalesce(s["disposition"]["default"] != 0, F.lit(False)).alias("default")))


def subtitle_tracks(streams: Column) -> Column:
    return F.transform(_by_type(streams, "subtitle"), lambda s: F.struct(
        F.coalesce(s["index"], F.lit(-1)).alias("index"),
        F.coalesce(s["codec_name"], F.lit("")).alias("codec"),
        s["tags"]["language"].alias("language"),
        F.coalesce(s["disposition"]["forced"] != 0, F.lit(False)).alias("forced"),
        F.coalesce(s["disposition"]["default"] != 0, F.lit(False)).alias("default"),
        s["tags"]["title"].alias("title")))


def video_bitrate(stream_bps: Column, format_bps: Column, size: Column,
                  duration: Column, audio_bps: Column) -> Column:
    """bps: the stream's own, else container minus known audio, else size over time."""
    known = F.aggregate(audio_bps, F.lit(0).cast("long"),
                        lambda acc, b: acc + F.coalesce(b, F.lit(0).cast("long")))
    rest = format_bps - known
    from_size = F.floor(F.try_divide((size * 8).cast("double"), duration)).cast("long")
    return (F.when(stream_bps > 0, stream_bps)
            .when((format_bps > 0) & (rest > 0), rest)
            .when(format_bps > 0, format_bps)
            .when((size > 0) & (duration > 0), from_size)
            .otherwise(F.lit(0).cast("long")))


# bucket -> largest height in it
BUCKET_TOPS = [("480p", 480), ("720p", 720), ("1080p", 1080), ("1440p", 1440), ("2160p", None)]


def resolution_class(height: Column) -> Column:
    h = F.coalesce(height, F.lit(0))
    chain = F.when(h <= 0, "unknown")
    for bucket, top in BUCKET_TOPS:
        chain = chain.when(h <= top, bucket) if top else chain.otherwise(bucket)
    return chain


def tier_of_height(height: Column) -> Column:
    h = F.coalesce(height, F.lit(0))
    return (F.when(h >= fixed.UHD_MIN_HEIGHT, "UHD")
            .when(h >= fixed.HD_MIN_HEIGHT, "HD").otherwise("SD"))


def normalize(df: DataFrame) -> DataFrame:
    """Documents with a video stream -> one typed probe row each.

    Needs path, stat_size, mtime, format and streams. Rows without a video
    stream are not returned; see `sources.probe_json.split_probe_errors`.
    """
    return typed(df.withColumn("video", primary_video(F.col("streams"))).filter(F.col("video").isNotNull()))


def typed(df: DataFrame, *keep: str) -> DataFrame:
    """One typed probe row for every row, and the columns `keep` with it. Needs what `normalize` does, and video."""
    fmt = F.col("format")
    staged = (
        df.withColumn("audio_tracks", audio_tracks(F.col("streams")))
        .withColumn("subtitle_tracks", subtitle_tracks(F.col("streams")))
        .withColumn("duration_seconds", F.coalesce(fmt["duration"].try_cast("double"), F.lit(0.0)))
        .withColumn("size", F.coalesce(to_int(fmt["size"]), F.col("stat_size")))
        .withColumn("bit_depth", bit_depth(F.col("video.pix_fmt")))
        # read several times below, so columns of their own
        .withColumn("stream_bps", to_int(F.col("video.bit_rate")))
        .withColumn("format_bps", to_int(fmt["bit_rate"])))
    v = F.col("video")
    return staged.select(
        "path", "size", "mtime", "duration_seconds",
        container(F.col("path"), fmt["format_name"]).alias("container"),
        F.coalesce(fmt["format_name"], F.lit("")).alias("format_name"),
        F.coalesce(v["codec_name"], F.lit("")).alias("video_codec"),
        F.coalesce(to_int(v["width"]).cast("int"), F.lit(0)).alias("width"),
        F.coalesce(to_int(v["height"]).cast("int"), F.lit(0)).alias("height"),
        frame_rate(v["r_frame_rate"]).alias("frame_rate"),
        F.coalesce(v["pix_fmt"], F.lit("")).alias("pixel_format"),
        "bit_depth",
        video_bitrate(F.col("stream_bps"), F.col("format_bps"), F.col("size"),
                      F.col("duration_seconds"),
                      F.transform("audio_tracks", lambda a: a["bitrate"])).alias("video_bitrate"),
        v["color_primaries"].alias("color_primaries"),
        v["color_transfer"].alias("color_transfer"),
        v["color_space"].alias("color_space"),
        is_hdr(v["color_transfer"], v["color_primaries"], v["color_space"],
               F.col("bit_depth")).alias("is_hdr"),
        "audio_tracks", "subtitle_tracks",
        creation_time(fmt["tags"]).alias("creation_time"),
        dv_profile(v).alias("dv_profile"), *keep)
