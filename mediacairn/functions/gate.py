"""Per-file predicates used by the plan and by jobs after it."""

from pyspark.sql import Column, functions as F

from . import fixed
from .rules import codec, target_mbps


def below_target_bitrate(bps: Column, height: Column) -> Column:
    return F.coalesce((bps > 0) & (bps / 1e6 < target_mbps(height)), F.lit(False))


def dv_strategy(profile: Column, allow_p7_convert=False, tools_present=False) -> Column:
    if not allow_p7_convert:
        seven = F.lit("p8_strip")
    else:
        seven = F.lit("p7_convert" if tools_present else None).cast("string")
    return F.when(profile == 7, seven).when(profile == 8, "p8_strip")


def dv_blocked(profile: Column) -> Column:
    return profile.isNotNull() & dv_strategy(profile).isNull()


def denoise_flag(height: Column, video_codec: Column, bps: Column) -> Column:
    h = F.coalesce(height, F.lit(0))
    return (((h > 0) & (h < 720))
            | ((codec(video_codec) == "h264") & (h < 1440) & below_target_bitrate(bps, h)))


def hw_decode_flag(preset_flag: Column, video_codec: Column, denoise: Column,
                   slow_codecs=None) -> Column:
    slow = fixed.SLOW_DECODE_CODECS if slow_codecs is None else slow_codecs
    flag = F.coalesce(preset_flag, F.lit(False))
    if not slow:
        return flag
    return flag | (~denoise & codec(video_codec).isin([s.lower() for s in slow]))


def encode_timeout(duration: Column, explicit: int | None = None) -> Column:
    if explicit is not None:
        return F.lit(max(explicit, 0)).cast("long")
    return (F.when(duration <= 0, F.lit(3600)).otherwise(
        F.greatest(F.lit(3600), F.floor(duration * 6)))).cast("long")


def bloat_applies(height: Column, size: Column, quality, enabled=True, retried=None) -> Column:
    """Size-overrun checks run only for UHD at a quality tighter than the relaxed one."""
    q = quality if isinstance(quality, Column) else F.lit(quality).cast("int")
    again = F.lit(False) if retried is None else F.coalesce(retried, F.lit(False))
    return F.coalesce(
        F.lit(enabled) & ~again & (height >= fixed.UHD_MIN_HEIGHT)
        & (q < fixed.RELAXED_UHD_QUALITY) & (size > 0), F.lit(False))


def preset_of_height(height: Column, film: bool = False) -> Column:
    """Name of the preset whose height band holds the file."""
    names = ["SD", "HD", "UHD-FILM" if film else "UHD"]
    h = F.coalesce(height, F.lit(0))
    chain = F.lit(None).cast("string")
    for n in reversed(names):
        band = fixed.PRESETS[n]
        inside = F.lit(True)
        if band["min_height"] is not None:
            inside = inside & (h >= band["min_height"])
        if band["max_height"] is not None:
            inside = inside & (h <= band["max_height"])
        chain = F.when(inside, n).otherwise(chain)
    return chain


def preset_value(preset: Column, field: str, kind: str) -> Column:
    chain = F.lit(None).cast(kind)
    for n, values in fixed.PRESETS.items():
        chain = F.when(preset == n, F.lit(values[field]).cast(kind)).otherwise(chain)
    return chain
