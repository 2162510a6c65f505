"""Track choice inside nested arrays: no shuffle, one row per file."""

from pyspark.sql import Column, functions as F

from . import fixed
from .let import let
from .rules import _lookup


def expand_languages(langs) -> list[str]:
    """Lowercased codes plus one hop through the pair table."""
    base = {x.lower() for x in langs}
    return sorted(base | {fixed.LANGUAGE_PAIRS.get(x, x) for x in base})


def expand_languages_column(langs: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGE_PAIRS.items() for x in kv])
    low = F.transform(langs, lambda x: F.lower(x))
    return F.array_sort(F.array_union(low, F.transform(low, lambda x: F.coalesce(pairs[x], x))))


def codec_rank(codec: Column) -> Column:
    return F.coalesce(_lookup(F.lower(codec), fixed.CODEC_RANK, "int"),
                      F.lit(fixed.CODEC_RANK_DEFAULT))


def is_lossless(codec: Column, channels: Column) -> Column:
    c = F.lower(codec)
    return F.coalesce(c.isin(fixed.LOSSLESS_CODECS) | c.startswith("pcm_")
                      | ((c == "dts") & (channels >= 6)), F.lit(False))


def is_commentary(title: Column) -> Column:
    return F.coalesce(F.lower(title).contains("commentary"), F.lit(False))


def quality_key(codec, channels, default, pos) -> Column:
    """Larger is better; equal tracks go to the earliest position."""
    return F.struct(is_lossless(codec, channels).alias("lossless"),
                    codec_rank(codec).alias("rank"), channels.alias("channels"),
                    F.coalesce(default, F.lit(False)).alias("default"),
                    (-pos).alias("neg_pos"))


def _with_pos(tracks: Column) -> Column:
    return F.transform(tracks, lambda t, i: F.struct(
        i.cast("int").alias("pos"), t["codec"].alias("codec"),
        F.lower(F.coalesce(t["language"], F.lit(""))).alias("lang"),
        t["channels"].alias("channels"), t["title"].alias("title"),
        F.coalesce(t["default"], F.lit(False)).alias("default")))


def eligible(tracks: Column, langs) -> Column:
    """Array of candidate tracks, never empty when there is audio."""
    want = expand_languages(langs)

    def choose(pos):
        any_default = F.exists(pos, lambda t: t["default"])
        plain = F.filter(pos, lambda t: ~is_commentary(t["title"]))
        return let(F.struct(any_default.alias("d"), plain.alias("plain"), pos.alias("all")), match)

    def match(x):
        hits = F.filter(x["plain"], lambda t: t["lang"].isin(want) | (~x["d"] & (t["pos"] == 0)))
        return let(hits, lambda h: F.when(F.size(h) > 0, h)
                   .when(F.size(x["plain"]) > 0, F.slice(x["plain"], 1, 1))
                   .otherwise(F.slice(x["all"], 1, 1)))
    return let(_with_pos(tracks), choose)


def _best(tracks: Column) -> Column:
    keyed = F.transform(tracks, lambda t: F.struct(
        quality_key(t["codec"], t["channels"], t["default"], t["pos"]).alias("key"),
        t.alias("track")))
    return F.array_max(keyed)["track"]


def _best_other(pool: Column, first: Column, channels: int) -> Column:
    return _best(F.filter(pool, lambda t: (t["channels"] == channels) & (t["pos"] != first["pos"])))


def _slot(kind: str, track: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), track.alias("track"))


def audio_ladder(tracks: Column, langs, add_compat=True) -> Column:
    """Array of (slot, kind, track) in output order; empty without audio."""
    def fill(x):
        s0, s1, s2 = x["s0"], x["s1"], x["s2"]
        wide = F.when(s1.isNotNull(), _slot("copy", s1)).when(s0["channels"] >= 6, _slot("opus51", s0))
        stereo = F.when(s2.isNotNull(), _slot("copy", s2)).when(
            (s0["channels"] > 2) | is_lossless(s0["codec"], s0["channels"]), _slot("aac20", s0))
        first = F.when(s0.isNotNull(), _slot("copy", s0))
        picked = F.array(first, wide, stereo) if add_compat else F.array(first)
        return F.transform(F.array_compact(picked), lambda e, i: F.struct(
            i.cast("int").alias("slot"), e["kind"].alias("kind"), e["track"].alias("track")))

    def others(y):
        return let(F.struct(y["s0"].alias("s0"), _best_other(y["pool"], y["s0"], 6).alias("s1"),
                            _best_other(y["pool"], y["s0"], 2).alias("s2")), fill)
    return let(eligible(tracks, langs), lambda pool: let(
        F.struct(pool.alias("pool"), _best(pool).alias("s0")), others))


def setting(kind: Column, field: str, cast: str) -> Column:
    return _lookup(kind, {k: v[field] for k, v in fixed.SYNTH_SETTINGS.items()}, cast)


def kept_subtitles(tracks: Column, langs, box="mkv", keep_all=False) -> Column:
    """Source positions of the subtitle tracks that stay."""
    want = expand_languages(langs)

    def stays(t):
        ok = F.lit(True) if keep_all else F.lower(F.coalesce(t["language"], F.lit(""))).isin(want)
        if box == "mp4":
            ok = ok & ~F.coalesce(t["codec"].isin(fixed.IMAGE_SUBTITLE_CODECS), F.lit(False))
        return ok
    flagged = F.transform(tracks, lambda t, i: F.when(stays(t), i.cast("int")))
    return F.array_compact(flagged)
