import random

import pytest
from pyspark.sql import functions as F

from mediacairn.functions import fixed, naming as n, tracks as tf
from mediacairn.operators import renames as rn, tracks as tk
from mediacairn.plans.media_queries import spelled

LANGS = ["en", "und"]
AUDIO = ("array<struct<index:int, codec:string, language:string, channels:int, channel_layout:string, "
         "bitrate:bigint, title:string, default:boolean>>")


def aud(i, codec, lang, ch, title=None, default=False):
    return (i, codec, lang, ch, None, None, title, default)


def plain_ladder(tracks, wanted):
    """The choice by its rules, one file at a time: (kind, source position) per slot."""
    want = set(tf.expand_languages(wanted))
    rows = [dict(pos=i, codec=(t[1] or "").lower(), lang=(t[2] or "").lower(), ch=t[3], spoken="commentary" not in (t[6] or "").lower(), default=bool(t[7]))
            for i, t in enumerate(tracks)]
    if not rows:
        return []
    marked = any(r["default"] for r in rows)
    heard = [r for r in rows if r["spoken"]]
    pool = [r for r in heard if r["lang"] in want or (not marked and r["pos"] == 0)] or heard[:1] or rows[:1]

    def lossless(r):
        return r["codec"] in fixed.LOSSLESS_CODECS or r["codec"].startswith("pcm_") or (r["codec"] == "dts" and r["ch"] >= 6)

    def best(of):
        return max(of, key=lambda r: (lossless(r), fixed.CODEC_RANK.get(r["codec"], fixed.CODEC_RANK_DEFAULT), r["ch"], r["default"], -r["pos"]), default=None)
    first = best(pool)
    wide, narrow = (best([r for r in pool if r["ch"] == n and r is not first]) for n in (6, 2))
    out = [("copy", first["pos"])]
    out += [("copy", wide["pos"])] if wide else [("opus51", first["pos"])] if first["ch"] >= 6 else []
    out += [("copy", narrow["pos"])] if narrow else [("aac20", first["pos"])] if first["ch"] > 2 or lossless(first) else []
    return out


def test_ladder_against_plain_choice(spark):
    rng = random.Random(8)
    files = {f"f{n}": [aud(i, rng.choice(["truehd", "dts", "FLAC", "eac3", "ac3", "aac", "pcm_s16le", "vorbis"]), rng.choice(["eng", "en", "und", "fre", "jpn", None]),
                           rng.choice([1, 2, 2, 6, 6, 8]), rng.choice([None, None, "Director Commentary", "Main"]), rng.random() < 0.2) for i in range(rng.randrange(7))]
             for n in range(400)}
    probes = spark.createDataFrame(list(files.items()), f"path string, audio_tracks {AUDIO}")
    got = {k: [] for k in files}
    for r in tk.ladder_rows(probes, LANGS).orderBy("path", "slot").collect():
        got[r.path].append((r.kind, r.src_pos))
    assert got == {k: plain_ladder(v, LANGS) for k, v in files.items()}
    flat = probes.select(F.col("path").alias("k"), F.posexplode("audio_tracks").alias("pos", "a")).select(
        "k", "pos", "a.codec", F.col("a.language").alias("lang"), "a.channels", F.col("a.default").alias("is_default"), "a.title")
    rows = {k: [] for k in files}
    for r in tk.audio_ladder(flat, LANGS).orderBy("k", "slot").collect():
        rows[r.k].append((r.kind, r.src_pos))
    assert rows == got


def test_languages_are_one_hop():
    assert tf.expand_languages({"deu"}) == ["de", "deu"] and tf.expand_languages({"DE"}) == ["de", "ger"]
    assert tf.expand_languages({"en", "und"}) == ["en", "eng", "und"]


def test_stream_usage(spark):
    subs = "array<struct<index:int, codec:string, language:string, forced:boolean, default:boolean, title:string>>"
    audio = [aud(0, "truehd", "eng", 8), aud(1, "ac3", "eng", 6), aud(2, "ac3", "eng", 2), aud(3, "ac3", "fre", 6)]
    sub = [(0, "subrip", "eng", False, False, None), (1, "subrip", "fre", False, False, None), (2, "hdmv_pgs_subtitle", "eng", False, False, None)]
    probes = spark.createDataFrame([("/a", audio, sub)], f"path string, audio_tracks {AUDIO}, subtitle_tracks {subs}")

    def use(**kw):
        r = tk.stream_usage(probes, LANGS, **kw).first()
        return r.kept_audio, r.dropped_audio, r.kept_subs, r.dropped_subs
    assert use() == ([0, 1, 2], [3], [0, 2], [1])
    assert use(box="mp4", add_compat=False) == ([0], [1, 2, 3], [0], [1, 2])
    assert use(keep_audio=True, keep_subs=True) == ([0, 1, 2, 3], [], [0, 1, 2], [])


@pytest.mark.parametrize("codec", ["av1", "hevc", "h264"])
def test_rewrite_of_composed_names_and_idempotence(spark, codec):
    rng = random.Random(codec)
    foreign, own = [spelled(x) for x in fixed.FOREIGN_TOKENS[codec]], fixed.CANONICAL_TOKEN[codec]
    lost = [spelled(x) for x in fixed.LOST_METADATA_TOKENS["av1"]]
    pairs = []
    for _ in range(300):
        parts, kept, joint, named = [], [], rng.choice([".", " ", "_", " . "]), False
        for _ in range(rng.randint(1, 3)):
            word = "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(4, 7)))
            parts.append(word)
            kept.append(word)
        for _ in range(rng.randint(0, 4)):
            kind, token = rng.randrange(4), rng.choice(foreign)
            if kind == 0:
                parts.append(rng.choice([token, token.upper(), token.lower(), f"[{token}]", f"{token}+{rng.choice(foreign)}"]))
            elif kind == 1:
                parts.append("5ch")
                kept.append("5ch")
            elif kind == 2 and codec == "av1":
                parts.append(rng.choice(lost))
                kept += [] if named else ["HDR10"]
                named = True
            else:
                parts.append(f"x{token}y")  # part of a longer word: no token
                kept.append(f"x{token}y")
        pairs.append((joint.join(parts), ".".join(kept) + "." + own))
    df = spark.createDataFrame(pairs, "stem string, want string")
    df = n.rewrite_name(n.rewrite_name(df, "stem", "got", codec), "got", "again", codec)
    for r in df.collect():
        assert r.got == r.want and r.again == r.want, r.stem
    assert n.rewrite_name(df, "stem", "same", "vp8").filter("same <> stem").count() == 0


def test_recycle_against_brute_force(spark, table):
    held = ["/bin/a.mkv", "/bin/a_recycled2.mkv", "/bin/a_recycled3.mkv", "/bin/b_recycled1.mkv", "/bin/a_recycled02.mkv", "/bin/c_recycledx.mkv"]
    names = [*"aaabbcaac", "a_recycled1", "d", "d", "d_recycled1", "a_recycled1", "e_recycled1", "e", "e", "e_recycled1_recycled1", "e_recycled1"]
    src = [(i, f"/src/{i}/{x}.mkv") for i, x in enumerate(names)]
    want, taken = {}, set(held)
    for _, path in src:
        base = "/bin/" + path.split("/")[-1][:-4]
        dst, k = base + ".mkv", 0
        while dst in taken:
            k += 1
            dst = f"{base}_recycled{k}.mkv"
        taken.add(dst)
        want[path] = dst
    rows = rn.recycle_destination(table("turn bigint, path string", *src), table("path string", *[(h,) for h in held]), "/bin")
    assert {r.path: r.destination for r in rows.collect()} == want
    kept = rn.recycle_destination(table("turn bigint, path string", (1, "/lib/d/x.mkv"), (2, "/else/y.mkv")), table("path string", ("/q",)), "/bin", "/lib")
    assert sorted(r.destination for r in kept.collect()) == ["/bin/d/x.mkv", "/bin/y.mkv"]


def test_rename_group_moves_together(table):
    old = "Foo.2024.DV.HDR10Plus.+.AV1.REENCODE"
    names = [f"/m/{old}.mkv", f"/m/{old}.srt", f"/m/{old}.nfo", f"/m/{old}.en.srt", "/m/Foo.2024.DV.mkv", f"/m/.@Recycle/{old}.mkv",
             "/n/Bar.VC-1.AV1.REENCODE.mkv", "/n/Bar.AV1.REENCODE.mkv"]
    listing = table("path string", *[(x,) for x in names])
    assert [(r.path, r.new_path) for r in rn.rename_plan(listing).collect()] == [(names[0], "/m/Foo.2024.HDR10.AV1.REENCODE.mkv")]
    moved = {r.path: (r.new_path, r.blocked) for r in rn.rename_sidecars(listing).collect()}
    assert set(moved) == set(names[:3]) and moved[names[1]] == ("/m/Foo.2024.HDR10.AV1.REENCODE.srt", False)
    assert [r.path for r in rn.rename_collisions(listing).collect()] == [names[6]]


def test_output_path_modes(table):
    df = table("path string", ("/lib/d/My Film.x264.mkv",), ("/top.mkv",))

    def out(**kw):
        return [r.output_path for r in rn.output_path(df, **kw).collect()]
    assert out() == ["/lib/d/My.Film.AV1.REENCODE.mkv", "/top.AV1.REENCODE.mkv"]
    assert out(mode="side", output_root="/o", source_root="/lib") == ["/o/d/My.Film.AV1.REENCODE.mkv", "/o/top.AV1.REENCODE.mkv"]
    assert out(rewrite=False, name_suffix="_v2") == ["/lib/d/My Film.x264 REENCODE_v2.mkv", "/top REENCODE_v2.mkv"]
    with pytest.raises(ValueError):
        rn.output_path(df, target="vp8")


def test_recycle_when_all_turns_are_the_same(spark, table):
    names = [f"/lib/{i:05d}/x.mkv" for i in range(3000)]
    for turn in (None, 7):
        got = rn.recycle_destination(table("turn bigint, path string", *[(turn, x) for x in reversed(names)]), table("path string", ("/bin/x_recycled1.mkv",)), "/bin")
        slots = {r.path: r.slot for r in got.collect()}
        assert slots == {x: i + (i > 0) for i, x in enumerate(names)}
