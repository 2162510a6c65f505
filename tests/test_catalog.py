from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mediacairn import session
from mediacairn.functions import gate as g, paths as p, probe as pr
from mediacairn.operators import incremental as inc
from mediacairn.sources import listing as ls, probe_json as pj, tree
from mediacairn.sources.state import State

LIST = "path string, size bigint, mtime double"


def paths(df):
    return sorted(r.path for r in df.collect())


def test_scan_takes_features_and_leaves_system_and_extras(table):
    rows = table(LIST, *[(x, s, 0.0) for x, s in [
        ("/r/Movies/Real (2020).mkv", 9), ("/r/Movies/.@__thumb/Real.mkv", 9), ("/r/@Recycle/Old.mkv", 9),
        ("/r/Movies/Trailers/preview.mkv", 9), ("/r/Movies/Real (2020)-trailer.mp4", 9), ("/r/empty.mkv", 0),
        ("/r/note.txt", 9), ("/r/_x.MKV", 9), ("/r/.x.mkv", 9), ("/r/.mkv", 9), ("/rest/a.mkv", 9)]])
    assert paths(ls.scan_listing(rows, "/r")) == ["/r/.x.mkv", "/r/Movies/Real (2020).mkv", "/r/_x.MKV"]
    assert "/r/Movies/Real (2020)-trailer.mp4" in paths(ls.scan_listing(rows, "/r", skip_extras=False))
    assert paths(ls.scan_listing(rows, "/r", recursive=False)) == ["/r/.x.mkv", "/r/_x.MKV"]
    # a root that is a file is taken whatever its name
    assert paths(ls.scan_listing(rows, "/r/Movies/Real (2020)-trailer.mp4")) == ["/r/Movies/Real (2020)-trailer.mp4"]
    # only directories below the root count
    assert paths(ls.scan_listing(rows, "/r/Movies/Trailers")) == ["/r/Movies/Trailers/preview.mkv"]


def test_read_listing_from_disk(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one two.mkv").write_bytes(b"xxx")
    row = ls.read_listing(spark, str(tmp_path)).first()
    assert row.path == str(tmp_path / "a" / "one two.mkv") and row.size == 3 and row.mtime > 0


def test_read_tree_loses_nothing(spark, tmp_path):
    root = tmp_path / "lib"
    for name, size in (("a/b/one.mkv", 3), ("a/.hidden.mkv", 4), ("_under/_x.MKV", 5), ("empty.mkv", 0), (".dot/deep/er/z.mkv", 7), ("@Recycle/old.mkv", 2),
                       ("sp ace/ü%20.mkv", 8), ("Trailers/t.mkv", 1)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * size)
    (tmp_path / "outside.mkv").write_bytes(b"x")
    (root / "in.mkv").symlink_to(root / "a/b/one.mkv")
    (root / "out.mkv").symlink_to(tmp_path / "outside.mkv")
    (root / "gone.mkv").symlink_to(root / "nowhere.mkv")
    (root / "a/up").symlink_to(root)
    (root / "linked").symlink_to(root / "a/b")
    want = {"a/b/one.mkv": 3, "a/.hidden.mkv": 4, "_under/_x.MKV": 5, "empty.mkv": 0, ".dot/deep/er/z.mkv": 7, "@Recycle/old.mkv": 2, "sp ace/ü%20.mkv": 8,
            "Trailers/t.mkv": 1, "in.mkv": 3, "linked/one.mkv": 3}
    for parts in (1, 3, 200):
        listing, errors = tree.split_errors(tree.read_tree(spark, str(root), parts=parts))
        got = listing.collect()
        assert len(got) == len(want) and {r.path[len(str(root)) + 1:]: r.size for r in got} == want
        assert all(r.mtime > 0 for r in got) and errors.count() == 0
    assert tree.read_tree(spark, str(root), parts=200).rdd.getNumPartitions() > 8
    assert sorted(r.path for r in ls.scan_listing(listing, str(root)).collect()) == sorted(str(root / n) for n in want if n not in ("empty.mkv", "@Recycle/old.mkv", "Trailers/t.mkv"))
    flat = tree.read_tree(spark, str(root), recursive=False).collect()
    assert {r.path[len(str(root)) + 1:] for r in flat} == {"empty.mkv", "in.mkv"}
    assert [(r.path, r.size) for r in tree.read_tree(spark, str(root / "a/b/one.mkv")).collect()] == [(str(root / "a/b/one.mkv"), 3)]
    gone = tree.split_errors(tree.read_tree(spark, str(root / "nothing")))
    assert gone[0].count() == 0 and [(r.path, r.error) for r in gone[1].collect()] == [(str(root / "nothing"), "FileNotFoundError")]


def test_path_parts_and_tags(table):
    rows = p.with_path_parts(table("path string", ("/a/b.c/d.e.mkv",), ("/.mkv",), ("x.",), ("/n/no_ext",)))
    got = {r.path: (r.dir, r.name, r.stem, r.suffix) for r in rows.collect()}
    assert got == {"/a/b.c/d.e.mkv": ("/a/b.c", "d.e.mkv", "d.e", ".mkv"), "/.mkv": ("/", ".mkv", ".mkv", ""),
                   "x.": (".", "x.", "x.", ""), "/n/no_ext": ("/n", "no_ext", "no_ext", "")}
    tags = table("s string", ("A.AV1.REENCODE",), ("a.reencode",), ("PREENCODER",), ("a_REENCODE",)).select(
        "s", p.has_reencode_word(F.col("s")).alias("w"), p.has_reencode_marker(F.col("s")).alias("m"))
    assert [(r.w, r.m) for r in tags.collect()] == [(True, True), (True, True), (False, False), (False, True)]


def test_probe_documents_good_and_bad(table):
    docs = table("path string, stat_size bigint, mtime double, doc string",
                 ("/a.mkv", 5, 1.0, '{"format":{"duration":"2.5"},"streams":[{"codec_type":"video","codec_name":"hevc","width":10,"height":20}]}'),
                 ("/b.mkv", 5, 1.0, '{"format":{},"streams":[{"codec_type":"audio"}]}'),
                 ("/c.mkv", 5, 1.0, '{"format"'),
                 ("/d.mkv", 5, 1.0, '{"format":{"duration":"N/A"},"streams":[{"codec_type":"video"}]}'))
    good, bad = pj.split_probe_errors(pj.parse_probe_text(docs))
    row = pr.normalize(good).first()
    assert (row.path, row.size, row.duration_seconds, row.height, row.video_codec) == ("/a.mkv", 5, 2.5, 20, "hevc")
    assert row.bit_depth == 8 and row.frame_rate == 0.0 and row.video_bitrate == 16 and row.audio_tracks == []
    assert {r.path: r.reason for r in bad.collect()} == {
        "/b.mkv": "no video stream", "/c.mkv": "not json", "/d.mkv": "bad number"}


def test_size_gate_life_cycle(table):
    listing = table(LIST, ("/big", 4096, 1.0), ("/small", 1024, 1.0))
    probes = table(LIST, ("/big", 4096, 1.0), ("/small", 4096, 0.5))
    decisions = table("id bigint, path string", (1, "/small"), (2, "/big"))
    none = table("path string, size bigint, mtime double, reason string, last_seen_at double")
    large, small = inc.size_gate(listing, 2048)
    kept, ledger, skipped = inc.skip_upsert_evict(probes, decisions, none, small, 10.0)
    assert paths(kept) == ["/big"] and paths(ledger) == ["/big"] and paths(skipped) == ["/small"]
    assert paths(inc.skip_clear(skipped, inc.size_gate(listing, 512)[0])) == []
    assert inc.size_gate(listing, 0)[1].count() == 0
    assert paths(inc.probe_delta(large, probes)) == [] and paths(inc.probe_delta(large, probes, force=True)) == ["/big"]


def test_gate_columns(probe):
    rows = probe(dict(height=480, video_codec="mpeg2video"), dict(height=1080, video_codec="h264", video_bitrate=4_000_000),
                 dict(height=1080, video_codec="h264", video_bitrate=9_000_000), dict(height=0, video_bitrate=1))
    got = rows.select(g.denoise_flag(F.col("height"), F.col("video_codec"), F.col("video_bitrate")).alias("d"),
                      g.below_target_bitrate(F.col("video_bitrate"), F.col("height")).alias("l")).collect()
    assert [r.d for r in got] == [True, True, False, False] and [r.l for r in got] == [False, True, False, False]


def files_of(where):
    return {str(f.relative_to(where)): f.stat().st_mtime_ns for f in where.rglob("part-*.parquet")}


SKIPPED = "path string, size bigint, mtime double, reason string, last_seen_at double"


def test_update_replaces_touched_partitions_only(spark, tmp_path, table):
    state = State(spark, str(tmp_path), parts=16)
    assert state.read("skipped_files").count() == 0
    rows = table(SKIPPED, *[(f"/{i}", i, 1.0, "r", 1.0) for i in range(200)])
    state.write("skipped_files", rows)
    where = tmp_path / "skipped_files"
    before = files_of(where)
    touched = state.update("skipped_files", table(SKIPPED, ("/7", 700, 1.0, "r", 2.0), ("/new", 5, 1.0, "r", 2.0)), inc.skip_upsert)
    after = files_of(where)
    same = {f for f in before if f.split("/")[0] not in {f"part={p}" for p in touched}}
    assert 0 < len(touched) <= 2 and same and all(after[f] == before[f] for f in same)
    assert not (set(before) - same) & set(after)
    got = {r.path: r.size for r in state.read("skipped_files").collect()}
    assert got == {f"/{i}": i for i in range(200) if i != 7} | {"/7": 700, "/new": 5}
    # a partition may lose all its rows, and so may the table
    state.update("skipped_files", rows.filter("path = '/7'"), lambda old, new: old.filter("false"))
    assert "/7" not in paths(state.read("skipped_files"))
    state.write("skipped_files", state.read("skipped_files").filter("size < 3"))
    assert paths(state.read("skipped_files")) == ["/0", "/1", "/2"]
    state.write("skipped_files", rows.limit(0))
    assert state.read("skipped_files").count() == 0


def test_a_failed_update_leaves_the_old_table(spark, tmp_path, table):
    state = State(spark, str(tmp_path), parts=4)
    rows = table(SKIPPED, *[(f"/{i}", i, 1.0, "r", 1.0) for i in range(50)])
    state.write("skipped_files", rows)
    before = files_of(tmp_path / "skipped_files")
    broken = lambda old, new: old.withColumn("size", F.when(F.col("size") == 49, F.raise_error(F.lit("disk full")).cast("bigint")).otherwise(-1))
    with pytest.raises(Exception, match="disk full"):
        state.update("skipped_files", rows, broken)
    assert files_of(tmp_path / "skipped_files") == before
    assert {r.size for r in state.read("skipped_files").collect()} == set(range(50))


def test_clean_up_removes_stored_tables(spark):
    session.clean_up(spark)
    made = session.stored(spark.range(5), "kept-for-a-while")
    where = made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert made.count() == 5 and Path(where).is_dir()
    assert session.clean_up(spark) == 1 and not Path(where).exists() and session.clean_up(spark) == 0
