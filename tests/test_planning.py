import random

import pytest
from pyspark.sql import functions as F

from mediacairn.functions import rules as r
from mediacairn.operators import audit as au, bands as bn, imports as im, planning as pl

LIST = "path string, size bigint, mtime double"
DEC = "id bigint, path string, status string, error string"


def gates(probe_rows, listing, decisions, **flags):
    return {x.path: x.gate for x in pl.plan_gate(probe_rows, listing, decisions, **flags).collect()}


def test_gate_order(probe, table):
    names = ["gone.mkv", "stall.HEVC.mkv", "dv5.mkv", "dv8.mkv", "x.AV1.REENCODE.mkv", "Done 2020.HEVC.mkv", "av1.mkv",
             "vp9.mkv", "low.mkv", "cut-bts.mkv", "fine.mkv", "once.mkv"]
    extra = {"dv5.mkv": dict(dv_profile=5), "dv8.mkv": dict(dv_profile=8), "av1.mkv": dict(video_codec="AV1"),
             "vp9.mkv": dict(video_codec="vp9"), "low.mkv": dict(video_bitrate=4_999_999)}
    rows = probe(*[dict(path="/m/" + n, **extra.get(n, {})) for n in names])
    listing = table(LIST, *[("/m/" + n, 1, 0.0) for n in names[1:]], ("/m/Done.2020.AV1.REENCODE.mkv", 0, 0.0))
    decisions = table(DEC, (1, "/m/stall.HEVC.mkv", "failed", "Encoder STALLED x"), (2, "/m/stall.HEVC.mkv", "failed", "encoder stalled"),
                      (3, "/m/once.mkv", "failed", "encoder stalled"), (4, "/m/once.mkv", "failed", "other"),
                      (5, "/m/once.mkv", "skipped", "encoder stalled"))
    got = gates(rows, listing, decisions, skip_codecs=[" VP9 ", ""])
    want = ["missing", "stalled", "dv", "ok", "reencoded", "existing_output", "av1_source", "skipped_codec",
            "low_bitrate", "extras", "ok", "ok"]
    assert got == {"/m/" + n: w for n, w in zip(names, want)}
    open_gates = gates(rows, listing, decisions, allow_reencoded=True, allow_av1=True, allow_extras=True, allow_low_bitrate=True)
    assert sorted(set(open_gates.values())) == ["dv", "missing", "ok", "stalled"]


def test_savings_cases(spark):
    mb = 1048576.0

    def saved(size_mb, best, height, seconds):
        fired = F.array(*[F.struct(F.lit(b).cast("double").alias("projected_savings_mb")) for b in best])
        if not best:
            fired = F.array().cast("array<struct<projected_savings_mb:double>>")
        df = spark.createDataFrame([(int(size_mb * mb), height, float(seconds))], "size bigint, height int, duration_seconds double")
        return df.select(r.projected_savings(fired).alias("s")).first().s
    assert saved(12000, [6500, 900], 1080, 3600) == pytest.approx(6500)
    assert saved(12000, [9000, 900], 1080, 3600) == pytest.approx(12000 - 5000)  # no more than the likely size leaves
    assert saved(8000, [20000], 1080, 0) == pytest.approx(0.95 * 8000)
    assert saved(6000, [1500], 0, 3600) == pytest.approx(1500)  # unknown bucket: no likely size
    assert saved(7000, [], 1080, 3600) == 0


def test_rules_over_probe(probe):
    rows = probe(dict(video_codec="mpeg2video", container="mpegts", video_bitrate=25_000_000, is_hdr=True),
                 dict(video_codec="av1", container="avi", video_bitrate=1), dict(video_codec="av1"))
    got = r.evaluate_rules(rows.filter("container <> 'matroska' or true")).collect()
    assert [[v.rule for v in x.fired] for x in got][0] == [
        "over_bitrate", "legacy_codec", "hd_non_av1", "container_migration", "hdr_advisory"]
    first = got[0].fired[0]
    assert first.severity == "high" and first.notes["resolution_class"] == "1080p"
    assert first.projected_savings_mb == pytest.approx(20_000_000 * 3600 / 8 / 1048576)
    cands = pl.candidates(rows).orderBy("video_codec").collect()
    assert [(c.video_codec, c.remux_only) for c in cands][:1] == [("av1", True)]
    with pytest.raises(ValueError, match="nope"):
        r.evaluate_rules(rows, ["nope"])


def test_own_rule_needs_no_udf(probe):
    r.register_rule("tall", lambda: r.verdict(F.col("height") > 2000, F.lit("tall"), "low", F.lit(1.0)), opt_in=True)
    try:
        rows = probe(dict(height=2160), dict(height=720))
        assert [c.height for c in pl.candidates(rows, ["tall"]).collect()] == [2160]
        assert "tall" not in [x.name for x in r.chosen_rules()]
    finally:
        del r.RULES["tall"]


def test_plan_twice_gives_the_same_table_with_ids_of_its_own(probe, table):
    rows = probe(dict(path="/a"), dict(path="/b", height=480))
    old = table("id bigint, path string, decided_at double, rules_fired array<string>, target string, projected_savings_mb double, "
                "status string, output_path string, actual_savings_mb double, error string, run_id bigint",
                (1, "/z", 0.0, [], "t", 1.0, "pending", None, None, None, 1), (2, "/y", 0.0, [], "t", 1.0, "failed", None, None, "e", 1))
    once = pl.pending_replace(old, pl.pending_rows(pl.candidates(rows), 5, 0.0))
    twice = pl.pending_replace(once, pl.pending_rows(pl.candidates(rows), 5, 0.0))
    rest = lambda df: sorted(str(r) for r in df.drop("id").collect())
    assert rest(once) == rest(twice) and once.count() == 3
    # a stored plan that is replaced gives its ids to no other row; the plan alone, made again, is the same
    ids = lambda df: {r.id for r in df.filter("status = 'pending'").collect()}
    assert ids(once) == {3, 4} and ids(twice) == {5, 6}
    assert sorted(once.collect()) == sorted(pl.pending_replace(old, pl.pending_rows(pl.candidates(rows), 5, 0.0)).collect())


def test_band_before_limit_keeps_unprobed(probe, table):
    ledger = table("id bigint, path string, status string, projected_savings_mb double",
                   (1, "/uhd", "pending", 9.0), (2, "/hd", "pending", 5.0), (3, "/unknown", "pending", 1.0))
    rows = probe(dict(path="/uhd", height=2160), dict(path="/hd", height=1080))
    assert [x.path for x in pl.apply_queue(ledger, rows, 720, 1439, 2).collect()] == ["/hd", "/unknown"]


def test_bands_from_a_table(spark, table):
    rng = random.Random(6)
    ddl = "name string, min_height int, max_height int, place int, quality int"
    for n in (1, 40):
        bands = []
        for i in range(n):
            low = rng.choice([None, rng.randint(-50, 3000), 20_000])
            high = rng.choice([None, (low or 0) + rng.randint(-20, 900)])
            bands.append((f"b{i}", low, high, rng.randint(0, 5), i))
        heights = [(i, rng.choice([None, rng.randint(-200, 4000), rng.randint(0, 100_000), 0])) for i in range(400)]

        def best(h):
            held = [b for b in bands if h is not None and (b[1] is None or b[1] <= h) and (b[2] is None or h <= b[2])]
            return min(held, key=lambda b: (b[3], b[0])) if held else (None,) * 5
        got = bn.with_band(table("id int, height int", *heights), table(ddl, *bands)).collect()
        assert len(got) == len(heights)
        assert {(r.id, r.preset, r.min_height, r.max_height, r.quality) for r in got} == {(i, best(h)[0], best(h)[1], best(h)[2], best(h)[4]) for i, h in heights}
    none = bn.with_band(table("id int, height int", (1, 5)), table(ddl)).collect()
    assert [(r.id, r.preset) for r in none] == [(1, None)]


def test_ids_rise_over_runs_and_reruns_agree(spark, table):
    ledger = "id bigint, path string, status string, run_id bigint"
    old = table(ledger, (3, "/a", "completed", 1), (9, "/z", "pending", 1))
    fresh = table(ledger, *[(None, f"/{i:04d}", "pending", 2) for i in range(1000)]).repartition(7)
    first = {r.path: r.id for r in pl.pending_replace(old, fresh).collect()}
    # the dropped row's id is never given again
    assert first == {"/a": 3} | {f"/{i:04d}": 10 + i for i in range(1000)}
    assert {r.path: r.id for r in pl.pending_replace(old, fresh.repartition(3)).collect()} == first
    second = pl.pending_replace(pl.pending_replace(old, fresh), fresh.limit(0).unionByName(table(ledger, (None, "/new", "pending", 3))))
    assert {r.path: r.id for r in second.collect()} == {"/a": 3, "/new": 1010}
    empty = pl.pending_replace(old, fresh.limit(0))
    assert [r.id for r in empty.collect()] == [3]
    again = pl.pending_replace(empty, table(ledger, (None, "/n", "pending", 4)), last_id=9)
    assert {r.path: r.id for r in again.collect()} == {"/a": 3, "/n": 10}
    assert pl.pending_replace(old.limit(0), fresh).agg(F.min("id")).first()[0] == 1


def test_the_deepest_root_covers_a_path(table):
    files = table("path string, size int", *[(x, i) for i, x in enumerate(["/m/a/x.mkv", "/m/a/b/y.mkv", "/m/ab/z.mkv", "/n/w.mkv", "/m/a", "top.mkv"])])
    roots = table("root string, run int", ("/m", 1), ("/m/a/", 2), ("/m/a/b/y.mkv", 3), ("/q", 4))
    got = {r.path: (r.root, r.run, r.size) for r in pl.covering_roots(files, roots).collect()}
    assert got == {"/m/a/x.mkv": ("/m/a/", 2, 0), "/m/a/b/y.mkv": ("/m/a/b/y.mkv", 3, 1), "/m/ab/z.mkv": ("/m", 1, 2), "/m/a": ("/m/a/", 2, 4)}
    assert {r.path: r.run for r in pl.covering_roots(files, table("root string, run int", ("/", 7))).collect()} == {
        x: 7 for x in ["/m/a/x.mkv", "/m/a/b/y.mkv", "/m/ab/z.mkv", "/n/w.mkv", "/m/a"]}


def test_size_sketches_add_up(spark, probe):
    rows = probe(dict()).selectExpr("*", "explode(sequence(1, 20000)) AS i").withColumn("size", F.expr("i * i % 7919 * 1000"))
    halves = [au.size_sketches(rows.filter(f"i % 2 = {n}")) for n in (0, 1)]
    merged = au.merged_sketches(halves[0].unionByName(halves[1]))
    exact = sorted(r["size"] for r in rows.select("size").collect())
    got = au.size_quantiles(merged).collect()
    assert [r.files for r in got] == [20000] * 5
    assert all(abs(sum(x <= r["size"] for x in exact) / 20000 - r.at) < 0.03 for r in got)


def test_import_queue(probe, table):
    probes = probe(dict(path="/fat.mkv", video_bitrate=30_000_000), dict(path="/old.mkv", video_codec="mpeg2video", video_bitrate=1), dict(path="/fine.mkv", video_codec="av1", video_bitrate=1_000_000))
    arrivals = "path string, seen_at double, replaces string"
    queue = im.merge_arrivals(table(im.QUEUE), table(arrivals, ("/old.mkv", 2.0, None), ("/fat.mkv", 1.0, None), ("/fine.mkv", 0.0, None), ("/new.mkv", 0.5, None), ("/fat.mkv", 1.0, None)))
    changed = im.drain(queue, probes, 1)
    queue = im.settle(queue, changed)
    state = lambda q: {r.path: r.status for r in q.collect()}
    assert state(queue) == {"/fat.mkv": "taken", "/old.mkv": "pending", "/fine.mkv": "left", "/new.mkv": "pending"}
    # told once more: nothing; an upgrade: pending again
    queue = im.merge_arrivals(queue, table(arrivals, ("/fat.mkv", 1.0, None), ("/fine.mkv", 5.0, "/was.mkv"), ("/fine.mkv", 4.0, None)))
    assert state(queue) == {"/fat.mkv": "taken", "/old.mkv": "pending", "/fine.mkv": "pending", "/new.mkv": "pending"}
    # what came again while the worker looked stays pending
    late = im.merge_arrivals(queue, table(arrivals, ("/old.mkv", 9.0, None)))
    assert state(im.settle(late, im.drain(queue, probes, 5)))["/old.mkv"] == "pending"
    ledger = table("id bigint, path string, status string, output_path string, decided_at double", (1, "/was.mkv", "completed", "/was.AV1.mkv", 1.0), (2, "/was.mkv", "failed", None, 2.0))
    assert [tuple(r) for r in im.outdated_outputs(queue, ledger).collect()] == [("/was.mkv", "/was.AV1.mkv", "/fine.mkv")]
