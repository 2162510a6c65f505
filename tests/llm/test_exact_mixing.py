import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from mediacairn.llm import exact_dedup, mixing


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_groups_against_python(docs, odd):
    rows = odd + [(20, "ÉCOLE a"), (21, "École A"), (22, "école a")]
    want = defaultdict(list)
    for i, t in rows:
        want[fold(t)].append(i)
    got = exact_dedup.exact_groups(docs(*rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        same = next(v for k, v in want.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(same) and r.keep_id == max((x for x in same if x is not None), default=None)
    assert sum(r.kept for r in got) == len(want)  # one row stays, also of rows that repeat the id


def test_rows_stay_whole(docs, odd):
    kept = exact_dedup.exact_dedup(docs(*odd, clashing=True))
    assert kept.columns == docs(*odd, clashing=True).columns
    assert sorted((fold(r.text), r.doc_id) for r in kept.collect()) == sorted(
        {fold(t): max((i for i, u in odd if fold(u) == fold(t) and i is not None), default=None) for _, t in odd}.items())


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key")).withColumn("slot", F.shiftrightunsigned("key", 48).cast("int"))
    slots = exact_dedup.directory(keys.union(keys), capacity=20)  # repeated keys don't fill a bucket
    held = keys.join(slots, "slot").groupBy("depth", "bucket").count().collect()
    assert sum(r["count"] for r in held) == 3000 and max(r["count"] for r in held) <= 20
    assert 7 < max(r.depth for r in held) <= 16
    assert all(r.bucket % (1 << 16 - r.depth) == 0 for r in held)


def test_full_depth_keeps_what_doesnt_fit(spark):
    keys = spark.range(50).select(F.col("id").alias("key")).withColumn("slot", F.lit(0))
    assert exact_dedup.directory(keys, capacity=4).collect() == [(0, 16, 0)]


def plan(rows):
    """doc_id -> words taken, and source -> target, in plain Python."""
    sizes = [(i, s, len((t or "").split())) for i, t, s in rows]
    words = defaultdict(int)
    for _, s, n in sizes:
        words[s] += n
    names = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(words.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * words[s]]
        if not over:
            return sizes, words, target | share
        for s in over:
            target[s] = 2 * words[s]
            left -= target[s]
            open_.remove(s)


def test_mix_against_python(docs):
    rows = [(i, "w " * (i * 37 % 90), ["a", "b", "c", None, ""][min(i % 9, 4)]) for i in range(700)] + [(900, None, "a"), (901, "x y", "d")]
    sizes, words, target = plan(rows)
    got = {r.doc_id: r for r in mixing.mixed(docs(*rows), rows_a_salt=100).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for i, s, n in sizes:
        r = got[i]
        assert (r.size, r.source_size) == (n, words[s]) and abs(r.target - target[s]) < 1e-6 and 0 <= r.copies <= 2
        assert r.copies in (int(target[s] / words[s]), -int(-target[s] // words[s])) if words[s] else r.copies == 0
        taken[s] += n * r.copies
    for s in words:
        assert abs(taken[s] - target[s]) <= 2 * 90, s


def test_mix_repeats(docs, odd):
    table = docs(*odd, clashing=True)
    first, again = mixing.mix(table), mixing.mix(table)
    assert first.columns == table.columns
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_no_words_at_all(docs):
    assert {r.copies for r in mixing.mixed(docs((1, None), (2, ""))).collect()} == {0}


def test_native():
    for module in (exact_dedup, mixing):
        text = open(module.__file__).read()
        assert not any(w in text for w in ("udf", "InPandas", "InArrow", "toPandas", ".rdd", "numpy"))
