import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from mediacairn.llm import resampling


def features(text, order):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i:i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def brute(rows, aims, order=1, buckets=10_000, least=20, percent=10):
    """Rows of doc_id, n_features, weight, score, rank."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    counts = [[0] * buckets, [0] * buckets]
    for side, texts in enumerate(([t for _, t in rows], aims)):
        for t in texts:
            for f in features(t, order)[1]:
                counts[side][bucket(f)] += 1
    s, t = counts
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, able = [], []
    for i, text in rows:
        words, all_ = features(text, order)
        weight = sum(gain[bucket(f)] for f in all_) // len(all_) if all_ else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= least:
                able.append((-score, i))
        out.append((i, len(all_), weight, score))
    able.sort()
    rank = {i: k + 1 for k, (_, i) in enumerate(able[:len(able) * percent // 100])}
    return sorted(((*r, rank.get(r[0])) for r in out), key=str)


def result(found):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in
                   found.select("row.doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé日9") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    text = lambda k: "".join(rng.choice(words[:k]).title() + rng.choice([" ", "  ", "\n", ", ", "_\x00", "é "]) for _ in range(rng.randint(0, 60)))
    return [(i * 7, text(200)) for i in range(n)], [text(40) for _ in range(20)]


@pytest.mark.parametrize("order, buckets, size", [(1, 10_000, 1 << 16), (3, 97, 30), (2, 1000, 0)])
def test_against_brute_force(spark, docs, order, buckets, size):
    rows, aims = corpus(order)
    aim = spark.createDataFrame([(t,) for t in aims], "text string")
    got = resampling.resample(docs(*rows), aim, order=order, buckets=buckets, size=size)
    want = brute(rows, aims, order, buckets)
    assert sum(r[4] is not None for r in want) > 5
    assert result(got) == want


def test_payloads_compose():
    shift, rng = resampling.Shift(), random.Random(1)
    left = [rng.randbytes(rng.randint(0, 9)) for _ in range(50)] + [b"x" * 70_000]
    right = [rng.randbytes(rng.randint(0, 300)) for _ in range(50)] + [b"y" * 100_000]
    pay = lambda parts: (np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([len(p) for p in parts]))
    crc, size = shift.join(pay(left), pay(right))
    assert crc.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(left, right)]
    assert size.tolist() == [len(a) + 1 + len(b) for a, b in zip(left, right)]


def test_odd_rows(spark, docs, odd):
    rows = [r for r in odd if r[0] != 5] + [(40, "same words " * 15), (41, "same words " * 15), (42, "w" * 100 + " w" * 30)]
    aims = ["same words", None, ""]
    aim = spark.createDataFrame([(t, 1) for t in aims], "text string, row int")
    got = resampling.resample(docs(*rows, clashing=True), aim, percent=50)
    assert result(got) == brute(rows, aims, percent=50)
    assert got.select("row.*").columns == [c for c in docs(clashing=True).columns if c != "text"]
    assert resampling.resample(docs(), aim).count() == 0
    assert result(resampling.resample(docs(*rows), aim.limit(0))) == brute(rows, [])


def test_rows_that_repeat_an_id(spark, docs):
    rows = [(1, "one " * 30)] * 3 + [(2, "two " * 30)]
    got = resampling.resample(docs(*rows), spark.createDataFrame([("two",)], "text string"), percent=75).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len(got) == 4
