import random
from itertools import combinations

import numpy as np

from mediacairn.llm import near_dedup


def shingles(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent=80):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, width))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in combinations([i for i in sorted(sets) if sets[i]], 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows, n = [], 0
    for size in (1, 3, 4, 5, 12, 40, 200):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, size // 20, size // 10, size // 6):
                other = list(base)
                for _ in range(edits):
                    other[rng.randrange(size)] = word()
                rows.append((n, " ".join(other).title() if edits % 2 else " ".join(other)))
                n += 1
    return rows


def test_against_brute_force(docs):
    for width in (4, 5):
        rows = corpus(width)
        want = brute(rows, width)
        got = near_dedup.near_groups(docs(*rows), width).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hub_that_is_not_the_smallest(docs):
    # all are linked through the last one only, so no bucket's smallest class shows it
    rng = random.Random(3)
    hub = [f"w{i}" for i in range(300)]
    rows = []
    for n in range(70):
        other = list(hub)
        for at in rng.sample(range(0, 300, 5), 7):
            other[at] = f"n{n}x{at}"
        rows.append((n, " ".join(other)))
    rows.append((99, " ".join(hub)))
    want = brute(rows, 4)
    assert len({c for _, c in want.values()}) < 71
    got = near_dedup.near_groups(docs(*rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_odd_rows(docs, odd):
    got = near_dedup.near_groups(docs(*odd)).collect()
    want = brute([r for r in odd if r[0] is not None], 4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted((i, *want[i]) for i, _ in odd if i is not None)
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(1, None, True)]
    kept = near_dedup.near_dedup(docs(*odd, clashing=True), width=4)
    assert kept.columns == docs(*odd, clashing=True).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in {*(i for i, (_, c) in want.items() if i == c), None})


def test_components_of_long_chains(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint"), str(tmp_path))
    assert dict(got.collect()) == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}


def test_signature_is_circulant():
    s = near_dedup.Signer(4)
    places = np.array([5, 77, 2**20 - 1])
    ring = s.shifted[:, 0]
    ring = np.concatenate([ring, s.shifted[-1, 1:]])[:2**20]
    got = s.signature(places.astype(np.uint64) << np.uint64(44))
    assert got.tolist() == [min(int(ring[(p + k) % 2**20]) for p in places) for k in range(s.size)]
    assert sorted(ring.tolist()) == list(range(2**20))
