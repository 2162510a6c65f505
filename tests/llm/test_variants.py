import random
import re
import zlib
from collections import Counter

from mediacairn.llm import spelling


def brute(rows, least=5, often=3, times=2, slip=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None and slip else 1
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= often}

    def cut(w):
        return {w[:i] + w[i + 1:] for i in range(len(w))}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return a in cut(b) or b in cut(a)
    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= times * n[w] else None, n[w], len(others)]
    rows = set()
    for w, (form, c, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, c, k, n[form] if form else None))
    return rows


def corpus(seed, docs=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéxyz") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(80):
            w = rng.choice(base)
            if rng.random() < 0.3:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice("abÿ")) + w[at + (kind != 2):]
            words.append(w.title() if rng.random() < 0.2 else w)
        rows.append((i, ", ".join(words)))
    return rows


def result(found):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


def test_against_brute_force(docs):
    rows = corpus(1)
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 50
    assert result(spelling.variants(docs(*rows))) == want


def test_many_small_cells_give_the_same(docs):
    rows = corpus(2)
    assert result(spelling.variants(docs(*rows), cell=5)) == brute(rows)


def test_cells_hold_every_near_word():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcn") for _ in range(rng.randint(5, 7))) for _ in range(300)})
    paths = {w: spelling.vector(w) for w in words}
    inner = {p[:k] for p in list(paths.values())[:40] for k in range(5)} | {b""}
    for a in words[:60]:
        reached = spelling.cells(paths[a], inner)
        assert len(reached) == len(set(reached)) and spelling.home(paths[a], inner) in reached
        for b in words:
            if spelling.near(a, b):
                assert spelling.home(paths[b], inner) in reached or spelling.home(paths[a], inner) in spelling.cells(paths[b], inner)


def test_each_pair_is_found_from_one_side():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abno") for _ in range(rng.randint(5, 6))) for _ in range(250)})
    paths = [spelling.vector(w) for w in words]
    found = list(spelling.Trie(words, paths).search(words, paths))
    want = {frozenset((a, b)) for a, x in enumerate(words) for b, y in enumerate(words) if spelling.near(x, y)}
    assert len(found) == len(want) and {frozenset(p) for p in found} == want


def test_verification_in_blocks_is_the_plain_one():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 7))) for _ in range(200)]
    others = [w for w in words if len(w) == 5]
    i, j = spelling.near_pairs(words, others)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted((a, b) for a, x in enumerate(words) for b, y in enumerate(others) if spelling.near(x, y))


def test_odd_rows(docs, odd):
    rows = odd + [(20, "a" * 300 + " " + "a" * 299 + " "), (21, "a" * 300 + " " + "a" * 299), (22, ("a" * 300 + " ") * 4 + "a" * 299), (None, "sevens sevens Sevens")] + [(n, "Seven×s") for n in (30, 31, 32)]
    want = brute(rows)
    assert ("a" * 299, "a" * 300, "a" * 300, 3, 1, 6) in want
    assert result(spelling.variants(docs(*rows, clashing=True))) == want
    assert spelling.variants(docs()).count() == 0


def test_chains_of_forms(spark, tmp_path):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("w20", None), ("v", None)]
    got = dict(tuple(r) for r in spelling.rooted(spark.createDataFrame(forms, "word string, form string"), str(tmp_path)).collect())
    assert got == {f"w{i}": "w20" for i in range(21)} | {"v": "v"}
