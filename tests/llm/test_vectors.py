import numpy as np

from mediacairn.llm import embedding_dedup


def brute(rows, threshold=0.9):
    """Rows of (n_links, component, kept)."""
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    vec = [np.array(v, float) / max(map(abs, v)) if o else None for (_, v), o in zip(rows, ok)]
    vec = [v / np.linalg.norm(v) if v is not None else None for v in vec]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                up[y] = x
    return sorted((str(i), n, str(root(i) if i is not None else None)) for (i, _), n in zip(rows, links))


def found(spark, rows, ddl="vec_id bigint, embedding array<double>", **more):
    return embedding_dedup.near_vectors(spark.createDataFrame(rows, ddl), **more)


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in rows)


def crowd(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.25, 0.35, 0.6], n)[:, None]
    x[5:25] = x[4]
    return [(int(i), [float(v) for v in row]) for i, row in zip(rng.permutation(n), x)]


def test_against_brute_force(spark):
    for dim, tile in ((24, 50), (100, 4096), (8, 20)):
        rows = crowd(dim, 300, dim)
        want = brute(rows)
        assert len({c for _, _, c in want}) > 5 and max(n for _, n, _ in want) > 20
        assert result(found(spark, rows, tile=tile)) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
            (8, [2.0, 0.0]), (8, [0.0, 3.0]), (9, [1.0]), (10, [5.0]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (12, [1e-200, 1e-200]), (13, [1e200, 1e200]), (6, [0.0, 1.0])]
    assert result(found(spark, rows)) == brute(rows)
    assert found(spark, []).count() == 0
    wide = found(spark, [(1, [1.0], 2, 3), (2, [2.0], 4, 5)], "vec_id bigint, embedding array<float>, id int, vec int")
    assert result(wide) == [("1", 1, "1"), ("2", 1, "1")]


def test_vectors_at_the_threshold(spark):
    # cosine exactly 0.9 in doubles, and one step below it
    edge = [(1, [1.0, 0.0]), (2, [0.9, (1 - 0.81) ** 0.5]), (3, [0.8999999, (1 - 0.8999999 ** 2) ** 0.5])]
    near = {r.vec_id: r.n_links for r in found(spark, edge).collect()}
    assert near[3] == 1 and near[2] >= 1  # 2 and 3 are close to each other, 3 is not close to 1


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 40)) * np.linspace(3, 0.1, 40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if x[i] @ x[j] >= 0.7}
    exact = lambda i, j: np.array([x[a] @ x[b] for a, b in zip(i, j)])
    got = [(int(a), int(b)) for i, j in embedding_dedup.compare(x, None, 0.7, exact, strip=64) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and set(got) == want
    across = [(int(a), int(b) + 80) for i, j in embedding_dedup.compare(x[:80], x[80:], 0.7, exact, strip=7) for a, b in zip(i, j)]
    assert set(across) == {(i, j) for i, j in want if i < 80 <= j}
