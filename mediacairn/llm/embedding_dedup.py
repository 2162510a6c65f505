"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned into the axes of their principal components, largest variance first (second
moments are summed on Spark; only a square matrix as wide as a vector comes to the driver). In a task two tiles of
vectors meet: products of the leading coordinates are accumulated first, and what the rest can add is bounded by the
product of the two suffix norms. A pair is dropped as soon as its cosine cannot reach the threshold any more; pairs
that last to the end are links, and those within 1e-9 of the threshold are worked out again from the given vectors.

Which tiles meet is decided by the same leading coordinates: a tree of splits, fitted on about SAMPLE vectors and
never more than LEAVES leaves (bounds of the layout only, no result depends on it), gives each vector a leaf; a leaf's
box holds all its vectors. A vector goes to another leaf only if it is no farther from that box than linked vectors can
be, and leaves with many vectors are cut into tiles of about TILE by hash. So no task grows with the input or with a
group of look-alikes; the work of a group is quadratic, as its links are, but only counts and a spanning forest leave a
task, at most one edge a vector. Equal vectors are one class, compared once and counted with their number.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of different length
or rows without vec_id (component null, kept). Rows that repeat a vec_id count as vectors of their own and lie
in one component. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import importable, map_batches, stored, work_dir
from .near_dedup import components

TILE, LEAVES, SAMPLE = 4096, 1 << 12, 1 << 15
#: Leading coordinates that boxes are made of, and where a comparison stops to drop pairs.
BOX, STEPS = 16, (8, 16, 32, 64)
NEAR = 1e-9


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes_of(rows: DataFrame) -> DataFrame:
    """id, vec -> id (smallest of equal vectors), n, dim, vec, h (a hash of vec: with id it names a class)."""
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    able = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    return able.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n", F.size("vec").alias("dim"), "vec", F.xxhash64("vec").alias("h"))


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes as columns, largest second moment first, for each length of vectors."""
    def run(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                x = unit(batch.column(1).filter(pa.array(dims == dim)))
                at = np.arange(dim * dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(at), pa.array((x.T @ x).ravel())],
                                                 names=["dim", "at", "m"])

    moments = map_batches(classes.select("dim", "vec"), run, "dim int, at bigint, m double").groupBy("dim", "at").agg(F.sum("m").alias("m"))
    found = moments.groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda x: x["m"]).alias("m")).collect()
    return {r.dim: np.linalg.eigh(np.array(r.m).reshape(r.dim, r.dim))[1][:, ::-1] for r in found}


def split_tree(points: np.ndarray, leaves: int) -> list:
    """Splits (axis, value) in the order of a complete binary tree, None where nothing is split."""
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    tree, parts = [], [points]
    for _ in range(depth):
        below = []
        for p in parts:
            spread = p.max(axis=0) - p.min(axis=0) if len(p) else np.zeros(1)
            axis = int(spread.argmax())
            value = float(np.median(p[:, axis])) if len(p) and spread[axis] > 0 else None
            tree.append(None if value is None else (axis, value))
            low = p[:, axis] < value if value is not None else np.ones(len(p), bool)
            below += [p[low], p[~low]]
        parts = below
    return tree


def leaf_of(points: np.ndarray, tree: list) -> np.ndarray:
    """Leaf numbers: the way through the tree, read as bits."""
    at, first = np.zeros(len(points), np.int64), len(tree)
    for i in range(first):  # children follow their parents
        if tree[i] is None:
            at[at == i] = 2 * i + 1
        else:
            here = np.flatnonzero(at == i)
            at[here] = 2 * i + 1 + (points[here, tree[i][0]] >= tree[i][1])
    return at - first


class Layout:
    """Axes, trees and boxes: what tasks need to know to deal vectors out."""

    def __init__(self, basis, trees):
        self.basis, self.trees, self.boxes = basis, trees, {}

    def leading(self, x: np.ndarray) -> np.ndarray:
        return x @ self.basis[x.shape[1]][:, :BOX]

    def by_length(self, batch, dims, vecs):
        """(rows, unit vectors) for each length of vectors in a batch."""
        dims = batch.column(dims).to_numpy()
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            yield dim, rows, unit(batch.column(vecs).take(pa.array(rows)))


def layout_of(classes: DataFrame, tile: int) -> Layout:
    """Axes of all vectors, and splits by the leading coordinates of about SAMPLE of them, drawn by hash."""
    counts = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}
    layout = Layout(axes(classes), {})
    shared = classes.sparkSession.sparkContext.broadcast(layout)
    share = min(1.0, SAMPLE / max(1, sum(counts.values())))
    drawn = classes.filter(F.pmod(F.xxhash64("id", "h"), F.lit(1 << 30)) < int(share * (1 << 30))).select("dim", "vec")

    def run(batches):
        for batch in batches:
            for dim, _, x in shared.value.by_length(batch, 0, 1):
                lead = shared.value.leading(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lead), dim, np.int32)), pa.array(list(lead), pa.list_(pa.float64()))], names=["dim", "lead"])

    points = {}
    for r in map_batches(drawn, run, "dim int, lead array<double>").collect():
        points.setdefault(r.dim, []).append(r.lead)
    # in one order, however tasks end: the splits are then the same in a rerun
    layout.trees = {dim: split_tree(np.array(sorted(points.get(dim, []))).reshape(-1, min(dim, BOX)), min(LEAVES, -(-n // tile))) for dim, n in counts.items()}
    return layout


def placed(classes: DataFrame, layout) -> DataFrame:
    """The classes with their leaf. layout: a broadcast Layout."""
    schema = f"{classes.schema.simpleString()[7:-1].replace(':', ' ')}, leaf int"

    def run(batches):
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int32)
            for dim, rows, x in layout.value.by_length(batch, 2, 3):
                leaf[rows] = leaf_of(layout.value.leading(x), layout.value.trees[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return map_batches(classes, run, schema)


def boxes_of(leaved: DataFrame, layout) -> dict:
    """dim -> (leaves, lower corners, upper corners, vectors in the leaf) of all vectors: at most LEAVES boxes a length."""
    def run(batches):
        for batch in batches:
            leaf = batch.column(5).to_numpy()
            for dim, rows, x in layout.value.by_length(batch, 2, 3):
                lead = layout.value.leading(x)
                for at in np.unique(leaf[rows]):
                    here = lead[leaf[rows] == at]
                    k = np.arange(here.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full_like(k, dim)), pa.array(np.full_like(k, at)), pa.array(k), pa.array(here.min(axis=0)),
                         pa.array(here.max(axis=0)), pa.array(np.full(len(k), len(here)))], names=["dim", "leaf", "k", "low", "high", "n"])

    found = (map_batches(leaved, run, "dim int, leaf int, k int, low double, high double, n bigint")
             .groupBy("dim", "leaf", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect())
    out = {}
    for dim in {r.dim for r in found}:
        rows = sorted((r.leaf, r.k, r.low, r.high, r.n) for r in found if r.dim == dim)
        wide = len({r[1] for r in rows})
        table = np.array([r[2:] for r in rows]).reshape(-1, wide, 3)
        out[dim] = (np.array([r[0] for r in rows[::wide]]), table[:, :, 0], table[:, :, 1], table[:, 0, 2].astype(np.int64))
    return out


def dealt(leaved: DataFrame, layout, threshold: float, tile: int) -> DataFrame:
    """The classes with a, sa, b, sb, side: each class once for every pair of tiles in which it may have a link.

    a, b are leaves and sa, sb tiles in them; side 0 belongs to (a, sa), side 1 to (b, sb). A tile also meets itself.
    """
    reach = 2 - 2 * threshold + NEAR  # squared distance of linked vectors

    def run(batches):
        for batch in batches:
            salt, own_leaf = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            for dim, rows, x in layout.value.by_length(batch, 2, 3):
                leaves, low, high, n = layout.value.boxes[dim]
                tiles = -(-n // tile)
                lead = layout.value.leading(x)
                place = np.searchsorted(leaves, own_leaf[rows])
                picked, keys = [], []
                for i, (row, p) in enumerate(zip(rows.tolist(), place.tolist())):
                    gap = np.maximum(0, np.maximum(low - lead[i], lead[i] - high))
                    own = int(salt[row] % tiles[p])
                    for q in np.flatnonzero((gap * gap).sum(axis=1) <= reach).tolist():
                        for s in range(int(tiles[q])):
                            me, other = (int(leaves[p]), own), (int(leaves[q]), s)
                            picked.append(row)
                            keys.append((*me, *other, 0) if me <= other else (*other, *me, 1))
                    if len(picked) >= 10_000:
                        yield copies(batch, picked, keys)
                        picked, keys = [], []
                if picked:
                    yield copies(batch, picked, keys)

    def copies(batch, picked, keys):
        rows = batch.take(pa.array(picked))
        return pa.RecordBatch.from_arrays([*rows.columns[:5], *[pa.array([k[i] for k in keys], pa.int32()) for i in range(5)]],
                                          names=["id", "n", "dim", "vec", "h", "a", "sa", "b", "sb", "side"])

    return map_batches(leaved, run, "id bigint, n bigint, dim int, vec array<double>, h bigint, a int, sa int, b int, sb int, side int")


class Links:
    """What two tiles find: weighted counts of each row, and a forest over their rows."""

    def __init__(self, weights):
        self.weights, self.counts, self.label = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def add(self, i, j):
        """Links between rows i and j (arrays), each pair once."""
        self.counts += np.bincount(i, self.weights[j], len(self.label)).astype(np.int64) + np.bincount(j, self.weights[i], len(self.label)).astype(np.int64)
        while True:  # hook larger roots to smaller ones, then let every row know its root
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def compare(x, y, threshold, exact, strip=256):
    """Yield (i, j), arrays of linked rows of x and y; y=None: pairs i < j of x. exact(i, j): cosines from the given vectors."""
    same, y = y is None, x if y is None else y
    dim = x.shape[1]
    stops = [s for s in STEPS if s < dim] + [dim]
    tails = [[np.sqrt(np.maximum((v[:, s:] ** 2).sum(axis=1), 0)) for s in stops] for v in (x, y)]
    for top in range(0, len(x), strip):
        rows, start = slice(top, top + strip), top if same else 0
        score = x[rows, :stops[0]] @ y[start:, :stops[0]].T
        alive = score + tails[0][0][rows, None] * tails[1][0][start:] >= threshold - NEAR
        if same:
            alive &= np.arange(start, len(y)) > np.arange(top, min(top + strip, len(x)))[:, None]
        i, j = np.nonzero(alive)
        score = score[i, j]
        i, j = i + top, j + start
        for k in range(1, len(stops)):
            if not len(i):
                break
            part = slice(stops[k - 1], stops[k])
            if 4 * len(i) > alive.size:  # most pairs are left: one product of matrices is cheaper than picking rows
                score = score + (x[rows, part] @ y[start:, part].T)[i - top, j - start]
            else:
                score = score + np.einsum("ij,ij->i", x[i, part], y[j, part])
            left = score + tails[0][k][i] * tails[1][k][j] >= threshold - NEAR
            i, j, score = i[left], j[left], score[left]
        close = np.abs(score - threshold) <= NEAR
        if close.any():
            good = ~close
            good[close] = exact(i[close], j[close]) >= threshold
            i, j = i[good], j[good]
        if len(i):
            yield i, j


def meet(rows: pa.Table, layout: Layout, threshold: float) -> pa.Table:
    """One pair of tiles -> id, h, links, b: links found here for each class, and with which id it is connected."""
    side = rows["side"].to_numpy()
    first = rows.slice(0, 1).to_pylist()
    same = bool(first) and (first[0]["a"], first[0]["sa"]) == (first[0]["b"], first[0]["sb"])
    if len(rows) < 2 or not (same or 0 < side.sum() < len(side)):
        return pa.table({c: pa.array([], pa.int64()) for c in ("id", "h", "links", "b")})
    ids = rows["id"].to_numpy()
    given = unit(rows["vec"])
    turned = given @ layout.basis[given.shape[1]]
    found = Links(rows["n"].to_numpy().astype(np.int64))
    left = np.arange(len(ids)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    exact = lambda i, j: np.array([float(np.dot(given[left[a]], given[right[b]])) for a, b in zip(i, j)])
    for i, j in compare(turned[left], None if same else turned[right], threshold, exact):
        found.add(left[i], right[j])
    hit = np.flatnonzero(found.counts)
    return pa.table({"id": ids[hit], "h": rows["h"].to_numpy()[hit], "links": found.counts[hit], "b": ids[found.label[hit]]})


def near_vectors(rows: DataFrame, threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """rows: vec_id, embedding -> vec_id, n_links, component_id, kept, class_id (smallest vec_id with an equal vector)."""
    spark = rows.sparkSession
    importable(spark)
    folder = work_dir(spark, "embedding-dedup")
    given = rows.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    classes = stored(classes_of(given), f"{folder}/classes")
    layout = layout_of(classes, tile)
    leaved = stored(placed(classes, spark.sparkContext.broadcast(layout)), f"{folder}/leaved")
    layout.boxes = boxes_of(leaved, spark.sparkContext.broadcast(layout))
    shared = spark.sparkContext.broadcast(layout)
    pairs = dealt(leaved, shared, threshold, tile).groupBy("dim", "a", "sa", "b", "sb").applyInArrow(
        lambda t: meet(t, shared.value, threshold), "id bigint, h bigint, links bigint, b bigint")
    found = stored(pairs, f"{folder}/found")
    joined = components(found.select(F.col("id").alias("a"), "b"), f"{folder}/joined")
    sums = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    known = (classes.select("id", "n", "vec", "h").join(sums, ["id", "h"], "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
             .select(F.col("id").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "id").alias("component_id"), "vec"))
    there = F.col("id").isNotNull() & given["vec"].eqNullSafe(known["vec"]) & given["vec"].isNotNull()
    return (given.join(known, there, "left")
            .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"), "class_id")
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
