"""Near-duplicate groups by circulant MinHash.

Two permutations make all coordinates of a signature. The first scatters a shingle to one of 2**20 places; the second,
shifted by one place more for each coordinate and closed to a ring, gives it a value there, and a coordinate is the
smallest value over the shingles of a document. As the shifted copies of the second permutation are neighbours in
memory, one read of a run of values serves all coordinates of a shingle.

BANDS bands of ROWS coordinates each: two documents of similarity 0.8 share none with a chance of about 5 in 10 million,
(1 - 0.8**6)**48. Documents with equal shingle sets are one class and only its smallest doc_id goes on. In a bucket of
equal bands every class is compared with the bucket's smallest on the full sets of both whole texts, and linked classes
are joined to components. Then the buckets that still hold several components are settled: members of different
components are compared block against block, first by signature (EARLY lies five deviations under the threshold), then
on full sets. So a group of n copies costs n comparisons and not n squared, no list of pairs is made, and yet no pair of
different components in a bucket stays uncompared. No bucket is capped.

Shingles are 64-bit fingerprints of runs of words. Nodes are doc_ids: rows that repeat one are one node. A row whose
doc_id is null is linked with nothing, has a null component and is kept. Null, empty and blank texts have no shingles
and link with nothing. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordPrints, map_batches, mix, packed, shingle_prints, slices, stored, word_spans, work_dir

PLACES = 1 << 20
BANDS, ROWS = 48, 6
EARLY = 0.68
BLOCK, TEXT_BLOCK = 512, 128
SEED = 20


class Signer:
    """Shingle sets, set fingerprints and circulant signatures of texts."""

    def __init__(self, width: int):
        self.width, self.prints, self.size = width, WordPrints(SEED), BANDS * ROWS
        ring = np.random.default_rng(SEED).permutation(PLACES).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:self.size]]), self.size)
        self.factors = mix(np.arange(1, self.size + 1, dtype=np.uint64)) | np.uint64(1)

    def sets(self, offsets, data) -> list[np.ndarray]:
        """The distinct shingles of each text, sorted."""
        spans, counts = word_spans(data, offsets)
        shingles, n = shingle_prints(self.prints(data, spans), counts, self.width)
        return [np.unique(x) for x in np.split(shingles, np.cumsum(n)[:-1])] if len(n) else []

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (shingles >> np.uint64(44)).astype(np.int64)
        least = np.full(self.size, 2**32 - 1, np.uint32)
        for i in range(0, len(places), 256):
            np.minimum(least, self.shifted[places[i:i + 256]].min(axis=0), out=least)
        return least

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        """Keys of the bands, one row per signature."""
        parts = (signatures.astype(np.uint64) + np.uint64(1)) * self.factors
        return mix(parts.reshape(len(signatures), BANDS, ROWS).sum(2, dtype=np.uint64)).view(np.int64)


#: Kept by a Python worker from task to task.
_signers: dict = {}


def signer(width) -> Signer:
    """The one of this process."""
    if width not in _signers:
        _signers[width] = Signer(width)
    return _signers[width]


def sign(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, f1, f2 (fingerprint of the set), bands, sketch (a byte of each coordinate)."""
    def run(batches):
        s = signer(width)
        for batch in batches:
            for first, offsets, data in slices(batch.column(1)):
                sets = s.sets(offsets, data)
                n = np.array([len(x) for x in sets])
                flat = np.concatenate(sets)
                at = np.concatenate([[0], np.cumsum(n)])
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + mix(np.array([salt], np.uint64))), dtype=np.uint64)])
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                signatures = np.array([s.signature(x) for x in sets], np.uint32)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(s.bands(signatures).ravel()))
                sketch = signatures.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                     bands, pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"])

    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, sketch binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar."""
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))

    def run(batches):
        s = signer(width)
        for batch in batches:
            for first, offsets, data in slices(batch.column(2)):
                n = len(offsets) - 1
                left, right = s.sets(offsets, data), []
                for _, o, d in slices(batch.column(3).slice(first, n)):
                    right += s.sets(o, d)
                linked = [similar(x, y, percent) for x, y in zip(left, right)]
                yield batch.select(["a", "b"]).slice(first, n).filter(pa.array(linked))

    return map_batches(both, run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): nodes of the edges (a, b) with the smallest node they reach.

    Rounds of large and small stars: every node hands its larger, then its smaller neighbours to the smallest one. Rounds
    grow with the logarithm of the longest chain; each is written to shared files.
    """
    edges = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/0")
    seen, turn = None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen, turn = state, turn + 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stored(small.filter("u != v").distinct(), f"{folder}/{turn}")


class Forest:
    """Union-find over the rows of one group."""

    def __init__(self, homes):
        self.up = {}
        self.at = [int(h) for h in homes]

    def root(self, x):
        while self.up.get(x, x) != x:
            self.up[x] = x = self.up.get(self.up[x], self.up[x])
        return x

    def apart(self, i, j):
        return self.root(self.at[i]) != self.root(self.at[j])

    def join(self, i, j):
        self.up[self.root(self.at[i])] = self.root(self.at[j])


def block_edges(members: DataFrame, carried: DataFrame, size: int, judge, named="doc_id") -> DataFrame:
    """Edges (a, b) between members of a group that lie in different components and pass a test.

    members: key, doc_id, component. carried: doc_id, sketch and what else `judge` needs. A group's largest component is cut into blocks
    by hash, and so are its other members; each block of these meets each block of the largest one, and each other, in
    about 2 * size rows. The largest component never meets itself, and no task grows with a group. Only edges that join
    something are returned, fewer than rows. judge(rows) -> test(i, j): are these rows linked? named: what an edge tells
    of its ends.
    """
    extra = [c for c in carried.columns if c not in ("doc_id", "sketch")]
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).select(
        "key", F.col("top.component").alias("most"), F.ceil(F.col("top.n") / size).cast("int").alias("large"),
        F.ceil((F.col("n") - F.col("top.n")) / size).cast("int").alias("small"))
    is_large = F.col("component") == F.col("most")
    own = F.pmod(F.xxhash64("doc_id"), F.when(is_large, F.col("large")).otherwise(F.col("small"))).cast("int")
    # cells (i, j): i of the small blocks, j of the large ones from 0 up, or of the small ones from -1 down
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    me = F.col("own")
    cells = F.when(is_large, F.transform(each("small"), lambda i: cell(i, me, F.lit(-1)))).otherwise(F.concat(
        F.transform(each("large"), lambda j: cell(me, j, me)),
        F.transform(each("small"), lambda i: cell(F.least(me, i), -1 - F.greatest(me, i), me))))
    spread = (members.join(groups.filter("small > 0"), "key").join(carried, "doc_id").withColumn("own", own).withColumn("cell", F.explode(cells))
              .select("key", "cell.i", "cell.j", F.col("cell.side").alias("own"), "doc_id", "component", "sketch", *extra))
    # of a block against the largest component, its own rows come first: each is compared with all that follow
    ordered = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("own"))

    def compare(rows):
        own, ids, homes = (np.array([r[k] for r in rows]) for k in (0, 1, 2))
        if len(rows) < 2 or len(np.unique(homes)) < 2:
            return
        sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        across, forest, test = own.min() != own.max(), Forest(homes), judge(rows)
        for k in range(len(rows) - 1):
            # of two blocks, only pairs across: pairs inside a block meet in the block's own group
            near = (homes[k + 1:] != homes[k]) & ((own[k + 1:] != own[k]) | (not across))
            near[near] = (sketches[k + 1:][near] == sketches[k]).mean(1) >= EARLY
            for x in (np.flatnonzero(near) + k + 1).tolist():
                if forest.apart(k, x) and test(k, x):
                    forest.join(k, x)
                    ends = homes if named == "component" else ids
                    yield int(min(ends[k], ends[x])), int(max(ends[k], ends[x]))

    def edges(found):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        held, rows = None, []
        for batch in batches:
            for key, i, j, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (key, i, j) != held:
                    if found := list(compare(rows)):
                        yield edges(found)
                    held, rows = (key, i, j), []
                rows.append(row)
        yield edges(list(compare(rows)))

    return map_batches(ordered, run, "a bigint, b bigint").distinct()


def settled(shared: DataFrame, joined: DataFrame, heads: DataFrame, texts: DataFrame, folder: str, width: int, percent: int) -> DataFrame | None:
    """Links between different components that meet in a bucket, which its smallest class didn't show; None if there are none."""
    placed = shared.filter("n > 2").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    # buckets with the same components are one: copies that share all bands lie in one group, and not in BANDS of them
    sum_of = lambda salt: F.sum(F.xxhash64("component", F.lit(salt)).cast("decimal(38,0)"))
    open_ = (placed.groupBy("key", "component").agg(F.lit(1).alias("one")).groupBy("key")
             .agg(F.count(F.lit(1)).alias("parts"), sum_of(1).alias("x"), sum_of(2).alias("y")).filter("parts > 1")
             .select("key", F.xxhash64("parts", "x", "y").alias("group")))
    sketches = heads.select("doc_id", "sketch").dropDuplicates(["doc_id"])
    members = stored(placed.join(open_, "key").select(F.col("group").alias("key"), "doc_id", "component").distinct(), f"{folder}/members")
    alike = stored(block_edges(members, sketches, BLOCK, lambda rows: lambda i, j: True, "component"), f"{folder}/alike")
    if alike.isEmpty():
        return None
    # components that look alike, over however many steps, are compared on full sets
    stars = components(alike, f"{folder}/clusters")
    clusters = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    members = stored(members.drop("key").dropDuplicates(["doc_id"])
                     .join(clusters.select(F.col("component").alias("key"), F.col("node").alias("component")), "component"), f"{folder}/clustered")

    def judge(rows):
        sets = []
        for _, offsets, data in slices(pa.array([r[4] for r in rows], pa.string())):
            sets += signer(width).sets(offsets, data)
        return lambda i, j: similar(sets[i], sets[j], percent)

    return stored(block_edges(members, sketches.join(texts, "doc_id"), TEXT_BLOCK, judge), f"{folder}/settled")


def near_groups(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with the same set)."""
    folder = work_dir(docs.sparkSession, "near-dedup")
    signed = stored(sign(docs, width), f"{folder}/signed")
    whole = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = whole.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("class_id"))
    heads = whole.join(classes.select(F.col("class_id").alias("doc_id"), "n_shingles", "f1", "f2"), ["doc_id", "n_shingles", "f1", "f2"], "left_semi")
    entries = heads.select("doc_id", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(entries.join(buckets, "key").filter("doc_id != pivot"), f"{folder}/shared")
    pairs = shared.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stored(docs.select("doc_id", "text").join(needed, "doc_id", "left_semi"), f"{folder}/texts")
    links = stored(confirmed(pairs, texts, width, percent), f"{folder}/links")
    joined = components(links, f"{folder}/joined")
    more = settled(shared, joined, heads, texts, folder, width, percent)
    if more is not None:
        joined = components(links.union(more), f"{folder}/all")
    named = classes.join(joined.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    named = named.select("n_shingles", "f1", "f2", "class_id", F.coalesce("component", "class_id").alias("component"))
    linked = F.col("n_shingles") > 0
    return (signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["n_shingles", "f1", "f2"], "left")
            .select("doc_id", "n_shingles", F.when(linked & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
                    "class_id")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, of which one stays of each group: the one with the smallest doc_id."""
    kept = near_groups(docs, width, percent).filter("kept").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("same"))
    kept = stored(kept, work_dir(docs.sparkSession, "near-kept"))
    there = F.col("row.doc_id").eqNullSafe(F.col("id"))
    single = (F.col("same") == 1) | F.col("id").isNull()
    once = packed(docs).join(kept.filter(single), there).select("row.*")
    if kept.filter(~single).isEmpty():
        return once
    return once.unionByName(packed(docs).join(kept.filter(~single), there).dropDuplicates(["id"]).select("row.*"))
