"""Language-model scores: context-tree weighting over bytes, beside an add-one word model.

Context tree. A byte is eight binary decisions, each a node of a binary tree of 255 nodes. Every node has its own
context tree over the one to DEPTH bytes before; each context holds a Krichevsky-Trofimov estimate from counts, and
its weighted probability is the mean of that estimate and of the product over its longer contexts. Training counts are
gathered over all training documents, so the weights are known for good; a bit is then predicted as the mixture of the
estimates at all depths by their posterior weights, and the sum over bits is the code length. What is gathered is a stored
table of runs of DEPTH + 1 bytes, which grows with the input. Its keys hold the nearest byte first, so contexts are ranges
of it: tasks work out contexts of three bytes and more by ranges, and those of two and fewer bytes, 2**16 at most, follow
from sums. The HEAVY_RUNS most frequent runs go to every task with their scores; other runs, seen or not, are
worked out as they are asked for and meet their texts by a join.
Texts are lower-cased (A-Z), stand after DEPTH marks and end with one (0xFF, in no UTF-8 text); the end is predicted too.

Word model. Sum over tokens, which are the words and one end, of log10((c + 1) / (N + V + 1)). Counts live in a table
keyed by 64-bit fingerprints of words. The HEAVY most frequent ones go to every task; only the other tokens move to meet
their counts, so no word is a hot key and no vocabulary is gathered in one place.

Nulls and empties: a null text counts as empty, one token. A null doc_id is never held out. Rows that repeat an id are
scored each. Without training documents every byte costs eight bits and nothing is known. An empty table gives an empty
result.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, UPPER, WordPrints, map_batches, slices, stored, word_spans, work_dir

HEAVY = 65_536
SEED = 8
END = 7  # fingerprint that stands for the end of a text
MARK = 0xFF
FOLD = np.arange(256, dtype=np.uint8)
FOLD[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
WORDS, TRIPLES, RUNS = 0, 1, 2
DEPTH = 5  # bytes of context; a run of one more byte has to fit 63 bits
HEAVY_RUNS = 1 << 20
AT_ONCE = 1 << 19  # rows that a task works out together, and positions of texts / 4

_prints: list = []


def prints() -> WordPrints:
    if not _prints:
        _prints.append(WordPrints(SEED))
    return _prints[0]


def marked(offsets, data):
    """(bytes of all texts, each followed by DEPTH marks and the first after as many; place of each text's first byte)."""
    lengths = np.diff(offsets)
    start = offsets[:-1] + DEPTH * np.arange(1, len(lengths) + 1)
    out = np.full(len(data) + DEPTH * (len(lengths) + 1), MARK, np.uint8)
    out[np.arange(len(data)) + np.repeat(start - offsets[:-1], lengths)] = FOLD[data]
    return out, start


def runs(offsets, data):
    """(run that ends with each byte of the texts and with their ends, place of each text's first among them)."""
    text, start = marked(offsets, data)
    wide = text.astype(np.int64)
    keys = wide[DEPTH:].copy()
    for j in range(1, DEPTH + 1):
        keys |= wide[DEPTH - j:-j] << (8 * (DEPTH + 1 - j))
    scored = np.ones(len(text), bool)
    for j in range(1, DEPTH):
        scored[start + np.diff(offsets) + j] = False  # the later marks after a text
    return keys[scored[DEPTH:]], offsets[:-1] + np.arange(len(start))


def merged(parts):
    """(keys, counts) pairs -> distinct keys in order and the sums of their counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def gathered(docs: DataFrame) -> DataFrame:
    """(kind, key, n): how often each word, each run of DEPTH + 1 bytes, and each run of three bytes occurs in `docs`.

    Keys of RUNS hold the byte before first, then the one before that, and the byte itself last; keys of TRIPLES are
    in the order of the text.
    """
    def batch_of(kind, keys, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

    def run(batches):
        waiting, held, parts = [], 0, []

        def counted():
            parts.append(np.unique(np.concatenate(waiting), return_counts=True))
            waiting.clear()

        def flushed():
            keys, n = merged(parts)
            parts.clear()
            yield batch_of(RUNS, keys, n)
            last, before = keys >> (8 * DEPTH), keys >> (8 * DEPTH - 8) & 255
            yield batch_of(TRIPLES, *merged([(before << 16 | last << 8 | keys & 255, n)]))

        for batch in batches:
            for _, offsets, data in slices(batch.column(0)):
                spans, _ = word_spans(data, offsets)
                words, n = np.unique(prints()(data, spans).view(np.int64), return_counts=True)
                yield batch_of(WORDS, np.append(words, END), np.append(n, len(offsets) - 1))
                waiting.append(runs(offsets, data)[0])
                held += len(waiting[-1])
                if held >= 4 * AT_ONCE:
                    counted()
                    held = 0
                    if sum(len(k) for k, _ in parts) >= 8 * AT_ONCE:
                        parts[:] = [merged(parts)]
                        if len(parts[0][0]) >= 4 * AT_ONCE:
                            yield from flushed()
        if waiting:
            counted()
        if parts:
            yield from flushed()

    counted = map_batches(docs.select("text"), run, "kind int, key bigint, n bigint")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5: Stirling's series past 10."""
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(10):
        low = z < 10
        if not low.any():
            break
        shift -= np.where(low, np.log(z), 0.0)
        z += low
    w = 1 / (z * z)
    return shift + (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))) / z


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte counts (..., 256) -> zeros and ones decided at each binary node (..., 256); node 0 is unused, 1 is the root."""
    heap = np.zeros((*counts.shape[:-1], 512))
    heap[..., 256:] = counts
    for low in (128, 64, 32, 16, 8, 4, 2, 1):
        heap[..., low:2 * low] = heap[..., 2 * low:4 * low:2] + heap[..., 2 * low + 1:4 * low:2]
    return heap[..., 0::2], heap[..., 1::2]


def estimate(zeros, ones) -> np.ndarray:
    """Log probability of the counts under Krichevsky-Trofimov."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)


def weighted(own, below) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, posterior weight of the context's own estimate)."""
    total = np.logaddexp(own, below) - np.log(2)
    return total, np.exp(own - np.log(2) - total)


def next_bit(zeros, ones) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def code(p: np.ndarray) -> np.ndarray:
    """Probability of a one at each node (..., 256) -> log10 probability of each byte (..., 256)."""
    heap = np.zeros((*p.shape[:-1], 512))
    for low in (1, 2, 4, 8, 16, 32, 64, 128):
        nodes = slice(low, 2 * low)
        heap[..., 2 * low:4 * low:2] = heap[..., nodes] + np.log10(1 - p[..., nodes])
        heap[..., 2 * low + 1:4 * low:2] = heap[..., nodes] + np.log10(p[..., nodes])
    return heap[..., 256:]


class ContextTree:
    """Depths 0 to 2: of each node, by the two bytes before, the part of a one's probability that these depths give,
    and the weight that is left to longer contexts. `index` is by the two bytes in the order of the text."""

    def __init__(self, keys, own, left, short_own, short_left):
        self.own, self.left = np.concatenate([own, short_own]), np.concatenate([left, short_left])
        self.index = np.repeat(np.arange(256)[None, :], 256, 0).ravel() + len(keys)
        self.index[keys] = np.arange(len(keys))

    @property
    def rows(self) -> np.ndarray:
        """log10 probability of each byte where longer contexts know nothing."""
        return code(self.own + 0.5 * self.left)


def context_tree(counts: DataFrame, totals: DataFrame | None = None) -> ContextTree:
    """(key of three bytes, n) -> the tree. A task does all contexts that end with one byte; the root has 256 below it.

    totals: (key, n) with the sums of the log weighted probabilities of the contexts of three bytes, by two bytes and
    node in place of the third; without them two bytes are the deepest context.
    """
    middle, deeper = F.expr("shiftright(key, 8) & 255").cast("int"), totals is not None

    def dense(table: pa.Table, deep: bool) -> np.ndarray:
        grid = np.zeros((256, 256))
        part = table.filter(pc.equal(table["deep"], deep))
        key = part["key"].to_numpy()
        np.add.at(grid, (key >> 16, key & 255), part["n"].to_numpy())
        return grid

    def pairs(table: pa.Table):
        """(counts by the byte before and the byte, zeros, ones, log weighted probability, posterior weight) of contexts of two bytes."""
        grid = dense(table, False)
        zeros, one = decisions(grid)
        own = estimate(zeros, one)
        return grid, zeros, one, *(weighted(own, dense(table, True)) if deeper else (own, np.ones_like(own)))

    def first(table: pa.Table) -> pa.Table:
        """Counts and weighted probability of one context of one byte."""
        grid, _, _, below, _ = pairs(table)
        total, _ = weighted(estimate(*decisions(grid.sum(0))), below.sum(0))
        return pa.table({"last": pa.array([table["key"][0].as_py() >> 8 & 255], pa.int32()), "counts": [grid.sum(0).tolist()], "total": [total.tolist()]})

    groups = counts.select("key", F.col("n").cast("double").alias("n"), F.lit(False).alias("deep"))
    if deeper:
        groups = groups.unionByName(totals.select("key", "n", F.lit(True).alias("deep")))
    groups = groups.withColumn("last", middle)
    ones = groups.groupBy("last").applyInArrow(first, "last int, counts array<double>, total array<double>").collect()
    root = np.sum([r.counts for r in ones], axis=0) if ones else np.zeros(256)
    root_total = np.sum([r.total for r in ones], axis=0) if ones else np.zeros(256)
    _, root_weight = weighted(estimate(*decisions(root)), root_total)
    root_bit = next_bit(*decisions(root))

    def second(table: pa.Table) -> pa.Table:
        """Predictions after each pair of bytes that ends with this one, and after the byte alone."""
        grid, zeros, one, below, deep_weight = pairs(table)
        seen = np.flatnonzero(grid.sum(1))
        last = int(table["key"][0].as_py() >> 8 & 255)
        z, o = decisions(grid.sum(0))
        _, weight = weighted(estimate(z, o), below.sum(0))
        own = root_weight * root_bit + (1 - root_weight) * weight * next_bit(z, o)
        left = (1 - root_weight) * (1 - weight)
        owns = np.concatenate([own + left * deep_weight[seen] * next_bit(zeros[seen], one[seen]), own[None, :]])
        lefts = np.concatenate([left * (1 - deep_weight[seen]), left[None, :]])
        return pa.table({"key": pa.array([*(seen << 8 | last).tolist(), -1 - last], pa.int32()),
                         "own": pa.array([x.tobytes() for x in owns], pa.binary()), "left": pa.array([x.tobytes() for x in lefts], pa.binary())})

    found = groups.groupBy("last").applyInArrow(second, "key int, own binary, left binary").collect()
    short = np.repeat((root_weight * root_bit)[None, :], 256, 0), np.repeat((1 - root_weight)[None, :], 256, 0)
    for r in found:
        if r.key < 0:
            short[0][-1 - r.key], short[1][-1 - r.key] = np.frombuffer(r.own), np.frombuffer(r.left)
    seen = [r for r in found if r.key >= 0]
    own, left = (np.array([np.frombuffer(r[k]) for r in seen]).reshape(-1, 256) for k in ("own", "left"))
    return ContextTree(np.array([r.key for r in seen], np.int64), own, left, *short)


def nodes(keys, n):
    """Of each of the eight decisions: (group of each row, first row of each group, zeros, ones). keys: in order."""
    for level in range(8):
        node = keys >> (8 - level)
        new = np.append(True, node[1:] != node[:-1])
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        one = keys >> (7 - level) & 1
        yield group, first, np.bincount(group, n * (1 - one), len(first)), np.bincount(group, n * one, len(first))


def deep(keys, n):
    """Depths DEPTH to 3 of whole contexts of three bytes, from runs in order and their counts.

    For each depth: its keys, the row of each run among them, and for each decision (group of each row, first row of
    each group, next bit, log weighted probability, posterior weight).
    """
    at, here, up, below = np.arange(len(keys)), keys, None, None
    for depth in range(DEPTH, 2, -1):
        found = []
        for level, (group, first, zeros, ones) in enumerate(nodes(here, n)):
            total, weight = estimate(zeros, ones), np.ones(len(first))
            if below:
                _, inner, _, inner_total, _ = below[level]
                total, weight = weighted(total, np.bincount(group[up[inner]], inner_total, len(first)))
            found.append((group, first, next_bit(zeros, ones), total, weight))
        yield here, at, found
        here, up = np.unique(here >> 16 << 8 | here & 255, return_inverse=True)
        n, at, below = np.bincount(up, n, len(here)), up[at], found


def whole_contexts(batches):
    """(keys, counts, asked) of whole contexts of three bytes, many at once, from rows in order of their keys."""
    held, size = [], 0
    context = 8 * (DEPTH - 2)
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= AT_ONCE:
            all_ = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(all_[0], all_[0][-1] >> context << context))
            if cut:
                yield [c[:cut] for c in all_]
            held, size = [[c[cut:] for c in all_]], size - cut
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def by_context(table: DataFrame) -> DataFrame:
    """Whole contexts of three bytes in one task and in order."""
    return table.repartitionByRange(F.shiftright("key", 8 * (DEPTH - 2))).sortWithinPartitions("key")


def deep_totals(table: DataFrame) -> DataFrame:
    """(key, n) for context_tree, from (key, n) of runs."""
    def run(batches):
        for keys, n in whole_contexts(batches):
            *_, (here, _, found) = deep(keys, n)
            for level, (_, first, _, total, _) in enumerate(found):
                k = here[first]
                node = 1 << level | (k & 255) >> (8 - level)
                place = (k >> 16 & 255) << 16 | (k >> 24) << 8 | node
                place, at = np.unique(place, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.bincount(at, total, len(place)))], names=["key", "n"])

    return map_batches(by_context(table.select("key", "n")), run, "key bigint, n double")


def run_scores(table: DataFrame, tree) -> DataFrame:
    """(key, n, asked) of all runs -> (key, value) of those asked for: log10 probability of the byte. tree: a broadcast."""
    def run(batches):
        for keys, n, asked in whole_contexts(batches):
            upper, depths, value = tree.value, list(deep(keys, n)), np.zeros(len(keys))
            row = upper.index[(keys >> (8 * DEPTH - 8) & 255) << 8 | keys >> (8 * DEPTH)]
            for level in range(8):
                p = np.full(len(keys), 0.5)
                for _, at, found in depths:
                    group, _, bit, _, weight = found[level]
                    g = group[at]
                    p = weight[g] * bit[g] + (1 - weight[g]) * p
                node = 1 << level | (keys & 255) >> (8 - level)
                p = upper.own[row, node] + upper.left[row, node] * p
                value += np.log10(np.where(keys >> (7 - level) & 1, p, 1 - p))
            yield pa.RecordBatch.from_arrays([pa.array(keys[asked]), pa.array(value[asked])], names=["key", "value"])

    return map_batches(by_context(table.select("key", "n", "asked")), run, "key bigint, value double")


class Lookup:
    """Values by key: one slot for each hash; keys whose slot is taken are searched for."""

    def __init__(self, keys, values):
        self.bits = max(4, 2 + int(np.ceil(np.log2(max(len(keys), 1)))))
        slot = self._slot(keys)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        self.keys[slot], self.values[slot] = keys, values
        over = self.keys[slot] != keys
        order = np.argsort(keys[over])
        self.more, self.more_values = keys[over][order], values[over][order]

    def _slot(self, keys):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys):
        """(values, which are known)."""
        slot = self._slot(keys)
        known, values = self.keys[slot] == keys, self.values[slot]
        rest = np.flatnonzero(~known)
        if len(rest) and len(self.more):
            at = np.minimum(np.searchsorted(self.more, keys[rest]), len(self.more) - 1)
            hit = self.more[at] == keys[rest]
            known[rest[hit]], values[rest[hit]] = True, self.more_values[at[hit]]
        values[~known] = 0
        return values, known


def heavy_from(counts: DataFrame) -> int:
    """Count from which on a run is among the HEAVY_RUNS most frequent ones; runs are taken by powers of 2 ** (1 / 16)."""
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    taken, least = 0, 1 << 62
    for r in sorted(counts.groupBy(step).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).collect(), reverse=True):
        taken += r.c
        if taken > HEAVY_RUNS:
            break
        least = r.least
    return least


def scores(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row."""
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "lm")
    counts = stored(gathered(training), f"{folder}/counts")
    words = counts.filter(F.col("kind") == WORDS).select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    top = words.orderBy(F.desc("n"), "key").limit(HEAVY).toArrow()
    order = np.argsort(top["key"].to_numpy())
    heavy = top["key"].to_numpy()[order], np.log10(top["n"].to_numpy()[order] + 1.0)
    of_runs = counts.filter(F.col("kind") == RUNS).select("key", "n")
    tree = spark.sparkContext.broadcast(context_tree(counts.filter(F.col("kind") == TRIPLES), stored(deep_totals(of_runs), f"{folder}/totals")))
    often = run_scores(of_runs.withColumn("asked", F.col("n") >= heavy_from(of_runs)), tree).toArrow()
    shared = spark.sparkContext.broadcast((*heavy, often["key"].to_numpy(), often["value"].to_numpy()))

    def run(batches):
        keys, logs, *often = shared.value
        lookup = Lookup(*often)
        for batch in batches:
            for first, offsets, data in slices(batch.column(1)):
                n = len(offsets) - 1
                spans, each = word_spans(data, offsets)
                tokens = np.append(prints()(data, spans).view(np.int64), np.full(n, END))
                owner = np.append(np.repeat(np.arange(n), each), np.arange(n))
                at = np.minimum(np.searchsorted(keys, tokens), max(len(keys) - 1, 0))
                known = keys[at] == tokens if len(keys) else np.zeros(len(tokens), bool)
                rest = ~known
                by = np.argsort(owner[rest], kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[rest], minlength=n))]).astype(np.int32)
                asked, begin = runs(offsets, data)
                values, found = lookup(asked) if total else (np.full(len(asked), 8 * np.log10(0.5)), np.ones(len(asked), bool))
                new = np.flatnonzero(~found)
                new_ends = np.searchsorted(new, np.append(begin, len(asked))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(each + 1),
                     pa.array(np.bincount(owner[known], minlength=n)), pa.array(np.bincount(owner[known], logs[at[known]], n)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[rest][by])),
                     pa.array(np.add.reduceat(values, begin)), pa.ListArray.from_arrays(pa.array(new_ends), pa.array(asked[new])), pa.array(np.diff(offsets))],
                    names=["doc_id", "n_tokens", "known", "logs", "rest", "score", "runs", "bytes"])

    passed = map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, known bigint, logs double, rest array<bigint>, score double, runs array<bigint>, bytes bigint")
    passed = stored(passed.withColumn("row", F.monotonically_increasing_id()), f"{folder}/passed")
    light = (passed.select("row", F.explode("rest").alias("key")).join(words, "key")
             .groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs")))
    asked = passed.select("row", F.explode("runs").alias("key"))
    every = (of_runs.withColumn("asked", F.lit(False)).unionByName(asked.select("key", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked")))
             .groupBy("key").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")))
    values = stored(run_scores(every, tree), f"{folder}/values")
    met = asked.join(values, "key").groupBy("row").agg(F.sum("value").alias("more_score"))
    none = float(np.log10(total + distinct + 1))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return passed.drop("rest", "runs").join(light, "row", "left").join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * none).alias("base_score"),
        score.alias("score"), (-score * float(np.log2(10)) / (F.col("bytes") + 1)).alias("bits_per_byte"))
