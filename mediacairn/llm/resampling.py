"""Importance resampling towards a target distribution, over an Aho-Corasick dictionary.

Words are longest runs of characters other than ASCII ones that are no digit and no letter; A-Z count as a-z. Features are
runs of 1 to `order` consecutive words of one text, joined by one space, and a feature's bucket is the CRC-32 of its
UTF-8 bytes modulo `buckets`. The words of both tables are counted on Spark, and the most frequent (DICTIONARY, of up to
LONGEST bytes; bounds on memory only) enter an automaton, each between two delimiters, with its CRC and its length as
payload. One scan of a text emits the payloads of its words; what lies between two matches that don't touch are words
outside the dictionary, whose payload is worked out on the spot, so every word of every text has one. Payloads of
neighbours compose: the CRC of "a b" follows from those of "a" and "b" and the length of "b", so longer features cost no
second look at the text. Buckets are stored once and read for the counts of all rows and then for the scores.

A bucket's gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of the counts s, t and totals S, T in rows and
target; a row's weight is the floored mean of its features' gains, its score adds Gumbel noise from SHA-256 of the seed
and its doc_id. Of the rows with at least `least` words, `percent` of them, floored, are drawn by score, ties to the
smaller doc_id. Scores are whole numbers in a range that the gains bound (about 120,000 values at most), so ranks come
from a histogram of scores and a numbering inside one score; no task sorts all rows.

A null or blank text has no features and weight 0. A row without doc_id counts in the totals but has no score and no
rank. Rows that repeat a doc_id are rows of their own; with equal scores their order is open. Empty tables: no rows; an
empty target gives gains by the rows alone. Long texts are scanned whole. Columns other than text come back inside `row`.
"""

import math
import zlib
from collections import Counter
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from .common import map_batches, slices, stored, work_dir

DICTIONARY, LONGEST = 1 << 16, 64
SLICE = 1_000_000
BETWEEN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def spaced(data: bytes) -> str:
    """Lower-case, every delimiter a blank."""
    return data.translate(BETWEEN).decode("utf-8", "replace")


class Shift:
    """CRC-32 of a string from those of its two halves: the first one's, moved on by as many zero bytes as the second has."""

    def __init__(self):
        step = []
        for c in range(256):  # one zero byte
            for _ in range(8):
                c = c >> 1 ^ 0xEDB88320 * (c & 1)
            step.append(c)
        one = np.array(step, np.uint32)
        values = np.arange(256, dtype=np.uint32)
        self.tables = [[self._byte(values << np.uint32(8 * k), one) for k in range(4)]]

    @staticmethod
    def _byte(c, one):
        return one[c & np.uint32(255)] ^ c >> np.uint32(8)

    def _apply(self, c, table):
        return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]

    def __call__(self, crc, n):
        """crc moved on by n bytes, both arrays."""
        crc, bit = crc.copy(), 0
        while (n >> bit).any():
            if bit == len(self.tables):  # twice as many bytes: the last table, applied to itself
                self.tables.append([self._apply(t, self.tables[-1]) for t in self.tables[-1]])
            moved = (n >> bit & 1).astype(bool)
            crc[moved] = self._apply(crc[moved], self.tables[bit])
            bit += 1
        return crc

    def join(self, a, b):
        """Payload of two neighbours with one blank between: arrays (crc, bytes) and (crc, bytes)."""
        blank = np.full(len(a[0]), zlib.crc32(b" "), np.uint32)
        ones = np.ones(len(a[0]), np.int64)
        left = self(a[0], ones) ^ blank
        return self(left, b[1]) ^ b[0], a[1] + 1 + b[1]


class Scanner:
    """The automaton of a dictionary, and the payloads of the words of many texts."""

    def __init__(self, words):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            self.automaton.add_word(f" {word} ", i)
        if len(words):
            self.automaton.make_automaton()
        raw = [w.encode() for w in words]
        self.crc = np.array([zlib.crc32(w) for w in raw], np.uint32)
        self.bytes = np.array([len(w) for w in raw], np.int64)
        self.length = np.array([len(w) for w in words], np.int64)
        self.shift = Shift()

    def payloads(self, texts: list[str]):
        """((crc, bytes) of all words in order, number of words of each text); texts are as spaced() makes them."""
        line = " " + " ".join(texts) + " "
        ends, hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.crc):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(line)), np.int64)
            ends, hits = found[0::2], found[1::2]
        starts = ends - self.length[hits] - 1
        before = np.concatenate([np.zeros(1, np.int64), ends])
        after = np.concatenate([starts, np.array([len(line) - 1])])
        rest, rest_ends = [], []
        for i in np.flatnonzero(after - before > 1):
            at = int(before[i])
            for word in line[at:int(after[i]) + 1].split(" "):
                at += len(word) + 1
                if word:
                    rest.append(word.encode())
                    rest_ends.append(at - 1)
        crc = np.concatenate([self.crc[hits], np.array([zlib.crc32(w) for w in rest], np.uint32)])
        size = np.concatenate([self.bytes[hits], np.array([len(w) for w in rest], np.int64)])
        ends = np.concatenate([ends, np.array(rest_ends, np.int64)])
        order = np.argsort(ends, kind="stable")
        limits = np.cumsum([0] + [len(t) + 1 for t in texts])
        return (crc[order], size[order]), np.diff(np.searchsorted(ends[order], limits, side="right"))

    def features(self, texts: list[str], order: int):
        """(CRC of all features, shorter ones first inside a text; number of features, of words of each text)."""
        words, counts = self.payloads(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        crcs, owners, now, at = [words[0]], [owner], words, np.arange(len(owner))
        for n in range(1, order):
            on = at[at + n < len(owner)]
            on = on[owner[on + n] == owner[on]]
            now = self.shift.join(tuple(x[np.searchsorted(at, on)] for x in now), tuple(x[on + n] for x in words))
            at = on
            crcs.append(now[0])
            owners.append(owner[on])
        owners = np.concatenate(owners)
        by_text = np.argsort(owners, kind="stable")
        return np.concatenate(crcs)[by_text], np.bincount(owners, minlength=len(texts)), counts


def cut(texts, most=SLICE):
    """Lists of whole spaced texts, about `most` bytes together."""
    for first, offsets, data in slices(texts, most):
        raw = data.tobytes()
        yield first, [spaced(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def word_counts(tables: list[DataFrame]) -> DataFrame:
    """word, n over all texts of the tables. Each batch is counted in its task first."""
    def run(batches):
        for batch in batches:
            n = Counter()
            for _, texts in cut(batch.column(0)):
                for text in texts:
                    n.update(text.split(" "))
            n.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    both = tables[0].select("text")
    for t in tables[1:]:
        both = both.unionByName(t.select("text"))
    return map_batches(both, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(counts: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of up to LONGEST bytes, down to a level of counts at which there are `size` at most: 4 MB.

    Levels of counts are counted first, so no more than these words come to the driver. What is left out has the
    scanner's other way.
    """
    fit = counts.filter(F.octet_length("word") <= LONGEST).withColumn("level", F.floor(8 * F.log2("n")))
    least, words = None, 0
    for level, n in sorted(fit.groupBy("level").count().collect(), reverse=True):  # 8 levels for each power of two
        words += n
        if words > size:
            break
        least = level
    return [] if least is None else sorted(r.word for r in fit.filter(F.col("level") >= least).select("word").collect())


#: Kept by a Python worker from task to task.
_scanners: dict = {}


def coded(docs: DataFrame, words, token: str, order: int, buckets: int) -> DataFrame:
    """row (all columns but text), n_words, n_features, buckets (little-endian 32-bit integers). words: a broadcast list."""
    rest = [c for c in docs.columns if c != "text"]
    inner = docs.select(F.struct(*rest).alias("row") if rest else F.struct(F.lit(0).alias("none")).alias("row"), "text")
    schema = StructType([inner.schema["row"], *StructType.fromDDL("n_words bigint, n_features bigint, buckets binary").fields])

    def run(batches):
        if token not in _scanners:
            _scanners.clear()
            _scanners[token] = Scanner(words.value)
        for batch in batches:
            for first, texts in cut(batch.column(1)):
                crc, n, counts = _scanners[token].features(texts, order)
                parts = np.split((crc % np.uint32(buckets)).astype("<u4"), np.cumsum(n)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(counts, pa.int64()), pa.array(n, pa.int64()),
                     pa.array([p.tobytes() for p in parts], pa.binary())], names=schema.names)

    return map_batches(inner, run, schema)


def bucket_counts(code: DataFrame, buckets: int, name: str) -> DataFrame:
    """bucket, `name`: features of all rows; every task sends at most `buckets` rows a batch."""
    def run(batches):
        for batch in batches:
            total = np.zeros(buckets, np.int64)
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_py(), "<u4"), minlength=buckets)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return map_batches(code.select("buckets"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(code: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket; `buckets` rows come to the driver."""
    both = (code.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(bucket_counts(code, buckets, "s"), "bucket", "left")
            .join(bucket_counts(target, buckets, "t"), "bucket", "left").fillna(0, ["s", "t"]))
    out = np.zeros(buckets, np.int64)
    rows = both.collect()
    total = {c: float(sum(r[c] for r in rows)) for c in "st"}
    for r in rows:
        out[r.bucket] = math.floor(1000 * math.log((r.t + 1.0) * (total["s"] + buckets) / ((r.s + 1.0) * (total["t"] + buckets))))
    return out


def weighed(code: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, n_words, n_features, weight."""
    schema = StructType([*code.drop("buckets").schema.fields, *StructType.fromDDL("weight bigint").fields])

    def run(batches):
        for batch in batches:
            weights = []
            for value in batch.column(3):
                at = np.frombuffer(value.as_py(), "<u4")
                weights.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], names=schema.names)

    return map_batches(code, run, schema)


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, least: int = 20, percent: int = 10,
             seed: int = 2024, size: int = DICTIONARY) -> DataFrame:
    """docs (doc_id, text, ...) and target (text, ...) -> row (docs without text), n_words, n_features, weight, score, rank."""
    spark = docs.sparkSession
    folder = work_dir(spark, "resampling")
    words = dictionary(stored(word_counts([docs, target]), f"{folder}/words"), size)
    shared = spark.sparkContext.broadcast(words)
    code = stored(coded(docs, shared, folder, order, buckets), f"{folder}/rows")
    aim = stored(coded(target.select("text"), shared, folder, order, buckets), f"{folder}/target")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("row.doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = stored(weighed(code, gains(code, aim, buckets)).withColumn("score", F.col("weight") + noise), f"{folder}/scored")
    able = F.col("score").isNotNull() & (F.col("n_words") >= least)
    drawn = scored.filter(able).count() * percent // 100
    # rows above each score: one row per different score goes through this window, 120,000 at most
    above = F.coalesce(F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = (scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).select(F.col("score").alias("at"), above.alias("above"))
             .filter(F.col("above") < drawn))
    rank = F.col("above") + F.row_number().over(W.partitionBy("score").orderBy("row.doc_id"))
    # a score that is not drawn from at all has no step, and its rows go through no window
    none = F.lit(None).cast("bigint")
    placed = scored.join(F.broadcast(steps), able & (F.col("score") == F.col("at")), "left").drop("at")
    top = placed.filter("above IS NOT NULL").withColumn("rank", rank)
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.drop("above").unionByName(placed.filter("above IS NULL").withColumn("rank", none).drop("above"))
