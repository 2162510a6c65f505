"""What the corpus operators share: folders, text columns, batches, word and shingle fingerprints."""

import ctypes
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from mediacairn.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder, shared by driver and executors, for the files of one run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write `df` to shared files and read it back: its lineage ends there, and every later reader sees the same rows."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library from where the driver has it.

    Elsewhere it is installed, or sent with --py-files, as any package is.
    """
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


#: Rows and bytes of an Arrow batch. Rows hold whole texts, and a batch exists in the executor and in its Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow: fn takes an iterator of record batches and yields record batches. Batches are small; see BATCH.

    Workers live on from task to task, so what a task has freed goes back to the system when it ends.
    """
    importable(df.sparkSession)
    for name, most in BATCH.items():
        df.sparkSession.conf.set(name, str(most))

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
        if trim:
            trim(0)

    return df.mapInArrow(run, schema)


def packed(df: DataFrame) -> DataFrame:
    """Whole rows in one column `row`, so that nothing an operator adds can clash with a column of the table."""
    return df.select(F.struct("*").alias("row"))


def beside_rows(df: DataFrame, column: str, start, added: str) -> DataFrame:
    """`row` and the columns `added` (DDL) that Python makes of one column of it.

    start() is called once a task and returns a function that takes an Arrow array of that column and yields, in order,
    (number of rows, arrays of the added columns).
    """
    schema = StructType([*packed(df).schema.fields, *StructType.fromDDL(added).fields])

    def run(batches):
        fn = start()
        for batch in batches:
            rows, at = batch.column(0), 0
            for n, arrays in fn(rows.field(column)):
                yield pa.RecordBatch.from_arrays([rows.slice(at, n), *arrays], names=schema.names)
                at += n

    return map_batches(packed(df), run, schema)


def ascii_lower(text):
    """Lower-case A-Z and nothing else; null counts as empty. In pure ASCII, lower() does just that, and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slices(texts: pa.Array, most=200_000):
    """Cut a column of whole texts into (first row, offsets, bytes) with about `most` bytes each.

    No text is cut: a longer one is a slice of its own. Nulls count as empty. Offsets start at 0.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, ends[first:last + 1] - ends[first], data[ends[first]:ends[last]]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordPrints:
    """Fingerprints of the words of many texts at once.

    A word is a longest run of bytes that are not 0x20 or 0x09-0x0D; A-Z count as a-z. Its print is a polynomial
    in an odd base over random values of its bytes, modulo 2^64, read off prefix sums over the whole slice.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.values[65:91] = self.values[97:123]
        self.base = int(rng.integers(2**32, 2**62)) | 1
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n):
        if len(self.powers) <= n:
            size = max(n + 1, 2 * len(self.powers))
            back = pow(self.base, -1, 2**64)
            for name, base in (("powers", self.base), ("inverse", back)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data, spans):
        start, end = spans
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.inverse[start])


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK):
    """(starts, ends) of all words in byte order, and the number of words of each text. blank: which bytes part words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return (none, none), np.zeros(len(offsets) - 1, np.int64)
    inside = ~blank[data]
    cut = np.zeros(n + 1, bool)  # a text begins here, so no word runs across
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return (start, end), np.diff(np.searchsorted(start, offsets))


def shingle_prints(words: np.ndarray, counts: np.ndarray, width: int):
    """(prints of all shingles, number of shingles of each text): runs of `width` words, or the whole text if it has fewer."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    first = np.cumsum(counts) - counts
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    total = np.zeros(len(at), np.uint64)
    short = np.repeat(np.where(counts < width, counts, width), n)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for j in range(width):
        total += np.where(short > j, padded[at + j] * factors[j], np.uint64(0))
    return mix(total + short.astype(np.uint64)), n
