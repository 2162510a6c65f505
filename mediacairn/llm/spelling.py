"""Spelling variants by a frequency-vector trie.

Words are longest runs of A-Z, a-z and U+00C0 to U+00FF; A-Z count as a-z. Letters are dealt into GROUPS groups by code
point, and a word's vector tells how many letters of each group it has. The trie has one level for each group: words lie
along the path of their counts. One inserted letter is a surplus of one in a group, one deleted letter a deficit, a
replaced letter both or neither; so a depth-first search from a word spends at most one surplus and one deficit on its
way down, and the words in the leaves it reaches are verified letter by letter. A deficit is spent only behind a
surplus: of two words with different vectors one finds the other and is not found by it, so that each pair is looked at
once and told to both.

The vocabulary is spread over Spark by the top of the trie: nodes with more words than a cell should hold are inner
nodes, and only their paths are known everywhere (a cell holds CELL words or a 2**14th of them all, so there are 2**14 *
GROUPS paths at most). Every word is searched in all cells its budget reaches; a task holds the trie of one cell and
takes its searches a block at a time, a set of words at each node. Results leave a task as a count and a best word for
each searched word, never as pairs. Words with equal vectors share a leaf; a word has few near words at most, so no
group grows with the input. Forms point from rarer to at least twice as frequent words, so roots follow by doubling
pointers, in as many rounds as the logarithm of the longest chain, 6 at most.

Where `slip` divides the CRC-32 of "<doc_id>:<run>", one letter of the run is left out, as the contract has it
(slip=None: none). A row without doc_id has no such runs. Null texts and texts without letters have no words; very long
texts are cut nowhere. Rows that repeat count again. An empty table gives an empty result.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, UPPER, importable, map_batches, stored, work_dir

GROUPS = 13
CELL = 8000
BLOCK = 2048
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = str.maketrans(UPPER, LOWER)


def runs(docs: DataFrame, least: int, slip: int | None) -> DataFrame:
    """doc_id, text -> word, n: words of at least `least` letters with their occurrences. A batch is counted in its task."""
    def run(batches):
        for batch in batches:
            total = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in Counter(RUN.findall(text.as_py() or "")).items():
                    word = word.lower() if word.isascii() else word.translate(SMALL)
                    if slip and doc is not None and len(word) >= least:
                        h = zlib.crc32(f"{doc}:{word}".encode())
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                    if len(word) >= least:
                        total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    return map_batches(docs.select(F.col("doc_id").cast("string"), "text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vector(word: str) -> bytes:
    """Letters of each group, one byte a group. 255 stands for more, so vectors are never farther apart than their words."""
    v = [0] * GROUPS
    for c in word:
        v[ord(c) % GROUPS] += 1
    return bytes(min(x, 255) for x in v)


def placed(words: DataFrame) -> DataFrame:
    """word, n -> word, n, path (the vector)."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([vector(w) for w in batch.column(0).to_pylist()], pa.binary())],
                                             names=["word", "n", "path"])

    return map_batches(words.select("word", "n"), run, "word string, n bigint, path binary")


def inner_nodes(words: DataFrame, cell: int) -> set[bytes]:
    """Paths of the nodes above the cells: those with more than a cell's words, each level below the last one's."""
    total, paths, level = words.count(), set(), 0
    most = max(cell, total >> 14)
    if total <= most:
        return paths
    paths.add(b"")
    for level in range(1, GROUPS):  # counted level by level, so that a level's counts are few
        heavy = words.groupBy(F.substring("path", 1, level).alias("path")).count().filter(F.col("count") > most).select("path").collect()
        if not heavy:
            break
        paths |= {bytes(r.path) for r in heavy}
    return paths


def cells(path: bytes, inner) -> list[bytes]:
    """The cells a search from `path` reaches: depth first over the inner nodes, one surplus to spend and then one deficit."""
    out, stack = [], [(b"", 0)]
    while stack:
        node, spent = stack.pop()
        if node not in inner:
            out.append(node)
            continue
        count = path[len(node)]
        stack.append((node + bytes([count]), spent))
        if spent == 0 and count < 255:
            stack.append((node + bytes([count + 1]), 1))
        if spent == 1 and count:
            stack.append((node + bytes([count - 1]), 2))
    return sorted(set(out))


def near(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced letter?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.array(words).view(np.uint32).reshape(len(words), -1)


def near_pairs(queries: list[str], others: list[str]):
    """(places in queries, places in others) of near words; others have one length."""
    size, out = len(others[0]), [np.zeros((2, 0), np.int64)]
    lengths = np.array([len(q) for q in queries])
    rows = letters(others)
    for length in (size - 1, size, size + 1):
        who = np.flatnonzero(lengths == length)
        if not len(who):
            continue
        asked = letters([queries[i] for i in who])
        step = max(1, 4_000_000 // (len(asked) * size))
        for first in range(0, len(rows), step):
            a, b = asked[:, None, :], rows[None, first:first + step, :]
            if length == size:
                found = (a != b).sum(axis=2) == 1
            else:  # equal letters from the front and from the back must cover the shorter word
                a, b = (a, b) if length < size else (b, a)
                short = a.shape[2]
                front = np.logical_and.accumulate(a == b[:, :, :short], axis=2).sum(axis=2)
                back = np.logical_and.accumulate((a == b[:, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
                found = front + back >= short
            i, j = np.nonzero(found)
            out.append(np.array([who[i], j + first]))
    return np.concatenate(out, axis=1)


class Trie:
    """Words by their vectors: a node is (count, node below) pairs, or in the last level the places of its words."""

    def __init__(self, words: list[str], paths: list[bytes]):
        self.words, self.root = words, {}
        for at, path in enumerate(paths):
            node = self.root
            for count in path[:-1]:
                node = node.setdefault(count, {})
            node.setdefault(path[-1], []).append(at)

    def search(self, words: list[str], paths: list[bytes]):
        """Yield (place of the searched word, place of a near word), each pair from one side only.

        Depth first, with a set of searches at every node: spent is 0, 1 behind a surplus, 2 behind the deficit after it.
        """
        counts = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, GROUPS).astype(np.int64)
        stack = [(self.root, 0, np.arange(len(words)), np.zeros(len(words), np.int8))]
        while stack:
            node, level, who, spent = stack.pop()
            asked = counts[who, level]
            for count, below in node.items():
                over = count - asked
                fits = (over == 0) | (over == 1) & (spent == 0) | (over == -1) & (spent == 1)
                if not fits.any():
                    continue
                here, now = who[fits], spent[fits] + (over[fits] != 0)
                if level < GROUPS - 1:
                    stack.append((below, level + 1, here, now))
                    continue
                others = [self.words[at] for at in below]
                if len(here) * len(others) < 32 or len({len(w) for w in others}) > 1:
                    found = [(i, j) for i, q in enumerate(here.tolist()) for j in range(len(others)) if near(words[q], others[j])]
                else:
                    found = zip(*near_pairs([words[q] for q in here.tolist()], others).tolist())
                for i, j in found:
                    if now[i] or words[here[i]] < others[j]:  # equal vectors: both are found from each other
                        yield int(here[i]), below[j]


def search_cell(homes: pa.Table, asked: pa.Table) -> pa.Table:
    """One cell: for each word of a near pair how many were found here, and the most frequent of them (ties: smallest)."""
    words, n = homes["word"].to_pylist(), homes["n"].to_pylist()
    found = {}

    def tell(word, other, times):
        count, best = found.get(word, (0, (0, "")))
        found[word] = count + 1, min(best, (-times, other))
    if words:
        trie = Trie(words, homes["path"].to_pylist())
        for first in range(0, len(asked), BLOCK):
            part = asked.slice(first, BLOCK)
            queries, times = part["word"].to_pylist(), part["n"].to_pylist()
            for q, at in trie.search(queries, part["path"].to_pylist()):
                tell(queries[q], words[at], n[at])
                tell(words[at], queries[q], times[q])
    rows = list(found.items())
    return pa.table({"word": pa.array([w for w, _ in rows], pa.string()), "n_near": pa.array([x[0] for _, x in rows], pa.int64()),
                     "best": pa.array([x[1][1] for _, x in rows], pa.string()), "best_n": pa.array([-x[1][0] for _, x in rows], pa.int64())})


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """word, n -> word, n_near, best, best_n of the words that have near words."""
    spark = words.sparkSession
    importable(spark)
    inner = spark.sparkContext.broadcast(inner_nodes(words, cell))

    def run(batches):
        for batch in batches:
            reached = [cells(p, inner.value) for p in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), [len(r) for r in reached])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array([c for r in reached for c in r], pa.binary())],
                                             names=["word", "n", "path", "cell"])

    asked = map_batches(words, run, "word string, n bigint, path binary, cell binary")
    # a word lives in the cell its own path leads to: the longest way through inner nodes, and one step more
    own = map_batches(words, lambda batches: (pa.RecordBatch.from_arrays(
        [*b.columns, pa.array([home(p, inner.value) for p in b.column(2).to_pylist()], pa.binary())], names=["word", "n", "path", "cell"])
        for b in batches), "word string, n bigint, path binary, cell binary")
    each = own.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(search_cell, "word string, n_near bigint, best string, best_n bigint")
    # largest n, then smallest word: a maximum of counts, and the smallest word of those that have it
    best = F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), F.col("best")))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", "b.best_n")


def home(path: bytes, inner) -> bytes:
    """The cell of a path."""
    for level in range(GROUPS):
        if path[:level] not in inner:
            return path[:level]
    return path


def rooted(forms: DataFrame, folder: str) -> DataFrame:
    """word, form -> word, root: forms followed to the last one, by pointers that reach twice as far each round."""
    at, turn = stored(forms.select("word", F.coalesce("form", "word").alias("root")), f"{folder}/roots0"), 0
    while True:
        turn += 1
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(at.join(on, "root").select("word", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")),
                       f"{folder}/roots{turn}")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, least: int = 5, often: int = 3, times: int = 2, slip: int | None = 97, cell: int = CELL) -> DataFrame:
    """doc_id, text -> word, form, root, n, n_near, form_n. Words: `least` letters, `often` occurrences at least.

    A form is the near word of largest n, if that is at least `times` the word's own.
    """
    folder = work_dir(docs.sparkSession, "spelling")
    words = stored(placed(runs(docs, least, slip).filter(F.col("n") >= often)), f"{folder}/words")
    found = near_words(words, cell)
    take = F.col("best_n") >= times * F.col("n")
    formed = stored(words.join(found, "word", "left").select(
        "word", F.when(take, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(take, F.col("best_n")).alias("form_n")), f"{folder}/forms")
    return formed.join(rooted(formed, folder), "word").select("word", "form", "root", "n", "n_near", "form_n")
