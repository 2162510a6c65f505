"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions and labels every byte with a probability for each
language; the mean over all bytes of a document is its pooled probability. The unit has one gate, which forgets and
resets (minimal gated unit). States run inside windows of WINDOW bytes, so that windows of many documents advance side
by side and a very long text costs no more a byte than a short one; every byte of every text is read.

It is trained in numpy by backpropagation through time, on excerpts of at most DOCUMENTS labelled documents of each
language, drawn by a hash of doc_id: EXCERPTS windows each, from all over the text.

Nulls and empties: a text that is null or has no letter is `und`, score 0. Rows without language are never learned
from. If nothing can be learned, every document is `und`, score 0. Ties go to the language that sorts first. An empty
table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import beside_rows, packed, slices

WINDOW = 128
HIDDEN = 8
DOCUMENTS, EXCERPTS = 600, 4
EPOCHS, BATCH, RATE = 6, 128, 0.02
TOGETHER = 2048


def excerpts(docs: DataFrame, per_language=DOCUMENTS, each=EXCERPTS) -> DataFrame:
    """(lang, piece): bounded training data, at most per_language * each pieces of a language."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    last = F.greatest(F.length("text") - WINDOW, F.lit(1))
    pieces = F.array_distinct(F.array(*[F.substring(F.col("text"), (1 + F.pmod(F.xxhash64("doc_id", F.lit(j)), last)).cast("int"), F.lit(WINDOW))
                                        for j in range(each)]))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return (usable.select("lang", "doc_id", pieces.alias("pieces")).withColumn("turn", F.row_number().over(order))
            .filter(F.col("turn") <= per_language).select("lang", F.explode("pieces").alias("piece")))


class Direction:
    """One gated recurrent layer. table: what a byte adds to gate and candidate; u: what the state adds."""

    def __init__(self, rng):
        self.table = rng.normal(0, 0.3, (2 * HIDDEN, 256)).astype(np.float32)
        self.table[:HIDDEN] -= 1  # begin with a slow gate
        self.u = rng.normal(0, 0.5 / np.sqrt(HIDDEN), (2 * HIDDEN, HIDDEN)).astype(np.float32)

    def states(self, data, out, keep=None):
        """data (time, windows) -> out (time, HIDDEN, windows). keep: gets what the way back needs."""
        h = np.zeros((HIDDEN, data.shape[1]), np.float32)
        for t in range(len(data)):
            z, r = self.table.take(data[t], axis=1), self.u @ h
            f = z[:HIDDEN]
            f += r[:HIDDEN]
            f *= 0.5
            np.tanh(f, out=f)
            f *= 0.5
            f += 0.5
            c = f * r[HIDDEN:]
            c += z[HIDDEN:]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, f, c, r[HIDDEN:]))
            step = np.subtract(c, h, out=out[t])
            step *= f
            step += h
            h = out[t]

    def back(self, data, keep, given):
        """Gradients of table and u by backpropagation through time; given: gradient of every state."""
        du = np.zeros_like(self.u)
        dz = np.empty((2 * HIDDEN, *data.shape), np.float32)
        dh = np.zeros_like(given[0])
        for t in range(len(data) - 1, -1, -1):
            h, f, c, r = keep[t]
            dh = dh + given[t]
            dc = dh * f * (1 - c * c)
            dr = np.concatenate([(dh * (c - h) + dc * r) * f * (1 - f), dc * f])
            dz[:HIDDEN, t], dz[HIDDEN:, t] = dr[:HIDDEN], dc
            du += dr @ h.T
            dh = dh * (1 - f) + self.u.T @ dr
        flat = data.ravel()
        return np.stack([np.bincount(flat, row.ravel(), 256) for row in dz]).astype(np.float32), du


class Network:
    def __init__(self, languages, seed=1):
        rng = np.random.default_rng(seed)
        self.languages = list(languages)
        self.ahead, self.behind = Direction(rng), Direction(rng)
        self.w = rng.normal(0, 0.3, (len(self.languages), 2 * HIDDEN)).astype(np.float32)
        self.b = np.zeros((len(self.languages), 1), np.float32)

    def labels(self, data, keep=None):
        """data (time, windows) -> states and probabilities of each language at each byte, both (time, ..., windows)."""
        first, second = ([], []) if keep is not None else (None, None)
        states = np.empty((len(data), 2 * HIDDEN, data.shape[1]), np.float32)
        self.ahead.states(data, states[:, :HIDDEN], first)
        self.behind.states(data[::-1], states[::-1, HIDDEN:], second)
        if keep is not None:
            keep += [first, second]
        p = np.matmul(self.w, states)
        p += self.b
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return states, p

    def train(self, windows, filled, truth, epochs=EPOCHS, rate=RATE, seed=2):
        """windows (n, WINDOW) bytes, filled: how many are text, truth: index of the language. Adam on cross-entropy."""
        rng = np.random.default_rng(seed)
        parts = [self.ahead.table, self.ahead.u, self.behind.table, self.behind.u, self.w, self.b]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        step, total = 0, epochs * -(-len(windows) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                data, keep = np.ascontiguousarray(windows[rows].T), []
                states, p = self.labels(data, keep)
                given = (np.arange(WINDOW)[:, None] < filled[rows]).astype(np.float32)
                p[:, truth[rows], np.arange(len(rows))] -= 1
                p *= (given / given.sum())[:, None, :]
                ds = np.matmul(self.w.T, p)
                grads = [*self.ahead.back(data, keep[0], ds[:, :HIDDEN]), *self.behind.back(data[::-1], keep[1], ds[::-1, HIDDEN:]),
                         np.einsum("tln,tsn->ls", p, states, optimize=True), p.sum((0, 2))[:, None]]
                step += 1
                now = rate * (1 - step / (total + 1))
                norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
                for part, g, m, v in zip(parts, grads, first, second):
                    g = g / norm
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    part -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        return self

    def pooled(self, offsets, data) -> np.ndarray:
        """Mean probabilities over the bytes of each text (rows of zeros for empty ones)."""
        lengths = np.diff(offsets)
        count = -(-lengths // WINDOW)
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(lengths)), count)
        inside = (np.arange(count.sum()) - first[owner]) * WINDOW
        start, filled = offsets[:-1][owner] + inside, np.minimum(lengths[owner] - inside, WINDOW)
        sums = np.zeros((len(start), len(self.languages)), np.float64)
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
        for at in range(0, len(start), TOGETHER):
            rows = slice(at, at + TOGETHER)
            windows = view[start[rows]].T.copy()
            there = np.arange(WINDOW)[:, None] < filled[rows]
            windows *= there
            _, p = self.labels(windows)
            p *= there[:, None, :]
            sums[rows] = p.sum(0).T
        out = np.zeros((len(lengths), len(self.languages)))
        np.add.at(out, owner, sums)
        return out / np.maximum(lengths, 1)[:, None]


def learn(docs: DataFrame, **bounds) -> Network | None:
    """Train on a bounded sample of the rows that have a language."""
    sample = sorted({(r.lang, r.piece) for r in excerpts(docs, **bounds).collect()})
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    pieces = [piece.encode()[:WINDOW] for _, piece in sample]
    windows = np.frombuffer(b"".join(p.ljust(WINDOW, b"\0") for p in pieces), np.uint8).reshape(-1, WINDOW)
    return Network(languages).train(windows, np.array([len(p) for p in pieces]), np.array([languages.index(lang) for lang, _ in sample]))


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """Every row of `docs` as `row`, with lang and score; only the text is looked at."""
    has_letter = F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))
    if network is None:
        return packed(docs).withColumns({"lang": F.lit("und"), "score": F.lit(0.0)})

    def run(texts):
        for _, offsets, data in slices(texts, 1_000_000):
            p = network.pooled(offsets, data)
            at = p.argmax(1)
            yield len(at), [pa.array([network.languages[i] for i in at], pa.string()), pa.array(np.minimum(p[np.arange(len(at)), at], 1.0))]

    return beside_rows(docs, "text", lambda: run, "lang string, score double").withColumns({
        "lang": F.when(has_letter, F.col("lang")).otherwise("und"), "score": F.when(has_letter, F.col("score")).otherwise(0.0)})
