"""Toxicity by a classifier chain.

Categories are predicted one after another, `insult`, `contempt`, then `toxic`; each is a linear (logistic) model over
the words that a text holds, and takes the logits of the categories before it as further inputs. Those inputs are made
out of fold in training: the labelled documents are cut into FOLDS, and a document's earlier probabilities come from
models that haven't seen it. The labels say toxic or not; a toxic document that holds a seed word of a category is
positive for that category too. The last model learns from the label alone, over all words.

A word is a longest run of letters (bytes from 0x80 on count as letters), A-Z as a-z. Words and their beginnings of
STEMS bytes are the inputs, so that inflected forms count which no label has shown; each counts once a document, so the
length of a text doesn't thin out what it holds. Weights are shrunk to zero where few documents speak for them.

Training takes at most LABELLED labelled documents, drawn by a hash of doc_id; predictions read every whole text.

Nulls and empties: a text without words is not toxic, all probabilities 0. Null labels and labels without document are
left out; a document labelled more than once is toxic if any label says so. Without both kinds of label, or any
word that several documents share, nothing is toxic and all probabilities are 0. Rows that repeat an id are predicted each. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordPrints, beside_rows, map_batches, mix, packed, slices, stored, word_spans, work_dir

LABELLED, FOLDS, WORDS = 10_000, 3, 3000
STEMS = (3, 4, 5, 6, 7, 8)
SHRINK, STEPS = 1.0, 300
THRESHOLD = 0.5
CHAIN = ("insult", "contempt", "toxic")
# fixed values: seed words of the categories
SEEDS = {"insult": "idiot moron clown loser fool stupid", "contempt": "worthless pathetic disgusting trash garbage useless"}

NO_LETTER = np.array([not (65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
_prints: list = []


def prints() -> WordPrints:
    if not _prints:
        _prints.append(WordPrints(3))
    return _prints[0]


def words_of(offsets, data):
    """(fingerprint, text it is in) of each word and of its beginnings of STEMS bytes, in byte order."""
    spans, counts = word_spans(data, offsets, NO_LETTER)
    start, end = spans
    owner = np.repeat(np.arange(len(counts)), counts)
    each, owners = [prints()(data, spans)], [owner]
    for n in STEMS:
        longer = end - start > n
        each.append(mix(prints()(data, (start[longer], start[longer] + n)) + np.uint64(n)))
        owners.append(owner[longer])
    return np.concatenate(each), np.concatenate(owners)


def distinct(each, owner):
    """Each fingerprint once a text, by text."""
    order = np.lexsort((each, owner))
    each, owner = each[order], owner[order]
    first = np.ones(len(each), bool)
    first[1:] = (each[1:] != each[:-1]) | (owner[1:] != owner[:-1])
    return each[first], owner[first]


def seed_prints(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    return prints()(data, word_spans(data, np.array([0, len(data)]), NO_LETTER)[0])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """A sparse matrix of documents and the words they hold."""

    def __init__(self, owner, column, documents, width):
        self.owner, self.column, self.documents, self.width = owner, column, documents, width

    def rows(self, wanted):
        """The documents in `wanted` (mask), numbered anew."""
        number = np.cumsum(wanted) - 1
        inside = wanted[self.owner]
        return Words(number[self.owner[inside]], self.column[inside], int(wanted.sum()), self.width)

    def times(self, w):
        return np.bincount(self.owner, w[self.column], self.documents)

    def back(self, g):
        return np.bincount(self.column, g[self.owner], self.width)


def fit(x: Words, earlier: np.ndarray, y: np.ndarray):
    """(word weights, weights of earlier logits, bias): accelerated proximal gradient on the summed loss, L1 on words."""
    n, k = len(y), earlier.shape[1]
    state = np.zeros(x.width + k + 1)
    state[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    ahead, momentum = state.copy(), 1.0
    # each coordinate has its own step: the curvature of its own column, times the most columns that meet in a row
    load = 1 + np.bincount(x.owner, minlength=n).max(initial=0) ** 0.5
    curve = np.concatenate([x.back(np.ones(n)), (earlier ** 2).sum(0), [n]]) / 4 * load + 1.0
    shrink = np.concatenate([np.full(x.width, SHRINK), np.zeros(k + 1)])
    for _ in range(STEPS):
        g = sigmoid(x.times(ahead[:x.width]) + earlier @ ahead[x.width:-1] + ahead[-1]) - y
        step = ahead - np.concatenate([x.back(g), earlier.T @ g + 1e-2 * ahead[x.width:-1], [g.sum()]]) / curve
        new = np.sign(step) * np.maximum(np.abs(step) - shrink / curve, 0)
        again = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead, state, momentum = new + (momentum - 1) / again * (new - state), new, again
    return state[:x.width], state[x.width:-1], state[-1]


def logits(model, x: Words, earlier: np.ndarray) -> np.ndarray:
    w, chain, bias = model
    return np.clip(x.times(w) + earlier @ chain + bias, -8, 8)


class Chain:
    def __init__(self, vocabulary, models):
        self.vocabulary, self.models = vocabulary, models

    def probabilities(self, offsets, data) -> np.ndarray:
        """(texts, categories); zeros for texts without words."""
        each, owner = words_of(offsets, data)
        n = len(offsets) - 1
        at = np.minimum(np.searchsorted(self.vocabulary, each), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == each
        column, row = distinct(at[known], owner[known])
        x = Words(row, column, n, len(self.vocabulary))
        earlier = np.zeros((n, 0))
        for model in self.models:
            earlier = np.hstack([earlier, logits(model, x, earlier)[:, None]])
        return sigmoid(earlier) * (np.bincount(owner, minlength=n) > 0)[:, None]


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, text) of at most `most` labelled documents, on shared files."""
    known = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # the sample is bounded, so it may go to every task
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", (F.col("toxic") == 1).alias("toxic"), "text")
    return stored(found, work_dir(docs.sparkSession, "toxicity"))


def telling_words(sample: DataFrame, documents: int, toxic: int, most: int) -> np.ndarray:
    """The fingerprints that tell toxic from other documents best, by the statistic of their two-by-two table."""
    def run(batches):
        for batch in batches:
            flags = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for first, offsets, data in slices(batch.column(1)):
                each, owner = distinct(*words_of(offsets, data))
                word, at = np.unique(each, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(at, minlength=len(word))),
                                                  pa.array(np.bincount(at, flags[first + owner], len(word)).astype(np.int64))], names=["word", "df", "hits"])

    counts = (map_batches(sample.select("toxic", "text"), run, "word bigint, df bigint, hits bigint")
              .groupBy("word").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits")))
    share = toxic / documents
    expected = F.col("df") * share
    worth = (F.col("hits") - expected) ** 2 / (expected * (1 - share) * (1 - F.col("df") / (documents + 1)) + 1e-9)
    top = counts.filter(F.col("df") >= min(4, 1 + toxic / 8)).orderBy(worth.desc(), "word").limit(most).select("word")
    return np.sort(top.toArrow()["word"].to_numpy().view(np.uint64))


def train(x: Words, holds: dict, toxic: np.ndarray, folds: np.ndarray, vocabulary: np.ndarray) -> Chain:
    """holds: which documents hold a seed word, by category."""
    models, earlier = [], np.zeros((len(toxic), 0))
    for category in CHAIN:
        y = (toxic & holds.get(category, True)).astype(float)
        models.append(fit(x, earlier, y))
        out = np.zeros(len(y))
        for fold in range(FOLDS):
            held = folds == fold
            model = fit(x.rows(~held), earlier[~held], y[~held])
            out[held] = logits(model, x.rows(held), earlier[held])
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(vocabulary, models)


def learn(docs: DataFrame, labels: DataFrame, most=LABELLED, words=WORDS) -> Chain | None:
    """Fit the chain to a bounded sample of the labelled documents; only their chosen words reach the driver."""
    sample = labelled(docs, labels, most)
    documents, toxic = sample.agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    if not 0 < toxic < documents:
        return None
    vocabulary = telling_words(sample, documents, toxic, words)
    if not len(vocabulary):
        return None
    seeds = {category: seed_prints(text) for category, text in SEEDS.items()}

    def run(batches):
        for batch in batches:
            for first, offsets, data in slices(batch.column(2)):
                n = len(offsets) - 1
                each, owner = words_of(offsets, data)
                flags = [pa.array(np.bincount(owner[np.isin(each, s)], minlength=n) > 0) for s in seeds.values()]
                at = np.minimum(np.searchsorted(vocabulary, each), len(vocabulary) - 1)
                known = vocabulary[at] == each
                column, row = distinct(at[known], owner[known])
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(first, n) for k in (0, 1)],
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(column.astype(np.int32))), *flags],
                                                 names=["doc_id", "toxic", "columns", *seeds])

    found = map_batches(sample, run, "doc_id bigint, toxic boolean, columns array<int>, " + ", ".join(f"{c} boolean" for c in seeds)).toArrow()
    found = found.sort_by("doc_id").combine_chunks()
    lists = found["columns"].combine_chunks()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    x = Words(owner, lists.flatten().to_numpy(), documents, len(vocabulary))
    truth = lambda name: found[name].to_numpy().astype(bool)
    return train(x, {c: truth(c) for c in seeds}, truth("toxic"), found["doc_id"].to_numpy() // 7 % FOLDS, vocabulary)


def predict(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """Every row of `docs` as `row`, with p_insult, p_contempt, p_toxic and toxic (probability THRESHOLD or more)."""
    names = [f"p_{category}" for category in CHAIN]
    if chain is None:
        return packed(docs).withColumns({n: F.lit(0.0) for n in names} | {"toxic": F.lit(False)})

    def run(texts):
        for _, offsets, data in slices(texts):
            p = chain.probabilities(offsets, data)
            yield len(p), [*[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= THRESHOLD)]

    return beside_rows(docs, "text", lambda: run, ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are not toxic."""
    return predict(docs, learn(docs, labels)).filter("NOT toxic").select("row.*")
