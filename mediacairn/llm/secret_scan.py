"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Base spans are leftmost non-overlapping matches, per kind, of three patterns over the whole text. The field tags tokens
as begin, inside or outside of a secret from the shape of the token (length, kinds of characters, changes between
them), the shapes of two tokens before and one after, and the file (how much of it is digits or signs, whether it names
credentials), with weights for every pair of neighbouring tags. It is trained in numpy by gradient of the exact
likelihood (forward-backward) on excerpts around base spans and on excerpts without, EXCERPTS of each at most; weak
labels are the base spans. All files are searched for base spans, and of those with some the ones with the lowest hashes
of doc_id and text are taken, so a secret that is rare in a large corpus still counts; of those without, one in 16 is
looked at. Files with the same hash give one excerpt. Decoding is Viterbi. A token whose outside score leads by more than
transitions can ever make up is outside on the best path, so the path is worked out only between such tokens; that is
exact. Tagged runs that touch no base span are added under the kind `crf`.

Offsets are code points, end exclusive. Nulls and empties: a null or empty text has no spans. Without base spans to
learn from nothing is added. Rows that repeat an id are scanned each. An empty table gives an empty result.
"""

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import beside_rows, map_batches

# fixed values: the patterns of the contract
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are as long as they can be, so shorter ones never hold or hide a longer one
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "crf"]

NAMED = re.compile(rb"password|passwd|secret|token|api_?key|credential|private|auth|bearer|login|pwd")
EXCERPTS, AROUND, TOKENS = 1500, 250, 96
STEPS, RATE, DECAY = 80, 0.2, 1e-4
OUT, BEGIN, IN = 0, 1, 2
FEATURES, SLOTS = 512, 28

#: x lower case, X upper case, 9 digit, u part of a longer character; other bytes stand for themselves.
SHAPE = bytes(ord("9") if 48 <= b < 58 else ord("X") if 65 <= b < 91 else ord("x") if 97 <= b < 123 else ord("u") if b >= 128 else b for b in range(256))
TOKEN = re.compile(rb"[xX9uK+/_.=-]+|[^xX9uK+/_.=\x00-\x20-]+")
LONG_HEX = re.compile(rb"[0-9a-f]{32}")


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the secret itself) of all base spans."""
    low, found = text.lower(), []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def shaped(data: bytes) -> bytes:
    """The bytes of a text by shape; words that name credentials become K."""
    out, low = data.translate(SHAPE), data.lower()
    if any(w in low for w in (b"passw", b"secret", b"token", b"key", b"auth", b"bearer", b"private", b"credential", b"login", b"pwd")):
        out = bytearray(out)
        for m in NAMED.finditer(low):
            out[m.start():m.end()] = b"K" * (m.end() - m.start())
        out = bytes(out)
    return out


def file_features(shape: bytes) -> list[int]:
    """Feature numbers of the whole file."""
    n = max(len(shape), 1)
    digits, signs = shape.count(b"9") / n, (shape.count(b"=") + shape.count(b":") + shape.count(b'"')) / n
    return [500 + int(np.searchsorted([0.005, 0.02, 0.08], digits)), 504 + int(np.searchsorted([0.001, 0.01, 0.05], signs)), 508 + (b"K" in shape)]


def token_features(token: bytes) -> list[int]:
    """Feature numbers of a shape, each under 64."""
    n = len(token)
    kinds = (b"x" in token) + 2 * (b"X" in token) + 4 * (b"9" in token) + 8 * (b"u" in token)
    changes = sum(a != b for a, b in zip(token[:64], token[1:64]))
    digits = token.count(b"9")
    out = [int(np.searchsorted([2, 4, 8, 12, 16, 20, 32, 40], n, side="right")), 10 + kinds, 26 + int(np.searchsorted([1, 2, 4, 8, 16], changes, side="right")),
           32 + (0 if not digits else 1 if digits < n / 4 else 2 if digits < n else 3)]
    if b"K" in token:
        out.append(36 + (set(token) <= set(b"K_")))
    if token in (b"=", b":"):
        out.append(38)
    elif token[:1] in (b'"', b"'") or token[:1] in b"=:" and len(token) < 4:
        out.append(39)
    elif not re.search(rb"[xX9uK]", token):
        out.append(40)
    if any(c in token for c in (b"_", b"-", b"/", b"+")):
        out.append(41)
    if b"." in token[:-1] or token.endswith((b".", b"=")):
        out.append(42 + (b"." in token[:-1]))
    if n >= 16 and 4 <= kinds < 8:
        out.append(44 + (kinds & 3))
    return out


#: Where the features of a token and of its neighbours begin.
OWN, LEFT, LEFT2, RIGHT, BIAS = 0, 64, 128, 192, 511


class Field:
    """Weights of features (FEATURES, 3) and of neighbouring tags (3, 3)."""

    def __init__(self):
        self.w = np.zeros((FEATURES, 3))
        self.t = np.zeros((3, 3))

    def train(self, features, tags, lengths):
        """features (n, TOKENS, SLOTS) numbers, unused slots hold FEATURES; tags (n, TOKENS). Adam on the likelihood."""
        n = len(features)
        there = np.arange(TOKENS) < lengths[:, None]
        flat, rows = features.reshape(n * TOKENS, SLOTS), np.arange(n)
        first, second = [0.0, 0.0], [0.0, 0.0]
        for step in range(1, STEPS + 1):
            w = np.vstack([self.w, np.zeros((1, 3))])
            e = w[flat].sum(1).reshape(n, TOKENS, 3)
            before, after = np.empty_like(e), np.zeros_like(e)
            before[:, 0] = e[:, 0]
            for t in range(1, TOKENS):
                x = before[:, t - 1, :, None] + self.t
                top = x.max(1)
                before[:, t] = np.where(there[:, t, None], top + np.log(np.exp(x - top[:, None]).sum(1)) + e[:, t], before[:, t - 1])
            pairs = np.zeros((3, 3))
            last = before[rows, lengths - 1]
            z = last.max(1) + np.log(np.exp(last - last.max(1, keepdims=True)).sum(1))
            for t in range(TOKENS - 2, -1, -1):
                follow = e[:, t + 1] + after[:, t + 1]
                x = self.t + follow[:, None, :]
                top = x.max(2)
                inside = there[:, t + 1]
                after[:, t] = np.where(inside[:, None], top + np.log(np.exp(x - top[:, :, None]).sum(2)), 0)
                p = np.exp(before[:, t, :, None] + self.t + follow[:, None, :] - z[:, None, None])
                pairs += p[inside].sum(0)
                np.subtract.at(pairs, (tags[inside, t], tags[inside, t + 1]), 1)
            p = np.exp(before + after - z[:, None, None]) * there[:, :, None]
            p[rows[:, None], np.arange(TOKENS), tags] -= there
            each = p.reshape(n * TOKENS, 3)
            g = np.stack([np.bincount(flat.ravel(), np.repeat(each[:, k], SLOTS), FEATURES + 1)[:FEATURES] for k in range(3)], axis=1)
            for i, (part, grad) in enumerate(((self.w, g), (self.t, pairs))):
                grad = grad / there.sum() + DECAY * part
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.99 * second[i] + 0.01 * grad * grad
                part -= RATE * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-9)
        return self

    def viterbi(self, scores: np.ndarray, edge: bool) -> list[int]:
        """Best tags of a run; edge: tokens that are outside stand on both sides (where the file has any)."""
        best, back = scores[0] + (self.t[OUT] if edge else 0), []
        for row in scores[1:]:
            x = best[:, None] + self.t
            back.append(x.argmax(0))
            best = x.max(0) + row
        tag = int((best + self.t[:, OUT]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]


class Shapes(dict):
    """Number of a shape; scores of new ones are worked out as they come and forgotten in one go past a bound."""

    def __init__(self, field: Field):
        self.field, self.rows = field, []

    def __missing__(self, token):
        f = np.array(token_features(token))
        self[token] = number = len(self.rows)
        self.rows.append(np.concatenate([self.field.w[f + at].sum(0) for at in (OWN, LEFT, LEFT2, RIGHT)]))
        return number

    def scores(self, tokens):
        if len(self.rows) > 100_000:
            self.clear()
            self.rows = []
        numbers = [self[t] for t in tokens]
        table = np.array(self.rows) if len(self.rows) != getattr(self, "size", -1) else self.table
        self.table, self.size = table, len(self.rows)
        own = table[numbers]
        out = own[:, :3].copy()
        out[1:] += own[:-1, 3:6]
        out[2:] += own[:-2, 6:9]
        out[:-1] += own[1:, 9:12]
        return out


def tagged(data: bytes, field: Field, shapes: Shapes) -> list[tuple[int, int]]:
    """Byte spans that the field tags as secret, over the whole text."""
    shape = shaped(data)
    tokens = TOKEN.findall(shape)
    if not tokens:
        return []
    scores = shapes.scores(tokens) + field.w[[*file_features(shape), BIAS]].sum(0)
    swing = 2 * (field.t.max() - field.t.min())
    doubtful = np.flatnonzero(scores[:, OUT] - scores[:, 1:].max(1) <= swing)
    if not len(doubtful):
        return []
    tags, n = {}, len(tokens)
    for run in np.split(doubtful, np.flatnonzero(np.diff(doubtful) > 1) + 1):
        first, last = int(run[0]), int(run[-1])
        # an end of the file is no neighbour: its transition is left out
        part = scores[first:last + 1].copy()
        if last == n - 1:
            part[-1] -= field.t[:, OUT]
        for i, tag in enumerate(field.viterbi(part, first > 0)):
            if tag != OUT:
                tags[first + i] = tag
    if not tags:
        return []
    places = [m.span() for m in TOKEN.finditer(shape)]
    spans: list[tuple[int, int]] = []
    for i in sorted(tags):
        if tags[i] == IN and i - 1 in tags and spans:
            spans[-1] = spans[-1][0], places[i][1]
        else:
            spans.append(places[i])
    return spans


def excerpt(text: str, start: int, end: int):
    """(features, tags) of the tokens around a place of a text, TOKENS at most, and the features of the whole file."""
    data = text[start:end].encode()
    shape = shaped(data)
    tags, at = [], []
    marks = [(len(text[start:s].encode()) if s > start else 0, len(text[start:e].encode()))
             for _, _, e, s in base_spans(text) if e > start and s < end]
    for m in TOKEN.finditer(shape):
        inside = [i for i, (s, e) in enumerate(marks) if m.start() < e and m.end() > s]
        tags.append(OUT if not inside else IN if at and inside[0] in at[-1] else BEGIN)
        at.append(inside)
    tokens = [token_features(m) for m in TOKEN.findall(shape)][:TOKENS]
    common = [*file_features(shaped(text.encode())), BIAS]
    rows = []
    for i, own in enumerate(tokens):
        row = [OWN + x for x in own] + common
        row += [LEFT + x for x in tokens[i - 1]] if i else []
        row += [LEFT2 + x for x in tokens[i - 2]] if i > 1 else []
        row += [RIGHT + x for x in tokens[i + 1]] if i + 1 < len(tokens) else []
        rows.append(row)
    return rows, tags[:TOKENS]


def place(text: str, turn: int, spans) -> int:
    """Around which an excerpt is made."""
    return spans[turn % len(spans)][3] if spans else turn % max(len(text), 1)


def lowest(turns: set[int], each: int) -> set[int]:
    return set(heapq.nsmallest(each, turns)) if len(turns) > each else turns


def drawn(turned: DataFrame, each: int) -> list[int]:
    """Of all (text, turn), the `each` lowest turns of files with base spans and of files without; tasks pass on no more."""
    def run(batches):
        kept = {True: set(), False: set()}
        for batch in batches:
            for text, turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                spans = base_spans(text)
                if not spans:
                    at = place(text, turn, spans)
                    # plain files are many
                    if turn % 16 or not TOKEN.search(shaped(text[max(0, at - AROUND):at + AROUND].encode())):
                        continue
                kept[bool(spans)].add(turn)
            for hit, turns in kept.items():
                if len(turns) > 4 * each:
                    kept[hit] = lowest(turns, each)
        for hit, turns in kept.items():
            turns = sorted(lowest(turns, each))
            yield pa.RecordBatch.from_arrays([pa.array([hit] * len(turns), pa.bool_()), pa.array(turns, pa.int64())], names=["hit", "turn"])

    found = map_batches(turned, run, "hit boolean, turn bigint").distinct()
    rows = [found.filter(F.col("hit") == hit).orderBy("turn").limit(each).collect() for hit in (True, False)]
    return [r.turn for part in rows for r in part]


def samples(docs: DataFrame, each=EXCERPTS) -> DataFrame:
    """(hit, turn, rows, tags): a bounded number of labelled excerpts."""
    def run(batches):
        done = set()
        for batch in batches:
            out = []
            for text, turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if turn in done:
                    continue
                done.add(turn)
                text = text or ""
                spans = base_spans(text)
                at = place(text, turn, spans)
                rows, tags = excerpt(text, max(0, at - AROUND), at + AROUND)
                if tags:
                    out.append((bool(spans), turn, rows, tags))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.int64()),
                                              pa.array([x[2] for x in out], pa.list_(pa.list_(pa.int32()))), pa.array([x[3] for x in out], pa.list_(pa.int32()))],
                                             names=["hit", "turn", "rows", "tags"])

    turned = docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("turn"))
    chosen = turned.filter(F.col("turn").isin(drawn(turned, each)))
    return map_batches(chosen, run, "hit boolean, turn bigint, rows array<array<int>>, tags array<int>").dropDuplicates(["turn"]).orderBy("turn")


def learn(docs: DataFrame, **bounds) -> Field | None:
    """Fit the field to the base spans of a bounded sample; None if it has none."""
    found = samples(docs, **bounds).collect()
    if not any(r.hit for r in found):
        return None
    features = np.full((len(found), TOKENS, SLOTS), FEATURES, np.int64)
    tags = np.zeros((len(found), TOKENS), np.int64)
    for i, r in enumerate(found):
        for j, row in enumerate(r.rows):
            features[i, j, :min(len(row), SLOTS)] = row[:SLOTS]
        tags[i, :len(r.tags)] = r.tags
    return Field().train(features, tags, np.array([len(r.tags) for r in found]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """Every row of `docs` as `row`, with spans: kind, start, end, by start and then kind as listed in KINDS."""
    def all_spans(text, shapes):
        base = base_spans(text)
        spans = [(start, kind, end) for start, kind, end, _ in base]
        if field:
            data = text.encode()
            for first, last in tagged(data, field, shapes):
                start = len(data[:first].decode(errors="ignore"))
                end = start + len(data[first:last].decode(errors="ignore"))
                if not any(start < e and end > s for s, _, e, _ in base):
                    spans.append((start, "crf", end))
        spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
        return [{"kind": k, "start": s, "end": e} for s, k, e in spans]

    def start():
        shapes = Shapes(field) if field else None

        def run(texts):
            for at in range(0, len(texts), 512):
                part = texts.slice(at, 512)
                yield len(part), [pa.array([all_spans(t or "", shapes) for t in part.to_pylist()], SPANS)]

        return run

    return beside_rows(docs, "text", start, "spans array<struct<kind: string, start: bigint, end: bigint>>")
