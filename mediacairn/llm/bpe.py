"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

A leaf holds rank and place of the pair that starts at a symbol; the root then holds the leftmost pair of lowest rank.
A merge changes three leaves: the merged pair's own, its left neighbour's, and the one of the symbol that is gone; each
is carried up to the root in as many steps as the tree is high. It ends when the root holds no pair. Trees of many words
of like length lie side by side in one array, so one step serves them all; when only a few of them still merge, each of
these is walked by itself in plain integers, since a step of arrays costs as much for one tree as for hundreds.

Words come about as in the tokenizer's file: marked special strings are cut out first, then canonical composition,
lower case, and the file's own split pattern; every byte of a word is a symbol, the last one with the end-of-word mark.
White space separates words and is dropped, so a text is encoded piece by piece between white space, and pieces that a
task has met are remembered, up to a bound after which it forgets them.

Decoding joins the tokens' strings by one blank, as the library does for a file without decoder.

Nulls and empties: a null or empty text, or one of white space only, has no tokens and decodes to the empty text. An
empty table gives an empty result. Texts are never cut; a word of any length is one tree.
"""

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import beside_rows, slices

#: White space by the Unicode property, as the tokenizer's pattern has it.
SPACE = r"\t-\r \x85\xa0  -     　"
REMEMBERED = 200_000
NONE = int(np.iinfo(np.int64).max)
#: So many trees are few.
FEW = 24


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class Vocabulary:
    """What the merges need of a tokenizer file; small and of fixed size, so it can go to every task."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + end] for s in symbols], np.int64)
        self.strings = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in (ids | self.special).items():
            self.strings[i] = s
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        first = np.unique(pairs[::-1], return_index=True)  # a pair that is listed twice has its last rank
        self.pairs, self.ranks = first[0], len(pairs) - 1 - first[1]
        self.made = made


class Merger:
    """Merges the symbols of many words at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.rank_of = dict(zip(vocabulary.pairs.tolist(), vocabulary.ranks.tolist()))
        self.made = vocabulary.made.tolist()

    def rank(self, left, right):
        """Rank of each pair, or NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.v.pairs, key), len(self.v.pairs) - 1)
        return np.where(self.v.pairs[at] == key, self.v.ranks[at], NONE)

    def words(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        """(token ids, joined token strings) of each word (UTF-8, not empty)."""
        out: list = [None] * len(words)
        lengths = np.array([len(w) for w in words])
        high = np.maximum(np.ceil(np.log2(np.maximum(lengths, 1))).astype(int), 0)
        for h in np.unique(high):
            same, width = np.flatnonzero(high == h), 1 << int(h)
            for part in np.array_split(same, max(1, len(same) * width >> 17)):
                self._group([words[i] for i in part], lengths[part], width, part, out)
        return out

    def _group(self, words, lengths, width, places, out):
        m = len(words)
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        ids = self.v.inner[data]
        row = np.arange(m)
        ids[row, lengths - 1] = self.v.last[data[row, lengths - 1]]
        column = np.arange(width)
        alive = column < lengths[:, None]
        following = np.where(column + 1 < lengths[:, None], column + 1, width)
        leading = np.broadcast_to(column - 1, (m, width)).copy()
        tree = np.full((m, 2 * width), NONE, np.int64)
        if width > 1:
            ranks = self.rank(ids[:, :-1], ids[:, 1:])
            known = (ranks != NONE) & (column[1:] < lengths[:, None])
            tree[:, width:2 * width - 1] = np.where(known, ranks * width + column[:-1], NONE)
            level = width
            while level > 1:
                np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2], out=tree[:, level // 2:level])
                level //= 2
        active = row[tree[:, 1] != NONE] if width > 1 else row[:0]
        while len(active) > FEW:
            root = tree[active, 1]
            at = root % width
            ids[active, at] = self.v.made[root // width]
            gone = following[active, at]
            after = following[active, gone]
            following[active, at] = after
            alive[active, gone] = False
            linked = after < width
            leading[active[linked], after[linked]] = at[linked]
            self._set(tree, width, active, gone, np.full(len(active), NONE))
            fresh = np.full(len(active), NONE)
            r, p = active[linked], at[linked]
            ranks = self.rank(ids[r, p], ids[r, after[linked]])
            known = ranks != NONE
            fresh[np.flatnonzero(linked)[known]] = ranks[known] * width + p[known]
            self._set(tree, width, active, at, fresh)
            left = leading[active, at]
            has = left >= 0
            r, p = active[has], left[has]
            if len(r):
                ranks = self.rank(ids[r, p], ids[r, at[has]])
                known = ranks != NONE
                value = np.full(len(r), NONE)
                value[known] = ranks[known] * width + p[known]
                self._set(tree, width, r, p, value)
            active = active[tree[active, 1] != NONE]
        for k in active.tolist():
            self._walk(tree[k], ids[k], following[k], leading[k], alive[k], width)
        ends = np.cumsum(alive.sum(1)).tolist()
        kept = ids[alive]
        raw = kept.astype("<u4").tobytes()
        strings = self.v.strings
        names = [strings[i] for i in kept.tolist()]
        start = 0
        for place, end in zip(places.tolist(), ends):
            out[place] = raw[4 * start:4 * end], " ".join(names[start:end])
            start = end

    def _walk(self, tree_row, ids_row, following_row, leading_row, alive_row, width):
        """The merges of one tree that are left."""
        tree, ids, following, leading = (x.tolist() for x in (tree_row, ids_row, following_row, leading_row))
        rank_of, made, gone_ones = self.rank_of, self.made, []

        def put(leaf, value):
            node = leaf + width
            tree[node] = value
            while node > 1:
                left, right = tree[node & -2], tree[node | 1]
                least = left if left < right else right
                node >>= 1
                if tree[node] == least:  # and so is all above
                    return
                tree[node] = least

        def pair(at, other):
            rank = rank_of.get(ids[at] << 32 | ids[other])
            put(at, NONE if rank is None else rank * width + at)
        while tree[1] != NONE:
            rank, at = divmod(tree[1], width)
            ids[at] = made[rank]
            gone = following[at]
            after = following[at] = following[gone]
            gone_ones.append(gone)
            put(gone, NONE)
            if after < width:
                leading[after] = at
                pair(at, after)
            else:
                put(at, NONE)
            if leading[at] >= 0:
                pair(leading[at], at)
        ids_row[:] = ids
        alive_row[gone_ones] = False

    @staticmethod
    def _set(tree, width, rows, leaves, values):
        """Point update: a leaf, then its ancestors."""
        node = leaves + width
        tree[rows, node] = values
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1


class Encoder:
    """Encodes and decodes texts; remembers the pieces between white space that it has met."""

    def __init__(self, vocabulary: Vocabulary, remembered=REMEMBERED):
        self.v, self.merger, self.remembered = vocabulary, Merger(vocabulary), remembered
        self.split = regex.compile(vocabulary.pattern)
        self.pieces = re.compile(f"[^{SPACE}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[bytes, str]] = {}

    def learn(self, pieces):
        """Encode pieces that are not known yet."""
        parts, words, place = [], [], {}
        for piece in pieces:
            own = []
            for i, part in enumerate(self.specials.split(piece) if "<|" in piece else (piece,)):
                if i % 2:
                    own.append(-1 - self.v.special[part])
                    continue
                # capital sigma becomes the plain small one, whatever follows
                low = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                for word in self.split.findall(low):
                    if word not in place:
                        place[word] = len(words)
                        words.append(word.encode())
                    own.append(place[word])
            parts.append(own)
        merged = self.merger.words(words)
        for piece, own in zip(pieces, parts):
            if len(own) == 1 and own[0] >= 0:
                self.known[piece] = merged[own[0]]
                continue
            found = [merged[x] if x >= 0 else ((-1 - x).to_bytes(4, "little"), self.v.strings[-1 - x]) for x in own]
            self.known[piece] = b"".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def __call__(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """(ids of each text as little-endian 32-bit integers, decoded texts)."""
        split = [self.pieces.findall(t) for t in texts]
        known = self.known
        fresh = {p for pieces in split for p in pieces if p not in known}
        if len(fresh) + len(known) > self.remembered:
            known.clear()
            fresh = {p for pieces in split for p in pieces}
        if fresh:
            self.learn(list(fresh))
        ids, decoded = [], []
        for pieces in split:
            own = [known[p] for p in pieces]
            ids.append(b"".join([x[0] for x in own]))
            decoded.append(" ".join([x[1] for x in own]))
        return ids, decoded


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Every row of `docs` as `row`, with ids (little-endian 32-bit integers) and decoded.

    vocabulary_path: a tokenizer file that the driver can read; its content, of fixed size, goes to every task.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))

    def start():
        encoder = Encoder(shared.value)  # what it remembers goes with the task

        def run(texts):
            for first, offsets, _ in slices(texts, 1_000_000):
                n = len(offsets) - 1
                ids, decoded = encoder([t or "" for t in texts.slice(first, n).to_pylist()])
                yield n, [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]

        return run

    return beside_rows(docs, "text", start, "ids binary, decoded string")
