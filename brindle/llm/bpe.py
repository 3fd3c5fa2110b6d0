"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols stand at the leaves of a segment tree that holds the rank of each adjacent pair; the root yields
the leftmost pair of the lowest rank. A merge changes two neighbouring pairs, which are updated in logarithmic time,
so a word of n symbols takes n log n steps, however long it is. Many short words are merged side by side, each in its
own tree, one numpy row a tree; long ones have a tree of their own. Tasks keep a bounded cache of words they have seen.

The vocabulary is a file in the JSON format of the tokenizers library: BPE with an end-of-word suffix over bytes,
NFC, white space runs as one space, lower case. Its path is a parameter; each worker reads it once.

Known limit: letters of the newest Unicode version, which the library's own tables don't know yet, may be split
differently: of all 1,112,064 code points 17,171 are, each of them unassigned in Unicode 15.1. Defined results: a null text counts as empty and gives no ids; the special tokens' strings in a text are special
tokens; repeated rows and further columns pass through.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the vocabulary's patterns, and its pattern of pieces.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
#: Words that a worker's cache holds at most; then it starts anew.
CACHE_WORDS = 500_000
NO_PAIR = 1 << 30
#: Symbols of a word that is merged beside others; characters of text that are looked through at a time.
ROW_SYMBOLS, TEXT_BLOCK = 65, 1 << 21


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next of those from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class PairTree:
    """Segment tree over the ranks of adjacent pairs: the minimum of (rank, position), with point updates.

    A node holds rank << SHIFT | position, so that the smallest key is the leftmost pair of the lowest rank.
    """

    SHIFT = 32

    def __init__(self, ranks: list[int]):
        n = len(ranks)
        self.size = size = 1 << (n - 1).bit_length()
        nodes = [0] * size + [(r << 32) | i for i, r in enumerate(ranks)] + [NO_PAIR << 32] * (size - n)
        for i in range(size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b
        self.nodes = nodes

    def root(self) -> tuple[int, int]:
        key = self.nodes[1]
        return key >> 32, key & 0xFFFFFFFF

    def update(self, position: int, rank: int) -> None:
        nodes, i = self.nodes, self.size + position
        nodes[i] = best = (rank << 32) | position
        while i > 1:
            other = nodes[i ^ 1]
            if other < best:
                best = other
            i >>= 1
            if nodes[i] == best:
                return
            nodes[i] = best


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.letters = dict(enumerate(byte_letters()))
        self.pieces = regex.compile(PIECE)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.first = np.array([self.ids.get(x, -1) for x in byte_letters()], np.int64)
        self.last = np.array([self.ids.get(x + self.suffix, -1) for x in byte_letters()], np.int64)
        keys = np.array([a << 20 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.merged = np.array([new for _, new in sorted(self.merges.values())], np.int64)
        self.words: dict[str, bytes] = {}  # packed ids by piece

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece, by merging the leftmost lowest-ranked pair until none is left."""
        names = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = [self.ids[x] for x in names[:-1] if x in self.ids]
        if names[-1] + self.suffix in self.ids:
            ids.append(self.ids[names[-1] + self.suffix])
        n, get = len(ids), self.merges.get
        if n < 2:
            return ids
        none = (NO_PAIR, 0)
        tree = PairTree([get(pair, none)[0] for pair in zip(ids, ids[1:])])
        update = tree.update
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while True:
            rank, i = tree.root()
            if rank == NO_PAIR:
                return [x for x in ids if x >= 0]
            j = after[i]
            ids[i] = merged = self.merges[ids[i], ids[j]][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                update(j, NO_PAIR)
                update(i, get((merged, ids[k]), none)[0])
            else:
                update(i, NO_PAIR)
            if (h := before[i]) >= 0:
                update(h, get((ids[h], merged), none)[0])

    def merge_many(self, pieces: list[str]) -> list[bytes]:
        """merge() of many pieces at once, as packed ids; trees of the same size stand side by side in an array."""
        out = [b""] * len(pieces)
        raws = [p.encode("utf-8") for p in pieces]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        data = np.frombuffer(b"".join(raws), np.uint8)
        stops = np.cumsum(lengths)
        starts = stops - lengths
        ids = self.first[data]
        ids[stops - 1] = self.last[data[stops - 1]]
        alone = lengths > ROW_SYMBOLS
        if (ids < 0).any():
            alone |= np.minimum.reduceat(ids, starts) < 0
        for at in np.flatnonzero(alone).tolist():
            out[at] = np.array(self.merge(pieces[at]), np.int32).tobytes()
        sizes = np.where(lengths < 2, 0, 1 << np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64))
        for size in np.unique(sizes[~alone]).tolist():
            rows = np.flatnonzero((sizes == size) & ~alone)
            spots = np.arange(size + 1)
            held = spots < lengths[rows, None]
            flat = np.full(held.shape, -1, np.int64)
            flat[held] = ids[(starts[rows, None] + spots)[held]]
            merged = self._merge_rows(flat, size) if size else flat
            left = merged >= 0
            packed = merged[left].astype(np.int32).tobytes()
            ends = (np.cumsum(left.sum(axis=1)) * 4).tolist()
            begin = 0
            for at, end in zip(rows.tolist(), ends, strict=True):
                out[at] = packed[begin:end]
                begin = end
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == pairs) & (a >= 0) & (b >= 0), self.pair_ranks[at], NO_PAIR)

    def _merge_rows(self, ids: np.ndarray, size: int) -> np.ndarray:
        m = len(ids)
        spots = np.arange(size, dtype=np.int64)
        nodes = np.empty((m, 2 * size), np.int64)
        nodes[:, size:] = self._rank(ids[:, :-1], ids[:, 1:]) << 8 | spots
        for i in range(size - 1, 0, -1):
            nodes[:, i] = np.minimum(nodes[:, 2 * i], nodes[:, 2 * i + 1])
        ends = (ids >= 0).sum(axis=1)
        after = np.arange(1, size + 2) + np.zeros((m, 1), np.int64)
        after[np.arange(m), ends - 1] = -1
        before = np.arange(-1, size) + np.zeros((m, 1), np.int64)
        none = NO_PAIR << 8
        live = np.flatnonzero(nodes[:, 1] < none)
        while len(live):
            root = nodes[live, 1]
            i, made = root & 255, self.merged[root >> 8]
            j = after[live, i]
            k = after[live, j]
            h = before[live, i]
            ids[live, i], ids[live, j] = made, -1
            after[live, i] = k
            has_k, has_h, has_j = k >= 0, h >= 0, j < size
            before[live[has_k], k[has_k]] = i[has_k]
            follows = np.full(len(live), NO_PAIR)
            follows[has_k] = self._rank(made[has_k], ids[live[has_k], k[has_k]])
            precedes = self._rank(ids[live[has_h], h[has_h]], made[has_h])
            row = np.concatenate([live, live[has_j], live[has_h]])
            spot = np.concatenate([i, j[has_j], h[has_h]])
            rank = np.concatenate([follows, np.full(has_j.sum(), NO_PAIR), precedes])
            node = size + spot
            nodes[row, node] = rank << 8 | spot
            while size > 1 and node[0] > 1:
                node >>= 1
                nodes[row, node] = np.minimum(nodes[row, 2 * node], nodes[row, 2 * node + 1])
            live = live[nodes[live, 1] < none]
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], np.int32).tolist()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids (int32) of each text; unknown words are looked up together."""
        block = []
        for text in texts:
            parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
            block.append([self.special[p] if p in self.special else self._pieces(p) for p in parts])
        words = self.words
        lists = [p for parts in block for p in parts if not isinstance(p, int)]
        distinct = set(chain.from_iterable(lists))
        unseen = distinct.difference(words)
        if len(words) + len(unseen) > CACHE_WORDS:
            words.clear()
            unseen = distinct
        fresh = list(unseen)
        if fresh:
            words.update(zip(fresh, self.merge_many(fresh), strict=True))
        get = words.__getitem__
        return [b"".join([np.int32(p).tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in parts]) for parts in block]

    def _pieces(self, text: str) -> list[str]:
        # Letters are lowered one by one, so a capital sigma never becomes a final one. White space ends pieces.
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.pieces.findall(text.replace("Σ", "σ").lower())

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, joined by spaces; unknown ids are left out."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of about TEXT_BLOCK bytes, so that a worker holds little besides its cache."""
    run: list[str] = []
    held = 0
    for t in texts:
        run.append(t.as_py() or "")
        held += len(run[-1])
        if held >= TEXT_BLOCK:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode(text: Column, path: str) -> Column:
    """array<int> of token ids."""

    def run(texts: pa.Array) -> pa.Array:
        v = vocabulary(path)
        made = []
        for block in _blocks(texts):
            rows = v.encode_batch(block)
            values = np.frombuffer(b"".join(rows), np.int32)
            stops = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            made.append(pa.ListArray.from_arrays(pa.array(stops), pa.array(values)))
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids; null for null."""

    def run(lists: pa.Array) -> pa.Array:
        v = vocabulary(path)
        rows = (v.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in lists)
        return pa.array(rows, pa.string(), size=len(lists))

    return F.arrow_udf(run, "string")(ids)
