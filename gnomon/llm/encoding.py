"""Encoding of a corpus with a public byte-level BPE tokenizer.

Pieces of text that need merging are bucketed by length into padded matrices of token
ids. In each round every row merges its leftmost pair of minimum rank, found by hashed
lookup; only the two pairs beside a merge are looked up again, and rows without a pair
left are compacted away.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
CACHED = 200_000  #: pieces whose ids a Python worker remembers
ROWS = 4096  #: most rows of a matrix
LONG = 4096  #: bytes of a piece from which on a matrix as wide as the piece costs more than a heap of its pairs


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a public tokenizer's vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Ranks of pairs of token ids, in an open-addressing hash table of numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 2.5))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slots, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slots[rest]] == -1]
            places, first = np.unique(slots[free], return_index=True)
            self.keys[places], self.ranks[places] = keys[free[first]], rank[free[first]]
            rest = rest[self.keys[slots[rest]] != keys[rest]]
            slots[rest] = (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where it doesn't merge or an id is -1."""
        out = np.full(left.shape, NONE, np.int32)
        where = np.nonzero((left >= 0) & (right >= 0))
        keys = left[where].astype(np.int64) << 32 | right[where]
        slots, found, open_ = self._slots(keys), np.full(len(keys), NONE, np.int32), np.arange(len(keys))
        while len(open_):
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
            slots[open_] = (slots[open_] + 1) & self.mask
        out[where] = found
        return out


class Encoder:
    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*(np.array(c, np.int64) for c in zip(*pairs)))
        self.cache: dict[str, list[int]] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces of similar length."""
        width = max(map(len, pieces))
        ids = np.full((len(pieces), width + 1), -1, np.int32)  # a last column that is always padding
        for i, piece in enumerate(pieces):
            ids[i, : len(piece)] = self.single[np.frombuffer(piece, np.uint8)]
        ranks = np.concatenate([self.pairs.lookup(ids[:, :-1], ids[:, 1:]), np.full((len(pieces), 1), NONE, np.int32)], 1)
        out: list[list[int]] = [[]] * len(pieces)
        rows = np.arange(len(pieces))
        while True:
            best = ranks.argmin(1)  # the leftmost of equals
            least = ranks[np.arange(len(rows)), best]
            done = least == NONE
            if done.any():
                for row, line in zip(rows[done], ids[done]):
                    out[row] = line[line >= 0].tolist()
                keep = ~done
                rows, best, least, ids, ranks = rows[keep], best[keep], least[keep], ids[keep], ranks[keep]
                if not len(rows):
                    return out
                used = int((ids >= 0).sum(1).max()) + 1
                ids, ranks = ids[:, :used], ranks[:, :used]
            at, each = np.arange(ids.shape[1]), np.arange(len(rows))
            source = np.minimum(at[None, :] + (at[None, :] > best[:, None]), ids.shape[1] - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            ids[each, best] = least  # a merged token's id is its rank
            ranks[each, best] = self.pairs.lookup(ids[each, best], ids[each, np.minimum(best + 1, ids.shape[1] - 1)])
            left = np.maximum(best - 1, 0)
            before = self.pairs.lookup(ids[each, left], ids[each, best])
            ranks[each[best > 0], left[best > 0]] = before[best > 0]

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one very long piece: the same merges in the same order, each found in a heap of pairs."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.lookup(ids[:-1], ids[1:])
        heap = [(int(ranks[i]), i) for i in np.flatnonzero(ranks != NONE).tolist()]
        heapq.heapify(heap)
        held, after, before = ids.tolist(), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank_at = ranks.tolist()
        known: dict[tuple[int, int], int] = {}
        while heap:
            rank, i = heapq.heappop(heap)
            if held[i] < 0 or rank_at[i] != rank:
                continue  # a pair that a merge has changed
            j = after[i]
            held[i], held[j] = rank, -1
            after[i] = k = after[j]
            if k < len(held):
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a < 0:
                    continue
                rank_ab = int(NONE)
                if b < len(held):
                    pair = (held[a], held[b])
                    if pair not in known:
                        known[pair] = int(self.pairs.lookup(np.array(pair[:1]), np.array(pair[1:]))[0])
                    rank_ab = known[pair]
                    if rank_ab != NONE:
                        heapq.heappush(heap, (rank_ab, a))
                if a < len(rank_at):
                    rank_at[a] = rank_ab
        return [x for x in held if x >= 0]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text, without special tokens; none for a null or empty text."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        new = {p: p.encode("utf-8", "surrogatepass") for p in {p for s in split for p in s} - self.cache.keys()}
        buckets: dict[int, list[str]] = {}
        for piece, data in new.items():
            if data in self.ranks:
                self.cache[piece] = [self.ranks[data]]
            elif len(data) > LONG:
                self.cache[piece] = self.merge_long(data)
            else:
                buckets.setdefault((len(data) - 1).bit_length(), []).append(piece)
        for held in buckets.values():
            held.sort(key=lambda p: len(new[p]))
            width = max(len(new[p]) for p in held)
            step = max(1, min(ROWS, 4_000_000 // width))
            for i in range(0, len(held), step):
                block = held[i : i + step]
                self.cache.update(zip(block, self.merge([new[p] for p in block])))
        return [[i for p in s for i in self.cache[p]] for s in split]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """The id and the token ids of every row, by the vocabulary at ``path`` (a parameter that each executor must see). Null and empty texts give an empty list; repeated rows each give a row."""
    path, pattern = path or tokenizer_path(), split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.encode(batch.column(1).to_pylist()), pa.list_(pa.int32()))], names=[id_column, "ids"])

    return df.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, f"{id_column} bigint, ids array<int>")
