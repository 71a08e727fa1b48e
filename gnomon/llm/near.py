"""Near-duplicate records: a similarity join with adaptive multi-match prefixes.

A text is its set of word shingles, in one global order, rare ones first. Two sets of
Jaccard similarity t share l tokens of their prefixes of n - ceil(t n) + l tokens. Each
text takes the l from 1 to ``MOST_MATCHES`` that is estimated to cost least, and a pair
must share as many prefix tokens as the lesser l of the two before it is verified.

The order comes from exact counts: tokens are counted bucket by bucket, and the
``MOST_HEAVY`` that most texts hold are known with their numbers; all others are light,
and how many texts hold a light token at most is known too. Postings travel as packed
blobs, bucketed by token; tokens that very many texts hold are spread over a grid of
cells, so that no task holds more than two blocks of one token's texts. Copies are one
node: links are between different word sequences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.consistent import Folder, bigram_model, canonical, words_of
from gnomon.session import materialize

WORDS, SIMILARITY = 3, 0.6
MOST_MATCHES = 3
VERIFY_COST = 8.0  #: of a candidate, where scanning a posting costs 1
MOST_HEAVY = 2_000_000  #: tokens whose counts are broadcast, 16 bytes each; which tokens are known costs or saves time, never links
COUNTED_TOKENS = 4_000_000  #: of a bucket in which tokens are counted
TOKEN_BYTES = 5  #: of a token: two shingles of two texts that agree in these are as good as never different
KEY_BITS = 8 * TOKEN_BYTES
MOST_BUCKETS, MOST_PARTITIONS = 1 << 20, 8192
CELL_TEXTS = 2_000  #: texts of one token in a block of its grid
BUCKET_POSTINGS = 500_000
SEEN_NODES = 500_000  #: nodes that a task remembers, to pass each on once
PAIRS_AT_ONCE = 500_000
BITMAP_BITS = (16, 28)  #: least and most of the bitmap of candidate nodes, as powers of two: 32 MB at most
BITMAP_BLOCK = 1 << 16  #: bytes
FLUSH = 400_000  #: postings packed at once
POSTING = np.dtype([("token", "<u8"), ("node", "<i8"), ("bits", "<u8"), ("size", "<u4"), ("at", "<u4"), ("level", "u1"), ("matches", "u1"), ("block", "<u4"), ("cell", "<u8"), ("own", "u1")])
_made = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("k", pa.int64()), ("tokens", pa.list_(pa.int64())), ("total", pa.int64())])
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Word sequences to sets of hashed shingles, a batch at a time."""

    def __init__(self, words: int) -> None:
        self.words, self.hashes = words, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The text's number and the token of each shingle; sorted, each token once for each text."""
        if len(self.hashes) > 1_000_000:
            self.hashes.clear()
        held, flat, sizes = self.hashes, [], []
        for text in texts:
            words = text.split(" ")
            sizes.append(len(words))
            for w in words:
                h = held.get(w)
                if h is None:
                    h = held[w] = xxhash.xxh3_64_intdigest(w)
                flat.append(h)
        h, sizes = np.array(flat, np.uint64), np.array(sizes)
        if len(h) < self.words:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        tokens = np.zeros(len(h) - self.words + 1, np.uint64)
        for i in range(self.words):
            tokens = mixed(tokens * _MIX[0] + h[i : len(h) - self.words + 1 + i])
        tokens >>= np.uint64(64 - KEY_BITS)
        owner = np.repeat(np.arange(len(sizes)), sizes)[: len(tokens)]
        whole = np.arange(len(tokens)) + self.words <= ends[: len(tokens)]
        owner, tokens = owner[whole], tokens[whole]
        order = np.lexsort((tokens, owner))
        owner, tokens = owner[order], tokens[order]
        first = np.ones(len(tokens), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])
        return owner[first], tokens[first]


def nodes(rows: DataFrame, words: int) -> DataFrame:
    """One pass over (id, text): each row with its node and key (id, node, k); each node that a task meets with its tokens (node, tokens); and how many tokens the task met (total)."""
    shared = rows.sparkSession.sparkContext.broadcast(bigram_model(rows.select("text")).counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, shingler, total = Folder(shared.value), Shingler(words), 0
        seen: set[int] = set()

        def made(**columns: object) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _made], schema=_made)

        for batch in batches:
            if len(seen) > SEEN_NODES:
                seen.clear()
            ids, every, keys, new, texts = [], [], [], [], []
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = fold(raw)
                text = words_of(form)
                if not text:
                    continue
                node = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                same = canonical(form) if "|" in form else text.replace(" ", "").replace("\u03c2", "\u03c3").replace("\u00df", "ss")
                ids.append(row)
                every.append(node)
                keys.append(xxhash.xxh3_64_intdigest(same) - (1 << 63))
                if node not in seen:
                    seen.add(node)
                    new.append(node)
                    texts.append(text)
            yield made(id=ids, node=every, k=keys)
            if texts:
                owner, tokens = shingler(texts)
                total += len(tokens)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
                yield made(node=new, tokens=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.view(np.int64))))
        yield made(total=[total])

    return materialize(rows.mapInArrow(run, "id bigint, node bigint, k bigint, tokens array<bigint>, total bigint"))


class Counts:
    """In how many texts the heavy tokens stand; all others stand in ``floor`` texts at most."""

    def __init__(self, keys: np.ndarray, texts: np.ndarray, floor: int) -> None:
        self.keys, self.texts, self.floor = keys, texts, floor

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The number of texts of each token; 0 for a light one."""
        if not len(self.keys) or not len(tokens):
            return np.zeros(len(tokens), np.int64)
        order = np.argsort(tokens)  # sorted keys are found several times as fast
        at = np.minimum(np.searchsorted(self.keys, tokens[order]), len(self.keys) - 1)
        out = np.zeros(len(tokens), np.int64)
        out[order] = np.where(self.keys[at] == tokens[order], self.texts[at], 0)
        return out


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane: planes of zeros compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def token_counts(made: DataFrame, total: int) -> Counts:
    """Exact counts over all nodes' tokens: summed where they are read, then bucket by bucket in ranges of keys. Each bucket passes on its heaviest tokens and the count of the heaviest that it keeps back."""
    buckets = min(MOST_BUCKETS, max(16, total // COUNTED_TOKENS))
    most = max(2, MOST_HEAVY // buckets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def blobs() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            to = (keys * np.uint64(buckets)) >> np.uint64(KEY_BITS)
            starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            parts = [(int(to[i]), np.diff(k, prepend=np.uint64(0)), n) for i, k, n in zip(starts, np.split(keys, starts[1:]), np.split(counts, starts[1:]))]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), pa.array([planes(k) for _, k, _ in parts], pa.binary()), pa.array([planes(n) for _, _, n in parts], pa.binary())], names=["bucket", "keys", "counts"])

        for batch in batches:
            if len(tokens := np.asarray(batch.column(0).flatten()).view(np.uint64)):
                waiting.append(tokens)
            if sum(map(len, waiting)) > COUNTED_TOKENS // 2:
                yield blobs()
        if waiting:
            yield blobs()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = None

        def full() -> pa.RecordBatch:
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            keys, counts = keys[counts > 1], counts[counts > 1]
            floor = 1
            if len(counts) > most:
                floor = int(np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1])
                keys, counts = keys[counts > floor], counts[counts > floor]
            return pa.RecordBatch.from_arrays([pa.array(np.append(keys.astype(np.int64), -1)), pa.array(np.append(counts.astype(np.int64), floor))], names=["key", "texts"])

        for batch in batches:
            for bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and held:
                    yield full()
                at = bucket
                held.append((np.cumsum(from_planes(keys), dtype=np.uint64), from_planes(counts).astype(np.int64)))
        if held:
            yield full()

    parts = made.filter("tokens is not null").select("tokens").mapInArrow(emit, "bucket int, keys binary, counts binary")
    parts = parts.repartitionById(min(buckets, MOST_PARTITIONS), F.col("bucket") % min(buckets, MOST_PARTITIONS)).sortWithinPartitions("bucket")
    counted = materialize(parts.mapInArrow(add, "key bigint, texts bigint"))
    floor = counted.filter("key < 0").agg(F.max("texts")).first()[0] or 1
    heavy = counted.filter((F.col("key") >= 0) & (F.col("texts") > floor)).toArrow()  # MOST_HEAVY rows at most
    keys, texts = heavy.column("key").to_numpy().astype(np.uint64), heavy.column("texts").to_numpy()
    order = np.argsort(keys)
    return Counts(keys[order], texts[order], floor)


def prefixes(owner: np.ndarray, tokens: np.ndarray, nodes: np.ndarray, counts: Counts, similarity: float) -> np.ndarray:
    """Postings of each text's prefix. A token that only its own text holds needs none."""
    freq = counts.of(tokens)
    order = np.lexsort((tokens, freq, owner))
    tokens, freq = tokens[order], freq[order].astype(np.float64)
    single = (freq == 0) if counts.floor <= 1 else np.zeros(len(freq), bool)
    freq[freq == 0] = 0.0 if counts.floor <= 1 else (1 + counts.floor) / 2
    sizes = np.bincount(owner, minlength=len(nodes))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bits = np.zeros(len(nodes), np.uint64)
    np.bitwise_or.at(bits, owner, np.uint64(1) << (tokens >> np.uint64(KEY_BITS - 6)))
    base = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    scan = np.concatenate([[0.0], np.cumsum(freq)])
    # a posting of a token that f texts hold meets f texts; about 1 / l ** 2 of the meetings share l tokens
    costs = []
    for l in range(1, MOST_MATCHES + 1):
        reach = np.minimum(base + l - 1, sizes)
        met = scan[starts[:-1] + reach] - scan[starts[:-1]]
        costs.append(np.where(base + l - 1 <= sizes, met * (1 + VERIFY_COST / l**2), np.inf))
    matches = np.argmin(np.array(costs), 0) + 1 if len(nodes) else np.empty(0, np.int64)
    at = np.arange(len(tokens)) - starts[owner]
    inside = at < (base + matches - 1)[owner]
    inside &= ~single
    who, at, tokens_in, freq_in = owner[inside], at[inside], tokens[inside], freq[inside]
    out = np.zeros(len(who), POSTING)
    out["token"], out["node"], out["bits"], out["size"], out["at"] = tokens_in, nodes[who], bits[who], sizes[who], at
    out["level"], out["matches"] = np.maximum(1, at - base[who] + 2), matches[who]
    blocks = np.maximum(1, np.ceil(freq_in / CELL_TEXTS)).astype(np.uint64)
    out["block"] = mixed(nodes[who].view(np.uint64)) % blocks
    spread = [out[blocks == 1]]
    for n in np.unique(blocks[blocks > 1]).tolist():
        hot = out[blocks == n]
        for other in range(n):
            copy = hot.copy()
            low, high = np.minimum(hot["block"], other), np.maximum(hot["block"], other)
            copy["cell"] = low.astype(np.uint64) * np.uint64(n) + high + 1
            copy["own"] = low == high
            spread.append(copy)
    return np.concatenate(spread)


def packed(postings: np.ndarray) -> bytes:
    """Postings column by column, which compresses better than row by row; of a token ``TOKEN_BYTES``."""
    columns = [np.ascontiguousarray(postings[name]) for name in POSTING.names]
    columns[0] = columns[0].view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
    return b"".join(c.tobytes() for c in columns)


def unpacked(blobs: list[bytes]) -> np.ndarray:
    width = POSTING.itemsize - 8 + TOKEN_BYTES
    out = np.zeros(sum(map(len, blobs)) // width, POSTING)
    at = 0
    for blob in blobs:
        n = len(blob) // width
        tokens = np.zeros((n, 8), np.uint8)
        tokens[:, :TOKEN_BYTES] = np.frombuffer(blob, np.uint8, n * TOKEN_BYTES).reshape(n, TOKEN_BYTES)
        out["token"][at : at + n] = tokens.view("<u8").ravel()
        place = n * TOKEN_BYTES
        for name in POSTING.names[1:]:
            kind = POSTING[name]
            out[name][at : at + n] = np.frombuffer(blob, kind, n, place)
            place += n * kind.itemsize
        at += n
    return out


def pairs_of(postings: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, node, matches needed) of the pairs of a bucket that meet in a cell and may still be similar enough."""
    postings = postings[np.lexsort((postings["node"], postings["size"], postings["cell"], postings["token"]))]
    c = {name: np.ascontiguousarray(postings[name]) for name in POSTING.names}
    new = np.ones(len(postings), bool)
    new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["cell"][1:] != c["cell"][:-1])
    fresh = new.copy()  # a node that several tasks met is posted by each
    fresh[1:] |= c["node"][1:] != c["node"][:-1]
    c = {name: column[fresh] for name, column in c.items()}
    starts = np.flatnonzero(new[fresh])
    size, place = c["size"].astype(np.int64), c["at"].astype(np.int64)
    ends = np.repeat(np.append(starts[1:], len(size)), np.diff(np.append(starts, len(size))))
    # each posting meets those behind it in its group, which are no smaller
    after = ends - np.arange(len(size)) - 1
    done = np.cumsum(after)
    begin = 0
    while begin < len(size):
        stop = max(begin + 1, int(np.searchsorted(done, done[begin] - after[begin] + PAIRS_AT_ONCE, side="right")))
        n = after[begin:stop]
        x = np.repeat(np.arange(begin, stop), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        begin = stop
        keep = size[x] >= similarity * size[y] - 1e-9
        x, y = x[keep], y[keep]
        overlap = np.ceil(similarity / (1 + similarity) * (size[x] + size[y]) - 1e-9)
        keep = np.minimum(place[x], place[y]) + np.minimum(size[x] - place[x], size[y] - place[y]) >= overlap
        x, y, overlap = x[keep], y[keep], overlap[keep]
        p, q = c["bits"][x], c["bits"][y]
        keep = np.minimum(size[x] - np.bitwise_count(p & ~q), size[y] - np.bitwise_count(q & ~p)) >= overlap
        x, y = x[keep], y[keep]
        need = np.minimum(c["matches"][x], c["matches"][y])
        keep = (c["level"][x] <= need) & (c["level"][y] <= need)
        # texts of one block meet in its own cell only
        keep &= (c["cell"][x] == 0) | c["own"][x].astype(bool) | (c["block"][x] != c["block"][y])
        x, y, need = c["node"][x[keep]], c["node"][y[keep]], need[keep]
        yield np.minimum(x, y), np.maximum(x, y), need


def near_pairs(rows: DataFrame, id_column: str, text_column: str, words: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links (node_a, node_b, similarity) between different word sequences, and members (id, node, k: what copies share).

    A text is its words in lower case, in consistent form. Null texts and those with fewer words than a shingle are linked to nothing; repeated rows are members of one node. Nodes are 64-bit hashes of the words, verified on 31-bit hashes of the shingles.
    """
    made = nodes(rows.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).filter("text is not null"), words)
    total = made.agg(F.sum("total")).first()[0] or 0
    counts = token_counts(made, total)
    shared = rows.sparkSession.sparkContext.broadcast((counts.keys, counts.texts, counts.floor))
    partitions = min(MOST_PARTITIONS, max(16, total // BUCKET_POSTINGS))
    buckets = max(partitions, total // BUCKET_POSTINGS)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts(*shared.value)
        waiting: list[np.ndarray] = []

        def blobs() -> pa.RecordBatch:
            every = np.concatenate(waiting)
            waiting.clear()
            to = ((mixed(every["token"] + every["cell"] * _MIX[0])) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            names, starts = np.unique(to[order], return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([packed(x) for x in np.split(every[order], starts[1:])], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            lists = batch.column(1)
            tokens = np.asarray(lists.flatten()).view(np.uint64)
            sizes = np.asarray(pc.list_value_length(lists))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            waiting.append(prefixes(owner, tokens, np.asarray(batch.column(0)), held, similarity))
            if sum(map(len, waiting)) > FLUSH:
                yield blobs()
        if waiting:
            yield blobs()

    posted = made.filter("tokens is not null").select("node", "tokens").mapInArrow(post, "bucket bigint, blob binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        at = None

        def out() -> Iterator[pa.RecordBatch]:
            for a, b, need in pairs_of(unpacked(blobs), similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need.astype(np.int32))], names=["node_a", "node_b", "need"])

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and blobs:
                    yield from out()
                    blobs.clear()
                at = bucket
                blobs.append(blob)
        if blobs:
            yield from out()

    met = posted.repartitionById(partitions, (F.col("bucket") % partitions).cast("int")).sortWithinPartitions("bucket").mapInArrow(meet, "node_a bigint, node_b bigint, need int")
    candidates = materialize(met.groupBy("node_a", "node_b").agg(F.count("*").alias("shared"), F.max("need").alias("need")).filter("shared >= need").select("node_a", "node_b"))
    sets = wanted_sets(made.filter("tokens is not null").select("node", "tokens"), candidates).dropDuplicates(["node"])
    a, b = sets.select(F.col("node").alias("node_a"), F.col("tokens").alias("set_a")), sets.select(F.col("node").alias("node_b"), F.col("tokens").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    alike = common / (F.size("set_a") + F.size("set_b") - common)
    links = candidates.join(a, "node_a").join(b, "node_b").select("node_a", "node_b", alike.alias("similarity")).filter(F.col("similarity") >= similarity)
    return links, made.filter("id is not null").select("id", "node", "k")


def wanted_sets(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """The sets of candidate nodes, and a few others, with 31 bits of each token: a bitmap of the candidates keeps all others out of the join. The bitmap grows with the candidates to 32 MB; beyond, it keeps fewer sets out."""
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], (16 * candidates.count()).bit_length()))

    def places(nodes: np.ndarray) -> np.ndarray:
        return (mixed(nodes.view(np.uint64) + _MIX[0]) >> np.uint64(64 - bits)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            at = np.unique(np.concatenate([places(np.asarray(c)) for c in batch.columns]))
            starts = np.flatnonzero(np.concatenate([[True], (at >> 3)[1:] != (at >> 3)[:-1]])) if len(at) else at
            if len(at):
                held[at[starts] >> 3] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), starts)
        blocks = [(i, held[i : i + BITMAP_BLOCK].tobytes()) for i in range(0, len(held), BITMAP_BLOCK) if held[i : i + BITMAP_BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], names=["at", "block"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = np.frombuffer(block, np.uint8)
                held[at] = held[at] | block if at in held else block
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["at", "block"])

    marked = np.zeros((1 << bits) // 8, np.uint8)
    for at, block in candidates.select("node_a", "node_b").mapInArrow(mark, "at int, block binary").repartition(32, "at").mapInArrow(merge, "at int, block binary").collect():
        marked[at : at + len(block)] = np.frombuffer(bytes(block), np.uint8)
    shared = sets.sparkSession.sparkContext.broadcast(marked.tobytes())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = places(np.asarray(batch.column(0)))
            batch = batch.filter(pa.array((held[at >> 3] >> (at & 7)) & 1 == 1))
            lists = batch.column(1)
            short = (np.asarray(lists.flatten()).view(np.uint64) >> np.uint64(KEY_BITS - 31)).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(short))], names=["node", "tokens"])

    return sets.mapInArrow(keep, "node bigint, tokens array<int>")


def near_records(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b) of linked records that aren't copies, the smaller id first."""
    a = members.select(F.col("id").alias("id_1"), F.col("node").alias("node_a"), F.col("k").alias("k_1"))
    b = members.select(F.col("id").alias("id_2"), F.col("node").alias("node_b"), F.col("k").alias("k_2"))
    pairs = links.select("node_a", "node_b").join(a, "node_a").join(b, "node_b").filter("k_1 <> k_2 and id_1 <> id_2")
    return pairs.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()
