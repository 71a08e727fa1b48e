"""Duplicates hidden by formatting, by recursive radix partitioning on canonical bytes.

The canonical text of a record is its consistent form's letters and digits in lower
case, the fields of an unsplit record sorted. Rows are combined where they are read,
routed to buckets by the leading bytes, and buckets that hold too many are split by
further bytes until each fits. Each bucket is then counted in a byte trie whose
terminals hold the number of copies and the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.consistent import Folder, bigram_model, canonical
from gnomon.session import materialize

BUCKET_ROWS = 200_000  #: most combined rows of a bucket, what one trie may hold
FIRST_BYTES = 4
STRIDE = 16  #: bytes of an edge of the trie
COMBINE_ROWS = 100_000  #: distinct texts held while combining, then passed on
_counted = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("copies", pa.int64()), ("first_id", pa.int64())])


def key(canon: bytes) -> tuple[int, int]:
    """128 bits to join on instead of the text."""
    k = xxhash.xxh3_128_intdigest(canon)
    return (k >> 64) - (1 << 63), (k & (1 << 64) - 1) - (1 << 63)


def keyed(df: DataFrame, id_column: str, text_column: str, keep: tuple[str, ...]) -> DataFrame:
    """One pass over (id, text, kept columns): each row with its key, and for each text and task one row (canon, copies, first_id), or more if a task holds very many texts. Texts without letters and digits are left out."""
    plain = df.select(F.col(id_column).cast("long").alias("__id"), F.col(text_column).alias("__text"), *keep).filter("__text is not null")
    shared = df.sparkSession.sparkContext.broadcast(bigram_model(plain.select("__text")).counts)
    fields = [f"{n} {t}" for n, t in plain.drop("__text").dtypes] + ["k1 bigint", "k2 bigint", "canon string", "copies bigint", "first_id bigint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Folder(shared.value)
        seen: dict[str, list[int]] = {}
        kinds: list[pa.Field] = []

        def flush() -> pa.RecordBatch:
            n = len(seen)
            texts = [pa.array(list(seen), pa.string()), pa.array([c for c, _ in seen.values()], pa.int64()), pa.array([i for _, i in seen.values()], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays([*(pa.nulls(n, f.type) for f in kinds), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *texts], names=names)

        names: list[str] = []
        for batch in batches:
            kinds = [f for f in batch.schema if f.name != "__text"]
            names = [f.name for f in kinds] + ["k1", "k2", "canon", "copies", "first_id"]
            place = batch.schema.get_field_index("__text")
            rows, keys = [], []
            for i, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(place).to_pylist())):
                if canon := canonical(fold(text)):
                    rows.append(i)
                    keys.append(key(canon.encode()))
                    if held := seen.get(canon):
                        held[0] += 1
                        held[1] = min(held[1], row)
                    else:
                        seen[canon] = [1, row]
            kept = batch.take(pa.array(rows, pa.int64()))
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(f.name) for f in kinds), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names
            )
            if len(seen) > COMBINE_ROWS:
                yield flush()
        if seen:
            yield flush()

    return plain.mapInArrow(run, ", ".join(fields))


def radix_buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``bucket``, leading bytes of ``canon``: as many as it takes for the rows of one bucket to fit.

    A bucket of one text is never split; after combining it is small. The list of oversized buckets stays a table, joined to the rows level by level.
    """
    data = F.encode("canon", "utf-8")
    rows = rows.withColumn("bucket", F.substring(data, 1, FIRST_BYTES))
    depth = FIRST_BYTES
    while True:
        longer = F.octet_length("canon") > depth
        over = rows.filter(longer & (F.octet_length("bucket") == depth)).groupBy("bucket").count().filter(F.col("count") > bucket_rows).select("bucket", F.lit(True).alias("over"))
        over = materialize(over)
        if over.isEmpty():
            return rows
        rows = rows.join(over, "bucket", "left").withColumn("bucket", F.when(F.col("over") & longer, F.substring(data, 1, depth * 2)).otherwise(F.col("bucket"))).drop("over")
        depth *= 2


class Trie:
    """A trie over bytes with edges of ``STRIDE`` bytes; a terminal counts copies and holds the smallest id."""

    def __init__(self) -> None:
        self.root: dict[Any, Any] = {}

    def add(self, text: bytes, copies: int, first: int) -> None:
        node = self.root
        for at in range(0, len(text), STRIDE):
            edge = text[at : at + STRIDE]
            below = node.get(edge)
            if below is None:
                below = node[edge] = {}
            node = below
        if None in node:
            node[None] = (node[None][0] + copies, min(node[None][1], first))
        else:
            node[None] = (copies, first)

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            for edge, below in node.items():
                if edge is None:
                    yield path, *below
                else:
                    stack.append((path + edge, below))


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to the terminals with more than one copy, a trie at a time."""

    def full(trie: Trie) -> pa.RecordBatch:
        found = [(*key(t), n, i) for t, n, i in trie.terminals() if n > 1]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 4, schema=_counted)

    trie, at = Trie(), None
    for batch in batches:
        for bucket, text, copies, first in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at:
                yield full(trie)
                trie, at = Trie(), bucket
            trie.add(text.encode(), copies, first)
    yield full(trie)


def duplicate_groups(texts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Key, copies and first_id of each text that more than one row holds, of combined rows (canon, copies, first_id)."""
    routed = radix_buckets(texts, bucket_rows).select("bucket", "canon", "copies", "first_id")
    return routed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count_buckets, "k1 bigint, k2 bigint, copies bigint, first_id bigint")


def collapse(df: DataFrame, id_column: str, text_column: str, keep: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each row of ``df`` that has copies: its id, first_id (the smallest of its group), copies, and the columns in ``keep``.

    Null texts and texts without letters and digits are copies of nothing. Rows that repeat entirely count as copies. An empty table gives no rows; other columns don't matter.
    """
    rows = materialize(keyed(df, id_column, text_column, keep))
    groups = materialize(duplicate_groups(rows.filter("canon is not null").select("canon", "copies", "first_id"), bucket_rows))
    return rows.filter("canon is null").select(F.col("__id").alias(id_column), *keep, "k1", "k2").join(groups, ["k1", "k2"]).drop("k1", "k2")
