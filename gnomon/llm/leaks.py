"""Evaluation texts in training text: a broadcast hash set of normalised test n-grams.

Documents are read once. A window of ``N`` words is looked up only where as many words
in a row all occur in test items; a hit is verified by its words, and runs of hits make
the leaked spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.consistent import SPACES, Folder, bigram_model, with_form

N = 12
#: Test items of one block; their n-grams are what is broadcast. More items make more blocks, each a pass over the documents.
BLOCK_ITEMS = 20_000

_word = regex.compile(r"[\p{L}\p{Nd}]+")
_chunk = re.compile(f"[^ \\t\\n\\r{SPACES}]+")


def words(form: str | None) -> list[tuple[str, int, int]]:
    """The runs of letters and digits of a consistent form, in lower case, with their places."""
    return [(m[0].lower(), m.start(), m.end()) for m in _word.finditer(form or "")]


class Items:
    """The n-grams of a block of test items, by hash."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.n, self.grams, self.known = n, {}, set()
        self.texts: dict[int, list[tuple[int, int]]] = {}
        self.words = []
        for item, form in items:
            text = [w for w, _, _ in words(form)]
            if len(text) < n:
                continue
            self.known.update(text)
            self.words.append(text)
            for at in range(len(text) - n + 1):
                self.grams.setdefault(hash(tuple(text[at : at + n])), []).append((item, len(self.words) - 1, at))

    def hits(self, text: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item, window, place in the item) of each window of ``text`` that stands in an item."""
        run = 0
        for at, word in enumerate(text, 1):
            run = run + 1 if word in self.known else 0
            if run >= self.n:
                window = text[at - self.n : at]
                for item, held, place in self.grams.get(hash(tuple(window)), ()):
                    if self.words[held][place : place + self.n] == window:
                        yield item, at - self.n, place

    def spans(self, form: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, words) of each longest passage that ``form`` shares with an item."""
        text = words(form)
        open_at: dict[tuple[int, int], list[int]] = {}
        done = []
        for item, at, place in self.hits([w for w, _, _ in text]):
            key = (item, place - at)
            if key in open_at and at == open_at[key][1] + 1:
                open_at[key][1] = at
            else:
                if key in open_at:
                    done.append((item, *open_at[key]))
                open_at[key] = [at, at]
        done += [(item, *at) for (item, _), at in open_at.items()]
        return [(item, text[a][1], text[b + self.n - 1][2], b - a + self.n) for item, a, b in done]


class Folded:
    """The consistent form of a text and where its places stand in the text: exactly where a stretch between blanks is unchanged, else at the stretch's ends."""

    def __init__(self, text: str, fold: Folder) -> None:
        self.form, self.starts, self.pieces = text, [], []
        if fold(text) == text:
            return
        out, size, last = [], 0, 0
        for m in _chunk.finditer(text):
            out.append(fold(text[last : m.start()]))  # of the same length: blanks become ordinary ones
            size += m.start() - last
            last = m.end()
            held = fold(m[0])
            self.starts.append(size)
            self.pieces.append((m.start(), m.end(), held == m[0]))
            out.append(held)
            size += len(held)
        self.form = "".join([*out, fold(text[last:])])

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The place in the text of a place in the form."""
        if not self.starts:
            return start, end
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (a, _, same_a), (c, d, same_b) = self.pieces[i], self.pieces[j]
        return (a + start - self.starts[i] if same_a else a), (c + end - self.starts[j] if same_b else d)


def leaked_spans(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "case_id", item_text: str = "quote", n: int = N, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc, item, start_char, end_char, words): passages of at least ``n`` words of a test item in a document, with their places in its text.

    Null and empty texts hold nothing; items of fewer words can't leak. Repeated rows repeat their spans; empty tables give none.
    """
    model = bigram_model(documents.select(text), items.select(item_text))
    tests = with_form(items.select(item_id, item_text), item_text, model)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), text).filter(F.col(text) != "")
    blocks = max(1, -(-tests.count() // block_items))
    context = documents.sparkSession.sparkContext
    counts = context.broadcast(model.counts)
    found = None
    for block in range(blocks):
        rows = [(int(r[0]), r[1]) for r in tests.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == block).select(item_id, "form").collect() if r[1]]
        shared = context.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held, fold = Items(shared.value, n), Folder(counts.value)
            for batch in batches:
                out = []
                for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    read = Folded(raw, fold)
                    out += [(doc, item, *read.span(a, b), size) for item, a, b, size in held.spans(read.form)]
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start_char", "end_char", "words"])

        part = docs.mapInArrow(scan, "doc_id bigint, item_id bigint, start_char bigint, end_char bigint, words bigint")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(documents: DataFrame, items: DataFrame, whole_share: float = 0.5) -> DataFrame:
    """doc_id and text of the documents without leaked spans; documents of which ``whole_share`` or more leaked are left out."""
    spans = leaked_spans(documents, items).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("spans"))
    docs = documents.select("doc_id", F.col("text").alias("form")).join(spans, "doc_id", "left")
    # folded from the left: the text kept so far and the place it reaches
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<start_char:bigint,end_char:bigint>>")),
        start,
        lambda s, x: F.struct(
            F.concat(s["kept"], F.when(x["start_char"] > s["at"], F.substring(F.col("form"), (s["at"] + 1).cast("int"), (x["start_char"] - s["at"]).cast("int"))).otherwise("")).alias("kept"),
            F.greatest(s["at"], x["end_char"]).alias("at"),
        ),
    )
    rest = F.concat(F.col("cut.kept"), F.substring(F.col("form"), (F.col("cut.at") + 1).cast("int"), F.length("form")))
    kept = docs.withColumn("cut", cut).select("doc_id", F.length("form").alias("before"), rest.alias("text"))
    return kept.filter((F.length("text") > F.col("before") * (1 - whole_share)) | F.col("before").isNull() | (F.col("before") == 0)).select("doc_id", "text")
