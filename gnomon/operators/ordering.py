"""Ordering, greedy choice and deduplication by key."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gnomon.session import materialize


def top_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Spark keeps only those of each key and task before it shuffles."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= n)


def round_robin(rows: DataFrame, groups: list[str], order: list[Column], limit: int) -> DataFrame:
    """A sample that takes one row of each group in turn, groups in their order, until ``limit`` rows are taken."""
    turn = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return rows.withColumn("turn", turn).filter(F.col("turn") <= limit).orderBy("turn", *groups).limit(limit)


def diverse(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with as many different keys as there are: first one row of each key, then the others, both in order."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1
    return rows.withColumn("again", first).orderBy("again", *order).limit(limit).drop("again")


def neighbours(rows: DataFrame, key: str, order: list[Column], text: str) -> DataFrame:
    """Each row with the text before and behind it in its key; empty at the ends."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("before", F.lag(text, 1, "").over(w)).withColumn("behind", F.lead(text, 1, "").over(w))


def canonical_rows(rows: DataFrame, key: list[str], rank: Column, arrival: Column, merged: str) -> DataFrame:
    """One row per key: the best ranked, among equals the first to arrive; ``merged`` is false if any row's is, else true if any row's is. ``copies`` counts the rows.

    One aggregation with partial sums: no window, so that a hot key is combined where it is read.
    """
    columns = [c for c in rows.columns if c not in key and c != merged]
    best = F.max_by(F.struct(*columns), F.struct(rank.alias("rank"), (-arrival).alias("first")))
    return rows.groupBy(*key).agg(best.alias("best"), F.bool_and(merged).alias(merged), F.count("*").alias("copies")).select(*key, "best.*", merged, "copies")


def _best(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """The best ``n`` rows of each combination of keys, by score and id; Spark cuts each task's rows before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id")))
    return rows.withColumn(name, place).filter(F.col(name) <= n).drop(name)


def choosable(offered: DataFrame, wanted: int) -> DataFrame:
    """Of candidates (minute, id, a, t, score, new_a, new_t) those that a greedy choice of ``wanted`` rows can take, at most some 100 + ``wanted`` of a minute, whatever it holds.

    While rows with both names new are left, the choice takes the best; at most ``wanted`` - 1 authors and as many titles are taken before, and each shuts out no more than ``wanted`` of the rows kept here. Else the best row of a new name counts, else the best rows of all.
    """
    taken = wanted - 1
    both = _best(offered.filter("new_a and new_t"), ["minute", "a", "t"], 1, "p")
    both = _best(_best(_best(both, ["minute", "a"], wanted, "p"), ["minute", "t"], wanted, "p"), ["minute"], 2 * taken * wanted + 1, "p")
    authors = _best(_best(offered.filter("new_a"), ["minute", "a"], 1, "p"), ["minute"], 2 * wanted, "p")
    titles = _best(_best(offered.filter("new_t"), ["minute", "t"], 1, "p"), ["minute"], 2 * wanted, "p")
    return reduce(DataFrame.unionByName, (both, authors, titles, _best(offered, ["minute"], wanted, "p"))).dropDuplicates(["minute", "id"])


def fill(held: DataFrame, offered: DataFrame, wanted: int = 7, author_first: bool = True) -> DataFrame:
    """Greedy fill of each minute up to ``wanted`` rows: of the candidates (minute, id, author, title, score) always the one that brings a new author and a new title (in that order, or the other), then the best score, then the least id.

    Minutes that are full drop out before anything of them is gathered; of the others no more than ``wanted`` names are held, and candidates are first cut to those that can be chosen. Only that bounded rest of a minute is handled in arrival order by one task. Null names count as empty ones.
    """
    counts = held.groupBy("minute").agg(F.count("*").alias("n"))
    few = held.join(counts.filter(F.col("n") < wanted), "minute")
    room = few.groupBy("minute").agg(F.first("n").alias("n"), F.collect_set(F.lower("author")).alias("authors"), F.collect_set(F.lower("title")).alias("titles"))
    offered = offered.withColumn("a", F.lower(F.coalesce("author", F.lit("")))).withColumn("t", F.lower(F.coalesce("title", F.lit(""))))
    full = counts.filter(F.col("n") >= wanted).select("minute")
    none = F.array().cast("array<string>")
    open_ = offered.join(full, "minute", "left_anti").join(room, "minute", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "authors": F.coalesce("authors", none), "titles": F.coalesce("titles", none)})
    open_ = open_.withColumns({"new_a": ~F.array_contains("authors", F.col("a")), "new_t": ~F.array_contains("titles", F.col("t"))})
    kept = choosable(open_.select("minute", "id", "a", "t", "score", "n", "authors", "titles", "new_a", "new_t"), wanted)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        authors, titles = set(row["authors"]), set(row["titles"])
        left = sorted(zip(pdf["id"], pdf["a"], pdf["t"], pdf["score"]), key=lambda r: (-r[3], r[0]))
        out = []
        while left and row["n"] + len(out) < wanted:
            new = [((r[1] not in authors), (r[2] not in titles)) for r in left]
            at = max(range(len(left)), key=lambda i: (new[i] if author_first else new[i][::-1], -i))
            taken = left.pop(at)
            authors.add(taken[1])
            titles.add(taken[2])
            out.append((int(row["minute"]), int(taken[0]), len(out) + 1))
        return pd.DataFrame(out, columns=["minute", "id", "pick"])

    return kept.drop("new_a", "new_t").groupBy("minute").applyInPandas(choose, "minute int, id bigint, pick int")


# passages that repeat known ones

SHINGLE = 8
SHARED = 0.8


def words_column(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w]+|_+", " ")), " "), lambda w: w != "")


def shares_run(a: Column, b: Column, share: float = SHARED) -> Column:
    """Whether two word lists hold a common run as long as ``share`` of the shorter: some run of the shorter stands in the longer."""
    shorter, longer = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n = F.ceil(F.size(shorter) * share - 1e-9).cast("int")
    text = F.concat(F.lit(" "), F.array_join(longer, " "), F.lit(" "))
    runs = F.sequence(F.lit(1), F.size(shorter) - n + 1)
    return (n > 0) & F.exists(runs, lambda i: F.contains(text, F.concat(F.lit(" "), F.array_join(F.slice(shorter, i, n), " "), F.lit(" "))))


def duplicate_status(known: DataFrame, new: DataFrame) -> DataFrame:
    """For each row of ``new`` (id, minute, text): EXACT if a known row of the same minute (any, where the new minute is null) has its text, NORMALIZED if only its letters, CONTEXT if they share a run of words as long as ``SHARED`` of the shorter, else NEW; and the least such known id.

    A run of that length covers the middle of the shorter text. So each text asks with the words in its middle, all of those if it is short, and the other side answers with all its shingles; minutes are part of the key. Texts of fewer words than a shingle can only be equal. Null and empty texts are NEW.
    """

    def prepared(df: DataFrame) -> DataFrame:
        words = words_column(F.col("text"))
        return df.select(F.col("id").cast("long").alias("id"), F.col("minute").cast("int").alias("minute"), "text", words.alias("words")).withColumn("letters", F.array_join("words", ""))

    # words are cut once, and read by each of the joins below
    a, b = (materialize(prepared(df).filter("letters <> ''")) for df in (new, known))

    def both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        """Pairs of equal keys (n, k): of one minute, and of all minutes where the new one is null."""
        n, k = left.alias("n"), right.alias("k")
        same = F.col(f"n.{key}") == F.col(f"k.{key}")
        return n.join(k, same & (F.col("n.minute") == F.col("k.minute"))).union(n.filter("n.minute is null").join(k, same))

    keyed = [df.select("id", "minute", F.xxhash64("letters").alias("key"), "letters", F.sha2("text", 256).alias("text")) for df in (a, b)]
    equal = both(*keyed, "key").toDF("id", "minute", "key", "letters", "text", "known_id", "known_minute", "known_key", "known_letters", "known_text").filter("letters = known_letters")
    equal = equal.groupBy("id").agg(F.min(F.when(F.col("text") == F.col("known_text"), F.col("known_id"))).alias("exact_id"), F.min("known_id").alias("normal_id"))

    def shingles(df: DataFrame, middle: bool) -> DataFrame:
        n = F.size("words")
        last = n - (SHINGLE - 1)
        # a run of SHARED of all words begins within the first 1 - SHARED of them and ends within the last
        first = F.ceil(n * (1 - SHARED)).cast("int") + 1
        spots = F.when(first + SHINGLE - 1 <= F.floor(n * SHARED), F.array(first)).otherwise(F.sequence(F.lit(1), last)) if middle else F.sequence(F.lit(1), last)
        return df.filter(n >= SHINGLE).select("id", "minute", F.explode(F.array_distinct(F.transform(spots, lambda i: F.xxhash64(*(F.get("words", i - 1 + k) for k in range(SHINGLE)))))).alias("key"))

    rest = a.join(equal.select("id"), "id", "left_anti")
    asked = both(shingles(rest, True), shingles(b, False), "key").union(both(shingles(rest, False), shingles(b, True), "key"))
    pairs = asked.toDF("id", "minute", "key", "known_id", "known_minute", "known_key").select("id", "known_id").distinct()
    wide = pairs.join(rest.select("id", F.col("words").alias("words_a")), "id").join(b.select(F.col("id").alias("known_id"), F.col("words").alias("words_b")), "known_id")
    shared = wide.filter(shares_run(F.col("words_a"), F.col("words_b"))).groupBy("id").agg(F.min("known_id").alias("context_id"))
    found = new.select(F.col("id").cast("long").alias("id")).join(equal, "id", "left").join(shared, "id", "left")
    status = F.when(F.col("exact_id").isNotNull(), "EXACT").when(F.col("normal_id").isNotNull(), "NORMALIZED").when(F.col("context_id").isNotNull(), "CONTEXT").otherwise("NEW")
    return found.select("id", status.alias("status"), F.coalesce("exact_id", "normal_id", "context_id").alias("known_id"))


def latest(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The one row that comes last."""
    return rows.orderBy(*order).limit(1)

