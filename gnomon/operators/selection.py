"""Choosing one row per tick under cooldowns, from a shuffled bag."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds for which a quote, its book and its author rest; and for which history is kept.
QUOTE_REST, BOOK_REST, AUTHOR_REST = 86_400, 43_200, 21_600
KEPT = 90_000
# Fixed values end.

_POLYNOMIAL = 0x04C11DB7


def _table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ _POLYNOMIAL) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        out.append(c)
    return out


_CRC = _table()


def cksum(data: bytes) -> int:
    """The checksum of POSIX cksum: a CRC over the bytes and then their number."""
    crc = 0
    n = len(data)
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    while n:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ n & 0xFF]
        n >>= 8
    return ~crc & 0xFFFFFFFF


def with_checksum(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """``rows`` with the checksum of a text column, in Arrow batches."""
    keyed = rows.withColumn("__key", key)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), f"{name} bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [cksum((x or "").encode()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*batch.schema.names[:-1], name])

    return keyed.mapInArrow(run, schema)


def bag_order(rows: DataFrame, release: str, cycle: int) -> DataFrame:
    """``rows`` (minute, id) with ``bag``: a checksum that orders each minute's ids anew for every release and cycle."""
    key = F.concat_ws(":", F.lit(release), F.lit(str(cycle)), F.col("minute").cast("string"), F.col("id").cast("string"))
    return with_checksum(rows, key, "bag")


def last_shown(history: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The last time before ``now`` at which each quote, book and author was shown, within the time that history is kept. Blank names are nobody's."""
    kept = history.filter((F.col("at") <= now) & (F.col("at") >= now - F.expr(f"interval {KEPT} seconds")))

    def last(column: str, name: str) -> DataFrame:
        return kept.filter(F.trim(F.col(column).cast("string")) != "").groupBy(F.lower(F.col(column).cast("string")).alias(column)).agg(F.max("at").alias(name))

    return last("id", "quote_at"), last("title", "book_at"), last("author", "author_at")


def with_level(rows: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """Candidates with ``level``: 0 if quote, book and author have rested, rising as the author's, the book's and the quote's rest are given up, in that order."""
    quotes, books, authors = last_shown(history, now)

    def rested(at: str, seconds: int) -> Column:
        return F.col(at).isNull() | (F.unix_timestamp(now) - F.unix_timestamp(at) >= seconds)

    out = rows.withColumn("__i", F.lower(F.col("id").cast("string"))).withColumn("__t", F.lower("title")).withColumn("__a", F.lower("author"))
    out = out.join(quotes.withColumnRenamed("id", "__i"), "__i", "left").join(books.withColumnRenamed("title", "__t"), "__t", "left").join(authors.withColumnRenamed("author", "__a"), "__a", "left")
    q, b, a = rested("quote_at", QUOTE_REST), rested("book_at", BOOK_REST), rested("author_at", AUTHOR_REST)
    level = F.when(~q, 4).otherwise(0) + F.when(~b, 2).otherwise(0) + F.when(~a, 1).otherwise(0)
    return out.withColumn("level", level).drop("__i", "__t", "__a", "quote_at", "book_at", "author_at")


def choose(rows: DataFrame, history: DataFrame, now: Column, release: str = "r1", cycle: int = 0) -> DataFrame:
    """For each minute the candidate with the lowest level, the first of them in the bag: one aggregation, no window."""
    ranked = bag_order(with_level(rows, history, now).select("minute", "id", "title", "author", "level"), release, cycle)
    return ranked.groupBy("minute").agg(F.min(F.struct("level", "bag", "id")).alias("x")).select("minute", "x.id", "x.level")


def refresh_mode(shown: DataFrame, every: int = 15, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """GC16 for the first display, the first of a day and each ``every``-th; GL16 for the others. ``shown`` has ``at``, ``device`` and the columns of ``order``."""
    from pyspark.sql import Window

    w = Window.partitionBy("device").orderBy(*order)
    full = F.lag("at").over(w).isNull() | (F.to_date(F.lag("at").over(w)) != F.to_date("at")) | (F.row_number().over(w) % every == 0)
    return shown.withColumn("mode", F.when(full, "GC16").otherwise("GL16"))


def next_bag(state: DataFrame, pool: DataFrame, release: str) -> DataFrame:
    """The bags (minute, cycle, ids) that the next choices draw from: what is left of each bag and still in the pool (minute, id); a bag that is used up, unreadable or missing starts a new cycle with its whole pool in a new order.

    A bag is as long as its minute's pool.
    """
    ids = F.from_json("ids", "array<bigint>")
    held = state.select("minute", "cycle", F.coalesce(ids, F.array().cast("array<bigint>")).alias("left"))
    pools = pool.groupBy("minute").agg(F.collect_set("id").alias("ids"))
    joined = pools.join(held, "minute", "left").withColumn("left", F.filter("left", lambda x: F.array_contains("ids", x)))
    full = F.coalesce(F.size("left") > 0, F.lit(False))
    kept = joined.filter(full).select("minute", "cycle", "left")
    fresh = joined.filter(~full).select("minute", (F.coalesce("cycle", F.lit(0)) + 1).alias("cycle"), F.explode("ids").alias("id"))
    key = F.concat_ws(":", F.lit(release), F.col("cycle").cast("string"), F.col("minute").cast("string"), F.col("id").cast("string"))
    filled = with_checksum(fresh, key, "bag").groupBy("minute", "cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("bag", "id"))), lambda x: x["id"]).alias("left"))
    return kept.unionByName(filled).select("minute", "cycle", F.to_json("left").alias("ids"))


def state_lines(history: DataFrame, bags: DataFrame, shown: int, now: Column, kept_seconds: int = KEPT) -> DataFrame:
    """The lines of a state file: version, number of displays, history that is still kept, and bags, in order."""
    lines = [
        history.sparkSession.createDataFrame([(0, "", "VERSION\t1"), (1, "", f"DISPLAY_COUNT\t{int(shown)}")], "part int, place string, value string"),
        history.filter(F.col("at") >= now - F.make_interval(secs=F.lit(kept_seconds))).select(F.lit(2).alias("part"), F.date_format("at", "yyyyMMddHHmmss").alias("place"), F.concat_ws("\t", F.lit("H"), F.unix_timestamp("at").cast("string"), F.format_string("%04d", "minute"), F.col("id").cast("string")).alias("value")),
        bags.select(F.lit(3).alias("part"), F.format_string("%04d", "minute").alias("place"), F.concat_ws("\t", F.lit("BAG"), F.format_string("%04d", "minute"), F.translate("ids", "[]", "")).alias("value")),
    ]
    return lines[0].unionByName(lines[1]).unionByName(lines[2]).orderBy("part", "place", "value").select("value")


def load_state(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the lines (value) of a state file: the history (at, minute, id), the bags (minute, cycle, ids) and the head (version, shown), one row or none. Lines that aren't of their kind are passed over; a bag of which an id is no number is left out, so that its minute starts anew."""
    cells = lines.select(F.split("value", "\t", -1).alias("c")).withColumn("kind", F.try_element_at("c", F.lit(1)))
    cell = lambda i, t: F.try_element_at("c", F.lit(i)).try_cast(t)
    history = cells.filter("kind = 'H'").select(F.timestamp_seconds(cell(2, "bigint")).alias("at"), cell(3, "int").alias("minute"), cell(4, "bigint").alias("id"))
    history = history.filter("at is not null and id is not null and minute between 0 and 1439")
    ids = F.transform(F.split(F.try_element_at("c", F.lit(3)), ","), lambda x: x.try_cast("bigint"))
    bags = cells.filter("kind = 'BAG'").select(cell(2, "int").alias("minute"), F.lit(0).alias("cycle"), ids.alias("list")).filter("minute between 0 and 1439")
    bags = bags.filter(F.coalesce(F.forall("list", lambda x: x.isNotNull()), F.lit(False))).select("minute", "cycle", F.to_json("list").alias("ids"))
    head = cells.filter("kind in ('VERSION', 'DISPLAY_COUNT')").agg(F.max(F.when(F.col("kind") == "VERSION", cell(2, "int"))).alias("version"), F.max(F.when(F.col("kind") == "DISPLAY_COUNT", cell(2, "bigint"))).alias("shown"))
    return history, bags, head.filter("version is not null or shown is not null")
