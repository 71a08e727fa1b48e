"""Coverage of the day's minutes by quotes: a dense vector of 1,440 counts and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MINUTES = 1440


def spine(spark: SparkSession) -> DataFrame:
    """Every minute of the day."""
    return spark.range(MINUTES).select(F.col("id").cast("int").alias("minute"))


def nonblank(text: str) -> Column:
    return F.nullif(F.trim(F.col(text)), F.lit(""))


def coverage(rows: DataFrame, minute: str = "minute_of_day", author: str = "author", title: str = "title", usable: Column | None = None) -> DataFrame:
    """For each minute of the day the rows, the usable ones, and their distinct authors and titles (blank ones don't count). Rows without a minute count for none."""
    usable = F.lit(True) if usable is None else usable
    counts = rows.filter(F.col(minute).isNotNull()).groupBy(F.col(minute).cast("int").alias("minute")).agg(
        F.count("*").alias("total"), F.count_if(usable).alias("usable"), F.count_distinct(nonblank(author)).alias("authors"), F.count_distinct(nonblank(title)).alias("titles")
    )
    # the day has 1,440 minutes: both sides are small whatever the rows
    return spine(rows.sparkSession).join(counts, "minute", "left").fillna(0)


def thresholds(covered: DataFrame, wanted: int = 7) -> DataFrame:
    """Minutes below and above given counts, and what is missing to ``wanted`` in each minute."""
    n = F.col("usable")
    return covered.agg(
        F.count_if(n == 0).alias("empty"), F.count_if(n == 1).alias("one"), F.count_if(n == 2).alias("two"), F.count_if(n < 3).alias("below_3"), F.count_if(n < 5).alias("below_5"), F.count_if(n < 7).alias("below_7"),
        F.count_if(n >= 7).alias("from_7"), F.count_if(n >= 14).alias("from_14"), F.sum(F.greatest(F.lit(0), wanted - n)).alias("missing"), F.sum(n).alias("usable"),
    )


def spread(covered: DataFrame) -> DataFrame:
    """Mean, median and percentiles (linear between ranks) of the counts of all minutes."""
    p = F.percentile("usable", F.array(*map(F.lit, (0.1, 0.25, 0.75, 0.9))))
    return covered.agg(F.avg("usable").alias("mean"), F.median("usable").alias("median"), *(p[i].alias(f"p{q}") for i, q in enumerate((10, 25, 75, 90))), F.min("usable").alias("least"), F.max("usable").alias("most"))


def target_rank(covered: DataFrame) -> DataFrame:
    """The minutes in the order in which they need quotes. The window holds 1,440 rows."""
    order = Window.orderBy("usable", "total", "authors", "titles", "minute")
    return covered.withColumn("rank", F.row_number().over(order))


def sparse_targets(rows: DataFrame, most: int = 2) -> DataFrame:
    """Minutes with at most ``most`` rows, what they lack to 3, 5 and 7, and their sorted ids and authors. Lists hold at most ``most`` rows."""
    counts = rows.filter("minute_of_day is not null").groupBy(F.col("minute_of_day").cast("int").alias("minute")).agg(F.count("*").alias("n"))
    few = spine(rows.sparkSession).join(counts, "minute", "left").fillna(0).filter(F.col("n") <= most)
    held = rows.join(F.broadcast(few.select("minute")), rows.minute_of_day == F.col("minute")).groupBy("minute").agg(F.array_sort(F.collect_list("quote_id")).alias("ids"), F.array_sort(F.collect_set(F.lower("author"))).alias("names"))
    lack = [F.greatest(F.lit(0), k - F.col("n")).alias(f"to_{k}") for k in (3, 5, 7)]
    joined = few.join(held, "minute", "left")
    text = [F.coalesce(F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ","), F.lit("")).alias(c) for c in ("ids", "names")]
    return joined.select("minute", "n", *lack, *text)


def paired(before: DataFrame, after: DataFrame, wanted: int = 7) -> DataFrame:
    """For each minute of the forenoon and its twin twelve hours later, what both lack before and after."""

    def lack(df: DataFrame, name: str) -> DataFrame:
        short = df.select(F.pmod("minute", F.lit(720)).alias("pair"), F.greatest(F.lit(0), wanted - F.col("usable")).alias("lack"))
        return short.groupBy("pair").agg(F.sum("lack").alias(name))

    return lack(before, "lack_before").join(lack(after, "lack_after"), "pair").withColumn("gain", F.col("lack_before") - F.col("lack_after"))


def top_groups(rows: DataFrame, column: str, most: int = 20) -> DataFrame:
    """The most frequent values of a column, blank ones left out; ties by name without case, then as written."""
    value = nonblank(column)
    return rows.filter(value.isNotNull()).groupBy(value.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.lower("name"), "name").limit(most)


def fill_gain(covered: DataFrame, offered: DataFrame, wanted: int = 7) -> DataFrame:
    """What each minute would take of the ``offered`` rows (minute, available) to reach ``wanted``."""
    both = covered.select("minute", "usable").join(offered, "minute", "left").fillna(0, ["available"])
    taken = F.least(F.greatest(F.lit(0), wanted - F.col("usable")), F.col("available"))
    return both.select("minute", "usable", "available", taken.alias("taken"), (F.col("usable") + taken).alias("reached"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of a table that no order of its rows changes: the words of the rows' digests are summed and folded, all commutative and combined where they are read, and the sums are digested. Rows that repeat count each time."""
    row = F.sha2(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    words = rows.select(*(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("bigint").alias(f"w{i}") for i in range(4)))
    sums = [F.sum(F.col(f"w{i}").cast("decimal(20,0)")).cast("string") for i in range(4)] + [F.bit_xor(f"w{i}").cast("string") for i in range(4)]
    return words.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *(F.coalesce(x, F.lit("")) for x in sums)), 256).alias("fingerprint"), F.count("*").alias("rows"))


def corpus_report(quotes: DataFrame) -> DataFrame:
    """The numbers of a corpus in one row: sizes, distinct minutes, names and sources (blank names don't count), verified, labelled and marked quotes, lengths."""
    n = F.length("quote")
    return quotes.agg(
        F.count("*").alias("quotes"), F.count_distinct("minute_of_day").alias("minutes"), F.count_distinct(nonblank("author")).alias("authors"), F.count_distinct(nonblank("title")).alias("titles"), F.count_if(F.col("quality_status").startswith("VERIFIED")).alias("verified"),
        F.count_if("sfw").alias("sfw"), F.count_if(F.col("sfw").isNull()).alias("unlabelled"), F.count_if(F.col("highlight_start").isNull()).alias("unmarked"), F.min(n).cast("bigint").alias("shortest"), F.max(n).cast("bigint").alias("longest"), F.round(F.avg(n), 6).alias("mean_length"), F.count_distinct("source_name").alias("sources"),
    )


def metric_rows(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, before, after, change) of the measures of ``thresholds`` for two states of coverage (minute, usable): one row each."""
    sides = [thresholds(df).select(*(F.col(m).cast("bigint").alias(m) for m in metrics)).unpivot([], metrics, "metric", name) for df, name in ((before, "before"), (after, "after"))]
    return sides[0].join(sides[1], "metric").withColumn("change", F.col("after") - F.col("before"))
