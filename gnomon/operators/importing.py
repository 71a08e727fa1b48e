"""Import of raw records: what each becomes, and the counters of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gnomon.functions.scalars import parse_time
from gnomon.functions.texts import display_text, normalized

# What a record becomes.
CANONICAL, COPY, VARIANT, MALFORMED, BAD_TIME = "CANONICAL", "EXACT", "TRIVIAL_VARIANT", "MALFORMED", "INVALID_TIME"
# Fixed values end.


def outcomes(raw: DataFrame, order: list[str]) -> DataFrame:
    """Raw records (time_24h, quote, error and the columns of ``order``) with minute, text, its hash and ``outcome``: of the records of a minute with the same letters the first in order is canonical, those with its text or that of an earlier one are copies, others variants. Records with an error or without text are malformed, those without a time of day invalid.

    Hot texts are ranked by running minima over their hashes only, not gathered.
    """
    rows = raw.withColumns({"minute": parse_time(F.col("time_24h")), "text": display_text(F.col("quote"))})
    rows = rows.withColumns({"hash": F.sha2("text", 256), "key": F.sha2(normalized(F.col("text")), 256)})
    bad = F.when(F.col("error").isNotNull() | (F.coalesce("text", F.lit("")) == ""), MALFORMED).when(F.col("minute").isNull(), BAD_TIME)
    place = F.struct(*order)
    firsts = rows.withColumn("bad", bad).filter("bad is null").groupBy("minute", "key", "hash").agg(F.min(place).alias("first"))
    firsts = firsts.withColumn("head", F.min("first").over(Window.partitionBy("minute", "key")))
    joined = rows.withColumn("bad", bad).join(firsts, ["minute", "key", "hash"], "left")
    outcome = F.coalesce("bad", F.when(place == F.col("head"), CANONICAL).when(place > F.col("first"), COPY).otherwise(VARIANT))
    return joined.withColumn("outcome", outcome).drop("bad", "first", "head", "key")


def counters(imported: DataFrame) -> DataFrame:
    """The numbers of a run: records, and those of each outcome."""
    each = {"canonical": CANONICAL, "exact": COPY, "trivial": VARIANT, "malformed": MALFORMED, "invalid": BAD_TIME}
    return imported.agg(F.count("*").alias("raw"), *(F.count_if(F.col("outcome") == v).alias(k) for k, v in each.items()))
