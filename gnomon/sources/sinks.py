"""Sinks: files that appear whole or not at all, and the small indexes of a release."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_with(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Write ``df`` beside ``path`` and put it in its place when it is complete; a write that fails leaves ``path`` as it was."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staged = f"{path}.{uuid.uuid4().hex}"
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
    try:
        df.write.format(kind).options(**options).save(staged)
    except Exception:
        fs.delete(new, True)
        raise
    if fs.exists(place):
        fs.rename(place, old)
    fs.rename(new, place)
    fs.delete(old, True)


def minute_index(pool: DataFrame) -> DataFrame:
    """Lines ``MMMM<TAB>ids`` of a pool (minute, id), in order: at most 1,440 lines."""
    lines = pool.groupBy("minute").agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), ",").alias("ids"))
    return lines.orderBy("minute").select(F.concat(F.format_string("%04d\t", F.col("minute").cast("int")), F.col("ids")).alias("value"))


def tab_lines(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Lines of tab-separated values in order; tabs and line ends in values become blanks."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in columns]
    return df.orderBy(*order).select(F.concat_ws("\t", *cells).alias("value"))


def json_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """One JSON object a line, nulls kept, in order."""
    return df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def checksum_lines(files: DataFrame) -> DataFrame:
    """Lines ``sha256  path`` in order of the path."""
    return files.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))
