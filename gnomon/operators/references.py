"""References to records that do not exist, or did not exist yet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnomon.session import materialize


@dataclass(frozen=True)
class Parent:
    """A parent table's key and the column that tells when a record came to exist."""

    rows: DataFrame
    key: str
    since: str


def spelled_number(text: Column) -> Column:
    """The whole number of any length that a text spells, as digits, else null: blanks around it, a sign, leading zeros, a fraction of zeros or a thousands comma don't matter."""
    bare = F.trim(F.regexp_replace(text.cast("string"), "[\\s\\x{a0}\\x{200b}\\x{feff}]+", " "))
    bare = F.when(bare.rlike("^[+-]?\\d{1,3}(,\\d{3})+(\\.0*)?$"), F.replace(bare, F.lit(","))).otherwise(bare)
    spelled = "^(?:[+]|(-))?0*(\\d+)(?:\\.0*)?$"
    digits = F.regexp_extract(bare, spelled, 2)
    return F.when(digits == "0", digits).when(digits != "", F.concat(F.regexp_extract(bare, spelled, 1), digits))


def whole_number(text: Column) -> Column:
    """The whole number that a text spells, else null; null too beyond the range of bigint."""
    return spelled_number(text).try_cast("long")


def key_states(references: DataFrame, parent: Parent) -> DataFrame:
    """The keys of ``references`` (``key``, ``since``: the earliest reference) that are missing, or late for some reference, with the parent's time.

    Keys are made distinct before they meet the parent, so that a key which a third of all rows hold moves as one row for each task.
    """
    keys = references.filter("key is not null").groupBy("key").agg(F.min("since").alias("earliest"))
    parents = parent.rows.select(F.col(parent.key).cast("long").cast(references.schema["key"].dataType).alias("key"), F.col(parent.since).alias("born")).filter("key is not null").groupBy("key").agg(F.min("born").alias("born"))
    missing = keys.join(parents, "key", "left_anti").select("key", F.lit(None).cast("timestamp").alias("born"), F.lit(True).alias("missing"))
    late = keys.join(parents, "key").filter("born > earliest").select("key", F.col("born").cast("timestamp"), F.lit(False).alias("missing"))
    return missing.unionByName(late)


def orphans(rows: DataFrame, table_name: str, row_id: str, field: str, parent: Parent, key: Column | None = None, since: str = "created_at") -> DataFrame:
    """The rows of a table whose ``field`` refers to no record of ``parent`` (``missing``) or to one that came later than the row (``late``).

    A null key, or a text that spells no whole number, refers to nothing. Without a time on either side a reference is never late. A row delivered twice comes out once; empty tables give no rows; an empty parent makes every reference missing.
    """
    key = F.col(field).cast("long") if key is None else key
    refs = rows.select(F.col(row_id).cast("long").alias("row_id"), key.alias("key"), F.col(since).alias("since"))
    states = materialize(key_states(refs, parent))
    held = refs.join(states, "key").filter("missing or born > since")
    return held.select(
        F.lit(table_name).alias("table_name"), "row_id", F.lit(field).alias("field_name"), F.when(F.col("missing"), "missing").otherwise("late").alias("ref_kind"), F.date_format("since", "yyyy-MM").alias("ref_month")
    ).distinct()


def clock_orphans(provenance: DataFrame, adjudications: DataFrame, quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """The orphan references of the imports and the adjudications."""
    to_quotes, to_sources = Parent(quotes, "quote_id", "created_at"), Parent(sources, "source_id", "imported_at")
    found = [
        orphans(provenance, "quote_provenance", "provenance_id", "quote_id", to_quotes),
        orphans(provenance, "quote_provenance", "provenance_id", "source_id", to_sources),
        orphans(adjudications, "english_v2_manual_adjudications", "adjudication_id", "quote_id", to_quotes, spelled_number(F.col("quote_id"))),  # a number beyond bigint is the id of no quote
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, kind and month."""
    return found.groupBy("table_name", "field_name", "ref_kind", "ref_month").agg(F.count("*").alias("orphans"))
