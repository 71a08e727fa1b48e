"""Orphan references, whole and as a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gnomon.operators.references import clock_orphans, orphan_report
from gnomon.session import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return clock_orphans(*(table(spark, sf, t) for t in ("quote_provenance", "english_v2_manual_adjudications", "quotes", "sources")))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(p4_found(spark, sf))


QUERIES = {f.__name__: f for f in (p4_found, p4_report)}


def _orphans(rows: str, row_id: str, field: str, key: str, parent: str, parent_key: str, since: str) -> str:
    return f"""SELECT DISTINCT '{rows}' AS table_name, r.{row_id} AS row_id, '{field}' AS field_name, CASE WHEN p.k IS NULL THEN 'missing' ELSE 'late' END AS ref_kind, strftime(r.created_at AT TIME ZONE 'UTC', '%Y-%m') AS ref_month
FROM {rows} r LEFT JOIN (SELECT {parent_key} AS k, min({since}) AS born FROM {parent} GROUP BY 1) p ON p.k = {key} WHERE {key} IS NOT NULL AND (p.k IS NULL OR p.born > r.created_at)"""


_FOUND = "\nUNION ALL ".join(
    (
        _orphans("quote_provenance", "provenance_id", "quote_id", "r.quote_id", "quotes", "quote_id", "created_at"),
        _orphans("quote_provenance", "provenance_id", "source_id", "r.source_id", "sources", "source_id", "imported_at"),
        _orphans("english_v2_manual_adjudications", "adjudication_id", "quote_id", "TRY_CAST(nullif(regexp_extract(trim(r.quote_id), '^([+-]?\\d{1,18})(\\.0*)?$', 1), '') AS BIGINT)", "quotes", "quote_id", "created_at"),
    )
)
ORACLES = {"p4_found": _FOUND, "p4_report": f"SELECT table_name, field_name, ref_kind, ref_month, count(*) AS orphans FROM ({_FOUND}) GROUP BY ALL"}
