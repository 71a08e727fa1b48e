"""Queries of the training-data problems beside their SQL, and their columns."""

import pytest
from oracle import compare

from gnomon.llm import queries

COLUMNS = {
    "p1_found": ["field_name", "name_a", "name_b"], "p2_found": ["id_a", "id_b"], "p3_found": ["quote_id", "field_name"], "p5_found": ["table_name", "row_id"], "p6_found": ["first_quote_id", "quote_id"],
    "p7_found": ["first_quote_id", "quote_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "case_id"], "p10_found": ["doc_id", "start_char", "end_char"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, small, name):
    assert compare(spark, name, small) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len({tuple(map(str, r)) for r in rows}) == len(rows)
