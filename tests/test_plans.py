"""Plans that matter at scale: pruned scans, pushed filters, no cartesian product, Python only where it is meant."""

import re

import pytest

from gnomon.plans import registry

RELATIONAL = ["p4_found", "d01_d04_e17_coverage", "d10_top_authors", "d17_having", "e01_e02_pool", "e04_left_null", "e05_anti_join", "e07_composite_join", "e09_three_way", "e12_scalar_subquery", "e14_e15_any_of", "f11_canonical", "f36_nearest_length"]
WIDE = {"f36_nearest_length": {"quote"}}


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", RELATIONAL)
def test_scans_read_what_they_need(spark, small, name):
    text = plan(registry.QUERIES[name](spark, small))
    read = {c for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in re.findall(r"(\w+):", schema)}
    assert read and not (read & {"quote", "raw_quote", "text"}) - WIDE.get(name, set())
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "InPandas" not in text and "InArrow" not in text


def test_filters_reach_the_scan(spark, small):
    text = plan(registry.QUERIES["e04_left_null"](spark, small))
    assert "EqualTo(duplicate_kind,CANONICAL)" in text


def test_time_reader_sees_only_texts_with_words_of_time(spark, small):
    from pyspark.sql import functions as F

    from gnomon.functions.clock import times
    from gnomon.session import table

    text = plan(table(spark, small, "documents").select(F.size(times(F.col("text")))))
    assert text.index("RLIKE") if "RLIKE" in text else re.search("(?i)rlike", text)


def test_released_tables_are_gone(spark):
    from pathlib import Path

    from gnomon.session import materialize, release

    kept, dropped = materialize(spark.range(3)), materialize(spark.range(4))
    place = lambda df: Path(df.inputFiles()[0].removeprefix("file://")).parent
    at, still = place(dropped), place(kept)
    release(dropped, spark.range(1))  # a table that wasn't written here is left alone
    release(dropped)
    assert not at.exists() and still.exists() and kept.count() == 3


def test_hot_minutes_are_cut_before_the_shuffle(spark):
    """Candidates of a minute are limited in each task; duplicate status stays in the JVM without a filter on pairs of other minutes."""
    from gnomon.operators import ordering as O

    rows = spark.range(50).selectExpr("cast(id % 3 as int) as minute", "id", "'a' as a", "'t' as t", "1.0D as score", "true as new_a", "true as new_t")
    plan = O.choosable(rows, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 6 and "Python" not in plan
    texts = spark.range(50).selectExpr("id", "cast(id % 3 as int) as minute", "'the old clock in the hall struck ten and nobody was there' as text")
    plan = O.duplicate_status(texts, texts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan and "CartesianProduct" not in plan
