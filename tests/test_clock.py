import pytest

from gnomon.functions.clock import read_times, times
from gnomon.functions.scalars import minute_variants

ONE = [
    ("The mail left at 6:52 p.m. in snow.", "6:52 p.m.", "EXACT_PM", 1132, None),
    ("Lessons began at twenty to nine in the morning.", "twenty to nine", "EXACT_CONTEXTUAL", 520, None),
    ("a quarter past five", "a quarter past five", "AMPM_AMBIGUOUS", None, (315, 1035)),
    ("At half-past eight that evening", "half-past eight", "EXACT_CONTEXTUAL", 1230, None),
    ("about four o'clock", "about four o'clock", "APPROXIMATE", None, None),
    ("between 5:05 and 6:35", "between 5:05 and 6:35", "RANGE", None, None),
    ("Chapter 9:32 says", "9:32", "INVALID", None, None),
    ("The station clock showed 20:15, and", "20:15", "EXACT_24H", 1215, None),
    ("at ten forty at night", "ten forty", "EXACT_CONTEXTUAL", 1360, None),
    ("0635 hours", "0635 hours", "EXACT_24H", 395, None),
    ("The watch changed at midnight.", "midnight", "EXACT_24H", 0, None),
    ("It was 12:00 a.m. by then", "12:00 a.m.", "EXACT_AM", 0, None),
    ("by seven o’clock", "by seven o’clock", "APPROXIMATE", None, None),
    ("at 27:05", "27:05", "INVALID", None, None),
    ("four minutes past noon", "four minutes past noon", "EXACT_24H", 724, None),
    ("She bet six to one", "six to one", "INVALID", None, None),
]


@pytest.mark.parametrize("text, span, confidence, minute, options", ONE)
def test_one_reading(text, span, confidence, minute, options):
    (r,) = read_times(text)
    assert (text[r.start : r.end], r.confidence, r.minute, r.options) == (span, confidence, minute, options)


@pytest.mark.parametrize("text", [None, "", "   ", "A midnight blue ribbon", "the 2.17 version", "She owns nine geese"])
def test_no_reading(text):
    assert read_times(text) == []


def test_start_and_end_are_a_range():
    assert [r.confidence for r in read_times("The play began at 7:00 and ended at 9:00.")] == ["RANGE", "RANGE"]


def test_readings_never_overlap():
    text = "At half past eight, from 2:40 to 3:15, about six o'clock or at 7:35 p.m., ten minutes to four in the afternoon"
    found = read_times(text)
    assert len(found) >= 4
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))


def test_column_and_phrases_read_back(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 1440, 7).select(F.col("id").cast("int").alias("m"), F.explode(minute_variants(F.col("id").cast("int"))).alias("p"))
    rows = rows.select("m", "p", times(F.concat(F.lit("It was "), F.col("p"), F.lit(" when he came."))).alias("r"))
    bad = [x for x in rows.collect() if not any(r.minute == x.m or (r.options and x.m in r.options) for r in x.r) and not (":" in x.p and not x.p.endswith("."))]
    assert bad == []


def test_nulls_in_the_column(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None,), ("",), ("no time",), ("at noon",)], "t string").select(F.size(times(F.col("t"))).alias("n"))
    assert [r.n for r in rows.collect()] == [0, 0, 0, 1]
