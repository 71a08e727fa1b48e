from pyspark.sql import functions as F

from gnomon.functions import gates as G

GOOD = "The porter carried twelve lamps down the stairs before the hall clock struck seven again."


def test_citations(spark):
    cases = [
        ("As it stands in John 3:16, he said.", "3:16", True),
        ("He rose. Halvorsen, 4:12 is quoted here.", "4:12", True),
        ("Ten o'clock, he said, is early.", "Ten o'clock", True),
        ("He rose. Ten o'clock) is early.", "Ten o'clock", True),
        ("At ten o'clock he rose, and left.", "ten o'clock", False),
        ("", "", False),
    ]
    rows = spark.createDataFrame([(q, q.find(p), q.find(p) + len(p), want) for q, p, want in cases] + [(None, None, None, None)], "q string, a int, b int, want boolean")
    found = rows.select(G.citation_shaped(F.col("q"), F.col("a"), F.col("b")).alias("c"), "want").collect()
    assert [r.c for r in found] == [r.want for r in found]


def test_context_faults(spark):
    cases = [
        (GOOD, 1, None),
        ("It struck.", 1, "too short"),
        (GOOD * 9, 1, "too long"),
        (GOOD.replace("twelve", "“twelve"), 1, "broken dialogue"),
        (GOOD[:1].lower() + GOOD[1:], 1, "begins inside a sentence"),
        (GOOD[:-1], 1, "no end of sentence"),
        (GOOD, 3, "several times"),
        (GOOD.replace("twelve lamps", "the testimony to the court"), 1, "legal text"),
        (GOOD.replace("porter carried", "porter | carried | and"), 1, "table"),
        (None, 0, "few words"),
    ]
    rows = spark.createDataFrame(cases, "q string, n int, want string")
    found = rows.select(G.context_fault(F.col("q"), F.col("n")).alias("f"), "want").collect()
    assert [r.f for r in found] == [r.want for r in found]


def test_resolutions_and_repairs(spark):
    rows = spark.createDataFrame([(600, [600, 1320], "10:00", "x"), (601, [600, 1320], "10:01", "x"), (600, [600, 1320], "22:00", "x"), (600, [600, 1320], "10:00", " "), (None, None, None, None)], "m int, o array<int>, s string, e string")
    assert [r.f for r in rows.select(G.resolution_fault(F.col("m"), F.col("o"), F.col("s"), F.col("e")).alias("f")).collect()] == [None, "no option", "other than shown", "no evidence", "no option"]
    rows = spark.createDataFrame([("ten to six", "It was ", "CLOCK_GRAMMAR_RELATIVE"), ("ten to six", "It was nearly ", "CLOCK_GRAMMAR_RELATIVE"), ("0:15", "at 1", "CLOCK_GRAMMAR_NUMERIC"), ("six", "it ", "UNKNOWN_CONTEXT"), (None, None, None)], "p string, b string, c string")
    assert [r.r for r in rows.select(G.repairable(F.col("p"), F.col("b"), F.col("c")).alias("r")).collect()] == [True, False, False, False, False]
