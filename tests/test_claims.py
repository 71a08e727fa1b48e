import pytest

from gnomon.functions import claims as C


def on(quote, phrase, minute):
    at = quote.index(phrase)
    return C.judge(quote, at, at + len(phrase), minute)


KEPT = [
    ("“We sail at 5:48—a—m,” the pilot wrote.", "5:48", 348),
    ("The ferry docked at two twenty-six P.M., with no one on deck.", "two twenty-six P.M.", 866),
    ("The choir sings at 6 1/2 o'clock on Sundays.", "6 1/2 o'clock", 390),
    ("The dial reads half-past four.", "half-past four", 270),
    ("The clock over the bar showed seven minutes to five, so the cook left.", "seven minutes to five", 1013),
    ("The lamps must be lit by 19:05, whatever the fog.", "19:05", 1145),
    ("At 2:51 p.m., Sgt. Brill saluted.", "2:51 p.m.", 891),
    ("She counted the coins, for it was 8.27 and the till was short.", "8.27", 1227),
    ("The church bell struck midnight, and the snow lay thick.", "midnight", 0),
    ("“Was it 23:10 already?” said the nurse.", "23:10", 1390),
]


@pytest.mark.parametrize("quote, phrase, minute", KEPT)
def test_kept(quote, phrase, minute):
    decision = on(quote, phrase, minute)
    assert decision.action == C.KEEP and minute in decision.minutes, decision
    off = on(quote, phrase, (minute + 7) % 1440)
    assert off.action == C.QUARANTINE and C.disposition(off, (minute + 7) % 1440) == "WRONG_MINUTE_LABEL"


@pytest.mark.parametrize(
    "quote, phrase, minute, kind",
    [
        ("The referee allowed one three-minute break.", "one three", 63, C.DURATION),
        ("They argued for seven minutes.", "seven", 420, C.DURATION),
        ("Eight minutes later the kettle sang.", "Eight", 480, C.RELATIVE),
        ("A six-minute delay annoyed the queue.", "six", 360, C.DURATION),
        ("The concert took two hours.", "two", 120, C.DURATION),
        ("The climb cost two hours and nine minutes.", "two hours and nine minutes", 129, C.DURATION),
        ("Within four minutes, the hall had filled.", "Within four minutes", 4, C.RELATIVE),
        ("Nine minutes earlier, the tide had turned.", "Nine minutes earlier", 9, C.RELATIVE),
        ("Chapter 7:21", "7:21", 441, C.REFERENCE),
        ("Mark 9:14", "9:14", 554, C.REFERENCE),
        ("Section 5:32", "5:32", 332, C.REFERENCE),
        ("The score was 2:11.", "2:11", 131, C.SCORE),
        ("The ratio was 4:30.", "4:30", 270, C.RATIO),
        ("He came half a minute after six, out of breath.", "a minute after six", 361, C.DURATION),
        ("The log covered 4:18–4:26.", "4:18", 258, C.RANGE_OF_TIME),
        ("The guests rose at about eight o'clock.", "eight o'clock", 480, C.ABOUT),
    ],
)
def test_set_aside(quote, phrase, minute, kind):
    decision = on(quote, phrase, minute)
    assert decision.action == C.QUARANTINE and kind in (decision.kind, decision.reason), decision


def test_for_review():
    assert C.judge(None, 0, 1, 5).action == C.judge("ten", None, None, 5).action == C.judge("ten", 0, 9, 5).action == C.judge("", 0, 0, 5).action == C.REVIEW
    assert on("He saw a thing.", "thing", 5).action == C.REVIEW


def test_other_half_of_the_day():
    decision = on("At 5:27 a.m. she woke.", "5:27 a.m.", 1047)
    assert decision.action == C.QUARANTINE and C.disposition(decision, 1047) == "WRONG_CLOCKFACE_SIDE"


def half(paragraph, phrase, options, before=""):
    at = paragraph.index(phrase)
    return C.resolve_half(paragraph, at, at + len(phrase), options, before).minute


def test_halves_of_the_day():
    assert half("Frost lay everywhere. That morning at nine o'clock she dressed.", "nine o'clock", (540, 1260)) == 540
    assert half("Late that evening, when ten o'clock struck, he slept.", "ten o'clock", (600, 1320)) == 1320
    assert half("In the morning, or that evening, at ten o'clock.", "ten o'clock", (600, 1320)) is None
    assert half("They met again at ten o'clock.", "ten o'clock", (600, 1320)) is None
    story = "The nurse locked the ward at 7:20 p.m. and went down."
    assert half("Three hours later, by the hall clock, ten twenty, she came up.", "ten twenty", (620, 1340), story) == 1340
    assert half("One hour later she slept. Three hours later it was ten twenty.", "ten twenty", (620, 1340), story) == 1340
    assert half("An hour later it was ten twenty.", "ten twenty", (620, 1340), story) is None
    assert half("Three hours later it was ten twenty.", "ten twenty", (620, 1340), "Nobody knew the time.") is None


def test_column(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("At 5:27 a.m. she woke.", 3, 12, 327), (None, None, None, None)], "q string, a int, b int, m int")
    found = rows.select(C.judged(F.col("q"), F.col("a"), F.col("b"), F.col("m")).alias("d")).select("d.action", "d.minutes").collect()
    assert [tuple(r) for r in found] == [("KEEP", [327]), ("REVIEW", [])]
