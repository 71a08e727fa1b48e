from gnomon.functions import timelines as T

DIARY = "At five past ten the porter swept the steps. At ten twenty the vicar called “Good morning” from the gate. At half past ten it rained. At a quarter to eleven the coach came."


def at(text, phrase):
    start = text.index(phrase)
    return start, start + len(phrase)


def test_greeting_runs_along_a_timeline():
    start, end = at(DIARY, "half past ten")
    assert T.by_greeting(DIARY, start).minute == 630
    assert T.resolve(DIARY, start, end, (630, 1350)).minute == 630
    assert T.by_greeting(DIARY, at(DIARY, "five past ten")[0]) is None  # before the greeting
    assert T.by_greeting(DIARY.replace("Good morning", "Good heavens"), start) is None
    backwards = DIARY.replace("five past ten", "ten to nine").replace("ten twenty", "a quarter past four")
    assert T.by_greeting(backwards, at(backwards, "half past ten")[0]) is None  # more than three hours
    short = "At ten twenty the vicar called “Good morning” from the gate. At half past ten it rained."
    assert T.by_greeting(short, at(short, "half past ten")[0]) is None  # two times are no timeline
    assert T.by_greeting("", 0) is None


def test_assessed_passages(spark):
    from pyspark.sql import functions as F

    open_ = "The coach came in at half past ten with the mail."
    start, end = at(open_, "half past ten")
    rows = [
        (open_, start, end, f"It was a wet evening. That evening all was still. {open_}", None, T.EITHER),
        (open_, start, end, f"The inn closed at 9:30 p.m. in a storm. One hour later all slept. {open_}", None, T.RESOLVED),
        (open_, start, end, None, None, T.TO_REVIEW),
        (open_, start, end, open_, "duplicate", T.REJECTED),
        (open_, 0, 3, open_, None, T.REJECTED),
        (None, None, None, None, None, T.REJECTED),
        ("", 0, 0, "", None, T.REJECTED),
    ]
    df = spark.createDataFrame(rows, "q string, a int, b int, s string, f string, want string")
    found = df.select(T.assessed(*map(F.col, "qabsf")).alias("d"), "want").select("d.*", "want").collect()
    assert [r.decision for r in found] == [r.want for r in found]
    assert found[1].minute == 1350 and all(r.minute is None for r in found if r.decision != T.RESOLVED)
