import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gnomon.functions import scalars as S
from gnomon.functions import texts as X
from gnomon.operators import coverage as C
from gnomon.operators import ordering as O
from gnomon.operators import references as R
from gnomon.operators import selection as G


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


@pytest.mark.parametrize("text, minute", [("00:00", 0), (" 7:05 ", 425), ("23:59", 1439), ("24:00", None), ("12:60", None), ("noon", None), ("", None), (None, None)])
def test_parse_time(spark, text, minute):
    assert spark.createDataFrame([(text,)], "t string").select(S.parse_time(F.col("t")).alias("m")).first().m == minute


def test_locate():
    assert X.place("It was ten. Ten!", "ten") == ("VERIFIED_EXACT", 7, 10)
    assert X.place("ten and ten", "ten") == ("AMBIGUOUS", None, None)
    assert X.place("It was half past six", "half-past six") == ("VERIFIED_NORMALIZED", 7, 20)
    assert X.place("nothing", "ten") == ("TIME_TEXT_NOT_FOUND", None, None)
    assert X.place(None, "ten")[0] == X.place("ten", None)[0] == X.place("", "")[0] == "TIME_TEXT_NOT_FOUND"
    assert X.find_all("aaaa", "aa") == [0, 1, 2]


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 3 % 1009,) for i in range(1009)], "k long").repartition(7)
    found = sorted((r.k, r.i) for r in X.numbered(rows, "k", "i").collect())
    assert found == [(k, k) for k in range(1009)]


def test_coverage_of_nothing(spark):
    empty = spark.createDataFrame([], "quote_id long, minute_of_day int, author string, title string")
    covered = C.coverage(empty)
    assert covered.count() == 1440
    row = C.thresholds(covered).first()
    assert (row.empty, row.missing, row.usable) == (1440, 7 * 1440, 0)


def test_fingerprint_ignores_order(spark):
    rows = [(i, f"t{i}") for i in range(50)]
    prints = set()
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        prints.add(C.fingerprint(spark.createDataFrame(rows, "a long, b string"), ["a", "b"]).first().fingerprint)
    assert len(prints) == 1
    assert C.fingerprint(spark.createDataFrame(rows[1:], "a long, b string"), ["a", "b"]).first().fingerprint not in prints


def greedy(held, offered, wanted, author_first=True):
    out = []
    for minute in sorted({m for m, *_ in offered}):
        authors, titles = {a.lower() for m, a, t in held if m == minute}, {t.lower() for m, a, t in held if m == minute}
        n = sum(m == minute for m, *_ in held)
        left = [o for o in offered if o[0] == minute]
        while left and n < wanted:
            def worth(o):
                new = (o[2].lower() not in authors, o[3].lower() not in titles)
                return (*(new if author_first else new[::-1]), o[4], -o[1])

            best = max(left, key=worth)
            left.remove(best)
            authors.add(best[2].lower())
            titles.add(best[3].lower())
            out.append((minute, best[1]))
            n += 1
    return out


@pytest.mark.parametrize("author_first", [True, False])
def test_fill_is_greedy(spark, author_first):
    rng = random.Random(3)
    held = [(rng.randrange(6), rng.choice("ABC"), rng.choice("xyz")) for _ in range(14)]
    offered = [(rng.randrange(8), i, rng.choice("ABCDa"), rng.choice("vwxyz"), float(rng.randrange(4))) for i in range(200)]
    found = O.fill(spark.createDataFrame(held, "minute int, author string, title string"), spark.createDataFrame(offered, "minute int, id long, author string, title string, score double"), 5, author_first)
    assert sorted((r.minute, r.id) for r in found.collect()) == sorted(greedy(held, offered, 5, author_first))


@pytest.mark.parametrize("author_first", [True, False])
def test_fill_of_a_hot_minute(spark, author_first):
    """A minute with thousands of candidates keeps a bounded number of them, and the choice is the same."""
    rng = random.Random(8)
    for names in (3, 40, 900):
        held = [(1, f"A{rng.randrange(names)}", f"T{rng.randrange(names)}") for _ in range(2)] + [(2, "x", "y")] * 9
        offered = [(rng.choice([1, 1, 1, 2, 3]), i, f"a{rng.randrange(names)}", f"t{rng.randrange(names)}", float(rng.randrange(50))) for i in range(3000)]
        frames = spark.createDataFrame(held, "minute int, author string, title string"), spark.createDataFrame(offered, "minute int, id long, author string, title string, score double")
        found = O.fill(*frames, 7, author_first)
        assert sorted((r.minute, r.id) for r in found.collect()) == sorted(greedy(held, offered, 7, author_first))
    flat = frames[1].selectExpr("minute", "id", "author as a", "title as t", "score", "true as new_a", "true as new_t")
    assert max(r["count"] for r in O.choosable(flat, 7).groupBy("minute").count().collect()) <= 2 * 6 * 7 + 1 + 14 + 14 + 7


def test_canonical_rows(spark):
    rows = spark.createDataFrame([("k", 1, "AMBIGUOUS", True), ("k", 2, "VERIFIED_EXACT", None), ("k", 3, "VERIFIED_EXACT", False), ("l", 4, None, None)], "key string, id long, status string, sfw boolean")
    found = {r.key: r for r in O.canonical_rows(rows, ["key"], S.status_rank(F.col("status")), F.col("id"), "sfw").collect()}
    assert (found["k"].id, found["k"].sfw, found["k"].copies) == (2, False, 3)
    assert (found["l"].id, found["l"].sfw, found["l"].copies) == (4, None, 1)


def test_duplicate_status(spark):
    long_ = "the old clock in the hall struck the hour of ten while nobody was there to hear"
    known = spark.createDataFrame([(1, 600, "Ten o'clock, said the clerk of the court"), (2, 600, long_), (3, 700, long_)], "id long, minute int, text string")
    new = spark.createDataFrame(
        [(10, 600, "Ten o'clock, said the clerk of the court"), (11, 600, "TEN O’CLOCK said the clerk -- of the court"), (12, 600, "And so it was: " + long_), (13, 800, long_), (14, None, long_), (15, 600, None), (16, 600, ""), (17, 600, "short one")],
        "id long, minute int, text string",
    )
    found = {r.id: (r.status, r.known_id) for r in O.duplicate_status(known, new).collect()}
    assert found == {10: ("EXACT", 1), 11: ("NORMALIZED", 1), 12: ("CONTEXT", 2), 13: ("NEW", None), 14: ("EXACT", 2), 15: ("NEW", None), 16: ("NEW", None), 17: ("NEW", None)}


def share_run(a, b, share=0.8):
    n = math.ceil(share * min(len(a), len(b)) - 1e-9)
    runs = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
    return n > 0 and any(tuple(b[i : i + n]) in runs for i in range(len(b) - n + 1))


def test_share_run(spark):
    pairs = [("a b c d e", "x a b c d y z"), ("a b c d e", "a b c x d e y"), ("", "a"), ("", ""), ("a", "a"), ("ab c d e f", "b c d e f")]
    rows = spark.createDataFrame([(a.split(), b.split()) for a, b in pairs], "a array<string>, b array<string>")
    assert [r.s for r in rows.select(O.shares_run(F.col("a"), F.col("b")).alias("s")).collect()] == [share_run(a.split(), b.split()) for a, b in pairs] == [True, False, False, False, True, True]


def test_duplicate_status_against_brute_force(spark):
    """Texts of 5 to 60 words, cut, padded and changed, of one of three minutes or of none."""
    rng = random.Random(12)
    base = [[f"w{rng.randrange(90)}" for _ in range(rng.randrange(5, 60))] for _ in range(25)]

    def some():
        w = list(rng.choice(base))
        lead, cut = rng.randrange(4), rng.randrange(4)
        w = [f"x{rng.randrange(9)}"] * lead + w[cut:]
        if rng.random() < 0.4 and w:
            w[rng.randrange(len(w))] = "changed"
        return " ".join(w)

    known, new = [[(i + k, rng.choice([1, 2, 3, None]), some()) for i in range(60)] for k in (0, 1000)]
    want = {}
    for i, m, t in new:
        near = [(j, u) for j, n, u in known if m is None or m == n]
        grams = lambda w: {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        same, run = [j for j, u in near if u == t], [j for j, u in near if grams(u.split()) & grams(t.split()) and share_run(t.split(), u.split())]
        want[i] = ("EXACT", min(same)) if same else ("CONTEXT", min(run)) if run else ("NEW", None)
    frames = [spark.createDataFrame(x, "id long, minute int, text string") for x in (known, new)]
    assert {r.id: (r.status, r.known_id) for r in O.duplicate_status(*frames).collect()} == want
    assert len({w for w, _ in want.values()}) > 1


def test_cksum():
    # what POSIX cksum prints
    assert G.cksum(b"") == 4294967295
    assert G.cksum(b"123456789") == 930766865


def test_choice_under_cooldown(spark):
    rows = spark.createDataFrame([(5, 1, "T", "A"), (5, 2, "U", "B"), (5, 3, "V", ""), (6, 4, "T", "C")], "minute int, id long, title string, author string")
    history = spark.createDataFrame([(2, "U", "B", at("2026-01-02 11:00:00")), (9, "V", "", at("2026-01-02 10:00:00")), (8, "T", "Z", at("2025-12-01 00:00:00"))], "id long, title string, author string, at timestamp")
    now = F.lit("2026-01-02 12:00:00").cast("timestamp")
    levels = {r.id: r.level for r in G.with_level(rows, history, now).collect()}
    assert levels == {1: 0, 2: 7, 3: 2, 4: 0}
    assert {r.minute: r.id for r in G.choose(rows, history, now).collect()} == {5: 1, 6: 4}


def test_orphans(spark):
    quotes = spark.createDataFrame([(1, at("2026-01-01 00:00:00"), "x"), (2, at("2026-03-01 00:00:00"), "y")], "quote_id long, created_at timestamp, row_id string")
    rows = spark.createDataFrame(
        [(1, "1", at("2026-02-01 00:00:00")), (2, " 002 ", at("2026-02-01 00:00:00")), (3, "+7", at("2026-02-01 00:00:00")), (4, "TBD", at("2026-02-01 00:00:00")), (5, None, at("2026-02-01 00:00:00")), (6, "2", None), (3, "+7", at("2026-02-01 00:00:00")), (7, "1.0", at("2025-12-31 00:00:00")), (8, "9" * 30, None)],
        "adjudication_id long, quote_id string, created_at timestamp",
    )
    parent = R.Parent(quotes, "quote_id", "created_at")
    found = R.orphans(rows, "t", "adjudication_id", "quote_id", parent, R.whole_number(F.col("quote_id")))
    assert sorted((r.row_id, r.ref_kind, r.ref_month) for r in found.collect()) == [(2, "late", "2026-02"), (3, "missing", "2026-02"), (7, "late", "2025-12")]
    assert R.orphans(rows.limit(0), "t", "adjudication_id", "quote_id", parent, R.whole_number(F.col("quote_id"))).count() == 0
    nobody = R.Parent(quotes.limit(0), "quote_id", "created_at")
    assert {r.ref_kind for r in R.orphans(rows, "t", "adjudication_id", "quote_id", nobody, R.whole_number(F.col("quote_id"))).collect()} == {"missing"}


def test_whole_numbers_of_many_digits(spark):
    """The range of bigint, and any number of leading zeros."""
    wanted = {"9223372036854775807": 2**63 - 1, "-9223372036854775808": -(2**63), "9223372036854775808": None, "0" * 30 + "42": 42, "-" + "0" * 20 + "7.00": -7, "0" * 25: 0, "0": 0, "+0012": 12, "1,000,000,000,000,000,000": 10**18, "": None, "-": None, "12a": None}
    rows = spark.createDataFrame([(t,) for t in wanted], "t string")
    assert {r.t: r.n for r in rows.select("t", R.whole_number(F.col("t")).alias("n")).collect()} == wanted


def test_references_of_many_digits_are_missing(spark):
    """Every spelled whole number is a reference in the query, those beyond bigint too."""
    day = at("2026-01-01 00:00:00")
    texts = ["9" * 19, "9" * 30, "0" * 30 + "1", "-0001", "1" * 19, "-0", "no", "9" * 30 + "x", None]
    rows = spark.createDataFrame([(i, t, day) for i, t in enumerate(texts)], "adjudication_id long, quote_id string, created_at timestamp")
    quotes = spark.createDataFrame([(1, day), (0, day)], "quote_id long, created_at timestamp")
    provenance = spark.createDataFrame([], "provenance_id long, quote_id long, source_id long, created_at timestamp")
    found = R.clock_orphans(provenance, rows, quotes, spark.createDataFrame([], "source_id long, imported_at timestamp"))
    assert sorted((r.row_id, r.ref_kind) for r in found.collect()) == [(0, "missing"), (1, "missing"), (3, "missing"), (4, "missing")]


def test_orphans_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.col("id").alias("provenance_id"), F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).alias("quote_id"), F.lit("2026-01-01").cast("timestamp").alias("created_at"))
    quotes = spark.range(3000).filter("id % 3 <> 0").select(F.col("id").alias("quote_id"), F.lit("2025-01-01").cast("timestamp").alias("created_at"))
    found = R.orphans(rows, "t", "provenance_id", "quote_id", R.Parent(quotes.filter("quote_id <> 77"), "quote_id", "created_at"))
    assert found.count() == 1001 and R.orphan_report(found).first().orphans == 1001


def test_state_is_read_back(spark):
    history = spark.createDataFrame([(at("2026-01-02 11:00:00"), 660, 5), (at("2026-01-02 11:01:00"), 661, 7), (at("2025-12-01 00:00:00"), 1, 8)], "at timestamp, minute int, id long")
    bags = spark.createDataFrame([(3, 0, "[1,2]"), (4, 0, "[9]")], "minute int, cycle int, ids string")
    lines = G.state_lines(history, bags, 12, F.lit("2026-01-02 12:00:00").cast("timestamp"))
    broken = spark.createDataFrame([("H\tx\t1\t2",), ("H\t5",), ("BAG\t0007\t1,x",), ("BAG\t9999\t1",), ("",), (None,), ("LAST\t1",)], "value string")
    found, held, head = G.load_state(lines.unionByName(broken))
    assert sorted((r.minute, r.id) for r in found.collect()) == [(660, 5), (661, 7)]
    assert {r.at for r in found.collect()} == {r.at for r in history.filter("minute > 1").collect()}
    assert sorted(map(tuple, held.collect())) == [(3, 0, "[1,2]"), (4, 0, "[9]")] and tuple(head.first()) == (1, 12)
    empty = G.load_state(lines.limit(0))
    assert [df.count() for df in empty] == [0, 0, 0]
