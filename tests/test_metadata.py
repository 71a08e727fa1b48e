from datetime import datetime, timezone

from pyspark.sql import functions as F

from gnomon.functions import passages as P
from gnomon.operators import selection as G
from gnomon.sources import metadata as M


def test_catalog_columns(spark):
    rows = spark.createDataFrame(
        [("Public domain in  the USA.", "en", "A Novel", "Fiction", "", "PR"), ("Copyrighted", "en; fr", "A Dictionary", "Dictionaries", None, None), (None, None, None, None, None, None)],
        "rights string, lang string, title string, subjects string, shelves string, classes string",
    )
    found = rows.select(M.is_public(F.col("rights")), M.is_english(F.col("lang")), M.literary_score(*(F.col(c) for c in ("title", "subjects", "shelves", "classes"))), M.is_literary_title(F.col("title"))).collect()
    assert [tuple(r) for r in found] == [(True, True, 100.0, True), (False, False, -500.0, False), (False, False, 0.0, None)]


def test_literary_scores(spark):
    cases = [
        ("Tales", "Short stories", "Children's Literature", "", "", "Text", "en", 100.0),  # two terms and two shelves
        ("Poems", "", "Nobel Prizes in Literature", "", "", "Text", "en", 0.0),  # a shelf that tells nothing
        ("Of Stars", "", "Category: Science - Astronomy", "QB", "", "Text", "en", -500.0),
        ("Of Stars", "Fiction", "Category: Science - Astronomy", "QB", "", "Text", "en", 45.0),
        ("A Voyage", "", "Category: Science - Travel Writing", "", "", "Text", "en", 45.0),
        ("Novel", "", "", "PZ", "Society for Theology", "Text", "en", -500.0),
        ("Novel", "", "", "PZ", "", "Sound", "en", -1000.0),
        ("Novel", "", "", "PZ", "", "Text", "en; de", -1000.0),
        (None, None, None, None, None, None, None, -1000.0),
    ]
    names = "title subjects shelves classes authors kind language"
    rows = spark.createDataFrame(cases, ", ".join(f"{n} string" for n in names.split()) + ", want double")
    found = rows.select(M.literary_score(*(F.col(n) for n in names.split())).alias("s"), "want", "title").collect()
    assert [(r.title, r.s) for r in found] == [(r.title, r.want) for r in found]


def test_work():
    page = "{{header\n| title = [[A/B|The ''Clock'']]\n| author = {{x}} Ann Lee\n| year = c. 1901\n}}\n{{PD-US}}text"
    assert M.work_of(page) == ("The Clock", "Ann Lee", 1901, "PUBLIC_DOMAIN", True)
    assert M.work_of("{{header|title=../|author=A|year=1990}}{{fair use}}") == (None, "A", 1990, "RESTRICTED", False)
    assert M.work_of("{{header|title=A Dictionary|author=A|year=1890}}") == ("A Dictionary", "A", 1890, "PUBLIC_DOMAIN", False)
    assert M.work_of(None) == M.work_of("") == (None, None, None, "UNKNOWN", False)


def test_inherited(spark):
    pages = spark.createDataFrame([(1, "w", None), (2, "w", "own"), (3, "v", None)], "page int, key string, title string")
    works = spark.createDataFrame([("w", "B"), ("w", "A"), ("w", None)], "key string, title string")
    assert sorted(tuple(r) for r in M.inherited(pages, works, "key", ["title"]).collect()) == [(1, "w", "A"), (2, "w", "own"), (3, "v", None)]


def test_sums(spark):
    text = "da39a3ee5e6b4b0d3255bfef95601890afd80709  a b.bz2\nbad line\nDA39A3EE5E6B4B0D3255BFEF95601890AFD80709 *c.bz2\n"
    found = spark.createDataFrame([(text,)], "t string").select(M.sums_of(F.col("t")).alias("m")).first().m
    assert found == dict.fromkeys(("a b.bz2", "c.bz2"), "da39a3ee5e6b4b0d3255bfef95601890afd80709")


def test_tree_digest(spark):
    files = [("r", "b", "2"), ("r", "a", "1"), ("s", "a", "1")]
    one, two = (M.tree_digest(spark.createDataFrame(x, "root string, path string, sha256 string"), "root").orderBy("root").collect() for x in (files, files[::-1]))
    assert one == two and one[0].digest != one[1].digest


def test_recovered():
    before = "The house was quiet. Nobody had come that day."
    paragraph = "He rose at 9:20 p.m. and wept."
    after = "Then the clerk went home through the old town, past the church and the silent mill. He slept."
    text, a, b = P.recovered(before, paragraph, after, "9:20 p.m.", 1280)
    assert text[a:b] == "9:20 p.m." and 80 <= len(text) <= 600 and text.endswith(".") and paragraph in text
    assert P.recovered(before, paragraph, after, "9:20 p.m.", 5) is None
    assert P.recovered("", "no such thing.", "", "9:20 p.m.", 5) is None


def test_window_and_once(spark):
    assert P.window("Ten O'Clock", None, "x", "It was ten o’clock then.") == ("It was ", " then.")
    assert P.window("noon", "x", None) == (None, None)
    rows = spark.createDataFrame([("a ten b", "ten"), ("ten ten", "ten"), ("x", "ten"), ("x", ""), (None, "x")], "t string, p string")
    assert [r.o and tuple(r.o) for r in rows.select(P.once(F.col("t"), F.col("p")).alias("o")).collect()] == [(2, 5), None, None, None, None]


def test_bags_and_state(spark):
    pool = spark.createDataFrame([(5, i) for i in range(4)] + [(6, 9), (7, 1)], "minute int, id long")
    state = spark.createDataFrame([(5, 2, "[3, 77, 1]"), (6, 4, "[]"), (7, 1, "oops")], "minute int, cycle int, ids string")
    bags = {r.minute: (r.cycle, r.ids) for r in G.next_bag(state, pool, "r").collect()}
    assert bags == {5: (2, "[3,1]"), 6: (5, "[9]"), 7: (2, "[1]")}
    new = {r.minute: r for r in G.next_bag(state.limit(0), pool, "r").collect()}
    order = sorted(range(4), key=lambda i: (G.cksum(f"r:1:5:{i}".encode()), i))
    assert new[5].cycle == 1 and new[5].ids == str(order).replace(" ", "")
    now = datetime(2026, 1, 2, 12, tzinfo=timezone.utc)
    history = spark.createDataFrame([(3, 5, now), (4, 5, datetime(2025, 12, 1, tzinfo=timezone.utc))], "id long, minute int, at timestamp")
    lines = [r.value for r in G.state_lines(history, G.next_bag(state, pool, "r"), 12, F.lit(now)).collect()]
    assert lines == ["VERSION\t1", "DISPLAY_COUNT\t12", f"H\t{int(now.timestamp())}\t0005\t3", "BAG\t0005\t3,1", "BAG\t0006\t9", "BAG\t0007\t1"]
