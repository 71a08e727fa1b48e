"""Names, near-duplicates, hidden duplicates and survivors."""

import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from gnomon.llm import formatting, names, near, survivor

PEOPLE = {
    "agnes": ["Agnes Jürgen Melzofimann", "Melzofimann, A. J.", "Agnes J. Melzofimann", "AGNES JURGEN MELZOFIMANN", "Agnes Jürgen Mezlofimann"],
    "anthony": ["Anthony Bragovugard", "Tony Bragovugard", "Athony Bragovugard", "Capt. Anthony Bragovugard", "A. Bragovugard"],
    "two": ["Silas Korzupawell"],
    "family": ["Sabine Korzupawell"],
    "junior": ["Thomas Harrinuthwick, Jr.", "Tommy Harrinuthwick Jr"],
    "senior": ["Thomas Harrinuthwick"],
    "office": ["Dragerawick Department of Harbours", "The Dragerawick Dept. of Harbours", "Department of Harbours, Dragerawick"],
    "other office": ["Gornazamere Department of Harbours"],
    "pen name": ["Yorroteloth (pseud.)", "“Yorroteloth”"],
}
TITLES = {
    1: ["The Chronicle of Bargepeheath, Volume I", "Chronicle of Bargepeheath, Vol. I, The", "_The Chronicle of Bargepeheath, Volume I_"],
    2: ["The Chronicle of Bargepeheath, Volume II", "The Chroncle of Bargepeheath, v. II"],
    3: ["Three Pistols for Bornikobridge", "3 Pistols for Bornikobridge", "three pistols for bornikobridge"],
    4: ["Saint Dalvukuthorpe’s Mirror", "St. Dalvukuthorpe's Mirror"],
}


def pairs(groups):
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_names(spark):
    every = [n for g in PEOPLE.values() for n in g] + ["S. Korzupawell", "Anonymous", "", "  ", None, "Anon.", "unknown"]
    titles = [t for g in TITLES.values() for t in g] + [None]
    rows = [(a, titles[i % len(titles)], 1) for i, a in enumerate(every * 3)]
    found = names.name_pairs(names.resolve(spark.createDataFrame(rows, "author string, title string, pid int"), {"author": "author", "title": "title"})).collect()
    assert {(r.name_a, r.name_b) for r in found if r.field_name == "author"} == pairs(PEOPLE)
    assert {(r.name_a, r.name_b) for r in found if r.field_name == "title"} == pairs(TITLES)
    assert len(found) == len(pairs(PEOPLE)) + len(pairs(TITLES))
    assert names.resolve(spark.createDataFrame([], "author string"), {"author": "author"}).count() == 0


def test_names_merge_until_none_is_left(spark, monkeypatch):
    """Where a round merges one pair only, 32 spellings of a title take 31 rounds."""
    word = "bornikobridgehaven"
    spellings = {f"Three Pistols for {word[:i]}{c}{word[i + 1 :]}" for c in "zq" for i in range(1, 17)}
    titles = [f"Three Pistols for {word}", *sorted(spellings)[:31]]
    one = names.chosen
    monkeypatch.setattr(names, "chosen", lambda found: names.materialize(one(found).orderBy("a", "b").limit(1)))
    found = names.resolve(spark.createDataFrame([(t,) for t in titles], "title string"), {"title": "title"}).collect()
    assert len(found) == 32 and len({r.entity for r in found}) == 1


def test_near():
    for a, b in (("harness", "harless"), ("flask", "flsak"), ("flask", "fllask"), ("flask", "flak")):
        assert names.near(a, b) and names.near(b, a)
        assert names.dropped(a) & names.dropped(b)
    assert not names.near("flask", "flask") and not names.near("cloak", "clerk")


def test_blocks_meet_as_all_pairs_do(spark):
    """The roles of a block lose no match that comparing all pairs finds, and never pair two full given names for their initial."""
    rng = random.Random(11)
    firsts = ["John", "Jon", "J.", "Jack", "James", "Jim", "Jane", "K.", "Kate", "Katherine", "Bill", "William", "W."]
    typed = sorted({f"{rng.choice(firsts)} {rng.choice(['', 'A. ', 'B. ', 'Anne ', 'Ann '])}{rng.choice(['Penhallow', 'Penhalow', 'Marsh'])}" for _ in range(150)})
    rows = spark.createDataFrame([("author", t) for t in typed], "field string, name string")
    _, profiles = names.profiles_of(rows)
    keys = names.blocked(profiles).persist()
    found = {(r.a, r.b) for r in names.edges(profiles, keys, keys).collect()}
    held = {r.pid: names.Person(r.spellings) for r in profiles.collect()}
    want = {(a, b) for a in held for b in held if a < b and names.match_persons(held[a], held[b])}
    assert found == want and want
    role = {r.pid: r.role for r in keys.filter("role > 0").collect()}
    assert all(role[p] == (names.RICH if x.firsts else names.POOR) for p, x in held.items())


# near-duplicates


def sets(text):
    w = text.lower().split()
    return frozenset(zip(w, w[1:], w[2:]))


def edited(rng, vocabulary, n):
    out = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.randrange(3, 60))
        for _ in range(rng.randrange(1, 4)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[at], rng.choice(vocabulary)]])
            out.append(" ".join(w))
    return out


def brute(rows):
    held = [(i, sets(t), t.lower().replace(" ", "")) for i, t in rows if t]
    return {(min(i, j), max(i, j)) for n, (i, a, x) in enumerate(held) for j, b, y in held[:n] if a and b and x != y and len(a & b) >= 0.6 * len(a | b) - 1e-12}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = edited(rng, [f"v{i}" for i in range(60)], 120) + ["a b", "a", "v1 v2 v3 " * 3000]
    rows = [(i, rng.choice([t, t.upper()])) for i, t in enumerate(texts + texts[:30])] + [(9001, None), (9002, ""), (9003, " - ")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "key long, text string, node int")
    links, members = near.near_pairs(df, "key", "text")
    assert {(r.id_a, r.id_b) for r in near.near_records(links, members).collect()} == brute(rows)
    none = near.near_pairs(df.limit(0), "key", "text")
    assert none[0].count() == none[1].count() == 0


@pytest.mark.parametrize("cell", [3, 2000])
def test_hot_tokens_lose_no_pair(monkeypatch, cell):
    """Tokens spread over a grid of cells meet the same pairs; each pair of texts in one cell of a token."""
    monkeypatch.setattr(near, "CELL_TEXTS", cell)
    rng = random.Random(6)
    texts = edited(rng, [f"v{i}" for i in range(12)], 60)
    texts = sorted(set(texts))
    owner, tokens = near.Shingler(3)(texts)
    counts = near.Counts(*np.unique(tokens, return_counts=True), 1)
    postings = near.prefixes(owner, tokens, np.arange(len(texts)), counts, 0.6)
    assert (postings["cell"] > 0).any() == (cell == 3)
    again = near.unpacked([near.packed(postings[:50]), near.packed(postings[50:])])
    met = {}
    for a, b, need in near.pairs_of(again, 0.6):
        for x, y, l in zip(a.tolist(), b.tolist(), need.tolist()):
            met.setdefault((x, y), []).append(l)
    kept = {p for p, l in met.items() if len(l) >= max(l)}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if (a := sets(texts[i])) and (b := sets(texts[j])) and len(a & b) >= 0.6 * len(a | b) - 1e-12}
    assert want <= kept


def test_tokens_are_counted_exactly(spark, monkeypatch):
    """The heaviest tokens have their true counts, however the rows are dealt, and no other stands in more texts than the floor."""
    rng = np.random.default_rng(9)
    pool = rng.choice(2**near.KEY_BITS, 300).astype(np.uint64)
    lists = [np.unique(rng.choice(pool[: 1 + i], 40)).view(np.int64).tolist() for i in range(300)]
    true = {}
    for row in lists:
        for t in row:
            true[t & (2**64 - 1)] = true.get(t & (2**64 - 1), 0) + 1
    for parts, most in ((1, 2_000_000), (7, 2_000_000), (7, 64)):
        monkeypatch.setattr(near, "MOST_HEAVY", most)
        monkeypatch.setattr(near, "COUNTED_TOKENS", 2_000 if parts > 1 else 4_000_000)
        made = spark.createDataFrame([(x,) for x in lists], "tokens array<bigint>").repartition(parts)
        counts = near.token_counts(made, sum(map(len, lists)))
        held = counts.of(np.array(list(true), np.uint64))
        assert all(n == h or h == 0 and n <= counts.floor for n, h in zip(true.values(), held.tolist()))
        assert (counts.floor == 1) == (most > 64) and 0 < len(counts.keys) <= most


def test_few_known_tokens_lose_no_pair(spark, monkeypatch):
    """Where only a few tokens are known to be heavy, and a small bitmap lets strangers pass, the links are the same."""
    rng = random.Random(15)
    rows = list(enumerate(edited(rng, [f"v{i}" for i in range(40)], 80)))
    df = spark.createDataFrame(rows, "key long, text string")
    for name, value in (("MOST_HEAVY", 64), ("BITMAP_BITS", (3, 4)), ("BITMAP_BLOCK", 1), ("CELL_TEXTS", 5), ("FLUSH", 50)):
        monkeypatch.setattr(near, name, value)
    assert {(r.id_a, r.id_b) for r in near.near_records(*near.near_pairs(df, "key", "text")).collect()} == brute(rows)


def test_long_texts_keep_their_sizes_and_places():
    """A text of 200,000 shingles and the 140,000 of its part that come last in the order of tokens."""
    tokens = np.unique(np.random.default_rng(8).integers(0, 2**40, 200_010).astype(np.uint64))[:200_000]
    counts = near.Counts(np.empty(0, np.uint64), np.empty(0, np.int64), 2)
    part = tokens[60_000:]
    owner = np.repeat([0, 1], [len(tokens), len(part)])
    postings = near.prefixes(owner, np.concatenate([tokens, part]), np.arange(2), counts, 0.6)
    again = near.unpacked([near.packed(postings)])
    assert again["size"].max() == 200_000 and again["at"].max() > 65_535
    met = [(x, y) for a, b, _ in near.pairs_of(again, 0.6) for x, y in zip(a.tolist(), b.tolist())]
    need = max(l for *_, n in near.pairs_of(again, 0.6) for l in n.tolist())
    assert met.count((0, 1)) >= need


# hidden duplicates


def rows_of_copies(spark):
    rows = [(5, "It was TEN!", "x"), (3, "it was\nten", "y"), (9, "“It  was ten”", "z"), (4, "It was two", "x"), (1, "b|a c|", "x"), (2, "A C | B", "x"), (6, None, None), (7, "", None), (8, " — ", None), (10, "It was ｔen", "x"), (10, "It was ten", "x"), (11, "z" * 100_000, "x"), (12, "Z" * 100_000 + ".", "x")]
    return spark.createDataFrame(rows, "quote_id long, quote string, canon string")


@pytest.mark.parametrize("bucket_rows", [1, 2, 200_000])
def test_collapse(spark, bucket_rows):
    found = formatting.collapse(rows_of_copies(spark), "quote_id", "quote", bucket_rows=bucket_rows)
    assert sorted((r.first_id, r.quote_id, r.copies) for r in found.collect()) == sorted([(3, 3, 5), (3, 5, 5), (3, 9, 5), (3, 10, 5), (3, 10, 5), (1, 1, 2), (1, 2, 2), (11, 11, 2), (11, 12, 2)])
    assert formatting.collapse(rows_of_copies(spark).limit(0), "quote_id", "quote").count() == 0


def test_collapse_of_a_hot_text(spark):
    rows = spark.range(9000).select(F.col("id").alias("quote_id"), F.when(F.col("id") % 3 == 0, "The same, always.").otherwise(F.concat(F.lit("the same "), F.col("id"))).alias("quote"))
    found = formatting.collapse(rows, "quote_id", "quote", bucket_rows=100)
    assert found.agg(F.count("*"), F.min("first_id"), F.max("first_id"), F.min("copies")).first() == (3000, 0, 0, 3000)


def test_trie():
    trie = formatting.Trie()
    for i, t in enumerate([b"a" * 16, b"a" * 17, b"a" * 16, b"a"]):
        trie.add(t, 1, 10 - i)
    assert sorted(trie.terminals()) == [(b"a", 1, 7), (b"a" * 16, 2, 8), (b"a" * 17, 1, 9)]


# survivors


def at(day):
    return datetime(2026, 1, day, tzinfo=timezone.utc) if day else None


def test_survivors_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, f"Text number {i % 25}{'!' * rng.randrange(3)}", rng.choice(["a/x", "b/y", "c/z", "no", None]), rng.choice([*survivor.STATUSES, None]), rng.choice([3, 7, None]), at(rng.choice([None, 1, 2, 3])), 1) for i in range(120)]
    rows += [(500, "Twin", "a/x", "AMBIGUOUS", 1, at(1), 1), (500, "Twin", "a/x", "AMBIGUOUS", 1, at(1), 1), (501, None, "a/x", None, None, None, 1)]
    quotes = spark.createDataFrame(rows, "quote_id long, quote string, source_name string, quality_status string, highlight_start int, created_at timestamp, first_id int")
    sources = spark.createDataFrame([("a/x",), ("b/y",), ("c/z",), (None,)], "source_name string")
    rank = {s: 4 - i for i, s in enumerate(survivor.STATUSES)}
    groups = {}
    for r in rows:
        if r[1]:
            groups.setdefault(r[1].rstrip("!"), []).append((r[0], (rank.get(r[3], 0), r[4] is not None, r[2] in ("a/x", "b/y", "c/z"), r[5].timestamp() if r[5] else -1)))
    want = {g[i][0] for g in groups.values() if len(g) > 1 for i in range(len(g)) if all(all(x >= y for x, y in zip(g[i][1], o[1])) and g[i][1] != o[1] for j, o in enumerate(g) if j != i)}
    best = survivor.best_rows(quotes, sources)
    assert {r.quote_id for r in best.filter("dominant").collect()} == want and want
    assert best.count() == sum(len(g) > 1 for g in groups.values())
    assert survivor.best_rows(quotes.limit(0), sources).count() == 0
    assert survivor.fused(quotes, sources.limit(0)).count() == best.count()


def test_model_tells_good_sources_from_bad(spark):
    """A source that agrees with the others is more sensitive and specific than one that errs."""
    rows = []
    for g in range(60):
        for s in range(1, 5):
            value = "right" if s < 4 else f"wrong{g % 7}"
            rows.append((g, s, "AMBIGUOUS", value))
    members = spark.createDataFrame(rows, "first_id long, source int, quality_status string, source_name string").withColumn("highlight_start", F.lit(None).cast("int"))
    quality = survivor.infer(survivor.claims(members), ["a", "b", "c", "d"])
    assert quality.sensitivity[0][1] > 0.8 > 0.5 > quality.sensitivity[0][4] and quality.specificity[0][1] > quality.specificity[0][4]


def test_the_model_names_the_survivor(spark):
    """Of two rows that are each better in one field, the one survives whose field the model trusts more; neither dominates."""
    rows = spark.createDataFrame([(1, 2, 10, 1, 0, None, 4), (1, 2, 11, 2, 7, None, 1)], "first_id long, copies long, quote_id long, source int, highlight_start int, created_at timestamp, status_rank int")
    rows = rows.withColumn("highlight_start", F.when(F.col("highlight_start") > 0, F.col("highlight_start")))
    for sure, want in (([0.5, 0.95, 0.6], 10), ([0.5, 0.6, 0.95], 11)):
        quality = survivor.Quality(["a", "b"], [[x] * 3 for x in sure], [[x] * 3 for x in sure])
        found = survivor.survivors(rows, quality).first()
        assert (found.quote_id, found.dominant) == (want, False)
