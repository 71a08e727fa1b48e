"""Consistent forms, truncation, sentences, encoding and leaks."""

import base64
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gnomon.llm import cutoff, encoding, leaks, sentences
from gnomon.llm.consistent import Bigrams, bigram_model, canonical, consistent, lookalikes, with_form, words_of

MODEL = Bigrams({("t", "h"): 50, ("h", "e"): 60, ("", "t"): 60, ("e", ""): 80, ("c", "l"): 9, ("l", "o"): 9, ("o", "c"): 9, ("c", "k"): 9, ("k", ""): 9, ("", "c"): 9, ("х", "о"): 5})


@pytest.mark.parametrize(
    "text, form, kinds",
    [
        ("thе clοck", "the clock", ["mixed_script"]),
        ("０７：２５", "07:25", ["fullwidth"]),
        ("ofﬁce", "office", ["ligature"]),
        ("café", "café", ["combining"]),
        ("\U0001d413\U0001d41e\U0001d427 ⓐⓣ ｶﾞ", "Ten at ガ", ["letter_form"]),
        ("w​ho­", "who", ["invisible"]),
        ("at ten", "at ten", ["space"]),
        ("часы “καλημέρα” — ½ … \t\n  x", "часы “καλημέρα” — ½ … \t\n  x", []),
        ("今天，！", "今天，！", []),
        ("\U0001f469‍\U0001f680 क्‍ष", "\U0001f469‍\U0001f680 क्‍ष", []),
        ("", "", []),
        (None, None, []),
    ],
)
def test_consistent(text, form, kinds):
    assert consistent(text, MODEL) == (form, kinds)


def test_canonical():
    assert canonical("It’s TEN!") == canonical("its ten") == "itsten"
    assert canonical("b x|A|") == canonical("a | bx") == "a|bx"
    assert canonical("ΜΕΣΆΝΥΧΤΑΣ") == canonical("μεσάνυχτας")
    assert words_of("9½ to-day") == "9 to day"


def test_lookalikes_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, "a", "x"), (2, "", None, "y"), (3, "thе " * 40_000, "the", "z"), (3, "the the the", "the", "z")], "quote_id long, quote string, form string, field_name string")
    found = lookalikes(rows, "quote_id", ["quote", "form"])
    assert found.count() == 8
    long_ = found.filter("size(classes) > 0").collect()
    assert [r.quote_id for r in long_] == [3] and long_[0].form == "the " * 40_000
    assert lookalikes(rows.limit(0), "quote_id", ["quote", "form"]).count() == 0


def test_with_form_is_the_function(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abс е́ｆ​|'’дα1") for _ in range(30)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    model = bigram_model(rows)
    assert {r.t: r.form for r in with_form(rows, "t", model).collect()} == {t: consistent(t, model)[0] for t in texts}


# truncation

CORPUS = ["The clerk called it hope, and wept. Nobody smiled at the door.", "He sold the lamp and the kettle. She wept.", "Nobody came to the door. She sold the kettle."] * 40


@pytest.fixture(scope="module")
def endings(spark):
    return cutoff.endings_model(spark.createDataFrame([(t,) for t in CORPUS], "t string"))


@pytest.mark.parametrize(
    "text, why",
    [
        ("The clerk called it hope, and wept.", ""),
        ("The clerk called it hope, and wept…", ""),
        ("“Heaven preserve the clerk!” cried Zoë.", ""),
        ("He stood. “But the clerk never sold that …”", ""),
        ("He stood. “I thought the lamp was—”", ""),
        ("(So at least Zoë told the clerk.)", ""),
        ("ten|10:00|a text that stops|A", ""),
        (None, ""),
        ("  ", ""),
        ("The clerk called it ho", "unterminated"),
        ("The clerk called it hope,", "unterminated"),
        ("“I thought the lamp was—", "unterminated"),
        ("The clerk called it ho…", "omitted"),
        ("Nobody came to the [...]", "omitted"),
        ("She sold the …", "omitted"),
        ("It was five o�", "broken"),
        ("&ldquo;It was ten.&rdqu", "broken"),
        ("It was ten.<b", "broken"),
        ("or so he told Mr.", "abbreviated"),
        ("“She sold the kettle.", "open"),
    ],
)
def test_evidence(endings, text, why):
    assert cutoff.evidence(text, endings) == why


def test_cut_records(spark):
    """A source that never sets a stop, at all lengths, cuts only at its limit and inside sentences; one that stops at a fixed length cuts every time."""
    good, bad = "He sold the lamp and the kettle.", "He sold the lamp and the ket"
    rng = random.Random(5)
    habit = [" ".join(rng.choices(["lamp", "kettle", "door"], k=rng.randrange(3, 60))) for _ in range(300)]
    limited = [("He sold the kettle and the lamp. " * 9)[i : i + 96].rstrip(". ").ljust(96, "x") for i in range(60)]
    rows = [(i, "s", good if i % 10 else bad, 1) for i in range(100)] + [(1000 + i, "bare", t, 1) for i, t in enumerate(habit)] + [(2000 + i, "limit", t, 1) for i, t in enumerate(limited)]
    rows += [(3000 + i, "bare", "She sold the lamp and the " + "old " * n, 1) for i, n in enumerate([3, 9, 14])]
    rows += [(4000 + i, "s", "He sold the lamp. She sold the kettle. Who saw the door? " * (1 + i % 20) + "She wept.", 1) for i in range(400)]
    rows += [(1, "s", bad, 1), (1, "s", bad, 1), (300, None, None, 1), (301, None, bad, 1)]
    df = spark.createDataFrame(rows, "id long, source string, text string, why int")
    found, rates = cutoff.cut_records({"t": (df, "id", "source", "text")})
    ids = sorted(r.row_id for r in found.collect())
    assert ids == sorted([*range(0, 100, 10), 1, 301, *range(2000, 2060), 3000, 3001, 3002])
    share = {r.source: (r.records, r.cut) for r in rates.collect()}
    assert share == {"s": (500, 11), "bare": (303, 3), "limit": (60, 60), None: (2, 1)}
    empty, none = cutoff.cut_records({"t": (df.limit(0), "id", "source", "text")})
    assert empty.count() == none.count() == 0


def test_cut_whatever_mark_follows(spark):
    """Any mark behind a word that never ends a sentence leaves the text cut; behind one that does, it is whole."""
    corpus = ["He sold the lamp and the kettle. She wept at the door of the inn. Nobody came."] * 4000
    model = cutoff.endings_model(spark.createDataFrame([(t,) for t in corpus], "t string"))
    for mark in (".", "!", "?", "…", " …", "...", "[…]", ".”"):
        assert cutoff.evidence(f"Nobody sold the lamp and the{mark}", model), mark
        assert not cutoff.evidence(f"Nobody sold the lamp and the kettle{mark}", model) or mark == "[…]"
        assert cutoff.evidence(f"Nobody sold the lamp and the kett{mark}", model), mark
    assert not cutoff.evidence("nobody sold the lamp to zoë.", model)  # without capitals any word may be a name


def test_words_are_counted_exactly(spark, monkeypatch):
    """A fragment is judged by its own count, not by that of a word of the same checksum; and the joined counts say what the counts in one object say."""
    fragment = "kettl"
    letters = "abcdefghijklmnopqrstuvwxyz"
    twin = next(w for w in map("".join, itertools.product(letters, repeat=5)) if w != fragment and (zlib.crc32(w.encode()) ^ zlib.crc32(fragment.encode())) & 0xFFFF == 0)
    texts = [f"He sold the {twin}. She wept."] * 10 + [f"He sold the {fragment}…", f"He sold the {twin}…", "He met the Zoë…", "She saw Penn…", "It was Penn Zoë…", *CORPUS[:9], "Then " + "the lamp and " * 6000 + "wept.", "He came to the.", None, ""]
    rows = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "id long, source string, text string")
    model = cutoff.endings_model(rows.select("text"))
    want = {i for i, t in enumerate(texts) if cutoff.evidence(t, model)}
    assert {10, len(texts) - 3} <= want and 11 not in want
    for most in (cutoff.COUNTED_AT_ONCE, 1):
        monkeypatch.setattr(cutoff, "COUNTED_AT_ONCE", most)
        found, _ = cutoff.cut_records({"t": (rows.repartition(5), "id", "source", "text")})
        assert {r.row_id for r in found.collect()} == want


# sentences

CASE = sentences.Case({"the": 9, "bucket": 5})
LEXICON = sentences.Lexicon({"然后": 50, "车夫": 50, "走": 20, "了": 90}, {"车夫": 40})


@pytest.mark.parametrize(
    "text, units",
    [
        ("“Come in!” Octavia said. “Come in!” The porter laughed.", ["“Come in!” Octavia said.", "“Come in!”", "The porter laughed."]),
        ("“Was it 5.28?” “It was not,” said René.", ["“Was it 5.28?”", "“It was not,” said René."]),
        ("“I thought so—” Beyond it lay mist.", ["“I thought so—”", "Beyond it lay mist."]),
        ("He paused... Then it fell. She waited … and waited.", ["He paused...", "Then it fell.", "She waited … and waited."]),
        ("At 5 a.m. Col. Penn rose. They left at 5 p.m. The bucket stayed.", ["At 5 a.m. Col. Penn rose.", "They left at 5 p.m.", "The bucket stayed."]),
        ("It had ropes, lamps, etc. Nobody smiled. St. Ives, No. 5, p. 7.", ["It had ropes, lamps, etc.", "Nobody smiled.", "St. Ives, No. 5, p. 7."]),
        ("‘The cloak,’ he wrote, ‘is old. It will not last.’", ["‘The cloak,’ he wrote, ‘is old.", "It will not last.’"]),
        ("CHAPTER III.\n\nOne line\nand more.\n\n* * *\n\nEnd.", ["CHAPTER III.", "One line\nand more.", "End."]),
        ("“Come in!” Octavia s\u0430id. They left at 5 ｐ.ｍ. \u0422he bucket stayed. D\u200br. Penn sat. \u0421apt. Lee slept.", ["“Come in!” Octavia s\u0430id.", "They left at 5 ｐ.ｍ.", "\u0422he bucket stayed.", "D\u200br. Penn sat.", "\u0421apt. Lee slept."]),
        ("IV. Of the ill-lit basket\n\n12. Of ropes\n\nIt is 4. Nobody came.", ["IV. Of the ill-lit basket", "12. Of ropes", "It is 4.", "Nobody came."]),
        ("„Es ist spät. Geh nach Hause“, sagte er. Am 19. Mai kam er.", ["„Es ist spät.", "Geh nach Hause“, sagte er.", "Am 19. Mai kam er."]),
        ("— Уже поздно. Ступайте, — сказал он. В 1865 г. Мальцев ушёл.", ["— Уже поздно.", "Ступайте, — сказал он.", "В 1865 г. Мальцев ушёл."]),
        ("Τι ώρα είναι; Ο κ. Πέτρος ήρθε.", ["Τι ώρα είναι;", "Ο κ. Πέτρος ήρθε."]),
        ("«أين الحارس؟» سأل الرجل. كم الساعة؟ باع د. علي.", ["«أين الحارس؟» سأل الرجل.", "كم الساعة؟", "باع د. علي."]),
        ("“क्या हुआ?” माली ने पूछा। आधी रात हो गई! वह आया।", ["“क्या हुआ?” माली ने पूछा।", "आधी रात हो गई!", "वह आया।"]),
        ("“几点了？”车夫问道。车夫笑了……然后走了。难道？“走了。回家去吧，”他说。", ["“几点了？”车夫问道。", "车夫笑了……然后走了。", "难道？", "“走了。", "回家去吧，”他说。"]),
        ("「今何時ですか。」と彼は尋ねた。真夜中だ！彼は寝た。", ["「今何時ですか。」と彼は尋ねた。", "真夜中だ！", "彼は寝た。"]),
        ("เมื่อเวลา 11.27 น. กะลาสีมา คนสวนจ่าย 28 บาท หมอไป", ["เมื่อเวลา 11.27 น. กะลาสีมา", "คนสวนจ่าย 28 บาท", "หมอไป"]),
        ("﻿  \r\n One.\r\n \r\nTwo. ", ["One.", "Two."]),
        ("", []),
        (None, []),
        ("* * *", []),
    ],
)
def test_sentences(text, units):
    found = sentences.sentences(text, LEXICON, CASE)
    assert [text[a:b] for a, b in found] == units


def test_best_path_weighs_neighbours():
    """Of two ends with only an initial between, one stays, by the better sum; words between keep both."""
    assert sentences.best_path("Vitamin B. C. fell", [(10, 1.0), (13, 1.2)]) == [13]
    assert sentences.best_path("Vitamin B. C. fell", [(10, 2.0), (13, 2.0)]) == [10, 13]
    assert sentences.best_path("Vitamin B. Cats. fell", [(10, 1.0), (16, 1.2)]) == [10, 16]
    assert sentences.best_path("... Cats ! . fell", [(3, 9.0), (10, 1.0), (12, 2.0)]) == [12]


def test_split_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "One. Two.", 0), (3, "One. Two.", 0), (4, "word " * 50_000, 0)], "doc_id long, text string, start_char int")
    found = sentences.split(rows)
    assert found.groupBy("doc_id").count().orderBy("doc_id").collect() == [(3, 4), (4, 1)]
    assert sentences.split(rows.limit(0)).count() == 0
    units = sentences.split(rows.filter("doc_id = 3"), numbered=True).select("sentence", "unit").distinct().orderBy("sentence").collect()
    assert [tuple(r) for r in units] == [(1, "One."), (2, "Two.")]


def test_dictionary_does_not_depend_on_tasks(spark, monkeypatch):
    """Words that every task sees once are counted like those that one task sees often, uses and openings alike."""
    rows = spark.createDataFrame([("车夫" + "".join(chr(0x5000 + 40 * i + j) for j in range(40)),) for i in range(8)], "text string")
    one, _ = sentences.train(rows.coalesce(1))
    assert (one.counts["车夫"], one.opens["车夫"]) == (8, 8)
    many, _ = sentences.train(rows.repartition(8))
    assert (many.counts, many.opens) == (one.counts, one.opens)
    monkeypatch.setattr(sentences, "COUNTED_AT_ONCE", 1)
    parts, _ = sentences.train(rows.coalesce(1))
    assert (parts.counts, parts.opens) == (one.counts, one.opens)


# encoding


def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_the_tokenizer_s(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "<|endoftext|>", "a" * 5000, "aaaaabaaaab" * 300, "今天" * 700, "tabs\t\n\r\n  x", "\U0001f570️ 61½", "กะลาสี " * 20]
    texts += ["".join(rng.choice("abc é’今ж ก12.,'s\n\U0001f600") for _ in range(rng.randrange(120))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, "same", "same"])], "doc_id long, text string, ids int")
    held = reference()
    found = {r.doc_id: list(r.ids) for r in encoding.encode(rows).collect()}
    assert found == {i: held.encode_ordinary(t or "") for i, t in enumerate([*texts, "same", "same"])}
    assert encoding.encode(rows.limit(0)).count() == 0


# leaks


def test_long_pieces_are_encoded_alike():
    """A piece beyond the width of a matrix has the ids that the tokenizer gives, and those of the matrix."""
    held, public = encoding.encoder(encoding.tokenizer_path(), encoding.split_pattern()), reference()
    rng = random.Random(3)
    for text in ("".join(rng.choice("abcdeéäthingon") for _ in range(6000)), "ha" * 3000, "a" * 100_000, "今天" * 2500):
        for piece in held.pattern.findall(text):
            assert held.merge_long(piece.encode()) == public.encode_ordinary(piece)
    word = "".join(rng.choice("aeionst") for _ in range(900)).encode()
    assert held.merge_long(word) == held.merge([word])[0]


def test_leaked_places_are_those_of_the_text(spark):
    """Full-width letters, look-alikes and invisible characters move the places of the form, not those of the text."""
    item = "the porter carried twelve lamps down the stairs before the hall clock struck seven again"
    dressed = item.replace("porter", "pо\u200brter").replace("lamps", "ｌａｍｐｓ").replace("clock", "cl\u043eck")
    text = f"It \u200bwas \ufb01ne.\n {dressed}\u200b. Then he left."
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = leaks.leaked_spans(rows, spark.createDataFrame([(5, item)], "case_id long, quote string")).collect()
    assert [(r.item_id, text[r.start_char : r.end_char].strip(".\u200b")) for r in found] == [(5, dressed)]
    clean = leaks.without_leaks(rows, spark.createDataFrame([(5, item)], "case_id long, quote string"), whole_share=0.99).first().text
    assert clean.startswith("It \u200bwas \ufb01ne.\n ") and clean.endswith(" Then he left.") and "stairs" not in clean


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([8, 12, 20, 30])))) for i in range(30)] + [(98, None), (99, "")]
    docs = []
    for i in range(80):
        words = rng.choices(vocabulary, k=rng.randrange(60))
        if i % 3 == 0:
            source = items[rng.randrange(30)][1].split()
            a = rng.randrange(max(1, len(source) - 5))
            words[10:10] = source[a : a + rng.choice([11, 12, 15, 40])]
        docs.append((i, rng.choice([" ", ", ", " "]).join(words).upper(), 0))
    docs += [(100, None, 0), (101, "", 0), (0, docs[0][1], 0), (102, "w1 " * 40_000, 0)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, form int")
    tests = spark.createDataFrame(items, "case_id long, quote string")

    def grams(text):
        w = (text or "").lower().replace(",", " ").split()
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, c) for d, t, _ in docs for c, q in items if grams(t) & grams(q)}
    found = leaks.leaked_spans(rows, tests)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want
    blocks = leaks.leaked_spans(rows, tests, block_items=7)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found.collect()))
    assert leaks.leaked_spans(rows.limit(0), tests).count() == leaks.leaked_spans(rows, tests.limit(0)).count() == 0
    by_id = {d: t for d, t, _ in docs}
    for r in found.collect():  # places are those of the text
        assert len(leaks.words(by_id[r.doc_id][r.start_char : r.end_char])) == r.words
    clean = leaks.without_leaks(rows.dropDuplicates(["doc_id"]), tests)
    assert leaks.leaked_spans(clean, tests).count() == 0 and clean.filter("doc_id = 100").first().text is None
