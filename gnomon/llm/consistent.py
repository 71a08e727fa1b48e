"""Visually identical text with different characters: one consistent form.

Compatibility forms (full-width, ligatures) are folded, accents composed, spaces
made ordinary and ignorable characters deleted. A word of several scripts then
becomes a lattice of its letters and their look-alikes, and Viterbi takes the path
that a script-consistent bigram model, counted over the whole corpus, likes best.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters that they look like.
CYRILLIC_LOOKS = dict(zip("аеорсухіјѕһԁԛԝкАВЕЅІЈКМНОРСТУХԚԜ", "aeopcyxijshdqwkABESIJKMHOPCTYXQW"))
GREEK_LOOKS = dict(zip("αεικνορτυχγηωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeikvoptuxynwABEZHIKMNOPTYX"))
ARMENIAN_LOOKS = dict(zip("օսհոցԼՕՍ", "ouhngLOU"))
# Fixed values end.

FOREIGN_TO_LATIN = CYRILLIC_LOOKS | GREEK_LOOKS | ARMENIAN_LOOKS
LOOKS: dict[str, list[str]] = {}
for _foreign, _latin in FOREIGN_TO_LATIN.items():
    LOOKS.setdefault(_foreign, []).append(_latin)
    LOOKS.setdefault(_latin, []).append(_foreign)

SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
WIDE = "０-９Ａ-Ｚａ-ｚ"
LIGATURES = "ﬀ-ﬆﬓ-ﬗ"
#: Other compatibility letters: mathematical alphabets, circled letters, half-width kana and hangul.
LETTER_FORMS = "\U0001d400-\U0001d7ff\u24b6-\u24e9\uff66-\uffdc"
MARKS = "\u0300-\u036f"
#: Java, quick: characters beyond ASCII, Latin letters and typographic marks. A text without any is in its consistent form already; Python looks at the others.
SUSPECT = "[^\\x00-\\x7f\\u00a1-\\u00ac\\u00ae-\\u024f\\u2010-\\u2027\\u2030-\\u205e]"
RESULT = T.StructType([T.StructField("form", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType()))])

#: Joiners that Indic and Arabic spelling and emoji need.
_join_controls = re.compile("(?<=[\u0900-\u0dff\u0600-ۿက-႟ក-\u17ff])[\u200c\u200d](?=[\u0600-ۿ\u0900-\u0dffက-႟ក-\u17ff])|\u200d(?=[☀-➿\U0001f000-\U0001faff])")
_invisible, _spaces = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{SPACES}]")
_wide_run, _wide = re.compile("[！-～]+"), re.compile(f"[{WIDE}]")
_letter_form = re.compile(f"[{LETTER_FORMS}]+")
_ligature, _marked = re.compile(f"[{LIGATURES}]"), re.compile(f"\\S[{MARKS}]+")
_foreign = re.compile("[\u0370-\u058f\u1f00-\u1fff]")
_word = re.compile(r"[^\W\d_]+")
_suspect = re.compile("[^\\x00-\\x7f\\u00a1-\\u00ac\\u00ae-\\u024f\\u2010-\\u2027\\u2030-\\u205e]")
_gap = re.compile(r"[\W_]+")
#: Numbers that are no digits, which Python counts among word characters.
_odd = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0be6-\u0bff\u0f2a-\u0f33\u2070-\u218b\u2460-\u249b\u24ea-\u24ff\u2776-\u2793\u3007\u3021-\u3029\u3192-\u3195\u3220-\u3229\u3248-\u324f\u3251-\u325f\u3280-\u3289\u32b1-\u32bf\U00010107-\U0001ecff]")
_other = regex.compile(r"[^\p{L}\p{Nd}]+")


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    """LATIN, CYRILLIC, GREEK, ARMENIAN, or "" for any other."""
    first = unicodedata.name(ch, "").split(" ", 1)[0]
    return first if first in SCRIPTS else ""


class Bigrams:
    """Script-consistent letter bigrams with add-a-tenth smoothing; "" is a word's edge."""

    SWITCH, CHANGE = -14.0, -0.5

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.counts, self.firsts = counts, Counter()
        for (a, _), n in counts.items():
            self.firsts[a] += n

    def step(self, a: str, b: str) -> float:
        if a and b and script(a) != script(b):
            return self.SWITCH
        a, b = a.lower(), b.lower()
        return math.log((self.counts.get((a, b), 0) + 0.1) / (self.firsts.get(a, 0) + 20))

    def best(self, word: str) -> str:
        """The likeliest reading of ``word`` in the lattice of its letters and their look-alikes."""
        paths = {"": (0.0, "")}
        for ch in word:
            options = [(ch, 0.0), *((x, self.CHANGE) for x in LOOKS.get(ch, ()))]
            paths = {c: max((s + self.step(p, c) + cost, w + c) for p, (s, w) in paths.items()) for c, cost in options}
        return max((s + self.step(p, ""), w) for p, (s, w) in paths.items())[1]


_CODES = 0x2000  #: code points below hold the four scripts


def _alphabet() -> tuple[list[str], np.ndarray]:
    """The letters of the four scripts in lower case, and for each code point its letter's number; 0 for any other."""
    places: dict[str, int] = {}
    codes = np.zeros(_CODES + 1, np.int32)
    for code in range(_CODES):
        ch = chr(code)
        if ch.isalpha() and script(ch) and len(ch.lower()) == 1:
            codes[code] = places.setdefault(ch.lower(), len(places) + 1)
    return ["", *places], codes


def count_bigrams(texts: list[str | None], total: np.ndarray, codes: np.ndarray) -> None:
    """Add the letter bigrams of texts to the matrix ``total``; row and column 0 are a word's edge."""
    points = np.frombuffer("\n".join(["", *filter(None, texts), ""]).encode("utf-32-le", "replace"), "<u4")
    letters_ = codes[np.minimum(points, _CODES)]
    total += np.bincount(letters_[:-1] * len(total) + letters_[1:], minlength=total.size).reshape(total.shape)


def consistent(text: str | None, model: Bigrams) -> tuple[str | None, list[str]]:
    """The consistent form of a text and the kinds of change that it needed; a null stays null."""
    if text is None:
        return None, []
    classes, held = [], text
    if _invisible.search(text):
        keep = {m.start() for m in _join_controls.finditer(text)}
        held = "".join(ch for i, ch in enumerate(text) if i in keep or not _invisible.match(ch))
        if held != text:
            classes.append("invisible")
    if _spaces.search(held):
        classes.append("space")
        held = _spaces.sub(" ", held)
    if _wide.search(held):
        classes.append("fullwidth")
        held = _wide_run.sub(lambda m: unicodedata.normalize("NFKC", m[0]) if _wide.search(m[0]) else m[0], held)
    if _ligature.search(held):
        classes.append("ligature")
        held = _ligature.sub(lambda m: unicodedata.normalize("NFKC", m[0]), held)
    if _letter_form.search(held):
        classes.append("letter_form")
        held = _letter_form.sub(lambda m: unicodedata.normalize("NFKC", m[0]), held)
    if _marked.search(held):
        classes.append("combining")
        held = _marked.sub(lambda m: unicodedata.normalize("NFC", m[0]), held)

    def settle(m: re.Match) -> str:
        word = m[0]
        kinds = {script(ch) for ch in word}
        if "LATIN" not in kinds or not kinds & {"CYRILLIC", "GREEK", "ARMENIAN"}:
            return word
        read = model.best(word)
        if 2 * sum(script(ch) == "LATIN" for ch in read) > len(read):
            classes.append("mixed_script")
        return read

    if _foreign.search(held):
        held = _word.sub(settle, held)
    return held, list(dict.fromkeys(classes))


def bigram_model(*texts: DataFrame) -> Bigrams:
    """Bigrams of every text of one-column frames. Only pairs of lower-case letters of one of four scripts, or of such a letter and a word's edge, are kept: some hundred thousand pairs at most, however large the corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, codes = _alphabet()
        total = np.zeros((len(alphabet), len(alphabet)), np.int64)
        for batch in batches:
            count_bigrams(batch.column(0).to_pylist(), total, codes)
        pairs = [(alphabet[i], alphabet[j], int(total[i, j])) for i, j in np.argwhere(total) if i or j]
        pairs = [(a, b, n) for a, b, n in pairs if not a or not b or script(a) == script(b)]
        columns = list(zip(*pairs)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["a", "b", "n"])

    parts = [df.mapInArrow(counted, "a string, b string, n bigint") for df in texts]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    rows = union.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return Bigrams({(r.a, r.b): r.n for r in rows})


def with_form(df: DataFrame, column: str, model: Bigrams, form: str = "form", classes: str | None = None) -> DataFrame:
    """``df`` with the consistent form of ``column``, and with the kinds of change if ``classes`` names a column for them.

    Python sees only the texts that hold a suspect character. A null text has a null form and no kinds; an empty one stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.counts)
    held: list[Bigrams] = []  # one model for each Python worker

    @F.pandas_udf(RESULT)
    def fold(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Bigrams(shared.value))
        out = [consistent(x, held[0]) if isinstance(x, str) else (None, []) for x in texts]
        return pd.DataFrame({"form": [a for a, _ in out], "classes": [b for _, b in out]})

    text = F.col(column)
    folded = f"__{form}"
    df = df.withColumn(folded, fold(F.when(text.rlike(SUSPECT), text)))
    df = df.withColumn(form, F.coalesce(F.col(f"{folded}.form"), text))
    if classes:
        df = df.withColumn(classes, F.coalesce(F.col(f"{folded}.classes"), F.array().cast("array<string>")))
    return df.drop(folded)


def words_of(form: str) -> str:
    """The words of a consistent form, in lower case, with a space between."""
    low = form.lower()
    return (_other.sub(" ", low) if _odd.search(low) else _gap.sub(" ", low)).strip()


def letters(form: str) -> str:
    """The letters and digits of a consistent form, ignoring case."""
    return words_of(form).replace(" ", "").replace("\u03c2", "\u03c3").replace("\u00df", "ss")


def canonical(form: str) -> str:
    """What copies share: the letters of a text, or the sorted letters of an unsplit record's fields."""
    if "|" in form:
        return "|".join(sorted(filter(None, map(letters, form.split("|")))))
    return letters(form)


class Folder:
    """Consistent forms in a Python worker, made from the model's broadcast counts; a text without any suspect character is its own."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.model = Bigrams(counts)

    def __call__(self, text: str) -> str:
        return consistent(text, self.model)[0] if not text.isascii() and _suspect.search(text) else text


def lookalikes(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """One row per text field: its consistent form and the kinds of change it needed.

    Nulls, empty texts and repeated rows each give one row; an empty table gives none.
    """
    model = bigram_model(*(df.select(F.col(c).alias("t")) for c in columns))
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in columns)))
    flat = df.select(F.col(id_column), fields.alias("f")).select(id_column, "f.field_name", "f.value")
    return with_form(flat, "value", model, "form", "classes")
