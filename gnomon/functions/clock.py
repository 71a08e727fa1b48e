"""Clock-time expressions in English prose, as structured columns.

A text is read as tokens. Small parsers over the tokens propose readings, which compete
for their span; the winners are then qualified by the words around them: a modifier
makes a reading approximate, a second time a range, the part of the day resolves it,
and the syntax of references, scores and measures makes it none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnomon.functions.scalars import ONES, TENS

# The kinds of a reading and the words that decide it.
EXACT_24H, EXACT_AM, EXACT_PM, CONTEXTUAL, AMBIGUOUS, APPROXIMATE, RANGE, INVALID = "EXACT_24H", "EXACT_AM", "EXACT_PM", "EXACT_CONTEXTUAL", "AMPM_AMBIGUOUS", "APPROXIMATE", "RANGE", "INVALID"
RANKS = {"range": 120, "relative": 100, "half_past": 100, "near_named": 95, "near": 90, "military": 80, "numeric": 75, "written": 70, "oclock": 65, "named": 55}
VAGUE = frozenset("about around nearly almost roughly approximately".split())
BOUNDS = frozenset("before after toward towards by".split())
CLOCK_CUES = frozenset("at by until from before after about around toward towards time timed read reads showed displayed".split())
SPOKEN_CUES = frozenset("at by until exactly struck was is read reads said says showed displayed indicated".split())
EXACT_CUES = frozenset("at until from since till through exactly struck was is".split())
DAYPARTS = {"morning": "a", "afternoon": "p", "evening": "p"}
MEASURES = frozenset("hour hours million billion degree degrees feet foot inch inches yard yards mile miles kilometer kilometers kilometre kilometres meter meters metre metres centimeter centimeters centimetre centimetres".split())
BETS = frozenset("bet bets betting betted wager wagered wagering odds win wins winning won".split())
SCORES = frozenset("score scored beat lost ratio odds won".split())
SECTIONS = {"chapter": "CHAPTER_VERSE", "chap": "CHAPTER_VERSE", "verse": "CHAPTER_VERSE", "verses": "CHAPTER_VERSE", "act": "CHAPTER_VERSE", "scene": "CHAPTER_VERSE", "book": "CHAPTER_VERSE", "article": "LEGAL_REFERENCE", "section": "LEGAL_REFERENCE", "statute": "LEGAL_REFERENCE", "clause": "LEGAL_REFERENCE", "subsection": "LEGAL_REFERENCE"} | dict.fromkeys("page pages pp line lines ll figure figures fig table tables".split(), "PAGE_LINE_REFERENCE") | dict.fromkeys("catalog catalogue serial model item code reference ref number no dated born died".split(), "DATE_CATALOG_CODE")
SCRIPTURE = frozenset("genesis exodus leviticus numbers deuteronomy joshua judges ruth samuel kings chronicles ezra nehemiah esther job psalm psalms proverbs ecclesiastes isaiah jeremiah lamentations ezekiel daniel hosea joel amos obadiah jonah micah nahum habakkuk zephaniah haggai zechariah malachi matthew mark luke john acts romans corinthians galatians ephesians philippians colossians thessalonians timothy titus philemon hebrews james peter jude revelation rev gen matt cor eph phil col thess tim heb".split())
# Fixed values end.

READING = T.StructType(
    [
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("minute", T.IntegerType()), T.StructField("confidence", T.StringType()),
        T.StructField("rule", T.StringType()), T.StructField("options", T.ArrayType(T.IntegerType())), T.StructField("reason", T.StringType()),
    ]
)
#: Java: a text without a match holds no reading, and never reaches Python.
PREFILTER = r"(?i)\d[:.]\d\d|\d{4}\s+hours?\b|o[’']clock|\b(?:past|after|to|before|midnight|midday|noon|about|around|nearly|almost|roughly|approximately|at|by|until|exactly|struck|was|is|reads?|said|says|showed|displayed|indicated|from|between)\b"

_lexer = re.compile(r"(?P<word>[A-Za-z]+(?:[’'][A-Za-z]+)*)|(?P<digits>\d+)|(?P<mark>[^\sA-Za-z\d])")
_dashes = frozenset("-‐‑‒–—―")
_values = {w: n for n, w in enumerate(ONES)} | {w: n for n, w in TENS.items()}


@dataclass(frozen=True)
class Token:
    kind: str
    low: str
    start: int
    end: int


@dataclass(frozen=True)
class Reading:
    start: int
    end: int
    rule: str
    confidence: str
    minute: int | None = None
    options: tuple[int, int] | None = None
    reason: str | None = None


class Reader:
    """The tokens of a text and what they spell."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [Token(m.lastgroup, m[0].lower().replace("’", "'"), m.start(), m.end()) for m in _lexer.finditer(text)]

    def low(self, i: int) -> str:
        return self.tokens[i].low if 0 <= i < len(self.tokens) else ""

    def skip_dash(self, i: int) -> int:
        while self.low(i) in _dashes and self.low(i):
            i += 1
        return i

    def number(self, i: int, most: int) -> tuple[int, int] | None:
        """(value, next token) of a number in words or in one or two digits."""
        if not 0 <= i < len(self.tokens):
            return None
        token = self.tokens[i]
        if token.kind == "digits":
            return (int(token.low), i + 1) if len(token.low) <= 2 and int(token.low) <= most else None
        value = _values.get(token.low)
        if value is None:
            return None
        if value in TENS:
            j = self.skip_dash(i + 1)
            unit = _values.get(self.low(j), 0)
            if 1 <= unit <= 9:
                return (value + unit, j + 1) if value + unit <= most else None
        return (value, i + 1) if value <= most else None

    def meridiem(self, i: int) -> tuple[str, int] | None:
        """(a or p, next token) of ``a.m.``, ``am``, ``a m``."""
        if self.low(i) in ("am", "pm"):
            return self.low(i)[0], i + 1 + (self.low(i + 1) == "." and self.tokens[i + 1].start == self.tokens[i].end)
        if self.low(i) in ("a", "p"):
            j = i + 1 + (self.low(i + 1) == ".")
            if self.low(j) == "m":
                return self.low(i), j + 1 + (self.low(j + 1) == "." and self.tokens[j + 1].start == self.tokens[j].end)
        return None

    def tail(self, i: int) -> tuple[str | None, int]:
        """The meridiem and the next token behind an hour, past ``o'clock``."""
        if self.low(i) == "o'clock":
            i += 1
        found = self.meridiem(i)
        return found if found else (None, i)

    def words_before(self, i: int, reach: int) -> list[str]:
        """The words within ``reach`` characters before token ``i``, up to the sentence's start, nearest first."""
        out = []
        begin = self.tokens[i].start
        for j in range(i - 1, -1, -1):
            token = self.tokens[j]
            if begin - token.start > reach or token.low in (".", "!", "?"):
                break
            out.append(token.low)
        return out

    # what the words around say

    def resolve(self, first: int, after: int, hour: int, minute: int, meridian: str | None) -> dict:
        """The minute of a 12-hour reading from tokens ``first`` to ``after``: by its meridiem or the part of the day, else two options."""
        face = hour % 12 * 60 + minute
        if meridian:
            if not 1 <= hour <= 12:
                return {"confidence": INVALID, "reason": "no hour of a 12-hour clock"}
            return {"confidence": EXACT_AM if meridian == "a" else EXACT_PM, "minute": face + 720 * (meridian == "p")}
        half = self.half_of_day(first, after, hour)
        if half:
            return {"confidence": CONTEXTUAL, "minute": face + 720 * (half == "p")}
        return {"confidence": AMBIGUOUS, "options": (face, face + 720), "reason": "no part of the day"}

    def half_of_day(self, first: int, after: int, hour: int) -> str | None:
        a, b, c = self.low(after), self.low(after + 1), self.low(after + 2)
        part = c if a in ("in", "during") and b == "the" else b if a in ("that", "this") else ""
        if part in DAYPARTS:
            return DAYPARTS[part]
        if (a == "tonight") or (a in ("at", "that") and b == "night"):
            return "a" if hour == 12 or 1 <= hour <= 4 else "p" if 6 <= hour <= 11 else None
        before = self.words_before(first, 90)
        for i, word in enumerate(before[:9]):
            if word in DAYPARTS and before[i + 1 : i + 2] in (["that"], ["this"]):
                return DAYPARTS[word]
            if (word, *before[i + 1 : i + 2]) in (("midnight", "after"), ("dawn", "before"), ("breakfast", "at")):
                return "a"
        return None

    # readings

    def readings(self) -> Iterator[tuple[Reading, int, int]]:
        """Proposed readings with their first token and the token behind them."""
        for i, token in enumerate(self.tokens):
            for propose in (self.range_, self.near, self.relative, self.military, self.numeric, self.written, self.oclock, self.named):
                found = propose(i, token)
                if found:
                    fields, rule, j = found
                    yield Reading(token.start, self.tokens[j - 1].end, rule, **fields), i, j

    def clock(self, i: int) -> tuple[int, int, str, str | None, int] | None:
        """(hour, minute, separator, meridian, next token) of digits with a colon or point between."""
        t = self.tokens
        if i + 2 >= len(t) or t[i].kind != "digits" or t[i + 2].kind != "digits" or t[i + 1].low not in (":", ".") or t[i].end != t[i + 1].start or t[i + 1].end != t[i + 2].start:
            return None
        if not 1 <= len(t[i].low) <= 2 or len(t[i + 2].low) != 2 or i and t[i - 1].end == t[i].start and (t[i - 1].kind != "mark" or t[i - 1].low == "."):
            return None
        if i + 3 < len(t) and t[i + 3].start == t[i + 2].end and t[i + 3].kind == "word" and not self.meridiem(i + 3):
            return None
        meridian = self.meridiem(i + 3)
        return int(t[i].low), int(t[i + 2].low), t[i + 1].low, meridian[0] if meridian else None, meridian[1] if meridian else i + 3

    def range_(self, i: int, token: Token):
        lead = token.low in ("from", "between")
        first = self.clock(i + lead)
        if first and (self.low(first[4]) in _dashes or self.low(first[4]) in ("to", "and")) and self.low(first[4]) and (second := self.clock(first[4] + 1)):
            return {"confidence": RANGE, "reason": "time range"}, "range", second[4]
        if lead and (a := self.number(i + 1, 12)) and self.low(a[1]) in (("to", "until") if token.low == "from" else ("and",)) and (b := self.number(a[1] + 1, 12)):
            j = b[1] + (self.low(b[1]) == "o'clock")
            if j > b[1] or self.meridiem(j) or {self.low(k) for k in range(j, j + 3)} & {*DAYPARTS, "forenoon", "night"}:
                return {"confidence": RANGE, "reason": "time range"}, "range", j
        return None

    def near(self, i: int, token: Token):
        j = i
        if token.low in ("sometime", "shortly", "just", "long") and self.low(i + 1) in ("before", "after", "past"):
            j = i + 1
        if self.low(j) not in VAGUE | BOUNDS | {"past", "near"}:
            return None
        if self.low(j + 1) in ("midnight", "noon", "midday"):
            return {"confidence": APPROXIMATE, "reason": "approximate named time"}, "near_named", j + 2
        if self.low(j) in BOUNDS - {"before", "after"} | {"past", "near"}:
            return None
        half = self.low(j + 1) == "half" and self.low(self.skip_dash(j + 2)) == "past"
        hour = self.number(self.skip_dash(j + 2) + 1 if half else j + 1, 12)
        if not hour:
            return None
        k = hour[1] + (self.low(hour[1]) == "o'clock" and not half)
        follower = self.tokens[k] if k < len(self.tokens) else None
        if follower and (follower.kind == "word" and follower.low not in ("at", "in", "that", "this", "tonight") or follower.low in ":." and self.clock(hour[1] - 1)):
            return None
        return {"confidence": APPROXIMATE, "reason": "approximate expression"}, "near", k

    def relative(self, i: int, token: Token):
        j = i + (token.low == "a" and self.low(i + 1) == "quarter")
        unit = word = ""
        if self.low(j) in ("quarter", "half"):
            unit, amount, j = self.low(j), 15 if self.low(j) == "quarter" else 30, j + 1
        elif token.low in ("a", "an") and self.low(i + 1) in ("minute", "minutes"):
            amount, j = 1, i + 1
        elif (found := self.number(i, 59)) and not (i and self.tokens[i - 1].low in _dashes and self.tokens[i - 2].low in TENS.values()):
            amount, j = found
        else:
            return None
        if self.low(j) in ("minute", "minutes"):
            word, j = "minute", j + 1
        j = self.skip_dash(j)
        direction = self.low(j)
        if direction not in ("past", "after", "to", "before") or token.kind == "digits" and not word:
            return None
        base, base_word = self.number(self.skip_dash(j + 1), 23), self.low(self.skip_dash(j + 1))
        named = base_word in ("midnight", "noon")
        if not base and not named:
            return None
        meridian, end = (None, self.skip_dash(j + 1) + 1) if named else self.tail(base[1])
        if named and (m := self.meridiem(end)):
            return {"confidence": INVALID, "reason": "a named time takes no meridiem"}, "relative", m[1]
        rule = "half_past" if unit == "half" else "relative"
        if not 1 <= amount <= 59 or unit == "half" and direction != "past":
            return {"confidence": INVALID, "reason": "no such amount of minutes"}, "relative", end
        delta = amount if direction in ("past", "after") else -amount
        if named and not word and not unit:
            return {"confidence": AMBIGUOUS, "reason": "minutes or hours from a named time"}, rule, end
        if named:
            return {"confidence": EXACT_24H, "minute": ((720 if base_word == "noon" else 0) + delta) % 1440}, rule, end
        if not word and not unit and not self.told(i, end):
            return {"confidence": APPROXIMATE, "reason": "no word of time before the phrase"}, rule, end
        if not word and not unit and amount == 1 and delta > 0 and self.low(i - 1) not in ("at", "was", "is", "struck", "time"):
            return {"confidence": APPROXIMATE, "reason": "no word of time before the phrase"}, rule, end
        hour = base[0]
        if hour == 0:
            return {"confidence": INVALID, "reason": "no such hour"}, rule, end
        if hour > 12:
            return {"confidence": EXACT_24H, "minute": (hour * 60 + delta) % 1440}, rule, end
        fields = self.resolve(i, end, hour, 0, meridian)
        face = (hour % 12 * 60 + delta) % 720  # the half of the day stays the hour's
        if fields["confidence"] == AMBIGUOUS:
            fields["options"] = (face, face + 720)
        elif fields.get("minute") is not None:
            fields["minute"] = face + 720 * (fields["minute"] >= 720)
        return fields, rule, end

    def told(self, i: int, end: int) -> bool:
        if self.low(i - 1) in ("at", "was", "is", "struck", "time"):
            return True
        following = [self.low(k) for k in range(end, end + 3)]
        return bool({*following} & {*DAYPARTS, "night"}) and following[0] in ("in", "during", "that", "this", "at")

    def military(self, i: int, token: Token):
        if token.kind != "digits" or len(token.low) != 4 or self.low(i + 1) not in ("hour", "hours"):
            return None
        hour, minute = divmod(int(token.low), 100)
        if hour > 23 or minute > 59:
            return {"confidence": INVALID, "reason": "no such time"}, "military", i + 2
        return {"confidence": EXACT_24H, "minute": hour * 60 + minute}, "military", i + 2

    def numeric(self, i: int, token: Token):
        found = self.clock(i)
        if not found:
            return None
        hour, minute, separator, meridian, end = found
        if hour > 23 or minute > 59 or meridian and not 1 <= hour <= 12:
            return {"confidence": INVALID, "reason": "no such time"}, "numeric", end
        if separator == "." and not meridian:
            return None
        if not meridian and (hour >= 13 or hour == 0 or token.low[0] == "0"):
            opening = i == 0 and self.low(end) not in {",", ";", ":", ")", *_dashes}
            if self.low(i - 1) not in CLOCK_CUES and not opening:
                return {"confidence": APPROXIMATE, "reason": "no word of time before the figures"}, "numeric", end
            return {"confidence": EXACT_24H, "minute": hour * 60 + minute}, "numeric", end
        return self.resolve(i, end, hour, minute, meridian), "numeric", end

    def written(self, i: int, token: Token):
        hour = self.number(i, 12)
        if not hour or hour[0] == 0 or self.low(i - 1) not in SPOKEN_CUES:
            return None
        j = self.skip_dash(hour[1])
        oh = self.low(j) == "oh"
        minute = self.number(self.skip_dash(j + 1) if oh else j, 9 if oh else 59)
        if not minute or self.tokens[j].kind == "digits" and self.tokens[j - 1].kind == "digits":
            return None
        k = self.skip_dash(minute[1])
        if self.low(k) in ("minute", "minutes", "hour", "hours") and k > minute[1]:
            return {"confidence": INVALID, "reason": "a duration"}, "written", minute[1]
        if self.low(minute[1]) in ("minute", "minutes", "past", "after", "to", "before", "hours", "hour"):
            return None
        meridian, end = self.tail(minute[1])
        return self.resolve(i, end, hour[0], minute[0], meridian), "written", end

    def oclock(self, i: int, token: Token):
        hour = self.number(i, 99)
        if not hour or self.low(hour[1]) != "o'clock":
            return None
        meridian, end = self.tail(hour[1])
        if not 1 <= hour[0] <= 12:
            return {"confidence": INVALID, "reason": "no such hour"}, "oclock", end
        return self.resolve(i, end, hour[0], 0, meridian), "oclock", end

    def named(self, i: int, token: Token):
        if token.low not in ("midnight", "midday", "noon") or token.low == "midnight" and self.low(i + 1) in ("blue", "sun", "oil"):
            return None
        before = [self.low(i - k) for k in (1, 2, 3)]
        if before[0] in VAGUE | BOUNDS | {"past", "near"} or self.low(i + 1) in ("had", "has") and self.low(i + 2) == "passed":
            return {"confidence": APPROXIMATE, "reason": "approximate named time"}, "named", i + 1
        comes = self.low(i + 1) in ("came", "comes", "arrived", "struck")
        if token.low == "midday" and not (before[0] in ("at", "until", "exactly") or comes):
            return None
        lead = next((w for w in before if w not in ("a", "the", "high")), "")
        if lead in EXACT_CUES or comes or token.low == "noon" and before[0] == "high":
            return {"confidence": EXACT_24H, "minute": 0 if token.low == "midnight" else 720}, "named", i + 1
        return {"confidence": APPROXIMATE, "reason": "no word of time before the name"}, "named", i + 1

    # qualifications

    def qualified(self, reading: Reading, i: int, j: int) -> Reading:
        """The reading with what stands before and behind it."""
        vague = {"minute": None, "options": None}
        before, after = self.words_before(i, 60), [self.low(k) for k in range(j, j + 4)]
        if before[:1] == ["and"] and "between" in before[2:7] or before[:1] in (["to"], ["until"]) and "from" in before[1:12] or before[:1] == ["or"] and len(before) > 1 and (before[1] in _values or before[1].isdigit()) or before[:2] in (["perhaps", "or"], ["maybe", "or"]):
            return replace(reading, confidence=RANGE, reason="time range or alternative", **vague)
        if before[:2] in (["and", "hours"], ["and", "hour"]):
            return replace(reading, confidence=APPROXIMATE, reason="hours and minutes", **vague)
        bare = [w for w in after if w not in (",", ";")]
        if bare[:3] in (["give", "or", "take"], ["plus", "or", "minus"]):
            return replace(reading, confidence=APPROXIMATE, reason="tolerance", **vague)
        if after[:1] == ["at"] and {*after[1:3]} & {"latest", "earliest"} or after[:2] in (["or", "perhaps"], ["or", "maybe"]):
            return replace(reading, confidence=RANGE, reason="bound or alternative", **vague)
        lead = 1 if before[:1] and before[0] in VAGUE | BOUNDS else 2 if before[:2] in (["like", "something"], ["upon", "close"]) else 3 if before[:3] == ["as", "early", "as"] else 0
        if lead:
            if lead == 1 and before[1:2] and before[1] in ("sometime", "shortly", "just") and before[0] in ("before", "after"):
                lead = 2
            return replace(reading, start=self.tokens[i - lead].start, confidence=APPROXIMATE, reason="modifier", **vague)
        return reading

    def reference(self, reading: Reading, i: int, j: int) -> str | None:
        """What else the figures are: a chapter, a page, a law, a score, a measure, a code; None if a time."""
        before, after = self.words_before(i, 180), [self.low(k) for k in range(j, j + 4)]
        head = next((w for w in before if w not in (".", ",", ";", ":")), "")
        if reading.rule in ("relative", "half_past"):
            if after[0] in MEASURES or before[:1] == ["and"] and before[1:2] and before[1] in MEASURES - {"hour", "hours"}:
                return "DIMENSION_RATIO"
            if {*before} & BETS or {*before[:8]} & SCORES and before[:1] not in (["at"], ["by"], ["until"], ["from"]):
                return "SCORE_RATIO"
            return "SCORE_RATIO" if self.low(j - 1) == "one" and self.low(j - 2) == "to" and after[0] == "that" else None
        if reading.rule not in ("numeric", "range") or not any(t.kind == "digits" for t in self.tokens[i:j]):
            return None
        if head in SCRIPTURE or after[0] in SCRIPTURE or i == 0 and after[0] in (",", ";", ":", ")"):
            return "CHAPTER_VERSE"
        if head in SECTIONS:
            return SECTIONS[head]
        if "§" in before[:2]:
            return "LEGAL_REFERENCE"
        if {*before[:12]} & {"see", "cf", "compare"} and {*before} & {"(", "["} or (after[0] == "," and after[1].isdigit() or after[0] in _dashes and after[1].isdigit() or after[0] == ")") and head not in ("at", "by", "until", "from", "was", "is"):
            return "PAGE_LINE_REFERENCE"
        if after[0] in ("proportion", "proportions", "ratio", "scale", "ft", "mm", "cm") or after[0] in MEASURES:
            return "DIMENSION_RATIO"
        if head in SCORES or before[:1] in (["of"], ["was"], ["is"]) and before[1:2] and before[1] in SCORES:
            return "SCORE_RATIO"
        return "DATE_CATALOG_CODE" if after[0] in ("/",) and after[1].isdigit() else None


def read_times(text: str | None) -> list[Reading]:
    """The readings of a text in order, none overlapping another."""
    if not text:
        return []
    reader = Reader(text)
    proposed = [(reader.qualified(r, i, j) if r.rule not in ("range", "near", "near_named") else r, i, j) for r, i, j in reader.readings()]
    proposed.sort(key=lambda x: (-RANKS[x[0].rule], x[0].start - x[0].end))
    taken: list[tuple[Reading, int, int]] = []
    for reading, i, j in proposed:
        if all(reading.end <= other.start or other.end <= reading.start for other, _, _ in taken):
            taken.append((reading, i, j))
    out = []
    for reading, i, j in sorted(taken, key=lambda x: x[0].start):
        kind = reader.reference(reading, i, j)
        out.append(replace(reading, confidence=INVALID, minute=None, options=None, reason=f"reference:{kind}") if kind else reading)
    return _started_and_ended(text, out)


def _started_and_ended(text: str, readings: list[Reading]) -> list[Reading]:
    """Two times at which one thing began and ended are a range."""
    out = list(readings)
    open_ = {EXACT_24H, EXACT_AM, EXACT_PM, CONTEXTUAL, AMBIGUOUS}
    for a in range(len(out) - 1):
        x, y = readings[a], readings[a + 1]
        if x.confidence in open_ and y.confidence in open_ and y.start - x.end <= 100:
            began = re.search(r"\b(?:began|started|commenced)\b[^.!?]*$", text[max(0, x.start - 70) : x.start], re.I)
            ended = re.search(r"\b(?:ended|finished|stopped|concluded)\b[^.!?]*$", text[x.end : y.start], re.I)
            if began and ended:
                out[a], out[a + 1] = (replace(r, confidence=RANGE, minute=None, options=None, reason="start and end") for r in (x, y))
    return out


@F.pandas_udf(T.ArrayType(READING))
def _read_column(texts: pd.Series) -> pd.Series:
    return pd.Series([[(r.start, r.end, t[r.start : r.end], r.minute, r.confidence, r.rule, list(r.options) if r.options else None, r.reason) for r in read_times(t)] if isinstance(t, str) else [] for t in texts])


def times(text: Column) -> Column:
    """The readings of a text column. Null, empty and blank texts, and texts without any word or figure of time, give an empty list."""
    return F.coalesce(_read_column(F.when(text.rlike(PREFILTER), text)), F.array().cast(T.ArrayType(READING)))
