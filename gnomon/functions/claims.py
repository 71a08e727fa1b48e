"""Whether a highlighted phrase is the clock time that its record claims.

The phrase is read with the words around it. A table of rules tells what is plainly
something else (a duration, a reference, a score, a measure, a range, an approximate
time) and why. What is left is read by its shape, see ``grammar``, or by the reader of
running text; the time is compared with the claimed minute, on both halves of the day
where neither phrase nor context tells which. What can't be read is left for review.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnomon.functions import grammar
from gnomon.functions.clock import AMBIGUOUS, APPROXIMATE, INVALID, MEASURES, RANGE, SCORES, SCRIPTURE, SECTIONS, Reader, read_times

# Kinds, what to do, and words of the rules.
KEEP, QUARANTINE, REVIEW = "KEEP", "QUARANTINE", "REVIEW"
EXACT, EITHER, DURATION, RELATIVE, REFERENCE, HEADING, SCORE, RATIO, NUMBER, UNREAD = "CLOCK_TIME_EXACT", "CLOCK_TIME_AMBIGUOUS", "DURATION", "RELATIVE_DURATION", "SECTION_OR_REFERENCE", "HEADING_OR_TOC", "SCORE_OR_RESULT", "RATIO_OR_MEASUREMENT", "NON_TEMPORAL_NUMBER", "UNKNOWN"
MISMATCH, ABOUT, RANGE_OF_TIME = "HIGHLIGHT_SEMANTIC_MISMATCH", "APPROXIMATE_CLOCK_EXPRESSION", "CLOCK_RANGE_EXPRESSION"
UNITS = r"(?:minutes?|hours?|seconds?|days?|weeks?|months?|years?)"
SPANNED = r"(?:interval|pause|delay|walk|wait|ride|journey|note|page|foot|inch|mile|dollar|pound|section|chapter|gap|break|drive)s?"
COUNTED = r"(?:men|women|people|persons?|children|boys?|girls?|horses?|cars?|ships?|trains?|pages?|chapters?|items?|objects?|guests?|votes?)"
# Fixed values end.

DECISION = T.StructType([*(T.StructField(n, T.StringType()) for n in ("kind", "action")), T.StructField("minutes", T.ArrayType(T.IntegerType())), *(T.StructField(n, T.StringType()) for n in ("reason", "confidence"))])


@dataclass(frozen=True)
class Decision:
    kind: str
    action: str
    minutes: tuple[int, ...] = ()
    reason: str = ""
    confidence: str = "LOW"


class Place:
    """A phrase and what stands beside it, in lower case with one kind of apostrophe."""

    def __init__(self, quote: str, start: int, end: int, section: str = "") -> None:
        low = lambda t: t.lower().replace("’", "'")
        self.phrase, self.near, self.far, self.section = low(quote[start:end]), low(quote[max(0, start - 100) : start]), low(quote[end : end + 100]), low(section)
        self.digits = bool(re.search(r"\d", self.phrase))
        self.word = (re.findall(r"([a-z]+)\.?\s*$", self.near) or [""])[0]
        verb = re.search(r"\b([a-z]+)\s+(?:of|was|is|stood at)\s*$", self.near)
        self.head = verb[1] if verb else self.word
        self.next = (re.findall(r"^\s+([a-z]+)", self.far) or [""])[0]

    def before(self, pattern: str) -> bool:
        return re.search(pattern + r"\s*$", self.near) is not None

    def behind(self, pattern: str) -> bool:
        return re.match(r"\s*" + pattern, self.far) is not None

    def holds(self, pattern: str) -> bool:
        return re.search(pattern, self.phrase) is not None


_DASH = "[-‐–—]"
_APPROXIMATE = r"(?:about|around|nearly|almost|barely|roughly|approximately|something like|close upon|shortly (?:before|after)|just (?:before|after|past)|not yet)"
#: What a phrase plainly is instead of a time of day: kind, code, test. The first that holds is given.
APART: list[tuple[str, str, Callable[[Place], bool]]] = [
    (HEADING, "STRUCTURE_TOC", lambda p: re.search(r"\b(?:contents|toc|index|title ?page)\b", p.section) is not None),
    (UNREAD, "HIGHLIGHT_SOURCE_MARKUP", lambda p: p.holds(r"</?time\b")),
    (RELATIVE, "RELATIVE_LATER", lambda p: p.behind(rf"(?:{UNITS}\s+)?(?:later|earlier|ago|afterwards?|before(?:hand)?,)\b") or p.holds(r"\b(?:later|earlier|ago)$")),
    (RELATIVE, "RELATIVE_DURATION_PHRASE", lambda p: p.before(r"\b(?:within|after|in another|for another)(?:\s+\w+){0,2}") and p.behind(rf"{UNITS}\b") or p.holds(rf"^(?:within|after)\s.*{UNITS}$")),
    (RELATIVE, "RELATIVE_DURATION_BASE_IS_QUANTITY", lambda p: p.holds(r"(?:minutes?|hours?) (?:after|before|past|to) [a-z0-9]+$") and p.behind(rf"{COUNTED}\b")),
    (DURATION, "DURATION_MINUTE_NOUN", lambda p: p.before(r"\bhalf") and p.holds(r"^an?\s+(?:minute|hour)")),
    (DURATION, "DURATION_HYPHENATED", lambda p: p.behind(rf"{_DASH}\s*(?:{UNITS}|{SPANNED})\b")),
    (DURATION, "DURATION_FOR_MINUTES", lambda p: p.before(r"\bfor") and p.behind(rf"{UNITS}\b")),
    (DURATION, "DURATION_ELAPSED_UNITS", lambda p: p.behind(rf"{_DASH}?\s*{UNITS}\b(?!\s+(?:past|after|to|before|till|of)\b)") or p.holds(rf"\b{UNITS}\s+and\b.*\b{UNITS}$") and not p.before(r"\b(?:precisely|exactly|clock time is)")),
    (RATIO, "MEASUREMENT_CONTEXT", lambda p: p.behind(rf"{_DASH}\s*[a-z]") and not p.behind(r"[—–-]\s*[ap]\b") and p.holds(r"[a-z]$")),
    (RATIO, "MEASUREMENT_CONTEXT", lambda p: p.digits and (p.before(r"[£$€]") or p.behind(r":\d") or p.next in MEASURES - {"hour", "hours"})),
    (REFERENCE, "REFERENCE_BRACKETED_ANNOTATION", lambda p: p.digits and (p.before(r"[\[{]") or p.behind(r"[\]}]"))),
    (REFERENCE, "REFERENCE_SCRIPTURE", lambda p: p.digits and p.word in SCRIPTURE),
    (REFERENCE, "REFERENCE_CHAPTER", lambda p: p.digits and p.word in ("chapter", "chap", "ch")),
    (REFERENCE, "REFERENCE_PAGE_LINE", lambda p: p.digits and p.word in ("page", "line", "p", "pp")),
    (REFERENCE, "REFERENCE_SECTION", lambda p: p.digits and p.word in SECTIONS),
    (REFERENCE, "REFERENCE_EXPLICIT", lambda p: p.digits and p.before(r"\b(?:see|cf\.?|compare)")),
    (REFERENCE, "REFERENCE_DENSE_COLON_LIST", lambda p: p.digits and len(re.findall(r"\d+:\d+", p.near[-60:] + p.far[:60])) >= 3),
    (RATIO, "RATIO_CONTEXT", lambda p: p.digits and p.head in ("ratio", "proportion", "scale", "odds")),
    (SCORE, "SCORE_CONTEXT", lambda p: p.digits and p.head in SCORES),
    (UNREAD, RANGE_OF_TIME, lambda p: p.behind(r"[-–—]\s*\d{1,2}[:.]\d\d") or p.before(r"\d{1,2}[:.]\d\d\s*(?:[-–—]|to|and|until)") or p.before(r"\bbetween\s+[^,.;!?]{1,35}\sand")),
    (UNREAD, ABOUT, lambda p: p.before(rf"\b{_APPROXIMATE}") or p.holds(rf"\b{_APPROXIMATE}\b") and not p.holds(r"^(?:about|around|approximately|near)\s+\w+$")),
    (NUMBER, "NON_TEMPORAL_IDENTIFIER", lambda p: p.digits and p.before(r"(?:\bno\.|\bnumber|#|\bflight|\broom|\bmodel)")),
]
#: What shows that a phrase is used as a time: words before it, and words of its own.
_CUED = r"(?:\b(?:at|by|until|till|exactly|precisely|struck|strikes?|was|is|it's|read|reads|said|says|showed|shows|displayed|indicated|had|from|before|after|to|of)|[-—–“\"'(,;:])"
_TOLD = r"o'clock|of the clock|on the clock|[ap]\s*\.?\s*m\b|midnight|noon|past|after|before|\bto\b|till|\bof\b|quarter|half|struck|strik|\d"


def _reading(quote: str, start: int, end: int) -> tuple[tuple[int, ...], str] | Decision:
    """The minutes that a phrase may be and the code of its form; or why it is none."""
    phrase, before, after = quote[start:end], quote[max(0, start - 90) : start], quote[end : end + 90]
    dashed = re.match(r"\s*[—–-]\s*([ap])\s*[—–.-]?\s*m\b", after, re.I)
    read = grammar.read(f"{phrase} {dashed[1]}m" if dashed else phrase)
    if read and read.told:
        return read.minutes, f"CLOCK_GRAMMAR_{read.code}"
    cue = "at "  # the phrase is said to be a time: running text is read as after a word of time
    found = [r for r in read_times(f"{cue}{phrase}{after}") if r.start < len(cue) + len(phrase) and r.end > len(cue)]
    first = found[0] if found else None
    if first and first.confidence == RANGE:
        return Decision(UNREAD, QUARANTINE, (), RANGE_OF_TIME, "HIGH")
    if first and first.confidence == APPROXIMATE and first.minute is None and not read:
        return Decision(UNREAD, QUARANTINE, (), ABOUT, "HIGH")
    at = re.search(r"\b(?:at|by|until|till|was|showed|struck|read)\s*$", before, re.I)  # whatever follows, it is a time
    if first and first.confidence == INVALID and not (read and (at or read.code in ("RELATIVE", "WRITTEN"))):
        kind, code = next(((k, c) for part, k, c in (("SCORE", SCORE, "SCORE_CONTEXT"), ("DIMENSION", RATIO, "MEASUREMENT_CONTEXT"), ("reference", REFERENCE, "REFERENCE_EXPLICIT")) if part in (first.reason or "")), (UNREAD, "NUMERIC_OUTSIDE_CLOCK_RANGE"))
        return Decision(kind, QUARANTINE if kind != UNREAD else REVIEW, (), code, "MEDIUM")
    if not read:
        if first and first.minute is not None:
            return (first.minute,), f"CLOCK_GRAMMAR_{(first.rule or '').upper()}"
        return (tuple(first.options), f"CLOCK_GRAMMAR_{(first.rule or '').upper()}") if first and first.options else Decision(UNREAD, REVIEW, (), "UNKNOWN_CONTEXT")
    code = f"CLOCK_GRAMMAR_{read.code}"
    if first and first.minute in read.minutes:
        return (first.minute,), code  # the words behind tell the half of the day
    around = Reader(f"{before} {phrase}")
    place = next((i for i, t in enumerate(around.tokens) if t.start >= len(before)), 0)
    side = around.half_of_day(place, len(around.tokens), 12) if around.tokens else None
    return ((read.minutes[side == "p"],) if side else read.minutes), code


def judge(quote: str | None, start: int | None, end: int | None, claimed: int | None, section: str | None = None) -> Decision:
    """The decision on a highlight. A null quote or highlight, or one outside the quote, is for review."""
    if quote is None or start is None or end is None or claimed is None or not 0 <= start < end <= len(quote):
        return Decision(UNREAD, REVIEW, (), "HIGHLIGHT_OFFSET_INVALID")
    here = Place(quote, start, end, section or "")
    apart = next(((kind, code) for kind, code, holds in APART if holds(here)), None)
    if apart:
        return Decision(apart[0], QUARANTINE, (), apart[1], "HIGH")
    found = _reading(quote, start, end)
    if isinstance(found, Decision):
        return found
    minutes, code = found
    if not here.before(_CUED) and not (here.holds(_TOLD) and not code.endswith(("_WRITTEN", "_BARE_CONTEXTUAL"))) and not here.holds(_TOLD.replace("|\\d", "")):
        reason = "COLON_WITHOUT_TIME_EVIDENCE" if code.endswith("NUMERIC") else "BARE_HOUR_WITHOUT_TIME_EVIDENCE" if code.endswith("BARE_CONTEXTUAL") else "WRITTEN_WITHOUT_TIME_EVIDENCE"
        return Decision(UNREAD, REVIEW, minutes, reason)
    kind = EXACT if len(minutes) == 1 else EITHER
    if claimed not in minutes:
        return Decision(kind, QUARANTINE, minutes, MISMATCH, "HIGH")
    return Decision(kind, KEEP, minutes, code, "HIGH" if kind == EXACT else "MEDIUM")


def disposition(decision: Decision, claimed: int) -> str:
    """What a mismatch is: the other half of the day, or another minute; "" if there is none."""
    if decision.reason != MISMATCH:
        return ""
    return "WRONG_CLOCKFACE_SIDE" if any(m % 720 == claimed % 720 for m in decision.minutes) else "WRONG_MINUTE_LABEL"


@F.pandas_udf(DECISION)
def _judged(quotes: pd.Series, starts: pd.Series, ends: pd.Series, claimed: pd.Series) -> pd.DataFrame:
    whole = lambda x: None if pd.isna(x) else int(x)
    rows = [judge(q if isinstance(q, str) else None, whole(a), whole(b), whole(m)) for q, a, b, m in zip(quotes, starts, ends, claimed)]
    return pd.DataFrame({"kind": [r.kind for r in rows], "action": [r.action for r in rows], "minutes": [list(r.minutes) for r in rows], "reason": [r.reason for r in rows], "confidence": [r.confidence for r in rows]})


def judged(quote: Column, start: Column, end: Column, claimed: Column) -> Column:
    """(kind, action, minutes, reason, confidence) of each highlight; see ``judge``."""
    return _judged(quote, start, end, claimed)


# the half of the day from the paragraph around

_NUMBER = r"(?:\d{1,3}|an?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|forty|fifty|half\s+an)"
_LATER = re.compile(rf"\b({_NUMBER})\s+(minutes?|hours?)\s+(?:later|afterwards?|had passed)\b", re.I)
_PART = re.compile(r"\b(?:in\s+the|that|this|next|every|early|late|the)\s+(?:same\s+)?(morning|forenoon|afternoon|evening|night)\b|\b(tonight|breakfast|dawn|sunrise|sunset|dusk|supper|midday meal)\b", re.I)
_SIDE = {"morning": "a", "forenoon": "a", "breakfast": "a", "dawn": "a", "sunrise": "a", "afternoon": "p", "evening": "p", "tonight": "p", "sunset": "p", "dusk": "p", "supper": "p"}


REACH = 600  #: characters of the paragraph before that are read for exact times


@dataclass(frozen=True)
class Resolution:
    minute: int | None
    evidence: str


def _value(word: str) -> float:
    words = "zero one two three four five six seven eight nine ten eleven twelve".split()
    low = re.sub(r"\s+", " ", word.lower())
    return float(low) if low.isdigit() else 0.5 if low.startswith("half") else 1.0 if low in ("a", "an") else words.index(low) if low in words else {"fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50}[low]


def resolve_half(paragraph: str, start: int, end: int, options: tuple[int, int], before: str = "") -> Resolution:
    """Which of two minutes an expression means: by a part of the day in its own sentence, if all of these agree, the nearest telling; else by the time that has passed since the last exact time, up to twelve hours; else neither."""
    left = max((m.end() for m in re.finditer(r"[.!?]\s", paragraph[:start])), default=0)
    right = next((m.start() for m in re.finditer(r"[.!?](?:\s|$)", paragraph[end:])), len(paragraph) - end) + end
    hour = options[0] // 60 % 12
    cues = []
    for m in _PART.finditer(paragraph[left:right]):
        word = (m[1] or m[2]).lower()
        side = _SIDE.get(word) or ("a" if hour == 0 or hour <= 4 else "p" if hour >= 6 else None)
        if side:
            cues.append((min(abs(left + m.start() - end), abs(start - left - m.end())), side, word))
    if cues and len({s for _, s, _ in cues}) == 1:
        return Resolution(options[cues[0][1] == "p"], f"part of the day: {min(cues)[2]}")
    if cues:
        return Resolution(None, "parts of the day disagree")
    then = _clock_after(f"{before[-REACH:]}\n{paragraph[:start]}")
    return Resolution(then, "time passed since an exact time") if then in options else Resolution(None, "nothing tells")


def _clock_after(story: str) -> int | None:
    """The minute at the end of a story: exact times set its clock, and the last time that passes after one, up to twelve hours, moves it on. Null if nothing moved it."""
    happened = [(r.start, r.minute, None) for r in read_times(story) if r.minute is not None]
    happened += [(m.start(), None, int(_value(m[1]) * (60 if m[2].lower().startswith("hour") else 1))) for m in _LATER.finditer(story)]
    clock = moved = None
    for _, shown, passed in sorted(happened, key=lambda e: e[0]):
        if shown is not None:
            clock, moved = shown, None
        elif clock is not None:
            moved = passed
    return (clock + moved) % 1440 if moved is not None and 0 < moved <= 720 else None
