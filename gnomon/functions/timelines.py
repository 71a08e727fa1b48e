"""Which half of the day a time means, by the times around it; and what becomes of a passage whose time has two halves."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnomon.functions.clock import read_times
from gnomon.functions.claims import resolve_half
from gnomon.functions.passages import containing

# Greetings of the halves of the day, and bounds of a timeline.
GREETINGS = {"good morning": "a", "good afternoon": "p", "buenos días": "a", "buenos dias": "a", "buenas tardes": "p"}
WITHIN, MEMBERS = 180, 3
REJECTED, TO_REVIEW, RESOLVED, EITHER = "REJECTED", "CONTEXT_REVIEW", "CONTEXT_RESOLVED", "DUAL_ELIGIBLE"
# Fixed values end.
_greeting = re.compile("|".join(g.replace(" ", r"\s+") for g in GREETINGS), re.I)


@dataclass(frozen=True)
class Resolution:
    minute: int | None
    evidence: str


def by_greeting(paragraph: str, start: int) -> Resolution | None:
    """The half of the day of the open time at ``start``, told by a greeting: one that follows an open time in its sentence, if the times from there (and at least the two before the asked one) to the asked one run forward, by ``WITHIN`` minutes at most in all."""
    times = [r for r in read_times(paragraph) if r.options]
    asked = next((i for i, r in enumerate(times) if r.start == start), None)
    if asked is None:
        return None
    clock = [r.options[0] % 720 for r in times]
    ran = [0]
    for a, b in zip(clock, clock[1:]):
        ran.append(ran[-1] + (b - a) % 720)
    for m in _greeting.finditer(paragraph):
        a, b = containing(paragraph, m.start(), m.end())
        anchor = max((i for i, r in enumerate(times) if a <= r.start < m.start() and r.end <= b), default=None)
        if anchor is None or not anchor < asked:
            continue
        first = min(anchor, asked - (MEMBERS - 1))
        if first >= 0 and ran[asked] - ran[first] <= WITHIN and ran[asked] > ran[anchor]:
            half = GREETINGS[re.sub(r"\s+", " ", m[0].lower())]
            return Resolution(times[asked].options[half == "p"], f"greeting and {asked - first + 1} times in a row")
    return None


def resolve(paragraph: str, start: int, end: int, options: tuple[int, int], before: str = "") -> Resolution:
    """The minute of an open time in its paragraph: what its own reading there says, else a greeting's timeline, else parts of the day and time passed."""
    for r in read_times(paragraph):
        if r.start == start and r.minute in options:
            return Resolution(r.minute, "read in context")
    told = by_greeting(paragraph, start)
    if told and told.minute in options:
        return told
    found = resolve_half(paragraph, start, end, options, before)
    return Resolution(found.minute, found.evidence)


def assess(quote: str | None, start: int | None, end: int | None, source: str | None, fault: str | None = None) -> tuple[str, int | None, str]:
    """(decision, minute, reason) of a passage: rejected if it has a fault or its highlight is no time with two halves; else resolved by the paragraph it was taken from or by itself, both halves if neither tells, to be reviewed if they disagree or there is no source."""
    if quote is None or start is None or end is None or not 0 <= start < end <= len(quote):
        return REJECTED, None, "no highlight"
    reading = [r for r in read_times(quote) if (r.start, r.end) == (start, end)]
    if fault or not reading or not reading[0].options:
        return REJECTED, None, fault or ("no reading" if not reading else f"read as {reading[0].confidence}")
    options = tuple(reading[0].options)
    if source is None:
        return TO_REVIEW, None, "no source"
    shown = resolve(quote, start, end, options)
    at = source.find(quote)
    there = resolve(source, at + start, at + end, options) if at >= 0 else Resolution(None, "not in the source")
    if None not in (shown.minute, there.minute) and shown.minute != there.minute:
        return TO_REVIEW, None, "quote and source disagree"
    minute = there.minute if there.minute is not None else shown.minute
    if minute is not None:
        return RESOLVED, minute, there.evidence if there.minute is not None else shown.evidence
    open_ = [r.evidence for r in (there, shown) if "disagree" in r.evidence]
    return (TO_REVIEW, None, open_[0]) if open_ else (EITHER, None, "nothing tells")


ASSESSED = T.StructType([T.StructField("decision", T.StringType()), T.StructField("minute", T.IntegerType()), T.StructField("reason", T.StringType())])


@F.pandas_udf(ASSESSED)
def _assessed(quotes: pd.Series, starts: pd.Series, ends: pd.Series, sources: pd.Series, faults: pd.Series) -> pd.DataFrame:
    text = lambda x: x if isinstance(x, str) else None
    whole = lambda x: None if pd.isna(x) else int(x)
    rows = [assess(text(q), whole(a), whole(b), text(s), text(f)) for q, a, b, s, f in zip(quotes, starts, ends, sources, faults)]
    return pd.DataFrame({"decision": [d for d, _, _ in rows], "minute": pd.array([m for _, m, _ in rows], "Int32"), "reason": [r for _, _, r in rows]})


def assessed(quote: Column, start: Column, end: Column, source: Column, fault: Column) -> Column:
    """(decision, minute, reason) of each passage; see ``assess``."""
    return _assessed(quote, start, end, source, fault)
