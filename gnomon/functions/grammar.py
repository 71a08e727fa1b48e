"""Phrases of clock time as shapes.

Each word of a phrase is read as one letter for its class, and a table of shapes says
what the classes mean together: where the hour and the minutes stand, and whether they
are added or taken away. A new way to write a time is a new line of the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from gnomon.functions.scalars import ONES, TENS

# Classes of words. n number, D time with a mark, E three or four figures, V hours and a half, K o'clock, M H S units, Q quarter, F half, P past, T to, N named times, X strike, C clock, U hundred, & and, a p halves of the day, y parts of the day.
CLASSES = {
    "K": "o'clock", "M": "minute minutes", "H": "hour hours h hrs", "S": "second seconds", "Q": "quarter", "F": "half", "P": "past after", "T": "to before till until of", "N": "noon midday midnight noonday",
    "X": "struck strike strikes striking", "C": "clock clocks", "U": "hundred", "&": "and", "a": "am", "p": "pm", "y": "morning forenoon dawn sunrise breakfast afternoon evening dusk sunset supper night tonight",
}
FILLERS = frozenset("a an the in at by around about that this just exactly precisely on it was is sharp then when were had approximately near".split())
NAMED = {"noon": 720, "midday": 720, "noonday": 720, "midnight": 0}
FORENOON, AFTERNOON = frozenset("morning forenoon dawn sunrise breakfast".split()), frozenset("afternoon evening dusk sunset supper".split())
#: Codes and shapes, the first that fits; h and m are the hour and the minutes, q and f a quarter and a half, s the side.
SHAPES = [
    ("NUMERIC", "(?P<d>D)"),
    ("HISTORICAL_DOT", "(?P<d>G)"),
    ("COMPACT", "(?P<d>E)H?"),
    ("FRACTION_OCLOCK", "(?P<d>V)K?"),
    ("EUROPEAN_24H", "(?P<h>n)H(?P<m>n)"),
    ("HOUR_MINUTE_UNITS", "(?P<h>n)H&?(?P<m>n)M(?:&?nS)?"),
    ("OCLOCK_PLUS_MINUTES", "(?P<h>n)K&(?P<m>n)M"),
    ("PRECISE_RELATIVE", "(?P<m>n)M&?nS(?P<s>[PT])(?:(?P<h>n)|(?P<b>N))K?"),
    ("RELATIVE", "(?:(?P<m>n)M?|(?P<one>M)|(?P<q>Q)|(?P<f>F))(?P<s>[PT])(?:(?P<h>n)|(?P<b>N))K?"),
    ("OFFSET_QUARTER", "(?P<h>n)K?&(?:(?P<q>Q)|(?P<f>F))"),
    ("WRITTEN_OCLOCK", "(?P<h>n)(?P<m>n)K"),
    ("OCLOCK", "(?P<h>n)K"),
    ("CLOCK_HOUR", "(?P<h>n)C"),
    ("STRIKE", "C?X(?:(?P<h>n)|(?P<b>N))"),
    ("NAMED", "(?P<b>N)"),
    ("WRITTEN_MILITARY", "(?P<h>n)U(?P<m>n)?H?"),
    ("WRITTEN_AND", "(?P<h>n)&(?P<m>n)"),
    ("WRITTEN", "(?P<h>n)(?P<m>n)"),
    ("BARE_CONTEXTUAL", "(?P<h>n)H?"),
]
# Fixed values end.

_class = {w: k for k, words in CLASSES.items() for w in words.split()}
_shapes = [(code, re.compile(shape)) for code, shape in SHAPES]
_number = {w: n for n, w in enumerate(ONES)} | {w: n for n, w in TENS.items()} | {"oh": 0, "o": 0}
_token = re.compile(r"(?P<D>\d{1,2}:\d{2}(?!\d))|(?P<G>\d{1,2}\.\d{1,2}(?!\d))|(?P<V>\d{1,2} ?(?:1/2|½))|(?P<E>\d{3,4}(?!\d))|(?P<n>\d{1,2}(?!\d))|(?P<w>o'clock|[a-z]+)|(?P<other>[^\s,;.!?\"“”()'])")


@dataclass(frozen=True)
class Reading:
    """What a phrase says: its code, the minutes of the day that it may be, and whether the phrase itself tells which half."""

    code: str
    minutes: tuple[int, ...]
    told: bool


def plain(phrase: str) -> str:
    """A phrase in lower case with one kind of marks: hyphens and dashes as blanks, halves of the day and clocks as one word."""
    text = re.sub(r"[-‐–—]+", " ", phrase.lower().replace("’", "'"))
    text = re.sub(r"\b([ap])\s*\.?\s*m\b\.?", r"\1m", text)
    text = re.sub(r"(\d)\s*([ap]m)\b", r"\1 \2", text)
    return re.sub(r"\b(?:of|on) the clock\b", "o'clock", re.sub(r"\b(\d{1,2})h(\d{2})\b", r"\1 h \2", text))


def shape_of(phrase: str) -> tuple[str, list[int | str]] | None:
    """The shape of a phrase and the value of each of its letters; None if a word has no class."""
    shape, values = "", []
    for m in _token.finditer(plain(phrase)):
        kind, text = m.lastgroup, m[0]
        if kind == "w":
            if text in _number:
                n = _number[text]
                tens = shape.endswith("n") and values[-1] in TENS and 0 < n < 10
                spoken = shape.endswith("n") and values[-1] == 0 and len(values) > 1 and n < 10  # one oh five
                if tens or spoken:
                    values[-1] += n
                else:
                    shape, values = shape + "n", [*values, n]
                continue
            if text in FILLERS:
                continue
            kind = _class.get(text, "other")
        if kind == "other":
            return None
        shape, values = shape + kind, [*values, int(text) if kind == "n" else text]
    return shape, values


def read(phrase: str) -> Reading | None:
    """The reading of a phrase by the first shape that fits all of it; None if there is none, or its numbers are no time."""
    found = shape_of(phrase)
    if not found:
        return None
    shape, values = found
    halves = [(k, v) for k, v in zip(shape, values) if k in "apy"]
    core = [(k, v) for k, v in zip(shape, values) if k not in "apy"]
    if len(core) > 1 and core[0][0] in "TP":  # by or before a time
        core = core[1:]
    letters = "".join(k for k, _ in core)
    for code, pattern in _shapes:
        m = pattern.fullmatch(letters)
        if m:
            value = {g: core[m.start(g)][1] for g, x in m.groupdict().items() if x}
            return _evaluated(code, value, halves)
    return None


def _evaluated(code: str, value: dict[str, int | str], halves: list[tuple[str, int | str]]) -> Reading | None:
    minutes, hour = 0, value.get("h")
    if "d" in value:
        figures = re.findall(r"\d+", str(value["d"]))
        if len(figures) == 3 or "½" in str(value["d"]):
            hour, minutes = int(figures[0]), 30
        elif len(figures) == 2:
            hour, minutes = int(figures[0]), int(figures[1])
        else:
            hour, minutes = divmod(int(figures[0]), 100)
            code = "COMPACT_12H" if any(k in "ap" for k, _ in halves) else "MILITARY" if str(value["d"]).startswith("0") else "COMPACT_24H"
    elif "m" in value:
        minutes = int(value["m"])
    else:
        minutes = 15 * ("q" in value) + 30 * ("f" in value) + ("one" in value)
    if minutes > 59:
        return None
    side = -1 if _class.get(str(value.get("s"))) == "T" else 1
    if "b" in value:
        return Reading(code, ((NAMED[str(value["b"])] + side * minutes) % 1440,), True)
    hour = int(hour)
    if hour > 24 or hour == 24 and minutes:
        return None
    half = {"a" if k == "a" or v in FORENOON else "p" if k == "p" or v in AFTERNOON else "a" if hour % 12 < 5 else "p" for k, v in halves}
    if hour == 0 or hour > 12 or code in ("MILITARY", "WRITTEN_MILITARY", "COMPACT_24H", "EUROPEAN_24H"):
        # a clock of 24 hours has no halves
        return None if any(k in "ap" for k, _ in halves) else Reading(code, ((hour * 60 + side * minutes) % 1440,), True)
    first = hour % 12 * 60 + side * minutes
    if len(half) == 1:
        return Reading(code, (first % 720 + 720 * (half == {"p"}),), True)
    return Reading(code, tuple(sorted((first % 720, first % 720 + 720))), False)
