"""Gates that a passage must pass, as columns: shape of a citation, consistency of a resolution, fitness of its context, repairable phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gnomon.functions.clock import SCRIPTURE
from gnomon.functions.passages import ENDS_WELL, LONG, WANTED, ground_column
from gnomon.functions.scalars import minute_to_time

# Words of legal texts, and times from which on a passage is a list of times.
LEGAL = r"(?i)\b(?:findings?|testimony|petitioner|respondent|appellant|appellee|judgment|statute|the court|upon the ground)\b"
MOST_TIMES = 3
# Fixed values end.


def citation_shaped(quote: Column, start: Column, end: Column) -> Column:
    """Whether a highlight looks like a citation: scripture with chapter and verse anywhere, a sentence that begins with a name and such figures, or a sentence that begins with the highlight and goes on with a comma or bracket. Null if quote or place is."""
    before, behind = F.substring(quote, F.lit(1), start.cast("int")), F.substring(quote, (end + 1).cast("int"), F.length(quote))
    scripture = quote.rlike(rf"(?i)\b(?:{'|'.join(sorted(SCRIPTURE))})\.?\s+\d{{1,3}}:\d{{1,3}}")
    named = quote.rlike(r"(?:^|[.!?]\s+)[A-Z][^.!?]{0,45},\s*\d{1,3}:\d{1,3}\b")
    leading = before.rlike(r"(?:^|[.!?][”’\"]?\s+)(?![\s\S])") & behind.rlike(r"^\s*[),]")
    return scripture | named | leading


def resolution_fault(minute: Column, options: Column, shown: Column, *evidence: Column) -> Column:
    """Why a resolution doesn't hold: no option, other than shown, or without evidence; null if it does."""
    blank = reduce(Column.__or__, (F.coalesce(F.trim(e), F.lit("")) == "" for e in evidence))
    held = F.coalesce(F.array_contains(options, minute), F.lit(False))
    return F.when(~held, "no option").when(~F.coalesce(shown == minute_to_time(minute), F.lit(False)), "other than shown").when(blank, "no evidence")


def context_fault(quote: Column, times: Column) -> Column:
    """Why a recovered context isn't fit for use; null if it is: it must be prose of readable length with balanced marks of speech, whole sentences, fewer than ``MOST_TIMES`` times and no legal text. ``times`` is the number of times read in it."""
    marks = lambda c: F.length(quote) - F.length(F.replace(quote, F.lit(c), F.lit("")))
    unbalanced = (marks('"') % 2 == 1) | (marks("“") != marks("”"))
    # columns first: what they settle needs no look at the words
    plain = (
        F.when(F.length(quote) < WANTED, "too short").when(F.length(quote) > LONG, "too long").when(unbalanced, "broken dialogue").when(quote.rlike("^\\P{L}*\\p{Ll}"), "begins inside a sentence")
        .when(~F.rtrim(quote).rlike(ENDS_WELL.replace("[”’]", "[”’\"]")), "no end of sentence").when(times >= MOST_TIMES, "several times").when(F.regexp_count(quote, F.lit(LEGAL)) >= 2, "legal text")
    )
    return F.coalesce(plain, ground_column(quote))


def repairable(phrase: Column, before: Column, code: Column) -> Column:
    """Whether a highlight may be put right by its own phrase: a time by the grammar, neither approximate nor part of a longer number."""
    about = phrase.rlike(r"(?i)\b(?:about|around|nearly|almost|roughly|approximately)\b") | before.rlike(r"(?i)\b(?:about|around|nearly|almost|roughly|approximately)\s*$")
    return F.coalesce(code.startswith("CLOCK_GRAMMAR_") & ~about & ~before.rlike(r"[\d:.]$"), F.lit(False))
