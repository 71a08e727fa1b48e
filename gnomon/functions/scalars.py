"""Column functions of times, texts and names. All are built-in expressions; nulls give nulls unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses, best first, and number words.
STATUS_RANKS = {"VERIFIED_EXACT": 4, "VERIFIED_NORMALIZED": 3, "AMBIGUOUS": 2, "TIME_TEXT_NOT_FOUND": 1}
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = {20: "twenty", 30: "thirty", 40: "forty", 50: "fifty"}
# Fixed values end.
NUMBER_WORDS = [ONES[n] if n < 20 else TENS[n - n % 10] + (f"-{ONES[n % 10]}" if n % 10 else "") for n in range(60)]


def parse_time(text: Column) -> Column:
    """Minute of day of ``H:MM`` or ``HH:MM`` with blanks around it; null for anything else."""
    hour = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*$", 1).try_cast("int")
    minute = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*$", 2).try_cast("int")
    return F.when((hour <= 23) & (minute <= 59), hour * 60 + minute)


def minute_to_time(minute: Column) -> Column:
    """``HH:MM`` of a minute from 0 to 1439; null outside."""
    return F.when(minute.between(0, 1439), F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int")))


def clock_minute(hour: Column, minute: Column, meridian: Column) -> Column:
    """Minute of day of a 12-hour clock; ``meridian`` starts with a or p."""
    return (hour % 12) * 60 + minute + F.when(F.lower(meridian).startswith("p"), 720).otherwise(0)


def clock_options(text: Column) -> Column:
    """The two minutes that trailing evidence ``HH:MM|HH:MM`` offers; null if there is none, a value is out of range, or both are one."""
    pattern = r"(\d{1,2}):(\d{2})\|(\d{1,2}):(\d{2})$"
    parts = [F.regexp_extract(text, pattern, i).try_cast("int") for i in range(1, 5)]
    first, second = parts[0] * 60 + parts[1], parts[2] * 60 + parts[3]
    fits = (parts[0] <= 23) & (parts[2] <= 23) & (parts[1] <= 59) & (parts[3] <= 59) & (first != second)
    return F.when(fits, F.array(first, second))


def status_rank(status: Column) -> Column:
    """4 for the best status to 1; 0 for an unknown or null one."""
    rank = F.lit(0)
    for name, value in STATUS_RANKS.items():
        rank = F.when(status == name, value).otherwise(rank)
    return rank


def number_words(value: Column) -> Column:
    """0 to 59 in words; null outside."""
    return F.when(value.between(0, 59), F.element_at(F.array(*map(F.lit, NUMBER_WORDS)), (value + 1).cast("int")))


def sparse_band(count: Column) -> Column:
    """How urgently a minute with so many quotes needs more: 6 for none down to 0 from seven on."""
    return F.when(count <= 2, 6 - count).when(count <= 4, 3).when(count <= 6, 2).otherwise(0).cast("int")


def highlighted(quote: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a quote."""
    return F.substring(quote, (start + 1).cast("int"), (end - start).cast("int"))


def marked(quote: Column, start: Column, end: Column, mark: str = "**") -> Column:
    """A quote with its highlight between marks."""
    return F.concat(F.substring(quote, F.lit(1), start.cast("int")), F.lit(mark), highlighted(quote, start, end), F.lit(mark), F.substring(quote, (end + 1).cast("int"), F.length(quote)))


def stable_identity(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a text in lower case with single blanks; ``-`` for an empty or null one."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.when(bare == "", "-").otherwise(F.substring(F.sha2(bare, 256), 1, 16))


def date_key(day: Column) -> Column:
    """``w-mm-dd`` with Sunday as 0."""
    return F.concat((F.dayofweek(day) - 1).cast("string"), F.date_format(day, "-MM-dd"))


def pseudo_shuffle(number: Column) -> Column:
    """A place in a fixed order that looks random: one step of a linear congruential generator."""
    return F.pmod(F.abs(number.cast("long") * 1103515245 + 12345), F.lit(2147483647))


def record_fields(text: Column) -> Column:
    """Fields of a record that was left unsplit: 1 for a plain text."""
    return F.regexp_count(text, F.lit(r"\|")) + 1


def minute_variants(minute: Column) -> Column:
    """The sorted distinct ways to write a minute that name its half of the day: digits on either clock, hour and minute in words, and o'clock, past and to with the part of the day."""
    hour, m = F.floor(minute / 60).cast("int"), (minute % 60).cast("int")
    twelve = F.pmod(hour + 11, F.lit(12)) + 1
    h, following = number_words(twelve), number_words(twelve % 12 + 1)
    half = F.when(hour < 12, "a.m.").otherwise("p.m.")
    part = F.when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")
    told = F.when(m == 30, F.concat(F.lit("half past "), h)).when(m < 30, F.concat(number_words(m), F.lit(" minutes past "), h)).otherwise(F.concat(number_words(60 - m), F.lit(" minutes to "), following))
    spoken = F.when(m > 0, F.array(told)).otherwise(F.array(F.concat(h, F.lit(" o'clock")), F.concat(h, F.lit(" o’clock"))))
    written = [F.format_string("%02d:%02d", hour, m), *(F.format_string(f"%d{mark}%02d %s", twelve, m, half) for mark in ":."), F.concat_ws(" ", h, number_words(m), half)]
    return F.array_sort(F.array_distinct(F.concat(F.array(*written), F.transform(spoken, lambda x: F.concat(x, F.lit(" in the "), part)))))


# Families of sources by how their names begin, and of parser rules and phrases, the first that fits.
SOURCE_FAMILIES = {"standardebooks/": "STANDARD_EBOOKS", "gutenberg/": "GUTENBERG", "english_wikisource": "WIKISOURCE"}
PHRASE_FAMILIES = {
    "colon_numeric": ("numeric", r"\d{1,2}:\d{2}"),
    "oclock": ("oclock", "o'clock"),
    "quarter_half": ("half_past", r"\b(?:quarter|half)\b"),
    "past_after": ("", r"\b(?:past|after)\b"),
    "to_before": ("relative", r"\b(?:to|before)\b"),
    "hour_minute_word_form": ("written_clock", r"\b(?:\d+|[a-z]+)\b.*\b(?:\d+|[a-z]+)\b"),
    "named_time": ("named_time", ""),
    "military": ("military", ""),
    "bare_hour_contextual": ("", r"^\s*(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|\d{1,2})\s*$"),
}
# Fixed values end.


def source_family(name: Column) -> Column:
    """The family of a source by its name; LEGACY for any other, also for a null."""
    family = [F.when(name == head if not head.endswith("/") else name.startswith(head), value) for head, value in SOURCE_FAMILIES.items()]
    return F.coalesce(*family, F.lit("LEGACY"))


def phrase_family(rule: Column, phrase: Column) -> Column:
    """How a time is written, by the parser's rule or by the phrase itself; other_legacy if neither tells."""
    text = F.translate(F.lower(F.coalesce(phrase, F.lit(""))), "’", "'")
    fits = [F.when((rule == r if r else F.lit(False)) | (text.rlike(f"(?s){pattern}") if pattern else F.lit(False)), name) for name, (r, pattern) in PHRASE_FAMILIES.items()]
    return F.coalesce(*fits, F.lit("other_legacy"))
