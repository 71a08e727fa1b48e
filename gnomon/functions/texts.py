"""Text functions that built-in expressions can't express, as Arrow batches, and numbering of rows."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCATED = T.StructType([T.StructField("status", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def display_text(raw: Column) -> Column:
    """A text for display: line-break tags as spaces, entities as characters, single blanks. Only texts with an entity go through Python."""
    broken = F.regexp_replace(raw, r"(?i)<\s*br\s*/?\s*>", " ")
    clear = F.coalesce(_unescape(F.when(F.contains(broken, F.lit("&")), broken)), broken)
    return F.trim(F.regexp_replace(clear, r"(?U)\s+", " "))


def fold(text: str) -> str:
    """Decomposed, without case, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if c.isalnum())


@F.pandas_udf(T.StringType())
def normalized(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


def find_all(text: str, part: str) -> list[int]:
    """Every place of ``part`` in ``text``, overlapping ones too."""
    return [m.start() for m in re.finditer(f"(?={re.escape(part)})", text)] if part else []


def place(quote: str | None, phrase: str | None) -> tuple[str, int | None, int | None]:
    """(status, start, end) of a phrase: exact if it stands once, ambiguous if more often; else the same for the normalized texts."""
    if not quote or not phrase:
        return "TIME_TEXT_NOT_FOUND", None, None
    exact = find_all(quote, phrase)
    if len(exact) == 1:
        return "VERIFIED_EXACT", exact[0], exact[0] + len(phrase)
    if exact:
        return "AMBIGUOUS", None, None
    chars = [(c, i) for i, ch in enumerate(quote) for c in fold(ch)]
    wanted = fold(phrase)
    spans = {(chars[a][1], chars[a + len(wanted) - 1][1] + 1) for a in find_all("".join(c for c, _ in chars), wanted)}
    if len(spans) == 1:
        return "VERIFIED_NORMALIZED", *spans.pop()
    return ("AMBIGUOUS" if spans else "TIME_TEXT_NOT_FOUND"), None, None


@F.pandas_udf(LOCATED)
def locate(quotes: pd.Series, phrases: pd.Series) -> pd.DataFrame:
    found = [place(q if isinstance(q, str) else None, p if isinstance(p, str) else None) for q, p in zip(quotes, phrases)]
    return pd.DataFrame({"status": [s for s, _, _ in found], "start": pd.array([a for _, a, _ in found], "Int32"), "end": pd.array([b for _, _, b in found], "Int32")})


def attribution(author: Column) -> Column:
    """An author for display: roles and years of life left out, ``Last, First`` turned, at most two names before et al."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(author, r"\s*[\[(][^\])]*[\])]", ""), r",?\s*\b\d{3,4}\??\s*-\s*(?:\d{3,4}\??)?", ""))
    people = F.filter(F.transform(F.split(bare, r"\s*;\s*"), lambda p: F.trim(F.regexp_replace(p, r"^([^,]+),\s*([^,]+)$", "$2 $1"))), lambda p: p != "")
    return F.when(F.size(people) > 2, F.concat(people[0], F.lit(" et al."))).otherwise(F.array_join(people, " and "))


def short_title(title: Column) -> Column:
    """A title without subtitle: what stands before a colon or semicolon, with single blanks and no marks around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.split(title, r"\s*[:;]\s+")[0], r"\s+", " "), r'^[_“"]+|[_”".]+$', ""))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their number from 0 in the order of a unique column: rows are range partitioned, numbered in their partition, and moved by the rows of those before."""
    held = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    held = held.withColumn("__part", F.shiftright("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row for each partition: the window is as long as there are partitions
    sizes = held.groupBy("__part").agg(F.count("*").alias("n")).selectExpr("__part", "sum(n) over (order by __part rows between unbounded preceding and 1 preceding) as before")
    return held.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__in") + F.coalesce("before", F.lit(0))).drop("__at", "__part", "__in", "before")
