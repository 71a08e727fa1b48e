"""Text cut off by field limits: a structural completeness check.

A stack automaton reads each text: quotation marks, brackets and markup that stay
open, a broken multibyte sequence, entity or escape at the end, and the mark that
ends it. Where a mark stands at the end all the same, the words that end sentences
elsewhere in the corpus decide whether its last sentence is whole: the automaton asks
for its last words, and the exact counts of the words asked for are joined to the
questions. A missing terminator is a cut, unless the source leaves it out by habit: a
habit is found at all lengths, a limit piles up at one. Texts of such a source are cut
where they reach its limit, or end in words that end no sentence.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.consistent import FOREIGN_TO_LATIN
from gnomon.session import materialize

TERMINATORS = ".!?。！？।؟"
OPENERS, CLOSERS = "“‘«([{", "”’»)]}"
#: A source of which more texts, those at its limits apart, lack a terminator leaves it out by habit; the share is held back by a prior worth so many texts (bare, all).
BASELINE, FEW = 0.5, (1, 10)
#: Bare texts of one length are a limit of their source where they surpass what chance gives by e to this power (Chernoff's bound).
PILED = 14.0
#: How likely a text is to be cut before its words are read: before a mark of omission, without a mark where that is habit, and before any other mark.
PRIOR = {"omitted?": 0.18, "bare?": 0.18, "unended?": 0.001}
HELD_BACK = 5  #: uses that a word's share of ends is held back by
COUNTS = ("used", "ends", "next_used", "next_ends", "last")
TERMINATED = frozenset((".", "!", "?"))
FRAGMENT = 0.5  #: how often a cut leaves a last word that stands nowhere else
COUNTED_AT_ONCE = 200_000  #: words whose counts a task holds before it passes them on to be summed

# Abbreviated words that a name or more follows.
ABBREVIATED = frozenset("mr mrs ms dr prof rev capt col gen lt sgt st hon sir messrs no vol ch pp cf".split())
# Fixed values end.

_tokens = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*|[.!?…]+")
_break = re.compile(r"<\s*/?\s*(?:br|p)\s*/?\s*>", re.I)
_tag = re.compile(r"</?[A-Za-z][^<>]*>")
_broken = re.compile(r"(?:�|&#?\w{0,8}|\\u[0-9a-fA-F]{0,3}|\\|%[0-9A-Fa-f]?)$")
_broken_tag = re.compile(r"</?[A-Za-z]*/?")
_marks = re.compile(r"[“”\"«»(\[{)\]}]")
_ellipsis = re.compile(r"(?:\s*(?:…|\.\s?\.\s?\.+|\.\.))+[.!]?$")
_figure = re.compile(r"(?:^|[\s(])\d{1,2}\.$")
_strip = " \t\r\n\u00a0\u200b\u200c\u200d\u2060\ufeff\u00ad”’\"'»)]}"
_latin = str.maketrans(FOREIGN_TO_LATIN)
_soft = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_last = re.compile(r"([^\W_]+(?:[’'-][^\W_]+)*)[^\w]*$")
_before = re.compile(r"([^\W_]+(?:[’'-][^\W_]+)*)[^\w]+[^\W_]+(?:[’'-][^\W_]+)*[^\w]*$")


def read(word: str) -> str:
    """A word at a text's end as it is read; its lower case is counted."""
    word = unicodedata.normalize("NFKC", word)
    return word.translate(_latin) if re.search("[A-Za-z]", word) else word


@dataclass
class Endings:
    """Counts of words: how often each is used and ends a sentence, the same of the word after it, and how many texts end in it and a mark that ends sentences; and of all uses the share that end one."""

    counts: dict[str, tuple[int, int, int, int, int]]
    base: float
    unseen: float  #: how often a whole sentence ends in a word that stands nowhere else (Good and Turing's estimate)

    def share(self, word: str, before: str) -> float:
        """The share of the uses of ``word`` that end a sentence. Of words hardly seen, names end one where names do, and a fragment in lower case never does."""
        word = read(word)
        if len(word) == 1 and word not in "aAI":
            return 0.0
        used, ends, *_ = self.counts.get(word.lower(), (0, 0, 0, 0, 0))
        name = word[:1].isupper()
        usual = self.after(before) if name else 0.0
        share = (ends + HELD_BACK * usual) / (used + HELD_BACK)
        return max(share, usual) if name and used >= HELD_BACK else share

    def after(self, before: str) -> float:
        """The share of the words after ``before`` that end a sentence."""
        _, _, used, ends, _ = self.counts.get(before.lower(), (0, 0, 0, 0, 0))
        return (ends + HELD_BACK * self.base) / (used + HELD_BACK)


def plain(text: str) -> str:
    """Text without transport artefacts: line-break tags and entities; a broken one at the end stays."""
    if "<" in text:
        text = _tag.sub("", _break.sub(" ", text))
    return html.unescape(text) if "&" in text else text


def ending_counts(*texts: DataFrame) -> DataFrame:
    """(word, used, ends, next_used, next_ends, last): exact counts over every text of one-column frames, a row for each word. The last word of each text counts only as that, since it is what is judged."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[Counter, ...] = tuple(Counter() for _ in range(5))

        def held() -> pa.RecordBatch:
            words = list(total[0].keys() | total[2].keys() | total[4].keys())
            columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in total)]
            for c in total:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", *COUNTS])

        for batch in batches:
            words: list[str] = []
            for text in batch.column(0).to_pylist():
                if text and "|" not in text:
                    words += _tokens.findall(_soft.sub("", plain(text)).lower())
                    mark = ""
                    while words and words[-1][:1] in ".!?…" and words[-1]:
                        mark = words.pop()
                    if words and words[-1] and mark in TERMINATED:
                        total[4][words[-1]] += 1
                    words.append("")  # what follows the last word isn't known
            for used, ends, pairs in ((*total[:2], zip(words, words[1:])), (*total[2:4], zip(words, words[2:]))):
                for (a, b), n in Counter(pairs).items():
                    if a and b and a[0] not in ".!?…":
                        used[a] += n
                        if b[0] in ".!?":
                            ends[a] += n
            if len(total[0]) > COUNTED_AT_ONCE:
                yield held()
        yield held()

    parts = [df.mapInArrow(counted, "word string, " + ", ".join(f"{c} bigint" for c in COUNTS)) for df in texts]
    return reduce(DataFrame.unionByName, parts).groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def endings_model(*texts: DataFrame) -> Endings:
    """The counts of a small corpus in one object."""
    counts = {word: tuple(counts) for word, *counts in ending_counts(*texts).toLocalIterator()}
    used, ends, once = (sum(x) for x in zip((0, 0, 0), *((c[0], c[1], c[0] == c[1] == 1) for c in counts.values())))
    return Endings(counts, *rates(used, ends, once))


def rates(used: int, ends: int, once: int) -> tuple[float, float]:
    """The share of all uses of words that end a sentence, and the share of such ends at a word that stands nowhere else, of which there were ``once``."""
    return ends / max(1, used), (once + 1) / (ends + 1)


def left_open(text: str) -> str:
    """The stack of openers without closers when the automaton has read ``text``; straight quotation marks toggle."""
    stack: list[str] = []
    for m in _marks.finditer(text):
        ch = m[0]
        if ch == '"':
            if '"' in stack:
                del stack[len(stack) - 1 - stack[::-1].index('"') :]
            else:
                stack.append(ch)
        elif ch in OPENERS:
            stack.append(ch)
        else:
            opener = OPENERS[CLOSERS.index(ch)]
            if opener in stack:
                del stack[len(stack) - 1 - stack[::-1].index(opener) :]
    return "".join(stack)


NONE = ("", "", "")  #: no reason and no question


def at_end(pattern: re.Pattern, text: str) -> re.Match | None:
    """The first match of a pattern bound to the text's end, looked for from the end on: exact where the match can only grow to the left by running on."""
    width = 48
    while True:
        start = max(0, len(text) - width)
        m = pattern.search(text, start)
        if not start or m and m.start() > start:
            return m
        width *= 4


def broken(text: str) -> bool:
    """Whether a text ends inside a multibyte sequence, entity, escape or tag."""
    text = text.rstrip()
    tag = text.rfind("<")
    return _broken.search(text, max(0, len(text) - 10)) is not None or tag >= 0 and _broken_tag.fullmatch(text, tag) is not None


def last_words(why: str, without: str, body: str) -> tuple[str, str, str]:
    """``why`` with the last word of ``body`` and the word before it; ``without`` if there is none. Before a mark that ends sentences any word of a text without capitals may be a name, and is given one."""
    last = at_end(_last, body)
    if not last:
        return without, "", ""
    before = at_end(_before, body)
    word = last[1].capitalize() if why == "unended?" and last[1].islower() and body == body.lower() else last[1]
    return why, word, before[1] if before else ""


def question(text: str | None) -> tuple[str, str, str]:
    """Why a text is cut, as far as the text alone tells: broken, unterminated, omitted, abbreviated or open; "" if it looks whole. Else, if its last words must be judged, "omitted?" or "unended?". Last words stand beside both, and beside "unterminated".

    A null or blank text and an unsplit record (its fields between |) are never cut.
    """
    if text is None or "|" in text or not text.strip():
        return NONE
    text = plain(text)
    if broken(text):
        return "broken", "", ""
    text = text if text.isascii() else _soft.sub("", text)
    body = text.rstrip(_strip)
    closed = text[len(body) :]
    if body.endswith(("[…", "[...", "[..")):
        return "omitted", "", ""
    quoted = any(x in closed for x in "”\"»") or "’" in closed
    if not body:
        return "unterminated", "", ""
    end = body[-1]
    if end in "—–-":
        return NONE if quoted else ("unterminated", "", "")  # a dash is no habit
    if end in ".!…" and (m := at_end(_ellipsis, body)) and (m[0].strip().startswith("…") or m[0].count(".") > 1):
        # speech that breaks off: the closing mark belongs to marks opened later than the whole text's own
        if quoted and not left_open(text) and re.search(r"[“\"«][^“”\"«»]*$", body[: m.start()]) and not re.match(r"\s*[“\"«][^“”\"«»]*$", body[: m.start()]):
            return NONE
        return last_words("omitted?", "omitted", body[: m.start()])
    if end not in TERMINATORS:
        return last_words("unterminated", "unterminated", body)
    if any(x in left_open(text) for x in "“«("):
        return "open", "", ""
    asked = last_words("unended?", "", body)
    last = asked[1]
    if end == "." and last and not quoted and (last.lower() in ABBREVIATED or len(last) == 1 and last.isupper() or _figure.search(body, max(0, len(body) - 4))):
        return "abbreviated", "", ""
    return asked if last.islower() and len(last) > 1 else NONE


def answer(asked: str, word: str, before: str, model: Endings) -> str:
    """Why a text is cut, where the counts of its last words tell: omitted, unterminated or unended; "" if it looks whole.

    Words that end sentences so seldom, against the share of all words, that the odds pass from the prior's to a cut.
    """
    odds = PRIOR[asked] / (1 - PRIOR[asked])
    share = model.share(word, before)
    if asked == "unended?":
        used, ends, _, _, last = model.counts.get(read(word).lower(), (0, 0, 0, 0, 0))
        if not used and last <= HELD_BACK:  # a fragment, if need be with its copies, or a word that the corpus hardly holds
            return ANSWERS[asked] if model.unseen < FRAGMENT * odds else ""
        # a whole text may end in a word never seen there, if others stand there
        share = (ends + HELD_BACK * model.after(before)) / (used + HELD_BACK) if used else 1.0
    return ANSWERS[asked] if share < model.base * odds else ""


ANSWERS = {"omitted?": "omitted", "bare?": "unterminated", "unended?": "unended"}


def evidence(text: str | None, model: Endings) -> str:
    """Why a text is cut: broken, unterminated, omitted, abbreviated, open or unended; "" if it looks whole. The habits of sources, which a single text can't show, are not asked."""
    why, word, before = question(text)
    return answer(why, word, before, model) if why.endswith("?") else why


def questions(rows: DataFrame) -> DataFrame:
    """(row_id, source, why, word, before, size) of rows (row_id, source, text); no size where there is no passage of one record."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [question(x) for x in texts]
            sizes = [len(x) if x and "|" not in x and x.strip() else None for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([x[i] for x in found], pa.string()) for i in range(3)), pa.array(sizes, pa.int32())], names=["row_id", "source", "why", "word", "before", "size"]
            )

    return rows.select("row_id", "source", "text").mapInArrow(ask, "row_id bigint, source string, why string, word string, before string, size int")


def habits(asked: DataFrame, baseline: float = BASELINE) -> DataFrame:
    """(table_name, source, size) at which a text without a terminator is no cut by that alone: the sizes of sources that leave it out by habit, their limits apart.

    Chance would give a source's bare texts the sizes that the table's terminated texts have. The rows are sums by source and size.
    """
    bare = F.sum((F.col("why") == "unterminated").cast("long"))
    sums = asked.filter("size is not null").groupBy("table_name", "source", "size").agg(bare.alias("bare"), F.count("*").alias("records"))
    usual = sums.groupBy("table_name", "size").agg(F.sum(F.col("records") - F.col("bare")).alias("ended"))
    every = usual.groupBy("table_name").agg(F.sum("ended").alias("all_ended"))
    mine = sums.groupBy("table_name", "source").agg(F.sum("bare").alias("all_bare")).filter("all_bare > 0")
    key = lambda *names: [x for n in names for x in [F.col(f"s.{n}").eqNullSafe(F.col(f"o.{n}"))]]
    held = sums.alias("s").join(mine.alias("o"), key("table_name", "source")).select("s.*", "all_bare").join(usual, ["table_name", "size"]).join(every, "table_name")
    chance = F.col("all_bare") * (F.col("ended") + 1) / (F.col("all_ended") + 1)
    piled = F.col("bare") * F.log(F.greatest(F.col("bare"), F.lit(1)) / chance) - (F.col("bare") - chance)
    held = held.withColumn("limit", (F.col("bare") > chance) & (piled > PILED))
    off = lambda c: F.sum(F.when(F.col("limit"), 0).otherwise(F.col(c)))
    omitting = held.groupBy("table_name", "source").agg(off("bare").alias("bare"), off("records").alias("records")).filter((F.col("bare") + FEW[0]) / (F.col("records") + FEW[1]) > baseline)
    return held.filter("bare > 0 and not limit").alias("s").join(omitting.alias("o"), key("table_name", "source"), "left_semi").select("table_name", "source", "size")


def answers(pending: DataFrame, counts: DataFrame) -> DataFrame:
    """(why, word, before, found) of the distinct questions whose answer is a cut: each question meets the counts of its own two words."""
    sums = counts.agg(F.sum("used").alias("used"), F.sum("ends").alias("ends"), F.count_if((F.col("used") == 1) & (F.col("ends") == 1)).alias("once")).first()
    held = rates(sums.used or 0, sums.ends or 0, sums.once)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, befores = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([read(x).lower() for x in words], pa.string()), pa.array([x.lower() for x in befores], pa.string())], names=["why", "word", "before", "k", "j"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                model = Endings({r["k"]: (r["used"], r["ends"], 0, 0, r["last"])}, *held)
                own = model.counts[r["k"]]
                same = r["j"] == r["k"]
                model.counts[r["j"]] = (*(own[:2] if same else (0, 0)), r["next_used"], r["next_ends"], own[4] if same else 0)
                out.append(answer(r["why"], r["word"], r["before"], model))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.string())], names=["why", "word", "before", "found"])

    asked = pending.select("why", "word", "before").distinct().mapInArrow(keyed, "why string, word string, before string, k string, j string")
    ends, after = counts.select(F.col("word").alias("k"), "used", "ends", "last"), counts.select(F.col("word").alias("j"), "next_used", "next_ends")
    met = asked.join(ends, "k", "left").join(after, "j", "left").fillna(0, list(COUNTS))
    return met.select("why", "word", "before", "k", "j", *COUNTS).mapInArrow(tell, "why string, word string, before string, found string").filter("found <> ''")


def cut_records(tables: dict[str, tuple[DataFrame, str, str, str]], baseline: float = BASELINE) -> tuple[DataFrame, DataFrame]:
    """The cut records of tables {name: (rows, id, source, text)}: (table_name, row_id, source, why); and how often each source cuts: (table_name, source, records, cut, share).

    A row delivered twice comes out once. Null and blank texts are not cut; empty tables give no rows. A null source is a source.
    """
    counts = materialize(ending_counts(*(rows.select(text) for rows, _, _, text in tables.values())))
    parts = []
    for name, (rows, row_id, source, text) in tables.items():
        rows = rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
        parts.append(questions(rows).withColumn("table_name", F.lit(name)))
    asked = materialize(reduce(DataFrame.unionByName, parts))
    columns = ["table_name", "row_id", "source", "why", "word", "before"]
    # only bare texts meet the habits of their sources
    bare, usual = asked.filter("why = 'unterminated'").alias("s"), habits(asked, baseline).withColumn("usual", F.lit(True)).alias("o")
    met = bare.join(usual, [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("table_name", "source", "size")], "left")
    why = F.when(F.col("usual") & (F.col("word") != ""), "bare?").otherwise(F.when(F.col("usual"), "").otherwise("unterminated"))
    bare = materialize(met.select("s.table_name", "row_id", "s.source", why.alias("why"), "word", "before"))
    pending = asked.filter("why like '%?'").select(columns).unionByName(bare.filter("why = 'bare?'"))
    told = materialize(answers(pending, counts))
    # rows without a question stay out of the join, where they would share one key
    judged = pending.join(told, ["why", "word", "before"]).select("table_name", "row_id", "source", F.col("found").alias("why"))
    settled = asked.filter("why <> 'unterminated' and why <> '' and why not like '%?'").select(judged.columns).unionByName(bare.filter("why = 'unterminated'").select(judged.columns))
    found = settled.unionByName(judged).groupBy("table_name", "row_id").agg(F.min("source").alias("source"), F.min("why").alias("why"))
    rates = asked.groupBy("table_name", "source").agg(F.count_distinct("row_id").alias("records"))
    cuts = found.groupBy("table_name", "source").agg(F.count("*").alias("cut"))
    report = rates.alias("r").join(cuts.alias("c"), (F.col("r.table_name") == F.col("c.table_name")) & F.col("r.source").eqNullSafe(F.col("c.source")), "left")
    report = report.select("r.table_name", "r.source", "r.records", F.coalesce("c.cut", F.lit(0)).alias("cut")).withColumn("share", F.col("cut") / F.col("records"))
    return found, report
