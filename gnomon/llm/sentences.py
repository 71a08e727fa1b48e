"""Sentence boundaries across languages and scripts.

Blank lines part units first. In Chinese and Japanese a lattice of the words of a
dictionary, counted over the corpus, is segmented around each gap, and final particles,
opening words and reporting verbs tell whether the gap ends a sentence. In spaced
scripts the terminators of a paragraph are the nodes of a lattice: each may end a
sentence or not, scored by the words beside it and by the end before it, and the best
path is taken. In Thai the spaces are classified by what stands beside them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.consistent import FOREIGN_TO_LATIN
from gnomon.session import materialize

# Words of many languages that show what a gap is.
#: Abbreviations before a name or figure, which never end a sentence.
BEFORE_NAME = frozenset("mr mrs ms messrs mme mlle dr prof rev capt col gen lt sgt maj st ste hon sir hr fr frl hrn sr sra srta d dña dn m mm h v p pp s cf vol no nr bd bl fig ch cap art ed n vgl vs op tel ul ул г гг д стр рис см проф др св им пл пер акад κ κα κος κυρ δρ καθ αρ σελ βλ د أ م ص डॉ श\u094dरी प\u094dरो स\u0902 प\u0943 प\u0902 क\u0941".split())
#: Abbreviations that may also be a sentence's last word.
MAY_END = frozenset("etc esq jr sr co ltd inc bros usw bzw u.s.w a.m p.m am pm a.d b.c e.g i.e z.b d.h т.д т.п т.е т.к и.т.д и.т.п н.э κ.λπ κ.ά π.χ κλπ μ.μ π.μ p.ej ee.uu av j.-c ibid al".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split())
#: Opening words, for where the corpus hasn't enough.
OPENERS = frozenset(
    "the a an it he she they we i you there this that these those in on at by for from with if when while nobody somebody everyone no some all what who why where how neither as but and then towards beyond once one two three under over after before his her their our my its not yet so such many most each every "
    "der die das ein eine er sie es wir ich im am um in der den dem war ist als wenn da doch und aber niemand "
    "le la les un une il elle on nous je dans en au aux ce cette où qui que quand mais et puis personne "
    "el la los las un una él ella nadie en al con por para cuando pero y entonces "
    "он она оно они мы я вы в на по но и а когда как никто всё это "
    "ο η το οι τα ένας μία αυτός αυτή κανείς στο στη όταν και αλλά".split()
)
REPORTING = frozenset(
    "said asked cried replied answered whispered shouted murmured muttered called exclaimed remarked added declared inquired enquired demanded "
    "sagte fragte rief antwortete dit demanda cria répondit murmura dijo preguntó gritó respondió murmuró contestó exclamó "
    "сказал сказала спросил спросила крикнул крикнула ответил ответила είπε ρώτησε φώναξε απάντησε "
    "قال قالت سأل سألت صاح صاحت أجاب أجابت همس कहा प\u0942छा बोला बोली चिल\u094dलाया प\u0941कारा".split()
)
ZH_REPORTING = ("说道", "问道", "答道", "喊道", "叫道", "说", "问", "答", "喊", "叫", "道", "想", "写")
JA_REPORTING = ("と", "って")
FINAL_PARTICLES = frozenset("了 吗 呢 吧 啊 呀 的 か だ た よ ね な す る い คร\u0e31บ ค\u0e48ะ คะ นะ แล\u0e49ว".split())
# Fixed values end.

#: Shares of all letters of spaceless scripts, and of all lower-case words, from which on a word is in the model: it holds no more than the inverse, however large the corpus. Of few uses nothing is learned.
DICTIONARY_SHARE, COMMON_SHARE, LEAST_USES = 5e-6, 1e-6, 3
LONE = -1.5  #: of two ends with nothing between but single letters and figures
COUNTED_AT_ONCE = 500_000  #: words whose counts a task holds before it passes them on to be summed
LONGEST_WORD = 6
LOOK_AHEAD = 240  #: characters behind a terminator that are read to judge it, from the next visible one on

_blank = re.compile(r"(?:\r\n?|[\n\x0b\x0c\x85  ])(?:[^\S\r\n]*(?:\r\n?|[\n\x0b\x0c\x85  ]))+| |\x0c")
_rule_line = re.compile(r"(?:(?<=\n)|(?<=\r)|\A)[ \t]*[*#=_~•·+\-–—][*#=_~•·+\-–— \t]*(?=[\r\n]|\Z)")
_edges = " \t\r\n\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a  \u202f\u205f\u3000\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad\u180e\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
_thai, _cjk = regex.compile(r"\p{Thai}"), regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_letter = regex.compile(r"\p{L}")
_greek = regex.compile(r"\p{Greek}")
_arabic_indic = regex.compile(r"[\p{Arabic}\p{Devanagari}]")
_end = regex.compile(r"(?:[.!?…‼⁇⁈⁉؟۔।॥;]|(?<=\p{Greek});|[—–]+(?=[”\"»’]))+(?P<close>(?:[\"'”’“‘»›)\]}]|[ \xa0\u202f\u2009](?:»|›))*)")
_end_not_greek = re.compile(r"(?:[.!?…‼⁇⁈⁉؟۔।॥;]|[—–]+(?=[”\"»’]))+(?P<close>(?:[\"'”’“‘»›)\]}]|[ \xa0\u202f\u2009](?:»|›))*)")
_next_ascii_word = re.compile(r"[A-Za-z0-9]+(?:['.-][A-Za-z0-9]+)*")
_cjk_end = re.compile(r"(?:[。！？!?｡]|…+|⋯+)+(?P<close>[”’」』）〉》】\"')\]]*)")
_next_word = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[’'.-][\p{L}\p{M}\p{N}]+)*")
_last_word = regex.compile(r"(?:[\p{L}\p{M}\p{N}]+(?:[.’'-] ?(?=[\p{L}\p{N}]))?)*[\p{L}\p{M}\p{N}]$")
_dotted = regex.compile(r"(?:(?<![\p{L}\p{N}])\p{L}{1,3}\.[ \xa0]?)*(?<![\p{L}\p{N}])[\p{L}\p{M}]+$")
_speaker = regex.compile(r"(?:(?:\p{Lu}[\p{L}’'-]*\.?|the|der|die|le|la|el)\s+(?:\p{Ll}+\s+)??){1,4}?(\p{Ll}+)\b(?!\s+(?:that|the|a|an|it|for)\b)")
_figure = re.compile(r"(?<![^\W_])\d{1,4}$")
_roman = re.compile(r"(?<![^\W_])[ivxlc]+$")
_noise = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\uff01-\uff5e\ufb00-\ufb06]")
_foreign, _ascii_letter = re.compile("[\u0370-\u058f\u1f00-\u1fff]"), re.compile("[A-Za-z\u00c0-\u024f]")
_alnum, _letters, _long_word = re.compile(r"[^\W_]"), re.compile(r"[^\W\d_]{2}"), regex.compile(r"(?:\p{L}\p{M}*){2}")
_caseless_start = regex.compile(r"[\p{Arabic}\p{Devanagari}]")
_cjk_run = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]+")
_lower_word = regex.compile(r"(?<![\p{L}\p{N}’'-])\p{Ll}[\p{Ll}\p{M}]+")
_dash_lead = re.compile(r"[—–-]\s")
_dash_on = regex.compile(r"[—–-]\s*\p{Ll}")
_tail = regex.compile(r"[\p{L}\p{M}]+$")
_initial = regex.compile(r"\p{L}\.")
_one_letter = regex.compile(r"\p{L}\p{M}*")
_spaceless = regex.compile(r"[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]")
_ignored = re.compile("[\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff]")
_mixed = regex.compile(r"\p{L}*(?:\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{Latin})\p{L}*")
_latin = str.maketrans(FOREIGN_TO_LATIN)


class Lexicon:
    """Words with their counts in texts of spaceless scripts, and how often they open a sentence."""

    def __init__(self, counts: dict[str, int], opens: dict[str, int]) -> None:
        self.total = sum(counts.values()) or 1
        self.counts, self.opens = counts, opens

    def segment(self, text: str) -> list[str]:
        """The best path through the lattice of dictionary words over ``text``; a letter in no word is one itself."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = []
            for start in range(max(0, end - LONGEST_WORD), end):
                n = self.counts.get(text[start:end], 0)
                if n or end - start == 1:
                    options.append((best[start][0] + math.log((n or 0.1) / self.total), start))
            best.append(max(options))
        words, at = [], len(text)
        while at:
            words.append(text[best[at][1] : at])
            at = best[at][1]
        return words[::-1]

    def opening(self, text: str) -> float:
        """The share of the uses of the first word of ``text`` that open a sentence."""
        words = self.segment(text[: 4 * LONGEST_WORD])
        return self.opens.get(words[0], 0) / max(1, self.counts.get(words[0], 0)) if words else 0.0

    def final(self, text: str) -> bool:
        """Whether ``text`` ends with a final particle."""
        words = self.segment(text[-4 * LONGEST_WORD :])
        return bool(words) and (words[-1] in FINAL_PARTICLES or words[-1][-1] in FINAL_PARTICLES)


class Case:
    """The words that are commonly written in lower case, with their counts: a capital on such a word opens a sentence."""

    def __init__(self, lower: dict[str, int]) -> None:
        self.lower = lower

    def common(self, word: str) -> bool:
        return word.lower() in OPENERS or word.lower() in self.lower


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """The pieces between blank lines, and between lines that are only a rule."""
    cuts = sorted([*((m.start(), m.end()) for m in _blank.finditer(text)), *((m.start(), m.end()) for m in _rule_line.finditer(text))])
    at = 0
    for a, b in cuts:
        if a > at:
            yield at, a
        at = max(at, b)
    if at < len(text):
        yield at, len(text)


def kind_of(text: str) -> str:
    """thai, cjk or spaced: the script of most of its letters."""
    if text.isascii() or not _spaceless.search(text):
        return "spaced"
    thai, cjk, letters = len(_thai.findall(text)), len(_cjk.findall(text)), len(_letter.findall(text))
    return "thai" if 2 * thai > letters else "cjk" if 2 * cjk > letters else "spaced"


def thai_gaps(text: str, lexicon: Lexicon) -> Iterator[int]:
    """A space ends a sentence unless a figure or an abbreviated word with its period stands beside it."""
    for m in re.finditer(r"[^\S\r\n]+", text):
        before, after = text[: m.start()], text[m.end() :]
        if not before.strip(_edges) or not after.strip(_edges) or after[:1] in "\r\n" or before[-1:] in "\r\n":
            continue
        word_before, word_after = before.split()[-1], after.split()[0]
        if before[-1].isdigit() or after[0].isdigit() or re.search(r"[^\W\d_.]\.$", word_before) or re.match(r"(?:[^\W\d_]{1,4}\.)+$", word_after):
            continue
        if after[0] in ",;:!?)]}”’»ๆฯ" or before[-1] in "([{“‘«":
            continue
        yield m.start()


def cjk_gaps(text: str, lexicon: Lexicon) -> Iterator[int]:
    for m in _cjk_end.finditer(text):
        after = text[m.end() :].lstrip(_edges)
        if not after:
            continue
        mark, closed = text[m.start() : m.start("close")], m["close"]
        if after[0] in "，、；：,;:)）":
            continue
        if re.search("[”’」』\"']", closed):
            if after.startswith(JA_REPORTING):
                continue
            clause = re.split("[。！？!?…“「『，]", after, maxsplit=1)[0]
            words = lexicon.segment(clause) if clause else []
            if not re.match("[“「『]", after) and any(w.endswith(ZH_REPORTING) for w in words[-3:]):
                continue
        if not mark.strip("…⋯") and not lexicon.final(text[max(0, m.start() - 24) : m.start()]) and lexicon.opening(after) < 0.5:
            continue  # an omission goes on unless a final particle or an opening word stands beside it
        if not mark.strip("…⋯") and lexicon.opening(after) < 0.2:
            continue
        yield m.end()


def _reports(after: str, caseless: bool) -> bool:
    """Whether the clause behind a quotation reports it: in scripts without capitals it holds a verb of speech, else such a verb follows the speaker."""
    if caseless:
        clause = regex.split(r"[.!?…؟।:;“”«»\"](?:\s|$)", after, maxsplit=1)[0]
        return any(w.strip("—–-،,") in REPORTING for w in clause.split())
    m = _speaker.match(after)
    return bool(m) and m[1].lower() in REPORTING


def spaced_gaps(text: str, case: Case) -> list[int]:
    """The places where sentences end, by the best path through the lattice of terminators."""
    nodes: list[tuple[int, float]] = []
    greek = not text.isascii() and bool(_greek.search(text))
    clean = text.isascii() or not (_noise.search(text) or _foreign.search(text) and _ascii_letter.search(text))
    for m in (_end if greek else _end_not_greek).finditer(text):
        marks, closed = text[m.start() : m.start("close")], m["close"]
        rest = text[m.end() : m.end() + LOOK_AHEAD]
        ahead = rest.lstrip(_edges)
        if not ahead and m.end() + LOOK_AHEAD < len(text):
            ahead = text[m.end() :].lstrip(_edges)[:LOOK_AHEAD]
        if not ahead:
            continue
        if ";" in marks and not greek:
            continue
        glued = len(rest) == len(ahead) and rest[:1] not in _edges
        if glued and not (_caseless_start.match(rest) and marks[0] in "؟।॥۔"):
            continue  # figures, dotted abbreviations, marks in a row
        if ahead[0] in ",;:،؛)" or ahead[0] in "—–-" and _dash_on.match(ahead):
            continue
        nodes.append((m.end(), _score(text, m.start(), marks, closed, ahead, case, str if clean else plain)))
    return best_path(text, nodes)


def best_path(text: str, nodes: list[tuple[int, float]]) -> list[int]:
    """The ends with the greatest sum of scores, a path through a lattice of two states for each terminator: it ends a sentence or not.

    Between two ends must stand a letter or digit, and two neighbours that both end one lose if nothing but single letters and figures stands between.
    """
    open_, ended = (0.0, None), None  # best values so far, each with its chain of ends; None if no path leads there
    at, begun = 0, False
    for end, score in nodes:
        apart = _alnum.search(text, at, end) is not None
        begun = begun or apart
        ways = []
        if begun:
            ways.append((open_[0] + score, open_))
            if ended and apart:
                ways.append((ended[0] + score + (0.0 if _letters.search(text, at, end) or _long_word.search(text, at, end) else LONE), ended))
        better = max((x for x in (open_, ended) if x), key=lambda x: x[0])
        way = max(ways, key=lambda x: x[0], default=None)
        open_, ended = (better[0], better[1]), way and (way[0], (end, way[1][1]))
        at = end
    chain = max((x for x in (open_, ended) if x), key=lambda x: x[0])[1]
    path = []
    while chain:
        path.append(chain[0])
        chain = chain[1]
    return path[::-1]


def plain(text: str) -> str:
    """What is read of a stretch of text: compatibility forms folded, ignorables left out, and words of mixed script in Latin."""
    if text.isascii() or not (_noise.search(text) or _foreign.search(text) and _ascii_letter.search(text)):
        return text
    text = _ignored.sub("", unicodedata.normalize("NFKC", text).replace("\u2026", "..."))
    return _mixed.sub(lambda m: m[0].translate(_latin), text)


def _score(text: str, at: int, marks: str, closed: str, ahead: str, case: Case, read: Callable[[str], str] = plain) -> float:
    """How much more likely a terminator is to end a sentence than not; stretches of text are read by ``read``."""
    ahead = read(ahead)
    word = (_next_ascii_word if ahead.isascii() else _next_word).search(ahead)
    lead = ahead[: word.start()] if word else ahead
    nxt = word[0] if word else ""
    quoted = bool(closed) and any(c in closed for c in "”’“‘»›\"'")
    if nxt and nxt[0].islower():
        return -5.0
    caseless = bool(nxt) and nxt[0].isalpha() and not nxt[0].isupper()
    opens = bool(lead) and (any(c in lead for c in "“„«‹‘([¿¡\"'") or _dash_lead.match(lead) is not None)
    if quoted and not opens and marks[-1] not in ".।" and _reports(ahead, caseless):
        return -4.0
    if marks[-1] != "." or marks.strip("."):
        return 3.0
    before = read(text[max(0, at - 40) : at])
    whole = before[before.rfind(" ") + 1 :]
    if len(whole) > 3 and whole.isalpha() and not _roman.fullmatch(whole) and (low := whole.lower()) not in BEFORE_NAME and low not in MAY_END:
        return 2.0  # a plain word
    if m := _figure.search(before):
        month = nxt.lower() in MONTHS
        return -3.0 if month and int(m[0]) <= 31 else 2.0
    if _roman.search(before) and regex.search(r"(?:vol|cap|ch|bd|p|pp|t)\.?\s+$", before[: _roman.search(before).start()].lower()):
        return -2.0
    m = _dotted.search(before)
    if not m:
        return 2.0
    last = m[0].replace("\xa0", " ")
    bare = last.replace(" ", "").lower()
    tail = _tail.search(last)[0]
    if quoted or closed.strip():
        return 2.0 if bare not in BEFORE_NAME else -1.0
    if bare in MAY_END or tail.lower() in MAY_END and "." not in last:
        return 2.0 if opens or nxt and not nxt[0].isdigit() and case.common(nxt) and not _initial.match(ahead) else -2.0
    if bare in BEFORE_NAME or tail.lower() in BEFORE_NAME and "." in last:
        return -3.0
    if _one_letter.fullmatch(tail):
        # an initial, or a letter of a dotted abbreviation; a one-letter word ends a sentence only before an opening word
        return -2.0 if tail.isupper() or "." in last or caseless or not case.common(nxt) else 1.0
    return 2.0


def heading(text: str) -> bool:
    """Whether a paragraph is a heading: chapter words with a number, a number before words without a closing mark, or a short line all in capitals."""
    line = text.strip(_edges)
    if len(line) > 80:
        return False
    if re.match(r"(?:[IVXLC]+|\d{1,3})\.\s+\S", line) and not re.search(r"[\r\n]|[.!?…:;][\"'”’»)]*$", line):
        return True
    if re.match(r"(?i)(?:chapter|kapitel|chapitre|capítulo|глава|κεφάλαιο|अध\u094dयाय|الفصل|book|part|volume|livre|teil|parte|часть)\s+[\w.]+", line) and "\n" not in line:
        return True
    return line.upper() == line and line.lower() != line and len(line.split()) <= 10 and not re.search(r"[!?”\"]", line)


def sentences(text: str | None, lexicon: Lexicon, case: Case) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points; none for a null or blank text."""
    out = []
    for a, b in paragraphs(text or ""):
        piece = text[a:b]
        kind = kind_of(piece)
        gaps = [] if heading(piece) else list(thai_gaps(piece, lexicon)) if kind == "thai" else list(cjk_gaps(piece, lexicon)) if kind == "cjk" else spaced_gaps(piece, case)
        at = 0
        for gap in [*gaps, len(piece)]:
            unit = piece[at:gap]
            left = len(unit) - len(unit.lstrip(_edges))
            right = len(unit.rstrip(_edges))
            if right > left and _alnum.search(unit):
                out.append((a + at + left, a + at + right))
            at = gap
    return out


def train(documents: DataFrame, text_column: str = "text") -> tuple[Lexicon, Case]:
    """The dictionary of Chinese and Japanese and the lower-case words, counted over all documents; of each those of the stated shares. Thai gaps need no dictionary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, opens, lower = Counter(), Counter(), Counter()

        def counted() -> pa.RecordBatch:
            rows = [("w", w, n, opens[w]) for w, n in words.items()] + [("l", w, n, 0) for w, n in lower.items()]
            words.clear(), opens.clear(), lower.clear()
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "word", "n", "opens"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                lower.update(_lower_word.findall(text))
                if len(words) + len(lower) > COUNTED_AT_ONCE:
                    yield counted()
                if text.isascii() or not _cjk.search(text):
                    continue
                for run in _cjk_run.finditer(text):
                    s = run[0]
                    first = run.start() == 0 or text[run.start() - 1] in "。！？\n“「『"
                    for n in range(1, LONGEST_WORD + 1):
                        words.update(s[i : i + n] for i in range(len(s) - n + 1))
                        if first and len(s) >= n:
                            opens[s[:n]] += 1
        yield counted()

    counted = documents.select(text_column).mapInArrow(count, "kind string, word string, n bigint, opens bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("opens").alias("opens"))
    counted = materialize(counted)
    sums = {r.kind: r.n for r in counted.filter((F.col("kind") == "l") | (F.char_length("word") == 1)).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    found: dict[str, dict[str, int]] = {}
    opens: dict[str, int] = {}
    for kind, share in (("w", DICTIONARY_SHARE), ("l", COMMON_SHARE)):
        least = max(LEAST_USES, share * sums.get(kind, 0))
        single = (F.char_length("word") == 1) & (F.col("n") >= share * sums.get(kind, 0))
        rows = counted.filter((F.col("kind") == kind) & ((F.col("n") >= least) | (single if kind == "w" else F.lit(False)))).collect()
        found[kind] = {r.word: r.n for r in rows}
        opens |= {r.word: r.opens for r in rows if r.opens}
    # a longer word must hold together: seen nearly as often as its rarer half alone would make it
    total = sum(n for w, n in found["w"].items() if len(w) == 1) or 1
    kept = {w: n for w, n in found["w"].items() if len(w) == 1 or all(n * total > 20 * found["w"].get(w[:i], n) * found["w"].get(w[i:], n) for i in range(1, len(w)))}
    return Lexicon(kept, {w: n for w, n in opens.items() if w in kept}), Case(found["l"])


def split(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", numbered: bool = False) -> DataFrame:
    """One row per sentence: its document, start_char and end_char in code points; if ``numbered``, also its number in the document from 1 and its text (sentence, unit).

    Null, empty and blank texts and lines without letters or digits give no rows; repeated rows repeat their sentences; other columns don't matter.
    """
    lexicon, case = train(documents, text_column)
    shared = documents.sparkSession.sparkContext.broadcast((lexicon.counts, lexicon.opens, case.lower))
    fields = {id_column: pa.int64(), "start_char": pa.int64(), "end_char": pa.int64()} | ({"sentence": pa.int32(), "unit": pa.string()} if numbered else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, opens, lower = shared.value
        held = Lexicon(counts, opens), Case(lower)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (a, b) in enumerate(sentences(text, *held), 1):
                    out.append((doc, a, b, i, text[a:b]) if numbered else (doc, a, b))
            columns = list(zip(*out)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], names=list(fields))

    return documents.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(run, f"{id_column} bigint, start_char bigint, end_char bigint" + (", sentence int, unit string" if numbered else ""))
