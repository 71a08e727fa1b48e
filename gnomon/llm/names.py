"""Variant spellings of names, by merge-and-rematch entity resolution.

Each distinct string becomes a profile. Profiles meet in blocks, matched profiles are
merged, which unions their spellings and initials, and the richer profiles enter
blocking again until no further merge occurs. Merges go from strong evidence to weak,
and a poor profile (initials, no middle name) is merged only if a single richer one
fits it, so that two members of a family are never joined through their initials.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.session import materialize, release

# Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "alex": "alexander", "alec": "alexander", "sandy": "alexander", "aggie": "agnes", "nessie": "agnes", "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "ced": "cedric",
    "charlie": "charles", "chas": "charles", "chuck": "charles", "clarrie": "clara", "dan": "daniel", "danny": "daniel", "dot": "dorothy", "dolly": "dorothy", "dottie": "dorothy", "dora": "dorothy", "edie": "edith", "ed": "edward edwin", "eddie": "edward", "ned": "edward edmund",
    "ted": "edward theodore", "teddy": "theodore edward", "nell": "eleanor helen", "ellie": "eleanor", "nellie": "eleanor", "nora": "eleanor", "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "bess": "elizabeth", "ernie": "ernest", "flo": "florence", "florrie": "florence",
    "fran": "frances", "fanny": "frances", "frank": "francis frances", "fred": "frederick wilfred", "freddie": "frederick", "freddy": "frederick", "gertie": "gertrude", "trudy": "gertrude", "hattie": "harriet", "hal": "henry harold", "harry": "henry harold harriet", "hank": "henry", "jim": "james", "jimmy": "james", "jamie": "james",
    "jo": "josephine joseph", "josie": "josephine", "joe": "joseph", "joey": "joseph", "jos": "joseph", "judy": "judith", "kate": "katherine", "kathy": "katherine", "kitty": "katherine", "katie": "katherine", "kit": "katherine", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "madge": "margaret", "daisy": "margaret",
    "matt": "matthew", "mattie": "matthew martha", "mike": "michael", "mick": "michael", "mickey": "michael", "nick": "nicholas", "penny": "penelope", "percy": "percival", "pippa": "philippa", "becky": "rebecca", "reba": "rebecca", "dick": "richard", "rick": "richard", "rich": "richard", "richie": "richard", "rob": "robert", "bob": "robert",
    "bobby": "robert", "robbie": "robert", "bert": "robert albert", "rosie": "rosalind", "ros": "rosalind", "roz": "rosalind", "sam": "samuel", "sammy": "samuel", "si": "silas", "sue": "susan", "susie": "susan", "suzy": "susan", "theo": "theodore theo", "tom": "thomas", "tommy": "thomas", "thos": "thomas", "toby": "tobias", "vicky": "victoria",
    "tori": "victoria", "vic": "victoria", "bill": "william", "billy": "william", "will": "william", "willie": "william", "wm": "william", "liam": "william", "zach": "zacharias", "zack": "zacharias", "geo": "george", "jas": "james", "jno": "john", "jack": "john", "robt": "robert", "saml": "samuel", "benj": "benjamin", "edw": "edward", "alf": "alfred",
    "chris": "christopher", "pat": "patrick patricia", "steve": "stephen", "dave": "david", "andy": "andrew", "greg": "gregory", "jeff": "geoffrey", "lottie": "charlotte", "molly": "mary", "polly": "mary", "sally": "sarah", "nan": "anne", "nancy": "anne", "tess": "theresa", "winnie": "winifred", "lina": "carolina", "viv": "vivian", "lavvy": "lavinia", "vinnie": "lavinia",
}
# Written forms of one word.
WORD_FORMS = {
    "&": "and", "co": "company", "comp": "company", "coy": "company", "dept": "department", "univ": "university", "rly": "railway", "ry": "railway", "bro": "brotherhood", "bros": "brothers", "comm": "committee", "cttee": "committee", "roy": "royal", "soc": "society", "hist": "historical", "assoc": "association", "assn": "association",
    "obs": "observatory", "inst": "institute", "lit": "literary", "ptg": "printing", "print": "printing", "pr": "press", "intl": "international", "natl": "national", "st": "saint", "hon": "honourable", "honorable": "honourable", "mr": "mister", "gray": "grey", "harbor": "harbour", "vol": "volume", "v": "volume", "colour": "color",
    "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine", "10": "ten", "11": "eleven", "12": "twelve", "harbors": "harbours", "theater": "theatre", "centre": "center",
}
ROMAN = {"1": "i", "2": "ii", "3": "iii", "4": "iv", "5": "v", "6": "vi", "7": "vii", "8": "viii", "9": "ix", "10": "x"}
HONORIFICS = frozenset("sir dr rev capt prof mr mrs miss ms lady lord col gen lt maj hon dame fr saint".split())
ORGANISATION = frozenset("of and the for company press society association university department committee brotherhood railway observatory institute college council club guild board office library museum historical literary printing royal".split())
NOBODY = frozenset("anon anonymous unknown none null nobody na n/a various untitled - ? unsigned author".split())
# Fixed values end.

STRONG, MIDDLE, INITIAL = 3, 2, 1
ANY, POOR, RICH = 0, 1, 2  #: roles in a block; two rich ones aren't compared
PROFILE = "field string, pid bigint, kind string, spellings array<string>, weights array<string>, jr boolean"


def folded(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def token_form(tokens: list[str]) -> list[str]:
    """Title or organisation words in one written form; a number behind ``volume`` is a roman one; the article the is left out."""
    out: list[str] = []
    for t in tokens:
        after = bool(out) and out[-1] in ("volume", "part", "book")
        t = ROMAN.get(t, t) if after else t if after and t == "v" else WORD_FORMS.get(t, t)
        if t != "the":
            out.append(t)
    return sorted(out)


def parse(field: str, name: str) -> tuple[str, str, bool] | None:
    """(kind, spelling, junior) of a name, or None if it names nobody.

    A person's spelling is ``surname|first|middles``, all else is sorted words.
    """
    text = folded(name).replace("’", "'").strip(" \t\r\n_\"“”'.*")
    text = re.sub(r"\s+", " ", text)
    if not re.search(r"\w", text) or text.strip(" .()") in NOBODY:
        return None
    if field != "author":
        tokens = re.findall(r"[^\W_]+|&", text.replace("'", ""))
        return ("tokens", " ".join(token_form(tokens)), False) if tokens else None
    text = re.sub(r"\((?:pseud|pen name|pseudonym)\.?\)?", " ", text).strip(" _\"“”'")
    junior = bool(re.search(r"\b(?:jr|junior)\b", text))
    text = re.sub(r",?\s*\b(?:jr|junior|sr|senior|esq)\b\.?", "", text).strip(" ,")
    if not text or text in NOBODY:
        return None
    words = [w for w in re.findall(r"[^\W_]+|&", text.replace("'", "")) if w]
    written = token_form(words)
    if any(w in ORGANISATION or len(w) >= 6 and any(len(o) >= 6 and near(w, o) for o in ORGANISATION) for w in [*words, *written]) or "&" in words:
        return "tokens", " ".join(written), False
    if "," in text:
        last, _, given = text.partition(",")
        text = f"{given.strip()} {last.strip()}"
    parts = re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", text)
    while len(parts) > 1 and parts[0] in HONORIFICS:
        parts = parts[1:]
    if len(parts) == 1:
        return ("mono", parts[0], junior) if parts[0] not in NOBODY else None
    if len(parts[-1]) == 1:
        return "tokens", " ".join(sorted(parts)), junior
    return "person", f"{parts[-1]}|{parts[0]}|{' '.join(parts[1:-1])}", junior


def near(a: str, b: str) -> bool:
    """Whether two words are one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and len(x) > 1 and x[2:] == y[2:])


def dropped(word: str) -> set[str]:
    """The word and the word without each of its letters: words that are near share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def given_forms(name: str) -> set[str]:
    return {*NICKNAMES.get(name, "").split()} or {name}


def same_given(a: str, b: str) -> int:
    """2 for one given name or its short form, 1 if a slip apart, else 0."""
    if a == b or given_forms(a) & given_forms(b) or given_forms(a) & {b} or given_forms(b) & {a}:
        return 2
    return int(min(len(a), len(b)) >= 3 and near(a, b))


class Person:
    """The union of a profile's spellings."""

    def __init__(self, spellings: list[str]) -> None:
        self.rows = [s.split("|") for s in spellings]
        self.surnames = {r[0] for r in self.rows}
        self.firsts = {r[1] for r in self.rows if len(r[1]) > 1}
        self.initials = {r[1] for r in self.rows if len(r[1]) == 1}
        middles = {r[2] for r in self.rows if r[2]}
        self.middles, self.middle_initials = {m for m in middles if len(m) > 1 and not re.fullmatch(r"(?:\w )+\w", m)}, {m for m in middles if len(m) == 1 or re.fullmatch(r"(?:\w )+\w", m)}

    @property
    def richness(self) -> tuple[int, int, int]:
        return (bool(self.firsts), 2 * bool(self.middles) or int(bool(self.middle_initials)), len(self.rows))

    def first_letters(self) -> set[str]:
        return {x[0] for f in self.firsts for x in {f, *given_forms(f)}} | self.initials

    def keys(self) -> Iterator[tuple[str, int]]:
        """Blocking keys with their roles, from every surname of the union with every initial, and from surnames and given names with a slip.

        Two profiles with given names meet by these, so in a block of an initial only profiles without are compared, with each other and with the rest.
        """
        role = RICH if self.firsts else POOR
        for s in self.surnames:
            yield from ((f"i|{s}|{i}", role) for i in self.first_letters())
            yield from ((f"s|{s}|{d}", ANY) for f in self.firsts for d in dropped(f))
            yield from ((f"t|{d}|{g}", ANY) for d in dropped(s) for f in self.firsts or self.initials for g in given_forms(f))


def same_middles(a: Person, b: Person) -> int | None:
    """None if the middle names exclude each other, 2 if both have them, 1 if one has, 0 if neither."""
    for x in a.middles | a.middle_initials:
        for y in b.middles | b.middle_initials:
            full = x in a.middles and y in b.middles
            if full and not same_given(x, y) or not full and [w[0] for w in x.split()] != [w[0] for w in y.split()]:
                return None
    return bool(a.middles | a.middle_initials) + bool(b.middles | b.middle_initials)


def match_persons(a: Person, b: Person) -> int:
    """STRONG, MIDDLE (one lacks a middle name), INITIAL (one has initials only) or 0."""
    middles = same_middles(a, b)
    if middles is None:
        return 0
    slips = 0 if a.surnames & b.surnames else 1
    if slips and not any(min(len(x), len(y)) >= 5 and near(x, y) for x in a.surnames for y in b.surnames):
        return 0
    if a.firsts and b.firsts:
        alike = [same_given(x, y) for x in a.firsts for y in b.firsts]
        if 2 not in alike and (slips or 1 not in alike) or 0 in alike and not _one_name(a.firsts | b.firsts):
            return 0
        return MIDDLE if middles == 1 else STRONG
    if not (a.first_letters() & b.first_letters()) or slips and (a.firsts or b.firsts or middles != 2):
        return 0
    return INITIAL


def _one_name(firsts: set[str]) -> bool:
    """Whether given names form one by short forms and slips, some pairs only through a third."""
    left, reached = set(firsts), {min(firsts)}
    while grown := {x for x in left - reached if any(same_given(x, y) for y in reached)}:
        reached |= grown
    return reached == left and len({x for f in firsts for x in given_forms(f) if sum(same_given(f, g) == 2 for g in firsts) > 1}) <= 1


def token_keys(spelling: str) -> Iterator[str]:
    tokens = spelling.split(" ")
    for i, t in enumerate(tokens):
        rest = " ".join(tokens[:i] + tokens[i + 1 :])
        if len(t) >= 3:
            yield from (f"{rest}|{d}" for d in dropped(t))


def match_tokens(a: list[str], b: list[str], wa: list[str], wb: list[str], mono: bool) -> int:
    """STRONG if some spelling of each differ by one slip in one word that isn't two well-known words; a word's weight is the number of profiles that hold it."""
    for x, p in zip(a, wa):
        for y, q in zip(b, wb):
            if x == y:
                return STRONG
            s, t = x.split(" "), y.split(" ")
            if len(s) != len(t):
                continue
            weights = dict(zip(s, map(int, p.split(" ")))) | dict(zip(t, map(int, q.split(" "))))
            only_s, only_t = list(s), list(t)
            for w in s:
                if w in only_t:
                    only_s.remove(w)
                    only_t.remove(w)
            if len(only_s) == 1 and min(len(only_s[0]), len(only_t[0])) >= (6 if mono else 3) and max(len(only_s[0]), len(only_t[0])) >= 4:
                u, v = only_s[0], only_t[0]
                low, high = sorted((weights[u], weights[v]))
                if near(u, v) and not (low >= 3 and low > 0.05 * high) and not re.fullmatch("[ivx]+|\\d+", u) and not re.fullmatch("[ivx]+|\\d+", v):
                    return STRONG
    return 0


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def profiles_of(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct (field, name): the spelling of each name (field, name, pid), and the first profiles."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, n, *p) for f, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (p := parse(f, n))]
            rows = [(f, n, _hash(f"{f}|{k}|{s}|{j}"), k, s, j) for f, n, k, s, j in rows]
            columns = list(zip(*rows)) or [[]] * 6
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["field", "name", "pid", "kind", "spelling", "jr"])

    spelled = materialize(names.mapInArrow(parsed, "field string, name string, pid bigint, kind string, spelling string, jr boolean"))
    first = spelled.groupBy("pid").agg(*(F.first(c).alias(c) for c in ("field", "kind", "spelling", "jr")))
    places = first.filter("kind <> 'person'").select("pid", "field", F.posexplode(F.split("spelling", " ")).alias("place", "word"))
    weights = places.groupBy("field", "word").agg(F.count_distinct("pid").alias("weight"))
    held = places.join(weights, ["field", "word"]).groupBy("pid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "weight"))), lambda x: x["weight"].cast("string")), " ").alias("weights"))
    first = first.join(held, "pid", "left").select("field", "pid", "kind", F.array("spelling").alias("spellings"), F.array(F.coalesce("weights", F.lit(""))).alias("weights"), "jr")
    return spelled.select("field", "name", "pid"), materialize(first)


def blocked(profiles: DataFrame) -> DataFrame:
    """(pid, key, role) of profiles."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for p in batch.to_pylist():
                head = f"{p['field']}|{p['kind']}|{p['jr']}|"
                found = set(Person(p["spellings"]).keys()) if p["kind"] == "person" else {(k, ANY) for s in p["spellings"] for k in token_keys(s)}
                out += [(p["pid"], _hash(head + k), role) for k, role in found]
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int8()))], names=["pid", "key", "role"])

    return profiles.mapInArrow(keys, "pid bigint, key bigint, role tinyint")


def matched(pairs: DataFrame) -> DataFrame:
    """(a, b, level, a_richer) of pairs of profiles that match."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == "person":
                    x, y = Person(r["spellings"]), Person(r["spellings_b"])
                    level = match_persons(x, y)
                    richer = x.richness[:2] > y.richness[:2]
                else:
                    level, richer = match_tokens(r["spellings"], r["spellings_b"], r["weights"], r["weights_b"], r["kind"] == "mono"), True
                if level:
                    out.append((r["a"], r["b"], level, richer))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=["a", "b", "level", "a_richer"])

    return pairs.mapInArrow(judge, "a bigint, b bigint, level int, a_richer boolean")


def edges(profiles: DataFrame, keys: DataFrame, fresh: DataFrame) -> DataFrame:
    """Matches of the profiles with ``fresh`` keys with all profiles. Rich profiles of a block meet only its others, so a block is never paired with itself for its initial alone."""
    others = keys.select("key", F.col("pid").alias("other"), F.col("role").alias("other_role"))
    met = None
    for asks, meets in ((ANY, (ANY,)), (POOR, (POOR, RICH)), (RICH, (POOR,))):
        part = fresh.filter(F.col("role") == asks).select("key", "pid").join(others.filter(F.col("other_role").isin(*meets)).select("key", "other"), "key")
        met = part if met is None else met.unionByName(part)
    met = met.filter("pid <> other").select(F.least("pid", "other").alias("a"), F.greatest("pid", "other").alias("b")).distinct()
    left = profiles.withColumnRenamed("pid", "a")
    right = profiles.select(F.col("pid").alias("b"), F.col("spellings").alias("spellings_b"), F.col("weights").alias("weights_b"))
    return matched(met.join(left, "a").join(right, "b").select("a", "b", "kind", "spellings", "weights", "spellings_b", "weights_b"))


def chosen(found: DataFrame) -> DataFrame:
    """The edges to merge now: all strong ones if there are any; else those of poor profiles that one richer profile fits, missing middle names before initials."""
    levels = {r.level for r in found.select("level").distinct().collect()}
    if STRONG in levels:
        return found.filter(F.col("level") == STRONG).select("a", "b")
    for level in (MIDDLE, INITIAL):
        if level in levels:
            poor = found.filter(F.col("level") == level).select(F.when(F.col("a_richer"), F.col("b")).otherwise(F.col("a")).alias("poor"), F.when(F.col("a_richer"), F.col("a")).otherwise(F.col("b")).alias("rich"))
            single = poor.groupBy("poor").agg(F.count("*").alias("n"), F.min("rich").alias("rich")).filter("n = 1")
            picked = materialize(single.select(F.least("poor", "rich").alias("a"), F.greatest("poor", "rich").alias("b")).distinct())
            if not picked.isEmpty():
                return picked
    return found.filter("false").select("a", "b")


def labels(links: DataFrame) -> DataFrame:
    """(pid, label): the least profile within two steps, and its own label. Longer chains end in later rounds."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("pid"), F.least("a", "low").alias("label"))
    two = both.join(one.withColumnRenamed("pid", "b"), "b").groupBy(F.col("a").alias("pid")).agg(F.min("label").alias("near_label")).join(one, "pid").select("pid", F.least("label", "near_label").alias("label"))
    up = two.select(F.col("pid").alias("label"), F.col("label").alias("higher"))
    return materialize(two.join(up, "label", "left").select("pid", F.coalesce("higher", "label").alias("label")))


def resolve(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, name, entity) of the distinct strings in the columns ``fields`` {field: column}.

    Null and blank strings and those that stand for nobody are left out; repeated rows count once; an empty table gives no rows. Jr. is another person; another number is another volume.
    """
    names = reduce(DataFrame.unionByName, (rows.select(F.lit(f).alias("field"), F.col(c).alias("name")).filter("name is not null").distinct() for f, c in fields.items()))
    spelled, profiles = profiles_of(names)
    entity = spelled
    keys = materialize(blocked(profiles))
    found = materialize(edges(profiles, keys, keys))
    while True:  # each round merges at least two profiles, so the last comes
        picked = chosen(found)
        moves = labels(picked)
        if moves.isEmpty():
            break
        merged = profiles.join(moves, "pid").groupBy("label").agg(F.first("field").alias("field"), F.first("kind").alias("kind"), F.collect_list(F.arrays_zip("spellings", "weights")).alias("held"), F.first("jr").alias("jr"))
        union = F.array_sort(F.array_distinct(F.flatten("held")))
        changed = materialize(merged.select("field", F.col("label").alias("pid"), "kind", union["spellings"].alias("spellings"), union["weights"].alias("weights"), "jr"))
        fresh = materialize(blocked(changed))
        older = (profiles, keys, entity)
        profiles = materialize(profiles.join(moves.select("pid"), "pid", "left_anti").select(changed.columns).unionByName(changed))
        keys = materialize(keys.join(moves.select("pid"), "pid", "left_anti").select("pid", "key", "role").unionByName(fresh))
        entity = materialize(entity.join(moves, "pid", "left").select("field", "name", F.coalesce("label", "pid").alias("pid")))
        kept = found.join(moves.select(F.col("pid").alias("a")), "a", "left_anti").join(moves.select(F.col("pid").alias("b")), "b", "left_anti").select("a", "b", "level", "a_richer")
        before, found = found, materialize(kept.unionByName(edges(profiles, keys, fresh)))
        release(before, changed, fresh, *older)
    release(found, keys, profiles)
    return entity.select("field", "name", F.col("pid").alias("entity"))


def name_pairs(resolved: DataFrame) -> DataFrame:
    """(field_name, name_a, name_b): the pairs of different strings of one entity."""
    a, b = resolved.select("field", "entity", F.col("name").alias("name_a")), resolved.select("field", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["field", "entity"]).filter("name_a < name_b").select(F.col("field").alias("field_name"), "name_a", "name_b")
