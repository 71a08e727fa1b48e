"""What catalogs and pages say of a work: rights, language, kind of literature, title, author and year."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Terms that tell literature and what is none, classes of a library that are literary, labels of shelves that tell nothing, and the words of rights.
PUBLIC = "public domain in the usa."
LITERARY_TERMS = tuple("adventure stories;autobiographies;biographical fiction;children's literature;children's stories;drama;fairy tales;fiction;historical fiction;legends;literature;memoirs;novel;plays;romance fiction;short stories;travel".split(";"))
LITERARY_SHELVES = tuple("adventure;children;fiction;literature;plays;school stories;short stories".split(";"))
OTHER_TERMS = tuple("almanacs;bibliography;bible;catalogs;congresses;dictionaries;directories;encyclopedias;guidebooks;handbooks;history and criticism;indexes;law;legislation;manuals;meteorology;parliament;periodicals;railroad travel;railroad company;sermons;statistics;technical manuals;theology".split(";"))
LITERARY_CLASSES = tuple("PZ PR PS PN PG PH PJ PK PL PM PQ PT".split())
EMPTY_SHELVES = ("nobel prizes in literature", "children's history", "children's instructional books")
LITERARY_SUBJECT = r"(?i)\b(?:fiction|drama|poetry|literature|short stories|fairy tales|legends?)\b"
OTHER_TITLES = re.compile(
    r"\b(?:dictionary|encyclop(?:a|ae)dia|catalog(?:ue)?|bibliography|gazette|statute|public law|constitution|executive order|treaty|schedule|timetable|parliamentary debates?|congressional record|bible|commentar(?:y|ies)|index|summa theologica|doctrine|confession of faith"
    r"|legal opinion|trial judgment|commission report|accident report|investigation|verdict|court|case law|research paper|transcribed interview|testimony|memorandum|calendar|guide book)\b|\bv\.\s",
    re.I,
)
NO_TEXT, OTHER_KIND = -1000.0, -500.0
LAST_PUBLIC_YEAR = 1930
# Fixed values end.


def is_public(rights: Column) -> Column:
    """Whether a statement of rights is the exact one that puts a work in the public domain."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(rights, r"\s+", " "))) == PUBLIC, F.lit(False))


def is_english(language: Column) -> Column:
    """Whether English is the only language given, by code or by name."""
    given = F.array_distinct(F.filter(F.transform(F.split(F.lower(language), "[;,]"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.coalesce((given == F.array(F.lit("en"))) | (given == F.array(F.lit("english"))), F.lit(False))


def literary_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """Which of some terms a text holds."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), t))


def literary_score(title: Column, subjects: Column, shelves: Column, classes: Column, authors: Column | None = None, kind: Column | None = None, language: Column | None = None) -> Column:
    """How literary a catalog calls a work: 45 for each literary term, 25 for each literary shelf and for a literary class, 100 at most; -500 if any term, also of the authors, speaks of another kind of book, or the shelf is one of science without literature or travel; -1000 if its kind isn't text or its language not English, where these are given."""
    bare = lambda c: F.lower(F.coalesce(c, F.lit("")))
    shelf = bare(shelves)
    for label in EMPTY_SHELVES:
        shelf = F.replace(shelf, F.lit(label), F.lit(""))
    about = F.concat_ws("; ", title, subjects, shelf)
    other = F.size(literary_terms(F.concat_ws("; ", about, authors if authors is not None else F.lit("")), OTHER_TERMS)) > 0
    literary = F.exists(F.transform(F.split(F.upper(F.coalesce(classes, F.lit(""))), "[;,]"), lambda c: F.trim(c)), lambda c: F.substring(c, 1, 2).isin(*LITERARY_CLASSES))
    science = F.contains(shelf, F.lit("category: science -")) & ~F.contains(shelf, F.lit("travel writing")) & ~literary & ~F.coalesce(subjects, F.lit("")).rlike(LITERARY_SUBJECT)
    points = 45.0 * F.size(literary_terms(about, LITERARY_TERMS)) + 25.0 * F.size(literary_terms(shelf, LITERARY_SHELVES)) + F.when(literary, 25.0).otherwise(0.0)
    no_text = F.lit(False)
    if kind is not None:
        no_text = no_text | (bare(kind) != "text")
    if language is not None:
        no_text = no_text | ~is_english(language)
    return F.when(no_text, NO_TEXT).when(science | other, OTHER_KIND).otherwise(F.least(F.lit(100.0), points))


def is_literary_title(title: Column) -> Column:
    """Whether a title names no work of reference, law or the like."""
    return ~title.rlike("(?i)" + OTHER_TITLES.pattern)


WORK = T.StructType([T.StructField("title", T.StringType()), T.StructField("author", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("literary", T.BooleanType())])


def work_of(wikitext: str | None) -> tuple[str | None, str | None, int | None, str, bool]:
    """(title, author, year, license, literary) of a page: the first values in its header templates; a license by template, else by year of publication. A title that points elsewhere (../) counts as none."""
    text = wikitext or ""
    templates = [m[0] for m in re.finditer(r"\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\}", text)]
    names = [re.sub(r"[_\s]+", " ", re.match(r"\{\{\s*([^|}]*)", t)[1]).strip().lower() for t in templates]
    values: dict[str, str] = {}
    for name, template in zip(names, templates):
        if name.startswith(("header", ":mediawiki:proofreadpage", "index", "process header")):
            for m in re.finditer(r"\|\s*(title|author|year|publication year)\s*=\s*((?:\[\[[^\]]*\]\]|\{\{[^{}]*\}\}|[^|{}])*)", template, re.I):
                plain = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", m[2])
                plain = re.sub(r"\s+", " ", re.sub(r"\{\{[^{}]*\}\}|'{2,}", "", plain)).strip()
                values.setdefault(m[1].lower().replace("publication ", ""), plain) if plain else None
    title = values.get("title") if not (values.get("title") or "").startswith("../") else None
    found = re.search(r"(?<!\d)(1\d{3}|20\d{2})(?!\d)", values.get("year", ""))
    year = int(found[1]) if found else None
    if any(re.match(r"pd\b|pd-|public domain", n) for n in names):
        license_ = "PUBLIC_DOMAIN"
    elif any(n.startswith(("copyrighted", "permission", "fair use")) for n in names):
        license_ = "RESTRICTED"
    else:
        license_ = "PUBLIC_DOMAIN" if year is not None and year <= LAST_PUBLIC_YEAR else "UNKNOWN"
    return title, values.get("author"), year, license_, bool(title and values.get("author") and not OTHER_TITLES.search(title))


@F.pandas_udf(WORK)
def work(texts: pd.Series) -> pd.DataFrame:
    rows = [work_of(t if isinstance(t, str) else None) for t in texts]
    frame = pd.DataFrame(rows, columns=[f.name for f in WORK])
    return frame.astype({"year": "Int32"})


def inherited(pages: DataFrame, works: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pages with their own values, else those of their work; each work's row is the one with the least values, so that a page stays one row."""
    held = works.groupBy(key).agg(*(F.min(c).alias(f"__{c}") for c in columns))
    joined = pages.join(held, key, "left")
    return joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in pages.columns))


def sums_of(text: Column) -> Column:
    """A map of file names to digests from the lines ``digest  name`` of a checksum file."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^[0-9a-fA-F]{32,}\s+\*?\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\S+\s+\*?(.+?)\s*$", 1), F.lower(F.regexp_extract(x, r"^(\S+)", 1))))
    return F.map_from_entries(pairs)


def tree_digest(files: DataFrame, root: str) -> DataFrame:
    """One digest of each root's files (root, path, sha256), whatever their order; a root's list holds one digest for each of its files."""
    rows = F.array_sort(F.collect_list(F.concat_ws("\x00", "path", "sha256")))
    return files.groupBy(root).agg(F.sha2(F.array_join(rows, "\x00"), 256).alias("digest"), F.count("*").alias("files"))


def catalog_index(catalog: DataFrame, rights: DataFrame) -> DataFrame:
    """The rows of a catalog (text, title, language, subjects, locc, bookshelves) with their rights and what follows from both: public, english, literary_score. A book without rights is not public; of several the last in order counts."""
    one = rights.groupBy(F.col("book").alias("text")).agg(F.max("rights").alias("rights"))
    judged = catalog.join(one, "text", "left")
    return judged.withColumns({"public": is_public(F.col("rights")), "english": is_english(F.col("language")), "literary_score": literary_score(*(F.col(c) for c in ("title", "subjects", "bookshelves", "locc")), *(F.col(c) if c in catalog.columns else None for c in ("authors", "type", "language")))})
