"""Readers of text corpora. Each gives rows in one schema and keeps what it can't read as rows with an ``error``."""

from __future__ import annotations

import bz2
import html
import os
import re
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = "path string, record_id string, time_24h string, time_text string, quote string, title string, author string, sfw string, error string"


def sfw(label: Column) -> Column:
    """True, false or null of the labels in use: sfw/nsfw, yes/no, true/false, 1/0."""
    bare = F.lower(F.trim(label))
    return F.when(bare.isin("sfw", "yes", "true", "1"), True).when(bare.isin("nsfw", "no", "false", "0"), False)


def read_pipe(spark: SparkSession, path: str) -> DataFrame:
    """Lines of 5 or 6 fields between |, without quoting. A line is numbered within its file, which is read whole; lines with other numbers of fields come out with an error, blank ones not."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).filter(F.trim("line") != "")
    fields = F.split("line", r"\|", -1)
    good = F.size("f").isin(5, 6)
    named = [F.when(good, F.col("f")[i]).alias(n) for i, n in enumerate(("time_24h", "time_text", "quote", "title", "author"))]
    return lines.withColumn("f", fields).select("path", (F.col("at") + 1).cast("string").alias("record_id"), *named, F.when(F.size("f") == 6, F.try_element_at("f", F.lit(6))).alias("sfw"), F.when(~good, F.concat(F.size("f"), F.lit(" fields"))).alias("error"))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold a list of records with time, time_name, quote and more. A file that holds none gives one row with an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for name, text in zip(pdf["path"], pdf["value"]):
                try:
                    records = yaml.safe_load(text)
                except yaml.YAMLError as e:
                    out.append((name, None, *[None] * 6, f"not YAML: {e}"[:200]))
                    continue
                if not isinstance(records, list):
                    out.append((name, None, *[None] * 6, "no list"))
                    continue
                for i, r in enumerate(records, 1):
                    if not isinstance(r, dict) or not all(r.get(k) for k in ("time", "time_name", "quote")):
                        out.append((name, str(i), *[None] * 6, "no time, time_name and quote"))
                    else:
                        out.append((name, str(r.get("id", i)), *(None if r.get(k) is None else str(r[k]) for k in ("time", "time_name", "quote", "source", "author", "sfw")), None))
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in QUOTE.split(", ")])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(parse, QUOTE)


def read_source(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A corpus by the name of its format, pipe_csv or yaml; any other name gives one row with an error."""
    reader = {"pipe_csv": read_pipe, "yaml": read_yaml}.get(kind)
    if reader:
        return reader(spark, path)
    return spark.createDataFrame([(path, *[None] * 7, f"unknown format {kind}")], QUOTE.replace("sfw boolean", "sfw string"))


RECOVERY = "operation recovery_id quote_id minutes time_text quote title author source_url source_project source_license source_locator source_id source_checksum semantic_rationale source_context_before source_context_after".split()


def read_recovery(spark: SparkSession, path: str) -> DataFrame:
    """The table of recovered passages: tabs between fields, a header. ``at`` holds the distinct minutes, given as clock times or numbers. Rows of an unknown operation, a repeated or missing id, without a minute of the day, or without what their operation needs have an ``error``."""
    from gnomon.functions.scalars import parse_time
    from gnomon.functions.texts import display_text

    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(", ".join(f"{n} string" for n in RECOVERY)).csv(path)
    shown = ("time_text", "quote", "title", "author", "source_context_before", "source_context_after")
    rows = rows.select(*(display_text(F.col(n)).alias(n) if n in shown else F.trim(n).alias(n) for n in RECOVERY)).withColumn("operation", F.upper("operation"))
    given = F.filter(F.transform(F.split(F.coalesce("minutes", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_distinct(F.transform(given, lambda x: F.when(F.contains(x, F.lit(":")), parse_time(x)).otherwise(x.try_cast("int"))))
    counts = rows.filter("recovery_id is not null").groupBy("recovery_id").agg(F.count("*").alias("n"))
    rows = rows.withColumn("at", at).join(counts, "recovery_id", "left")
    blank = lambda n: F.coalesce(F.col(n), F.lit("")) == ""
    needed = ("time_text", "quote", "title", "author", "source_url", "source_project", "source_license", "semantic_rationale")
    error = (
        F.when(~F.coalesce(F.col("operation").isin("NEW_QUOTE", "EXISTING_QUOTE"), F.lit(False)), "unknown operation")
        .when(blank("recovery_id") | (F.col("n") > 1), "missing or repeated id")
        .when((F.size("at") == 0) | F.exists("at", lambda m: m.isNull() | ~m.between(0, 1439)), "no minute of the day")
        .when((F.col("operation") == "EXISTING_QUOTE") & F.col("quote_id").try_cast("bigint").isNull(), "no quote")
        .when((F.col("operation") == "NEW_QUOTE") & F.greatest(*(blank(n) for n in needed)), "lacks evidence")
    )
    return rows.withColumn("error", error).drop("n")


def read_adjudications(spark: SparkSession, path: str) -> DataFrame:
    """The reviewers' table: tabs between fields, a header. Minutes out of range and rows delivered more often than once for a quote and minute have an ``error``."""
    schema = "quote_id string, original_minute int, adjudication_action string, corrected_minutes string, corrected_highlight string, evidence_code string, evidence_text string, reviewed_by string"
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(schema).csv(path)
    minutes = F.transform(F.filter(F.split(F.coalesce("corrected_minutes", F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("int"))
    counts = rows.groupBy("quote_id", "original_minute").agg(F.count("*").alias("n"))
    bad = F.exists("minutes", lambda m: m.isNull() | ~m.between(0, 1439)) | ~F.col("original_minute").between(0, 1439)
    return rows.withColumn("minutes", minutes).join(counts, ["quote_id", "original_minute"], "left").withColumn("error", F.when(bad, "minute out of range").when(F.col("n") > 1, "delivered twice")).drop("n")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog as CSV, plain or gzip: rows whose number is a number, blanks in cells made single."""
    names = ("Text#", "Type", "Issued", "Title", "Language", "Authors", "Subjects", "LoCC", "Bookshelves")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"the catalog lacks {missing}")
    cells = [F.trim(F.regexp_replace(F.col(f"`{n}`"), r"\s+", " ")).alias(n.strip("#").lower()) for n in names]
    return rows.filter(F.col("`Text#`").rlike(r"^\d+$")).select(*cells).withColumn("text", F.col("text").cast("long"))


PARAGRAPH = "path string, section string, paragraph int, text string, document_offset int, error string"
_BLOCKED_TAGS = frozenset("nav table ol ul dl aside header footer figure figcaption".split())
_BLOCKED_TYPES = re.compile(r"\b(?:toc|landmarks|endnotes?|footnotes?|noteref|titlepage|colophon|imprint|epigraph)\b")


# Names of files that hold no prose, and parts of such names.
NO_PROSE = "colophon copyright cover halftitlepage imprint loi titlepage toc uncopyright".split()
NO_PROSE_PARTS = "acknowledgement bibliography colophon copyright endnote footnote glossary imprint index titlepage transcriber uncopyright".split()
# Fixed values end.


def is_literary_file(path: Column) -> Column:
    """Whether a file's name is one of prose."""
    stem = F.lower(F.regexp_extract(path, r"([^/\\\\]*?)(?:\.[^./\\\\]*)?$", 1))
    return ~stem.isin(*NO_PROSE) & ~stem.rlike("|".join(NO_PROSE_PARTS))


def paragraphs_of_xhtml(text: str) -> list[tuple[str | None, int, str, int]]:
    """(section, number, text, offset) of the paragraphs in a body of the kind bodymatter that is neither front nor back matter; those in navigation, tables, lists, notes and hidden parts are counted and left out. Offsets run over the kept ones, one apart."""
    root = ET.fromstring(re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)(\w+);", lambda m: html.unescape(m[0]), text))
    out: list[tuple[str | None, int, str, int]] = []
    number = offset = 0

    def visit(node: ET.Element, blocked: bool, section: str | None) -> None:
        nonlocal number, offset
        tag = node.tag.rpartition("}")[2]
        kind = next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == "type"), "")
        blocked = blocked or tag in _BLOCKED_TAGS or bool(_BLOCKED_TYPES.search(kind)) or "hidden" in node.attrib
        section = node.get("id") or section
        if tag == "p":
            words = re.sub(r"\s+", " ", "".join(node.itertext())).strip()
            if words and not blocked:
                out.append((section, number, words, offset))
                offset += len(words) + 1
            number += 1
            return
        for child in node:
            visit(child, blocked, section)

    body = next((n for n in root.iter() if n.tag.rpartition("}")[2] == "body"), None)
    kinds = {k.rpartition(":")[2] for n, v in (body.attrib.items() if body is not None else ()) if n.rpartition("}")[2] == "type" for k in v.lower().split()}
    if "bodymatter" in kinds and not kinds & {"frontmatter", "backmatter"}:
        visit(body, False, None)
    return out


def read_xhtml(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of XHTML files whose names are those of prose; a file that is no XML gives one row with an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, text in zip(pdf["path"], pdf["value"]):
                try:
                    out += [(name, *p, None) for p in paragraphs_of_xhtml(text)]
                except ET.ParseError as e:
                    out.append((name, None, None, None, None, f"not XML: {e}"))
            frame = pd.DataFrame(out, columns=[f.split(" ")[0] for f in PARAGRAPH.split(", ")])
            yield frame.astype({"paragraph": "Int32", "document_offset": "Int32"})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.filter(is_literary_file(F.col("path"))).mapInPandas(parse, PARAGRAPH)


_START, _END = re.compile(r"^\*\*\* ?START OF (?:THE|THIS) .*$", re.M), re.compile(r"^\*\*\* ?END OF (?:THE|THIS) .*$", re.M)
_DROPPED = re.compile(r"^(?:\[?transcriber|\[illustration|produced by|chapter\s+[\divxlc]+\.?\s*$|contents\.?$|.*\.{4,}\s*\d+\s*$)", re.I | re.S)
_BACK = re.compile(r"^(?:index|footnotes|endnotes|the end|finis|appendix\b.*|glossary)\.?$", re.I)


def collapsed(block: str, at: int = 0) -> tuple[str, list[int]]:
    """A block with single blanks, and for each of its characters the place in the file, if the block begins at ``at``."""
    out, places = [], []
    for m in re.finditer(r"\s+|\S", block.rstrip()):
        if out or not m[0].isspace():
            out.append(" " if m[0].isspace() else m[0])
            places.append(at + m.start())
    return "".join(out), places


def source_offset(places: Column, index: Column) -> Column:
    """The place in the file of a character of a paragraph by its map; the place behind the last one for the end; null outside."""
    last = F.try_element_at(places, F.lit(-1)) + 1
    return F.when((index >= 0) & (index < F.size(places)), F.try_element_at(places, (index + 1).cast("int"))).when(index == F.size(places), last)


def paragraphs_of_book(text: str) -> list[tuple[int, str, int]]:
    """(number, text, offset in the file) of the paragraphs between the START and END lines; contents, chapter lines and notes of transcribers are left out, and all from an index or the like on.

    A text without its markers raises ValueError.
    """
    start = _START.search(text)
    end = _END.search(text, start.end()) if start else None
    if not start or not end:
        raise ValueError("no START and END line")
    out = []
    for m in re.finditer(r"(?:[^\n]*\S[^\n]*(?:\n|$))+", text[start.end() : end.start()]):
        words = re.sub(r"\s+", " ", m[0]).strip()
        if _BACK.match(words):
            break
        if not _DROPPED.match(words):
            out.append((len(out), words, start.end() + m.start() + len(m[0]) - len(m[0].lstrip())))
    return out


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of plain-text books, with lines of any ending."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, text in zip(pdf["path"], pdf["value"]):
                try:
                    out += [(name, None, n, t, at, None) for n, t, at in paragraphs_of_book(text.replace("\r\n", "\n").replace("\r", "\n"))]
                except ValueError as e:
                    out.append((name, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in PARAGRAPH.split(", ")]).astype({"paragraph": "Int32", "document_offset": "Int32"})

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(parse, PARAGRAPH)


PAGE = "path string, member bigint, page_id bigint, namespace int, title string, revision bigint, timestamp string, text string"


def pages_of(payload: bytes) -> Iterator[tuple[int, int, str, int, str, str]]:
    """(id, namespace, title, revision, time, text) of the pages in a piece of a dump, which may lack the root element."""
    text = payload.decode("utf-8", "replace")
    for m in re.finditer(r"<page>.*?</page>", text, re.S):
        try:
            page = ET.fromstring(m[0])
        except ET.ParseError:
            continue
        get = {k: page.findtext(k) for k in ("title", "ns", "id", "revision/id", "revision/timestamp", "revision/text")}
        if get["title"] is not None and get["ns"] is not None and get["id"] is not None and page.find("revision") is not None:
            yield int(get["id"]), int(get["ns"]), get["title"], int(get["revision/id"] or 0), get["revision/timestamp"] or "", get["revision/text"] or ""


def stream_ranges(offsets: DataFrame, size: int) -> DataFrame:
    """(start, end) of each member of a multistream archive, from the distinct offsets of its index; the last one ends with the archive."""
    starts = offsets.select(F.col("offset").cast("long").alias("start")).distinct()
    ends = F.array_sort(F.collect_list("start"))
    pairs = starts.agg(ends.alias("s")).select(F.explode(F.arrays_zip(F.col("s").alias("start"), F.concat(F.slice("s", F.lit(2), F.size("s")), F.array(F.lit(size).cast("long"))).alias("end"))).alias("r"))
    return pairs.select("r.start", "r.end")


def read_wiki(spark: SparkSession, path: str, ranges: DataFrame, tasks: int = 64) -> DataFrame:
    """Pages of a bz2 multistream dump on any file system that all executors reach: each task reads its own ranges of the file, so that a large archive is read by many."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(path) as file:
            for pdf in batches:
                out = []
                for start, end in zip(pdf["start"], pdf["end"]):
                    file.seek(start)
                    out += [(path, start, *p) for p in pages_of(bz2.decompress(file.read(end - start)))]
                yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in PAGE.split(", ")])

    return ranges.repartition(tasks, "start").mapInPandas(parse, PAGE)


def namespace_kind(namespace: Column, title: Column) -> Column:
    """What a page is for: MAIN, PAGE, INDEX or EXCLUDED."""
    return F.when(namespace == 0, "MAIN").when((namespace == 104) & title.startswith("Page:"), "PAGE").when((namespace == 106) & title.startswith("Index:"), "INDEX").otherwise("EXCLUDED")


def work_key(namespace: Column, title: Column) -> Column:
    """The work of a page: an index for itself and its pages, else the title before the first stroke."""
    page = F.concat(F.lit("Index:"), F.regexp_replace(F.regexp_replace(title, "^Page:", ""), r"/\d+$", ""))
    return F.when(namespace == 104, page).when(namespace == 106, title).otherwise(F.substring_index(title, "/", 1))


def year(text: Column) -> Column:
    """The first year from 1000 to 2099 that stands alone."""
    return F.regexp_extract(text, r"(?<![0-9])(1[0-9]{3}|20[0-9]{2})(?![0-9])", 1).try_cast("int")


_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_KEEP_FIRST = frozenset(("sic", "hwe", "hyphenated word end"))
_SILENT = re.compile(r"^(?:pd|header|footer|index|nop|rule|dhr|page break|anchor|smallrefs|reflist|authority control|license|no license)\b", re.I)


def wikitext_paragraphs(text: str) -> list[str]:
    """Paragraphs of wikitext as plain text: references, tables, headings, categories and silent templates dropped, text templates replaced by their text, links by what they show. A documented subset of the syntax."""
    text = re.sub(r"<!--.*?-->|<ref[^>/]*/>|<ref\b.*?</ref>|<(?:math|gallery|pages)\b.*?(?:/>|</\w+>)", "", text, flags=re.S)
    text = re.sub(r"<(?:br|hr)\s*/?>", "\n", text)
    text = re.sub(r"\{\|.*?\|\}", "\n\n", text, flags=re.S)

    def shown(m: re.Match) -> str:
        name, *args = (p.strip() for p in m[1].split("|"))
        plain = [a for a in args if not re.match(r"\w+\s*=", a)]
        if _SILENT.match(name) or not plain:
            return ""
        return plain[0] if name.lower() in _KEEP_FIRST else plain[1] if name.lower() == "corr" and len(plain) > 1 else plain[-1]

    before = None
    while before != text:
        before, text = text, _TEMPLATE.sub(shown, text)
    text = re.sub(r"\[\[(?:category|file|image):[^\]]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+\s?([^\]]*)\]", r"\1", text)
    text = re.sub(r"'{2,}|</?\w[^>]*>|^[*#:;]+\s*", "", text, flags=re.M)
    kept = [re.sub(r"\s+", " ", html.unescape(p)).strip() for p in re.split(r"\n\s*\n", text)]
    return [p for p in kept if p and not re.match(r"^=+.*=+$", p)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def wiki_paragraphs(texts: pd.Series) -> pd.Series:
    return pd.Series([wikitext_paragraphs(t) if isinstance(t, str) else [] for t in texts])


def proofread_level(text: Column) -> Column:
    """The level in a page's quality tag; null without one."""
    return F.regexp_extract(text, r'<pagequality[^>]*level="?(\d)', 1).try_cast("int")


def rights_of(payload: bytes) -> tuple[int, str] | None:
    """The number and the rights of an RDF record."""
    try:
        root = ET.fromstring(payload)
    except ET.ParseError:
        return None
    number = next((int(m[1]) for n in root.iter() if n.tag.rpartition("}")[2] == "ebook" for v in n.attrib.values() if (m := re.search(r"(\d+)$", v))), None)
    rights = [n.text.strip() for n in root.iter() if n.tag.rpartition("}")[2] == "rights" and n.text and n.text.strip()]
    return (number, rights[-1]) if number is not None and rights else None


def opened(path: str) -> pa.NativeFile:
    """A file of any file system by its path or address, for reading from any place."""
    if re.match(r"file:/(?!/)", path):
        path = f"file://{path[5:]}"
    fs, place = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return fs.open_input_file(place)


def read_rights(spark: SparkSession, path: str) -> DataFrame:
    """(book, rights) of the RDF files in tar archives of any compression: each archive is streamed by one task, of which only one member is in memory."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                out = []
                with opened(name) as file, tarfile.open(fileobj=file, mode="r|*") as archive:
                    for member in archive:
                        if member.name.endswith(".rdf") and (held := archive.extractfile(member)) and (found := rights_of(held.read())):
                            out.append(found)
                        if len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=["book", "rights"])
                            out = []
                yield pd.DataFrame(out, columns=["book", "rights"])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(parse, "book bigint, rights string")


OPF = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "author", "language", "rights")] + [T.StructField("genres", T.ArrayType(T.StringType()))])


def opf_fields(text: str) -> tuple[str | None, str | None, str | None, str | None, list[str]]:
    """Title, authors (the creators with that role, else all), language, rights and subjects of a package file."""
    root = ET.fromstring(text)
    named = lambda tag: [n for n in root.iter() if n.tag.rpartition("}")[2] == tag and n.text and n.text.strip()]
    first = lambda tag: next((n.text.strip() for n in named(tag)), None)
    roles = {n.get("refines", "").lstrip("#") for n in named("meta") if n.get("property") == "role" and n.text.strip() == "aut"}
    creators = named("creator")
    writers = [n for n in creators if n.get("id") in roles] or creators
    return first("title"), ", ".join(n.text.strip() for n in writers) or None, first("language"), first("rights"), [n.text.strip() for n in named("subject")]


@F.pandas_udf(OPF)
def opf(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        try:
            rows.append(opf_fields(t))
        except (ET.ParseError, TypeError):
            rows.append((None, None, None, None, None))
    return pd.DataFrame(rows, columns=[f.name for f in OPF])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
