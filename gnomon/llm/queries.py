"""The queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gnomon.llm import cutoff, encoding, formatting, leaks, names, near, sentences, survivor
from gnomon.llm.consistent import lookalikes
from gnomon.session import spread, table


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return names.resolve(table(spark, sf, "quotes"), {"author": "author", "title": "title"})


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.name_pairs(_names(spark, sf))


def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every string with its entity's least spelling."""
    found = _names(spark, sf)
    return found.join(found.groupBy("field", "entity").agg(F.min("name").alias("entity_name"), F.count("*").alias("spellings")), ["field", "entity"]).select(F.col("field").alias("field_name"), "name", "entity_name", "spellings")


def _near(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    quotes, candidates = table(spark, sf, "quotes"), table(spark, sf, "scanned_candidates")
    rows = spread(quotes.select(F.col("quote_id").alias("id"), "quote")).unionByName(spread(candidates.select(F.col("cand_id").alias("id"), "quote")))
    return near.near_pairs(rows, "id", "quote")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_records(*_near(spark, sf))


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record: its class (records with the same words) and the number of classes that it is linked to."""
    links, members = _near(spark, sf)
    ends = F.explode(F.array("node_a", "node_b")).alias("node")
    return members.select("id", F.col("node").alias("class_id")).join(links.select(ends).groupBy(F.col("node").alias("class_id")).agg(F.count("*").alias("links")), "class_id", "left").fillna(0, ["links"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Letter forms beyond those of full width and the joined ones are folded but are no case."""
    cases = F.size(F.array_remove("classes", "letter_form")) > 0
    return lookalikes(table(spark, sf, "quotes"), "quote_id", ["quote", "time_text"]).filter(cases).select("quote_id", "field_name")


def p3_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes(table(spark, sf, "quotes"), "quote_id", ["quote", "time_text"]).select("quote_id", "field_name", "form", F.array_join("classes", ",").alias("classes"))


def _cut(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    fields = {"quotes": ("quote_id", "source_name", "quote"), "quote_provenance": ("provenance_id", "source_id", "raw_quote")}
    return cutoff.cut_records({name: (spread(table(spark, sf, name).select(*columns)), *columns) for name, columns in fields.items()})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cut(spark, sf)[0].select("table_name", "row_id")


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _cut(spark, sf)[1]


def _quotes(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "quotes").select("quote_id", "quote", *columns))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.collapse(_quotes(spark, sf), "quote_id", "quote").filter("quote_id <> first_id").select(F.col("first_id").alias("first_quote_id"), "quote_id")


def p6_passages(spark: SparkSession, sf: str) -> DataFrame:
    """One row per passage that has copies, with their number."""
    return formatting.collapse(_quotes(spark, sf), "quote_id", "quote").filter("quote_id = first_id").select(F.col("first_id").alias("first_quote_id"), "copies")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    best = survivor.best_rows(_quotes(spark, sf, *survivor.FIELDS, "created_at"), table(spark, sf, "sources"))
    return best.filter("dominant").select(F.col("first_id").alias("first_quote_id"), "quote_id")


def p7_fused(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.fused(_quotes(spark, sf, *survivor.FIELDS, "created_at"), table(spark, sf, "sources"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode(_documents(spark, sf))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_spans(_documents(spark, sf), table(spark, sf, "semantic_golden_cases"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).select("doc_id", F.col("item_id").alias("case_id")).distinct()


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).withColumnRenamed("item_id", "case_id")


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.without_leaks(_documents(spark, sf), table(spark, sf, "semantic_golden_cases"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split(_documents(spark, sf))


def p10_units(spark: SparkSession, sf: str) -> DataFrame:
    """Each sentence with its number in the document and its text."""
    return sentences.split(_documents(spark, sf), numbered=True).select("doc_id", "sentence", "unit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_entities, p2_found, p2_links, p3_found, p3_consistent, p5_found, p5_rates, p6_found, p6_passages, p7_found, p7_fused, p8_ids, p9_found, p9_spans, p9_clean, p10_found, p10_units)
}

# What p3 counts as a change, for DuckDB's regular expressions.
_SUSPECT = (
    r"[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{feff}\x{fff9}-\x{fffb}]"
    r"|[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]|[\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}]|[\x{fb00}-\x{fb06}]|[\x{300}-\x{36f}]"
    r"|\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{Latin}"
)
_INVISIBLE = _SUSPECT.split("|")[0]


def _sql_letters(text: str) -> str:
    """Letters and digits in lower case, with one letter for all that look alike in either case: equal where the consistent forms are equal, and else only by a freak of two whole passages."""
    from gnomon.llm.consistent import CYRILLIC_LOOKS, GREEK_LOOKS

    wide = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94) if chr(0x21 + i).isalnum()}
    one: dict[str, str] = {"ς": "σ"}
    for a, b in (CYRILLIC_LOOKS | GREEK_LOOKS | wide).items():
        a, b = a.lower(), b.lower()
        a, b = one.get(a, a), one.get(b, b)
        one = {k: b if v == a else v for k, v in one.items()} | {a: b}
    one = {k: v for k, v in one.items() if k != v}
    bare = f"regexp_replace(nfc_normalize({text}), '{_INVISIBLE}', '', 'g')"
    for ligature, letters in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}.items():
        bare = f"replace({bare}, '{ligature}', '{letters}')"
    return f"regexp_replace(translate(lower({bare}), '{''.join(one)}', '{''.join(one.values())}'), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"


_CANON = f"""SELECT *, min(quote_id) OVER (PARTITION BY canon) AS first_id FROM (
  SELECT *, CASE WHEN contains(quote, '|') THEN array_to_string(list_sort(list_filter(list_transform(string_split(quote, '|'), lambda x: {_sql_letters("x")}), lambda x: x <> '')), '|')
    ELSE {_sql_letters("quote")} END AS canon FROM quotes) WHERE canon <> ''"""

ORACLES: dict[str, str] = {
    "p3_found": f"""SELECT quote_id, 'quote' AS field_name FROM quotes WHERE regexp_matches(quote, '{_SUSPECT}')
UNION ALL SELECT quote_id, 'time_text' FROM quotes WHERE regexp_matches(time_text, '{_SUSPECT}')""",
    "p6_found": f"SELECT first_id AS first_quote_id, quote_id FROM ({_CANON}) WHERE quote_id <> first_id",
    "p6_passages": f"SELECT first_id AS first_quote_id, count(*) AS copies FROM ({_CANON}) GROUP BY first_id HAVING count(*) > 1",
    "p7_found": f"""WITH r AS (SELECT first_id, quote_id, CASE quality_status WHEN 'VERIFIED_EXACT' THEN 4 WHEN 'VERIFIED_NORMALIZED' THEN 3 WHEN 'AMBIGUOUS' THEN 2 WHEN 'TIME_TEXT_NOT_FOUND' THEN 1 ELSE 0 END AS q,
  CASE WHEN highlight_start IS NULL THEN 0 ELSE 1 END AS h, CASE WHEN source_name IN (SELECT source_name FROM sources WHERE source_name IS NOT NULL) THEN 1 ELSE 0 END AS s,
  coalesce(epoch_us(created_at), -4611686018427387904) AS t FROM ({_CANON}))
SELECT a.first_id AS first_quote_id, a.quote_id FROM r a JOIN r b ON a.first_id = b.first_id AND a.quote_id <> b.quote_id GROUP BY a.first_id, a.quote_id
HAVING bool_and(a.q >= b.q AND a.h >= b.h AND a.s >= b.s AND a.t >= b.t AND (a.q > b.q OR a.h > b.h OR a.s > b.s OR a.t > b.t))""",
    "p9_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(nfc_normalize(translate(text, 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９', 'abcdefghijklmnopqrstuvwxyz0123456789')), '[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g')), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT case_id, regexp_extract_all(lower(quote), '[\p{L}\p{Nd}]+') AS w FROM semantic_golden_cases),
dn AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS gram FROM d, range(1, 2000) t(i) WHERE i <= len(w) - 11),
gn AS (SELECT case_id, array_to_string(w[i : i + 11], ' ') AS gram FROM g, range(1, 2000) t(i) WHERE i <= len(w) - 11)
SELECT DISTINCT doc_id, case_id FROM dn JOIN gn USING (gram)""",
}
