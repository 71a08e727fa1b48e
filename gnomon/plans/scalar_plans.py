"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions import scalars as S
from gnomon.functions import texts as X
from gnomon.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT quote_id, CASE WHEN h <= 23 AND m <= 59 THEN h * 60 + m END AS minute FROM (SELECT quote_id, TRY_CAST(nullif(regexp_extract(time_24h, '^\\s*(\\d{1,2}):(\\d{2})\\s*$', 1), '') AS INT) AS h, TRY_CAST(nullif(regexp_extract(time_24h, '^\\s*(\\d{1,2}):(\\d{2})\\s*$', 2), '') AS INT) AS m FROM quotes)")
def b01_parse_time(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "quotes").select("quote_id", S.parse_time(F.col("time_24h")).alias("minute"))


@query("SELECT quote_id, printf('%02d:%02d', minute_of_day // 60, minute_of_day % 60) AS clock FROM quotes WHERE minute_of_day BETWEEN 0 AND 1439")
def b02_minute_to_time(spark, sf):
    return table(spark, sf, "quotes").filter("minute_of_day between 0 and 1439").select("quote_id", S.minute_to_time(F.col("minute_of_day")).alias("clock"))


_ENTITIES = {"ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "mdash": "—", "ndash": "–", "hellip": "…", "nbsp": "\u00a0", "quot": '"', "apos": "''", "eacute": "é", "#39": "''", "#8217": "’", "lt": "<", "gt": ">", "amp": "&"}


def _unescaped(text: str) -> str:
    for name, char in _ENTITIES.items():
        text = f"replace({text}, '&{name};', '{char}')"
    return text


_BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"SELECT provenance_id, trim(regexp_replace({_unescaped("regexp_replace(raw_quote, '(?i)<\\s*br\\s*/?\\s*>', ' ', 'g')")}, '{_BLANKS}', ' ', 'g'), ' ') AS text FROM quote_provenance")
def b03_display_text(spark, sf):
    return table(spark, sf, "quote_provenance").select("provenance_id", X.display_text(F.col("raw_quote")).alias("text"))


@query()
def b04_normalized_hash(spark, sf):
    rows = table(spark, sf, "quotes").withColumn("normal", X.normalized(F.col("quote")))
    return rows.select("quote_id", F.sha2("normal", 256).alias("hash"), F.sha2("normal", 256).eqNullSafe(F.col("normalized_quote_hash")).alias("kept"))


@query("SELECT quote_id, sha256(quote) AS hash, coalesce(sha256(quote) = quote_hash, false) AS fresh FROM quotes WHERE quote IS NOT NULL")
def b05_text_hash(spark, sf):
    h = F.sha2("quote", 256)
    return table(spark, sf, "quotes").filter("quote is not null").select("quote_id", h.alias("hash"), F.coalesce(h == F.col("quote_hash"), F.lit(False)).alias("fresh"))


@query()
def b08_locate_highlight(spark, sf):
    rows = table(spark, sf, "quotes").select("quote_id", X.locate(F.col("quote"), F.col("time_text")).alias("at"))
    return rows.select("quote_id", "at.status", F.col("at.start").alias("start_char"), F.col("at.end").alias("end_char"))


_RANK = "CASE quality_status WHEN 'VERIFIED_EXACT' THEN 4 WHEN 'VERIFIED_NORMALIZED' THEN 3 WHEN 'AMBIGUOUS' THEN 2 WHEN 'TIME_TEXT_NOT_FOUND' THEN 1 ELSE 0 END"


@query(f"SELECT {_RANK} AS status_rank, count(*) AS n FROM quotes GROUP BY 1")
def b09_status_rank(spark, sf):
    return table(spark, sf, "quotes").groupBy(S.status_rank(F.col("quality_status")).alias("status_rank")).agg(F.count("*").alias("n"))


@query("SELECT quote_id, bool_and(raw_sfw) AS sfw FROM quote_provenance GROUP BY quote_id")
def b10_merge_sfw(spark, sf):
    """False wins over true, both over null."""
    return table(spark, sf, "quote_provenance").groupBy("quote_id").agg(F.bool_and("raw_sfw").alias("sfw"))


@query("SELECT quote_id, substring(quote, highlight_start + 1, highlight_end - highlight_start) AS phrase, substring(quote, 1, highlight_start) || '**' || substring(quote, highlight_start + 1, highlight_end - highlight_start) || '**' || substring(quote, highlight_end + 1) AS shown FROM quotes WHERE highlight_start IS NOT NULL AND highlight_end >= highlight_start")
def b12_b57_highlight(spark, sf):
    rows = table(spark, sf, "quotes").filter("highlight_start is not null and highlight_end >= highlight_start")
    at = (F.col("quote"), F.col("highlight_start"), F.col("highlight_end"))
    return rows.select("quote_id", S.highlighted(*at).alias("phrase"), S.marked(*at).alias("shown"))


@query("SELECT CASE WHEN starts_with(slug, 'standardebooks/') THEN 'STANDARD_EBOOKS' WHEN starts_with(slug, 'gutenberg/') THEN 'GUTENBERG' WHEN slug = 'english_wikisource' THEN 'WIKISOURCE' ELSE 'LEGACY' END AS family, count(*) AS n FROM (SELECT source_name AS slug FROM quotes UNION ALL SELECT t.slug FROM (VALUES ('standardebooks/a_b'), ('gutenberg/12'), ('english_wikisource'), ('english_wikisource/x')) AS t(slug)) GROUP BY 1")
def b13_source_family(spark, sf):
    """The families of the quotes' sources, which here are all of one, and of four names that show the others."""
    shown = spark.createDataFrame([("standardebooks/a_b",), ("gutenberg/12",), ("english_wikisource",), ("english_wikisource/x",)], "source_name string")
    rows = table(spark, sf, "quotes").select("source_name").unionByName(shown)
    return rows.groupBy(S.source_family(F.col("source_name")).alias("family")).agg(F.count("*").alias("n"))


_FAMILY = r"""CASE WHEN r = 'numeric' OR regexp_matches(p, '\d{1,2}:\d{2}') THEN 'colon_numeric' WHEN r = 'oclock' OR contains(p, 'o''clock') THEN 'oclock' WHEN r = 'half_past' OR regexp_matches(p, '\b(quarter|half)\b') THEN 'quarter_half'
 WHEN regexp_matches(p, '\b(past|after)\b') THEN 'past_after' WHEN r = 'relative' OR regexp_matches(p, '\b(to|before)\b') THEN 'to_before' WHEN r = 'written_clock' OR len(list_filter(regexp_extract_all(p, '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '\d+|[a-z]+'))) >= 2 THEN 'hour_minute_word_form'
 WHEN r IN ('named_time', 'military') THEN r WHEN regexp_full_match(p, '\s*(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|\d{1,2})\s*') THEN 'bare_hour_contextual' ELSE 'other_legacy' END"""


@query(f"SELECT {_FAMILY} AS family, count(*) AS n FROM (SELECT lower(replace(coalesce(time_text, ''), '’', chr(39))) AS p, parser_rule AS r FROM scanned_candidates UNION ALL SELECT lower(replace(coalesce(time_text, ''), '’', chr(39))), NULL FROM quotes) GROUP BY 1")
def b14_phrase_family(spark, sf):
    """How the times of candidates, by rule and phrase, and of quotes, by phrase, are written."""
    rows = table(spark, sf, "scanned_candidates").select("parser_rule", "time_text").unionByName(table(spark, sf, "quotes").select(F.lit(None).cast("string").alias("parser_rule"), "time_text"))
    return rows.groupBy(S.phrase_family(F.col("parser_rule"), F.col("time_text")).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT cand_id, m.minute AS minute FROM scanned_candidates, UNNEST(CASE WHEN minute_of_day IS NOT NULL THEN [minute_of_day] ELSE list_filter([possible_minute_am, possible_minute_pm], lambda x: x IS NOT NULL) END) AS m(minute)")
def b18_b41_minutes_of_candidates(spark, sf):
    """One row per minute that a candidate may stand for."""
    both = F.array_compact(F.array("possible_minute_am", "possible_minute_pm"))
    return table(spark, sf, "scanned_candidates").select("cand_id", F.explode(F.when(F.col("minute_of_day").isNotNull(), F.array("minute_of_day")).otherwise(both)).alias("minute"))


@query("SELECT cand_id, am * 60 + bm AS first_minute, cm * 60 + dm AS second_minute FROM (SELECT cand_id, possible_minute_am // 60 AS am, possible_minute_am % 60 AS bm, possible_minute_pm // 60 AS cm, possible_minute_pm % 60 AS dm FROM scanned_candidates WHERE possible_minute_am IS NOT NULL AND possible_minute_pm IS NOT NULL AND possible_minute_am <> possible_minute_pm)")
def b18_clock_options(spark, sf):
    """Evidence text written from the two minutes and read back."""
    rows = table(spark, sf, "scanned_candidates").filter("possible_minute_am is not null and possible_minute_pm is not null")
    text = F.concat(F.lit("no part of the day; "), S.minute_to_time(F.col("possible_minute_am")), F.lit("|"), S.minute_to_time(F.col("possible_minute_pm")))
    return rows.select("cand_id", S.clock_options(text).alias("o")).filter("o is not null").select("cand_id", F.col("o")[0].alias("first_minute"), F.col("o")[1].alias("second_minute"))


@query("SELECT lower(coalesce(author, '')) AS author, substring(CASE WHEN trim(regexp_replace(lower(coalesce(author, '')), '\\s+', ' ', 'g')) = '' THEN '-' ELSE sha256(trim(regexp_replace(lower(coalesce(author, '')), '\\s+', ' ', 'g'))) END, 1, 16) AS identity, count(*) AS n FROM quotes GROUP BY 1, 2")
def b43_stable_identity(spark, sf):
    return table(spark, sf, "quotes").groupBy(F.lower(F.coalesce("author", F.lit(""))).alias("author"), S.stable_identity(F.col("author")).alias("identity")).agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%w-%m-%d') AS day_key, count(*) AS n FROM events GROUP BY 1")
def b44_date_key(spark, sf):
    return table(spark, sf, "events").groupBy(S.date_key(F.col("ts")).alias("day_key")).agg(F.count("*").alias("n"))


@query("SELECT (1400 + i) % 1440 AS minute, i AS place FROM range(120) t(i)")
def b45_minute_window(spark, sf):
    return spark.range(120).select(((F.col("id") + 1400) % 1440).alias("minute"), F.col("id").alias("place"))


@query("WITH r AS (SELECT quote_id, row_number() OVER (ORDER BY quote_id) - 1 AS i, count(*) OVER () AS n FROM quotes), k AS (SELECT DISTINCT CAST(round_even(j * (n - 1) / 199.0, 0) AS BIGINT) AS i FROM range(200) t(j), (SELECT count(*) AS n FROM quotes)) SELECT quote_id FROM r JOIN k USING (i)")
def b46_even_sample(spark, sf):
    """200 quotes at even distances in the order of their ids: numbers are given by range partitions, not in one window."""
    rows = table(spark, sf, "quotes").select("quote_id")
    numbered = X.numbered(rows, "quote_id", "i")
    total = rows.count()
    wanted = spark.range(200).select(F.bround(F.col("id") * (total - 1) / 199.0, 0).cast("long").alias("i")).distinct()
    return numbered.join(F.broadcast(wanted), "i").select("quote_id")


@query("SELECT CASE WHEN n = 1 THEN 'CLEAN' WHEN n <= 7 THEN 'RECORD' ELSE 'RECORDS' END AS kind, count(*) AS n FROM (SELECT len(quote) - len(replace(quote, '|', '')) + 1 AS n FROM quotes) GROUP BY 1")
def b48_record_kind(spark, sf):
    n = S.record_fields(F.col("quote"))
    return table(spark, sf, "quotes").groupBy(F.when(n == 1, "CLEAN").when(n <= 7, "RECORD").otherwise("RECORDS").alias("kind")).agg(F.count("*").alias("n"))


_ONES = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"


def _spelled(n: str) -> str:
    return f"(CASE WHEN {n} < 20 THEN {_ONES}[{n} + 1] ELSE ['twenty','thirty','forty','fifty'][{n} // 10 - 1] || CASE WHEN {n} % 10 > 0 THEN '-' || {_ONES}[{n} % 10 + 1] ELSE '' END END)"


_VARIANTS = f"""WITH c AS (SELECT CAST(i AS INT) AS minute, i // 60 AS h, i % 60 AS m, (i // 60 + 11) % 12 + 1 AS t, CASE WHEN i < 720 THEN 'a.m.' ELSE 'p.m.' END AS half, CASE WHEN i < 720 THEN 'morning' WHEN i < 1080 THEN 'afternoon' ELSE 'evening' END AS part FROM range(1440) r(i))
SELECT DISTINCT minute, unnest([printf('%02d:%02d', h, m), printf('%d:%02d %s', t, m, half), printf('%d.%02d %s', t, m, half), {_spelled("t")} || ' ' || {_spelled("m")} || ' ' || half] ||
  CASE WHEN m = 0 THEN [{_spelled("t")} || ' o''clock in the ' || part, {_spelled("t")} || ' o’clock in the ' || part] WHEN m = 30 THEN ['half past ' || {_spelled("t")} || ' in the ' || part]
  WHEN m < 30 THEN [{_spelled("m")} || ' minutes past ' || {_spelled("t")} || ' in the ' || part] ELSE [{_spelled("(60 - m)")} || ' minutes to ' || {_spelled("(t % 12 + 1)")} || ' in the ' || part] END) AS phrase FROM c"""


@query(_VARIANTS)
def b21_minute_variants(spark, sf):
    return spark.range(1440).select(F.col("id").cast("int").alias("minute"), F.explode(S.minute_variants(F.col("id").cast("int"))).alias("phrase"))


@query(f"SELECT v.minute, v.phrase FROM ({_VARIANTS}) v WHERE (SELECT count(*) FROM quotes q WHERE q.minute_of_day = v.minute) < 2")
def b22_sparse_phrases(spark, sf):
    """The ways to write the minutes that have fewer than two quotes: what a search for them looks for."""
    from gnomon.operators.coverage import sparse_targets

    sparse = sparse_targets(table(spark, sf, "quotes"), 1).select("minute")
    return sparse.select("minute", F.explode(S.minute_variants(F.col("minute"))).alias("phrase"))


_PEOPLE = r"list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(regexp_replace(author, '\s*[\[(][^\])]*[\])]', '', 'g'), ',?\s*\b\d{3,4}\??\s*-\s*(?:\d{3,4}\??)?', '', 'g'), ' '), '\s*;\s*'), lambda p: trim(regexp_replace(p, '^([^,]+),\s*([^,]+)$', '\2 \1'), ' ')), lambda p: p <> '')"


@query(rf"""SELECT author, title, CASE WHEN author IS NOT NULL THEN CASE WHEN len(p) > 2 THEN p[1] || ' et al.' ELSE coalesce(array_to_string(p, ' and '), '') END END AS shown_author,
  trim(regexp_replace(regexp_replace(regexp_split_to_array(title, '\s*[:;]\s+')[1], '\s+', ' ', 'g'), '^[_“"]+|[_”".]+$', '', 'g'), ' ') AS shown_title FROM (SELECT DISTINCT author, title, {_PEOPLE} AS p FROM quotes)""")
def b47_attribution(spark, sf):
    rows = table(spark, sf, "quotes").select("author", "title").distinct()
    return rows.select("author", "title", X.attribution(F.col("author")).alias("shown_author"), X.short_title(F.col("title")).alias("shown_title"))


@query(f"SELECT n AS value, {_spelled('n')} AS word, n AS back FROM range(60) t(n)")
def b16_numbers(spark, sf):
    """Number words spelled and read back."""
    words = spark.range(60).select(F.col("id").alias("value"), S.number_words(F.col("id")).alias("word"))
    back = F.array_position(F.array(*map(F.lit, S.NUMBER_WORDS)), F.col("word")) - 1
    return words.select("value", "word", back.alias("back"))
