"""Queries of joins, sets, ordering, greedy choice and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions import scalars as S
from gnomon.operators import coverage as C
from gnomon.operators import ordering as O
from gnomon.operators import selection as G
from gnomon.operators.references import whole_number
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


_WHOLE = "TRY_CAST(nullif(regexp_extract(trim(quote_id), '^([+-]?\\d{1,18})(\\.0*)?$', 1), '') AS BIGINT)"
_JUDGED = f"SELECT DISTINCT {_WHOLE} AS quote_id, adjudication_action AS action FROM english_v2_manual_adjudications"


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "english_v2_manual_adjudications").select(whole_number(F.col("quote_id")).alias("quote_id"), F.col("adjudication_action").alias("action")).distinct()


@query(f"""WITH j AS ({_JUDGED}) SELECT quote_id, minute_of_day AS minute, 'quote' AS origin FROM quotes q WHERE quality_status LIKE 'VERIFIED%' AND NOT EXISTS (SELECT 1 FROM j WHERE j.quote_id = q.quote_id AND action = 'QUARANTINE')
UNION ALL SELECT cand_id, minute_of_day, 'candidate' FROM scanned_candidates WHERE review_status = 'IMPORTED' AND minute_of_day IS NOT NULL
UNION ALL SELECT q.quote_id, q.minute_of_day, 'judged' FROM quotes q WHERE quality_status NOT LIKE 'VERIFIED%' AND EXISTS (SELECT 1 FROM j WHERE j.quote_id = q.quote_id AND action LIKE 'KEEP%')""")
def e01_e02_pool(spark, sf):
    """Three sources of (quote, minute): what is verified and not put aside, imported candidates, and what reviewers keep."""
    quotes, j = table(spark, sf, "quotes").select("quote_id", F.col("minute_of_day").alias("minute"), "quality_status"), judged(spark, sf)
    fine = F.col("quality_status").startswith("VERIFIED")
    first = quotes.filter(fine).join(j.filter("action = 'QUARANTINE'"), "quote_id", "left_anti")
    second = table(spark, sf, "scanned_candidates").filter("review_status = 'IMPORTED' and minute_of_day is not null").select(F.col("cand_id").alias("quote_id"), F.col("minute_of_day").alias("minute"))
    third = quotes.filter(~fine).join(j.filter("action like 'KEEP%'"), "quote_id", "left_semi")
    parts = [df.select("quote_id", "minute", F.lit(origin).alias("origin")) for df, origin in ((first, "quote"), (second, "candidate"), (third, "judged"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT p.provenance_id, q.minute_of_day AS minute, p.raw_time_24h AS clock FROM quote_provenance p JOIN quotes q ON q.quote_id = p.quote_id AND q.time_24h <> p.raw_time_24h")
def e03_inner_join(spark, sf):
    p, q = table(spark, sf, "quote_provenance"), table(spark, sf, "quotes")
    return p.join(q, (p.quote_id == q.quote_id) & (q.time_24h != p.raw_time_24h)).select("provenance_id", F.col("minute_of_day").alias("minute"), F.col("raw_time_24h").alias("clock"))


@query("SELECT q.quote_id FROM quotes q LEFT JOIN quote_provenance p ON p.quote_id = q.quote_id AND p.duplicate_kind = 'CANONICAL' WHERE p.quote_id IS NULL")
def e04_left_null(spark, sf):
    p = table(spark, sf, "quote_provenance").filter("duplicate_kind = 'CANONICAL'").select("quote_id")
    return table(spark, sf, "quotes").select("quote_id").join(p, "quote_id", "left_anti")


@query("SELECT quote_id FROM quotes WHERE source_name IS NOT NULL AND source_name NOT IN (SELECT source_name FROM sources WHERE source_name IS NOT NULL)")
def e05_anti_join(spark, sf):
    """Quotes whose source is named as no source is."""
    names = table(spark, sf, "sources").select("source_name").filter("source_name is not null")
    return table(spark, sf, "quotes").select("quote_id", "source_name").filter("source_name is not null").join(names, "source_name", "left_anti").select("quote_id")


@query("SELECT cand_id FROM scanned_candidates c WHERE EXISTS (SELECT 1 FROM quotes q WHERE q.author = c.author AND q.minute_of_day = c.minute_of_day)")
def e06_semi_join(spark, sf):
    """Candidates whose author already has a quote at their minute."""
    held = table(spark, sf, "quotes").select("author", "minute_of_day")
    return table(spark, sf, "scanned_candidates").select("cand_id", "author", "minute_of_day").join(held, ["author", "minute_of_day"], "left_semi").select("cand_id")


@query("SELECT a.provenance_id, b.provenance_id AS other_id FROM quote_provenance a JOIN quote_provenance b ON a.quote_id = b.quote_id AND a.source_id = b.source_id AND a.import_run_id = b.import_run_id AND a.provenance_id < b.provenance_id")
def e07_composite_join(spark, sf):
    """Imports of one quote from one source in one run, under different ids."""
    p = table(spark, sf, "quote_provenance").select("quote_id", "source_id", "import_run_id", "provenance_id")
    return p.join(p.withColumnRenamed("provenance_id", "other_id"), ["quote_id", "source_id", "import_run_id"]).filter("provenance_id < other_id").select("provenance_id", "other_id")


@query("SELECT c.cand_id, m.n FROM scanned_candidates c JOIN (SELECT minute_of_day AS minute, count(*) AS n FROM quotes GROUP BY 1) m ON m.minute = coalesce(c.minute_of_day, c.possible_minute_pm)")
def e08_coalesce_key(spark, sf):
    counts = table(spark, sf, "quotes").groupBy(F.col("minute_of_day").alias("minute")).agg(F.count("*").alias("n"))
    return table(spark, sf, "scanned_candidates").select("cand_id", F.coalesce("minute_of_day", "possible_minute_pm").alias("minute")).join(counts, "minute").select("cand_id", "n")


@query("SELECT p.provenance_id, s.slug, r.run_status FROM quote_provenance p JOIN sources s ON s.source_id = p.source_id JOIN import_runs r ON r.import_run_id = p.import_run_id")
def e09_three_way(spark, sf):
    p = table(spark, sf, "quote_provenance").select("provenance_id", "source_id", "import_run_id")
    return p.join(table(spark, sf, "sources").select("source_id", "slug"), "source_id").join(table(spark, sf, "import_runs").select("import_run_id", "run_status"), "import_run_id").select("provenance_id", "slug", "run_status")


@query("""SELECT q.quote_id, coalesce(a.source_id, b.source_id, -1) AS source_id FROM quotes q LEFT JOIN sources a ON a.source_name = q.source_name
LEFT JOIN (SELECT split_part(source_name, '/', 1) AS house, min(source_id) AS source_id FROM sources GROUP BY 1) b ON b.house = lower(split_part(q.source_name, '/', 1))""")
def e10_two_level_lookup(spark, sf):
    """The source of a quote by its name, else by the first part of its name without case, else -1."""
    names = table(spark, sf, "sources").select("source_name", F.col("source_id").alias("by_name"))
    houses = names.groupBy(F.split_part("source_name", F.lit("/"), F.lit(1)).alias("house")).agg(F.min("by_name").alias("by_house"))
    rows = table(spark, sf, "quotes").select("quote_id", "source_name").withColumn("house", F.lower(F.split_part("source_name", F.lit("/"), F.lit(1))))
    return rows.join(names, "source_name", "left").join(houses, "house", "left").select("quote_id", F.coalesce("by_name", "by_house", F.lit(-1)).alias("source_id"))


@query("SELECT 'quotes' AS origin, quote_id AS id, author FROM quotes UNION ALL SELECT 'candidates', cand_id, author FROM scanned_candidates UNION ALL SELECT 'provenance', provenance_id, raw_author FROM quote_provenance")
def e11_union(spark, sf):
    parts = [("quotes", "quotes", "quote_id", "author"), ("candidates", "scanned_candidates", "cand_id", "author"), ("provenance", "quote_provenance", "provenance_id", "raw_author")]
    frames = [table(spark, sf, t).select(F.lit(origin).alias("origin"), F.col(i).alias("id"), F.col(a).alias("author")) for origin, t, i, a in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("SELECT s.source_id, (SELECT strftime(max(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') FROM quote_provenance p WHERE p.source_id = s.source_id) AS last_import, (SELECT count(*) FROM quote_provenance p WHERE p.source_id = s.source_id) AS imports FROM sources s")
def e12_scalar_subquery(spark, sf):
    last = table(spark, sf, "quote_provenance").groupBy("source_id").agg(F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last_import"), F.count("*").alias("imports"))
    return table(spark, sf, "sources").select("source_id").join(last, "source_id", "left").fillna(0, ["imports"])


@query("SELECT 'no_import' AS kind, quote_id FROM (SELECT quote_id FROM quotes EXCEPT SELECT quote_id FROM quote_provenance) UNION ALL SELECT 'no_quote', quote_id FROM (SELECT quote_id FROM quote_provenance WHERE quote_id IS NOT NULL EXCEPT SELECT quote_id FROM quotes)")
def e13_set_difference(spark, sf):
    q, p = table(spark, sf, "quotes").select("quote_id"), table(spark, sf, "quote_provenance").select("quote_id").filter("quote_id is not null")
    return q.subtract(p).select(F.lit("no_import").alias("kind"), "quote_id").union(p.subtract(q).select(F.lit("no_quote"), "quote_id"))


_SPARSE = "SELECT CAST(i AS INT) AS minute FROM range(1440) t(i) WHERE (SELECT count(*) FROM quotes WHERE minute_of_day = i) < 2"


@query(f"SELECT DISTINCT c.cand_id, s.minute FROM scanned_candidates c JOIN ({_SPARSE}) s ON s.minute = c.minute_of_day OR s.minute = c.possible_minute_am OR s.minute = c.possible_minute_pm")
def e14_e15_any_of(spark, sf):
    """Candidates whose minute, or one of whose two minutes, is sparse: an equi-join on the exploded minutes."""
    sparse = C.sparse_targets(table(spark, sf, "quotes"), 1).select("minute")
    options = F.array_distinct(F.array_compact(F.array("minute_of_day", "possible_minute_am", "possible_minute_pm")))
    return table(spark, sf, "scanned_candidates").select("cand_id", F.explode(options).alias("minute")).join(F.broadcast(sparse), "minute")


@query("SELECT w || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS day_key FROM range(7) a(w), range(1, 13) b(m), range(1, 32) c(d) WHERE d <= CASE WHEN m = 2 THEN 29 WHEN m IN (4, 6, 9, 11) THEN 30 ELSE 31 END")
def e16_day_labels(spark, sf):
    """The 2,562 labels of weekday, month and day, a fixed number."""
    days = spark.sql("select explode(sequence(date'2000-01-01', date'2000-12-31')) as d")
    weekdays = spark.range(7).select(F.col("id").cast("string").alias("w"))
    return weekdays.join(days, F.lit(True)).select(F.concat("w", F.date_format("d", "-MM-dd")).alias("day_key"))


@query("SELECT import_run_id FROM import_runs WHERE run_status = 'COMPLETE' ORDER BY started_at DESC, import_run_id DESC LIMIT 1")
def e20_latest_run(spark, sf):
    return O.latest(table(spark, sf, "import_runs").filter("run_status = 'COMPLETE'"), [F.desc("started_at"), F.desc("import_run_id")]).select("import_run_id")


@query("SELECT doc_id, CAST(i - 1 AS INT) AS place, lag(p, 1, '') OVER w AS before, p AS text, lead(p, 1, '') OVER w AS behind FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '(\\r?\\n){2,}') AS ps FROM documents WHERE text IS NOT NULL)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)")
def f02_neighbours(spark, sf):
    parts = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", r"(\r?\n){2,}")).alias("place", "text"))
    return O.neighbours(parts, "doc_id", [F.asc("place")], "text")


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC NULLS LAST, abs(doc_id * 1103515245 + 12345) % 2147483647, doc_id LIMIT 100")
def f03_pseudo_shuffle(spark, sf):
    return table(spark, sf, "documents").orderBy(F.desc_nulls_last("n_chars"), S.pseudo_shuffle(F.col("doc_id")), "doc_id").limit(100).select("doc_id")


@query("SELECT quote_id FROM (SELECT quote_id, row_number() OVER (PARTITION BY lower(author) ORDER BY sha256(CAST(quote_id AS VARCHAR)), quote_id) > 1 AS again FROM quotes WHERE author IS NOT NULL) ORDER BY again, sha256(CAST(quote_id AS VARCHAR)), quote_id LIMIT 500")
def f04_diverse(spark, sf):
    rows = table(spark, sf, "quotes").filter("author is not null").select("quote_id", F.lower("author").alias("key"))
    return O.diverse(rows, "key", [F.sha2(F.col("quote_id").cast("string"), 256), F.asc("quote_id")], 500).select("quote_id")


@query()
def f05_f08_fill(spark, sf):
    """Every minute filled to seven by candidates with new authors and titles first."""
    held = table(spark, sf, "quotes").select(F.col("minute_of_day").alias("minute"), "author", "title")
    offered = table(spark, sf, "scanned_candidates").filter("minute_of_day is not null").select(F.col("minute_of_day").alias("minute"), F.col("cand_id").alias("id"), "author", "title", F.coalesce(F.col("context_score") + F.col("literary_quality_score"), F.lit(0.0)).alias("score"))
    return O.fill(held, offered)


@query("""SELECT minute, cand_id FROM (SELECT c.minute_of_day AS minute, cand_id, row_number() OVER (PARTITION BY c.minute_of_day ORDER BY context_score DESC NULLS LAST, cand_id) AS place, coalesce(n, 0) AS n FROM scanned_candidates c LEFT JOIN (SELECT minute_of_day, count(*) AS n FROM quotes GROUP BY 1) q ON q.minute_of_day = c.minute_of_day WHERE c.minute_of_day IS NOT NULL) WHERE place <= 7 - n""")
def f08_fixed_order_fill(spark, sf):
    counts = table(spark, sf, "quotes").groupBy(F.col("minute_of_day").alias("minute")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "scanned_candidates").filter("minute_of_day is not null").select(F.col("minute_of_day").alias("minute"), "cand_id", "context_score")
    return O.top_per_key(rows, "minute", [F.desc_nulls_last("context_score"), F.asc("cand_id")], 7).join(F.broadcast(counts), "minute", "left").filter(F.col("place") <= 7 - F.coalesce("n", F.lit(0))).select("minute", "cand_id")


_RANK = "CASE quality_status WHEN 'VERIFIED_EXACT' THEN 4 WHEN 'VERIFIED_NORMALIZED' THEN 3 WHEN 'AMBIGUOUS' THEN 2 WHEN 'TIME_TEXT_NOT_FOUND' THEN 1 ELSE 0 END"


@query(f"SELECT minute_of_day, quote_hash, arg_max(quote_id, ({_RANK}, -quote_id)) AS quote_id, bool_and(sfw) AS sfw, count(*) AS copies FROM quotes WHERE minute_of_day IS NOT NULL AND quote_hash IS NOT NULL GROUP BY 1, 2")
def f11_canonical(spark, sf):
    rows = table(spark, sf, "quotes").filter("minute_of_day is not null and quote_hash is not null").select("minute_of_day", "quote_hash", "quote_id", "quality_status", "sfw")
    return O.canonical_rows(rows, ["minute_of_day", "quote_hash"], S.status_rank(F.col("quality_status")), F.col("quote_id"), "sfw").select("minute_of_day", "quote_hash", "quote_id", "sfw", "copies")


_WORDS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\x{{200c}}\x{{200d}}]+'), lambda w: w <> '')"
_RUN = "CAST(ceil(0.8 * least(len(n.w), len(k.w)) - 1e-9) AS INT)"


@query(f"""WITH k AS (SELECT quote_id AS id, minute_of_day AS minute, quote AS t, {_WORDS.format(t="quote")} AS w FROM quotes WHERE quote IS NOT NULL), n AS (SELECT cand_id AS id, minute_of_day AS minute, quote AS t, {_WORDS.format(t="quote")} AS w FROM scanned_candidates WHERE quote IS NOT NULL),
x AS (SELECT n.id, min(k.id) FILTER (n.t = k.t) AS e, min(k.id) AS l FROM n JOIN k ON array_to_string(n.w, '') = array_to_string(k.w, '') AND (n.minute IS NULL OR n.minute = k.minute) WHERE len(n.w) > 0 GROUP BY 1),
g AS (SELECT id, minute, w, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' ')))) AS gram FROM n WHERE len(w) >= 8 AND id NOT IN (SELECT id FROM x)),
h AS (SELECT id, minute, w, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' ')))) AS gram FROM k WHERE len(w) >= 8),
p AS (SELECT DISTINCT g.id, h.id AS known_id FROM g JOIN h ON g.gram = h.gram AND (g.minute IS NULL OR g.minute = h.minute)),
c AS (SELECT p.id, min(p.known_id) AS c FROM p JOIN n ON n.id = p.id JOIN k ON k.id = p.known_id WHERE len(list_filter(range(1, least(len(n.w), len(k.w)) - {_RUN} + 2),
  lambda i: contains(' ' || array_to_string(CASE WHEN len(n.w) <= len(k.w) THEN k.w ELSE n.w END, ' ') || ' ', ' ' || array_to_string((CASE WHEN len(n.w) <= len(k.w) THEN n.w ELSE k.w END)[i : i + {_RUN} - 1], ' ') || ' '))) > 0 GROUP BY 1)
SELECT s.cand_id AS id, CASE WHEN x.e IS NOT NULL THEN 'EXACT' WHEN x.l IS NOT NULL THEN 'NORMALIZED' WHEN c.c IS NOT NULL THEN 'CONTEXT' ELSE 'NEW' END AS status, coalesce(x.e, x.l, c.c) AS known_id FROM scanned_candidates s LEFT JOIN x ON x.id = s.cand_id LEFT JOIN c ON c.id = s.cand_id""")
def f12_f13_duplicate_status(spark, sf):
    known = table(spark, sf, "quotes").select(F.col("quote_id").alias("id"), F.col("minute_of_day").alias("minute"), F.col("quote").alias("text"))
    new = table(spark, sf, "scanned_candidates").select(F.col("cand_id").alias("id"), F.col("minute_of_day").alias("minute"), F.col("quote").alias("text"))
    return O.duplicate_status(known, new)


@query("SELECT cand_id FROM (SELECT cand_id, source, parser_rule, row_number() OVER (PARTITION BY source, parser_rule ORDER BY cand_id) AS turn FROM scanned_candidates WHERE source IS NOT NULL AND parser_rule IS NOT NULL) ORDER BY turn, source, parser_rule LIMIT 300")
def f14_f15_round_robin(spark, sf):
    rows = table(spark, sf, "scanned_candidates").filter("source is not null and parser_rule is not null")
    return O.round_robin(rows, ["source", "parser_rule"], [F.asc("cand_id")], 300).select("cand_id")


@query("SELECT cand_id, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS fewest FROM scanned_candidates c LEFT JOIN (SELECT minute_of_day AS minute, count(*) AS n FROM quotes GROUP BY 1) a ON a.minute = c.possible_minute_am LEFT JOIN (SELECT minute_of_day AS minute, count(*) AS n FROM quotes GROUP BY 1) b ON b.minute = c.possible_minute_pm WHERE c.possible_minute_am IS NOT NULL ORDER BY fewest, context_score DESC, cand_id LIMIT 200")
def f16_f20_queue(spark, sf):
    """Candidates open between two minutes, those first whose sparser minute has fewest quotes."""
    counts = table(spark, sf, "quotes").groupBy(F.col("minute_of_day").alias("minute")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "scanned_candidates").filter("possible_minute_am is not null").select("cand_id", "possible_minute_am", "possible_minute_pm", "context_score")
    for half in ("am", "pm"):
        rows = rows.join(F.broadcast(counts.select(F.col("minute").alias(f"possible_minute_{half}"), F.col("n").alias(half))), f"possible_minute_{half}", "left")
    fewest = F.least(F.coalesce("am", F.lit(0)), F.coalesce("pm", F.lit(0)))
    return rows.withColumn("fewest", fewest).orderBy("fewest", F.desc("context_score"), "cand_id").limit(200).select("cand_id", "fewest")


@query("""SELECT 'minute_and_clock' AS rule, count(*) AS broken FROM quotes WHERE time_24h <> printf('%02d:%02d', minute_of_day // 60, minute_of_day % 60)
UNION ALL SELECT 'highlight_inside', count(*) FROM quotes WHERE highlight_start < 0 OR highlight_end > length(quote) OR highlight_start >= highlight_end
UNION ALL SELECT 'highlight_is_phrase', count(*) FROM quotes WHERE quality_status = 'VERIFIED_EXACT' AND highlight_start IS NOT NULL AND substring(quote, highlight_start + 1, highlight_end - highlight_start) <> time_text
UNION ALL SELECT 'unique_ids', count(*) FROM (SELECT quote_id FROM quotes GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'two_minutes_or_one', count(*) FROM scanned_candidates WHERE (minute_of_day IS NULL) = (possible_minute_am IS NULL) OR possible_minute_pm <> possible_minute_am + 720
UNION ALL SELECT 'scores', count(*) FROM scanned_candidates WHERE context_score NOT BETWEEN 0 AND 100 OR literary_quality_score NOT BETWEEN 0 AND 100""")
def f34_validators(spark, sf):
    """Rules and the rows that break them."""
    q, c = table(spark, sf, "quotes"), table(spark, sf, "scanned_candidates")
    length = F.col("highlight_end") - F.col("highlight_start")
    one = q.agg(
        F.count_if(F.col("time_24h") != S.minute_to_time(F.col("minute_of_day"))).alias("minute_and_clock"),
        F.count_if((F.col("highlight_start") < 0) | (F.col("highlight_end") > F.length("quote")) | (length <= 0)).alias("highlight_inside"),
        F.count_if((F.col("quality_status") == "VERIFIED_EXACT") & F.col("highlight_start").isNotNull() & (S.highlighted(F.col("quote"), F.col("highlight_start"), F.col("highlight_end")) != F.col("time_text"))).alias("highlight_is_phrase"),
    )
    two = q.groupBy("quote_id").count().filter("count > 1").agg(F.count("*").alias("unique_ids"))
    three = c.agg(
        F.count_if((F.col("minute_of_day").isNull() == F.col("possible_minute_am").isNull()) | (F.col("possible_minute_pm") != F.col("possible_minute_am") + 720)).alias("two_minutes_or_one"),
        F.count_if(~F.col("context_score").between(0, 100) | ~F.col("literary_quality_score").between(0, 100)).alias("scores"),
    )
    parts = [df.unpivot([], df.columns, "rule", "broken") for df in (one, two, three)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT minute_of_day AS minute, arg_min(quote_id, (abs(length(quote) - 180), quote_id)) AS quote_id FROM quotes WHERE quote IS NOT NULL AND minute_of_day IS NOT NULL GROUP BY 1")
def f36_nearest_length(spark, sf):
    rows = table(spark, sf, "quotes").filter("quote is not null and minute_of_day is not null")
    return rows.groupBy(F.col("minute_of_day").alias("minute")).agg(F.min_by("quote_id", F.struct(F.abs(F.length("quote") - 180), F.col("quote_id"))).alias("quote_id"))


def _history(spark, sf):
    """What was shown: the imports as a log, one display each; and now, when the last of them was."""
    p = table(spark, sf, "quote_provenance")
    now = p.agg(F.max("created_at")).first()[0]
    return p.select(F.col("quote_id").alias("id"), F.col("raw_title").alias("title"), F.col("raw_author").alias("author"), F.col("created_at").alias("at")), F.lit(now).cast("timestamp")


_LEVELS = """now AS (SELECT max(created_at) AS t FROM quote_provenance), h AS (SELECT p.* FROM quote_provenance p, now WHERE created_at <= now.t AND created_at >= now.t - INTERVAL 90000 SECONDS),
a AS (SELECT lower(raw_author) AS k, max(created_at) AS t FROM h WHERE trim(raw_author) <> '' GROUP BY 1), b AS (SELECT lower(raw_title) AS k, max(created_at) AS t FROM h WHERE trim(raw_title) <> '' GROUP BY 1), c AS (SELECT quote_id AS k, max(created_at) AS t FROM h GROUP BY 1),
l AS (SELECT q.quote_id AS id, CASE WHEN c.t IS NOT NULL AND floor(epoch(now.t)) - floor(epoch(c.t)) < 86400 THEN 4 ELSE 0 END + CASE WHEN b.t IS NOT NULL AND floor(epoch(now.t)) - floor(epoch(b.t)) < 43200 THEN 2 ELSE 0 END + CASE WHEN a.t IS NOT NULL AND floor(epoch(now.t)) - floor(epoch(a.t)) < 21600 THEN 1 ELSE 0 END AS level,
  q.minute_of_day, q.quality_status FROM quotes q CROSS JOIN now LEFT JOIN a ON a.k = lower(q.author) LEFT JOIN b ON b.k = lower(q.title) LEFT JOIN c ON c.k = q.quote_id)"""


@query(f"WITH {_LEVELS} SELECT id, level FROM l")
def g03_g09_levels(spark, sf):
    rows = table(spark, sf, "quotes").select(F.col("quote_id").alias("id"), "title", "author")
    return G.with_level(rows, *_history(spark, sf)).select("id", "level")


@query(
    f"""WITH {_LEVELS},
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i << 24, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 2147483648 > 0 THEN xor((c << 1) & 4294967295, 79764919) ELSE c << 1 END)) AS t),
k AS (SELECT minute_of_day AS minute, id, level, 'r1:0:' || minute_of_day || ':' || id AS s FROM l WHERE minute_of_day IS NOT NULL AND quality_status LIKE 'VERIFIED%'),
d AS (SELECT minute, id, level, 4294967295 - list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(range(1, length(s) + 1), lambda i: CAST(ord(s[i]) AS BIGINT)), [CAST(length(s) AS BIGINT)]), lambda c, x: xor((c << 8) & 4294967295, t[xor(c >> 24, x) + 1])) AS bag FROM k, crc)
SELECT minute, arg_min(id, (level, bag, id)) AS id, min(level) AS level FROM d GROUP BY minute"""
)
def g01_g08_choice(spark, sf):
    """One quote for each minute of the day."""
    rows = table(spark, sf, "quotes").filter("minute_of_day is not null and quality_status like 'VERIFIED%'").select(F.col("minute_of_day").alias("minute"), F.col("quote_id").alias("id"), "title", "author")
    return G.choose(rows, *_history(spark, sf))


@query("SELECT minute_of_day AS minute, quote_id FROM quotes WHERE minute_of_day IS NOT NULL AND sfw")
def a45_minute_index(spark, sf):
    """The pool of each minute as sorted rows: ranges of minute and id, so that a hot minute is dealt to several tasks."""
    return table(spark, sf, "quotes").filter("minute_of_day is not null and sfw").select(F.col("minute_of_day").alias("minute"), "quote_id").orderBy("minute", "quote_id")


@query("SELECT event_id, CASE WHEN prev IS NULL OR CAST(prev AS DATE) <> CAST(ts AS DATE) OR n % 15 = 0 THEN 'GC16' ELSE 'GL16' END AS mode FROM (SELECT event_id, ts, lag(ts) OVER w AS prev, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def g13_refresh_mode(spark, sf):
    shown = table(spark, sf, "events").select("event_id", F.col("user_id").alias("device"), F.col("ts").alias("at"))
    return G.refresh_mode(shown, order=("at", "event_id")).select("event_id", "mode")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M') AS tick, min(event_id) AS event_id, count(*) AS repeats FROM events GROUP BY 1, 2")
def g12_first_of_minute(spark, sf):
    """One display per device and minute: the first; later ones of the minute repeat it."""
    return table(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("tick")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("repeats"))
