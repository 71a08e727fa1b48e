"""Queries of aggregation over the minutes of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions import scalars as S
from gnomon.operators import coverage as C
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


_USABLE = "quality_status IN ('VERIFIED_EXACT', 'VERIFIED_NORMALIZED')"
_COVER = f"""SELECT m.minute, coalesce(total, 0) AS total, coalesce(usable, 0) AS usable, coalesce(authors, 0) AS authors, coalesce(titles, 0) AS titles FROM (SELECT CAST(i AS INT) AS minute FROM range(1440) t(i)) m
LEFT JOIN (SELECT minute_of_day AS minute, count(*) AS total, count(*) FILTER ({_USABLE}) AS usable, count(DISTINCT nullif(trim(author), '')) AS authors, count(DISTINCT nullif(trim(title), '')) AS titles FROM quotes WHERE minute_of_day IS NOT NULL GROUP BY 1) q USING (minute)"""


def covered(spark: SparkSession, sf: str) -> DataFrame:
    return C.coverage(table(spark, sf, "quotes"), usable=F.col("quality_status").isin("VERIFIED_EXACT", "VERIFIED_NORMALIZED"))


@query(_COVER)
def d01_d04_e17_coverage(spark, sf):
    return covered(spark, sf)


@query("SELECT CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute, count(*) AS total, count(*) FILTER (event_type = 'error') AS usable FROM events GROUP BY 1")
def d01_event_minutes(spark, sf):
    rows = table(spark, sf, "events").withColumn("minute", (F.hour("ts") * 60 + F.minute("ts")).cast("int"))
    return rows.groupBy("minute").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("usable"))


@query("SELECT DISTINCT minute_of_day AS minute, 'author' AS kind, lower(author) AS name FROM quotes WHERE author IS NOT NULL UNION ALL SELECT DISTINCT minute_of_day, 'title', lower(title) FROM quotes WHERE title IS NOT NULL")
def d02_names_of_minutes(spark, sf):
    """The authors and titles of each minute, as a set of rows: no minute's set is held by one task."""
    names = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.lower(c).alias("name")) for c in ("author", "title")))).alias("x")
    return table(spark, sf, "quotes").select(F.col("minute_of_day").alias("minute"), names).select("minute", "x.kind", "x.name").filter("name is not null").distinct()


@query(f"SELECT round(avg(usable), 6) AS mean, round(median(usable), 6) AS median, round(quantile_cont(usable, 0.1), 6) AS p10, round(quantile_cont(usable, 0.25), 6) AS p25, round(quantile_cont(usable, 0.75), 6) AS p75, round(quantile_cont(usable, 0.9), 6) AS p90, min(usable) AS least, max(usable) AS most FROM ({_COVER})")
def d05_d07_spread(spark, sf):
    found = C.spread(covered(spark, sf))
    return found.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes))


@query(f"SELECT CAST(ceil(quantile_cont(usable, 0.9)) AS BIGINT) AS p90 FROM ({_COVER})")
def d06_p90_ceiling(spark, sf):
    return covered(spark, sf).agg(F.ceil(F.percentile("usable", F.lit(0.9))).alias("p90"))


@query(f"SELECT count(*) FILTER (usable = 0) AS empty, count(*) FILTER (usable = 1) AS one, count(*) FILTER (usable = 2) AS two, count(*) FILTER (usable < 3) AS below_3, count(*) FILTER (usable < 5) AS below_5, count(*) FILTER (usable < 7) AS below_7, count(*) FILTER (usable >= 7) AS from_7, count(*) FILTER (usable >= 14) AS from_14, CAST(sum(greatest(0, 7 - usable)) AS BIGINT) AS missing, CAST(sum(usable) AS BIGINT) AS usable FROM ({_COVER})")
def d08_d09_thresholds(spark, sf):
    return C.thresholds(covered(spark, sf))


def _top(column: str) -> str:
    return f"SELECT trim({column}) AS name, count(*) AS n FROM quotes WHERE nullif(trim({column}), '') IS NOT NULL GROUP BY 1 ORDER BY n DESC, lower(name), name LIMIT 20"


@query(_top("author"))
def d10_top_authors(spark, sf):
    return C.top_groups(table(spark, sf, "quotes"), "author")


@query(_top("title"))
def d10_top_titles(spark, sf):
    return C.top_groups(table(spark, sf, "quotes"), "title")


@query("SELECT arg_min(quote_id, (length(quote), quote_id)) AS shortest, min(length(quote)) AS least, arg_max(quote_id, (length(quote), -quote_id)) AS longest, max(length(quote)) AS most FROM quotes WHERE quote IS NOT NULL")
def d11_extreme_quotes(spark, sf):
    n = F.length("quote")
    return table(spark, sf, "quotes").filter("quote is not null").agg(F.min_by("quote_id", F.struct(n, F.col("quote_id"))).alias("shortest"), F.min(n).cast("bigint").alias("least"), F.max_by("quote_id", F.struct(n, -F.col("quote_id"))).alias("longest"), F.max(n).cast("bigint").alias("most"))


@query("SELECT source, count(*) AS candidates, count(*) FILTER (minute_of_day IS NOT NULL) AS certain, count(*) FILTER (possible_minute_am IS NOT NULL) AS open, count(DISTINCT title) AS titles, round(avg(context_score), 6) AS context FROM scanned_candidates GROUP BY source")
def d12_d13_source_stats(spark, sf):
    return table(spark, sf, "scanned_candidates").groupBy("source").agg(
        F.count("*").alias("candidates"), F.count_if(F.col("minute_of_day").isNotNull()).alias("certain"), F.count_if(F.col("possible_minute_am").isNotNull()).alias("open"), F.count_distinct("title").alias("titles"), F.round(F.avg("context_score"), 6).alias("context")
    )


@query(f"SELECT CASE WHEN c.minute_of_day IS NULL THEN 'open' WHEN m.usable < 3 THEN 'sparse' WHEN m.usable < 7 THEN 'thin' ELSE 'dense' END AS kind, count(*) AS n FROM scanned_candidates c LEFT JOIN ({_COVER}) m ON m.minute = c.minute_of_day GROUP BY 1")
def d14_accounting(spark, sf):
    """Every candidate in exactly one class of its minute."""
    rows = table(spark, sf, "scanned_candidates").select(F.col("minute_of_day").alias("minute")).join(F.broadcast(covered(spark, sf).select("minute", "usable")), "minute", "left")
    kind = F.when(F.col("minute").isNull(), "open").when(F.col("usable") < 3, "sparse").when(F.col("usable") < 7, "thin").otherwise("dense")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT m.minute, count(c.cand_id) AS candidates, count(c.cand_id) FILTER (review_status = 'PENDING') AS pending, count(c.cand_id) FILTER (review_status = 'IMPORTED') AS imported, count(c.cand_id) FILTER (literary_quality_score >= 60) AS good, count(DISTINCT lower(author)) AS authors FROM (SELECT CAST(i AS INT) AS minute FROM range(1440) t(i)) m LEFT JOIN scanned_candidates c ON c.minute_of_day = m.minute GROUP BY 1")
def d15_candidate_pivot(spark, sf):
    counts = table(spark, sf, "scanned_candidates").filter("minute_of_day is not null").groupBy(F.col("minute_of_day").alias("minute")).agg(
        F.count("*").alias("candidates"), F.count_if(F.col("review_status") == "PENDING").alias("pending"), F.count_if(F.col("review_status") == "IMPORTED").alias("imported"), F.count_if(F.col("literary_quality_score") >= 60).alias("good"), F.count_distinct(F.lower("author")).alias("authors")
    )
    return C.spine(spark).join(counts, "minute", "left").fillna(0)


@query("SELECT coalesce(rejection_reason, review_status, 'UNPROCESSED') AS pattern, count(*) AS n FROM scanned_candidates GROUP BY 1")
def d16_patterns(spark, sf):
    return table(spark, sf, "scanned_candidates").groupBy(F.coalesce("rejection_reason", "review_status", F.lit("UNPROCESSED")).alias("pattern")).agg(F.count("*").alias("n"))


@query("SELECT quote_id, count(*) AS deliveries, count(DISTINCT source_id) AS sources FROM quote_provenance GROUP BY quote_id HAVING count(DISTINCT source_id) >= 2")
def d17_having(spark, sf):
    return table(spark, sf, "quote_provenance").groupBy("quote_id").agg(F.count("*").alias("deliveries"), F.count_distinct("source_id").alias("sources")).filter("sources >= 2")


@query("SELECT validation_status, duplicate_kind, count(*) AS n, count(*) FILTER (raw_author LIKE '%,%') AS turned FROM quote_provenance GROUP BY 1, 2")
def d18_matrix(spark, sf):
    return table(spark, sf, "quote_provenance").groupBy("validation_status", "duplicate_kind").agg(F.count("*").alias("n"), F.count_if(F.col("raw_author").contains(",")).alias("turned"))


@query("WITH a AS (SELECT DISTINCT TRY_CAST(nullif(regexp_extract(trim(quote_id), '^([+-]?\\d{1,18})(\\.0*)?$', 1), '') AS BIGINT) AS quote_id, adjudication_action AS action FROM english_v2_manual_adjudications) SELECT q.minute_of_day AS minute, count(DISTINCT q.quote_id) AS quotes, array_to_string(list_sort(list_distinct(list(a.action))), ',') AS actions FROM quotes q JOIN a USING (quote_id) GROUP BY 1")
def d19_minute_impacts(spark, sf):
    """For each minute the quotes that reviewers judged, and how."""
    from gnomon.operators.references import whole_number

    judged = table(spark, sf, "english_v2_manual_adjudications").select(whole_number(F.col("quote_id")).alias("quote_id"), F.col("adjudication_action").alias("action")).distinct()
    rows = table(spark, sf, "quotes").select("quote_id", F.col("minute_of_day").alias("minute")).join(judged, "quote_id")
    return rows.groupBy("minute").agg(F.count_distinct("quote_id").alias("quotes"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))


@query("SELECT minute, count(*) AS n FROM (SELECT quote_id, minute_of_day AS minute FROM quotes WHERE minute_of_day IS NOT NULL UNION SELECT cand_id, minute_of_day FROM scanned_candidates WHERE minute_of_day IS NOT NULL) GROUP BY 1")
def d20_union_counts(spark, sf):
    both = table(spark, sf, "quotes").select(F.col("quote_id").alias("id"), F.col("minute_of_day").alias("minute")).union(table(spark, sf, "scanned_candidates").select("cand_id", "minute_of_day")).filter("minute is not null").distinct()
    return both.groupBy("minute").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT CAST(i AS INT) AS minute, (SELECT count(*) FROM quotes WHERE minute_of_day = i) AS n FROM range(1440) t(i)) SELECT n.minute, n.n, greatest(0, 3 - n.n) AS to_3, greatest(0, 5 - n.n) AS to_5, greatest(0, 7 - n.n) AS to_7, coalesce(array_to_string(list_sort(list(q.quote_id)), ','), '') AS ids, coalesce(array_to_string(list_sort(list_distinct(list(lower(q.author)))), ','), '') AS names FROM n LEFT JOIN quotes q ON q.minute_of_day = n.minute WHERE n.n <= 2 GROUP BY 1, 2")
def d21_sparse_targets(spark, sf):
    return C.sparse_targets(table(spark, sf, "quotes"))


@query("""SELECT sha256(concat_ws(',', n, s0, s1, s2, s3, x0, x1, x2, x3)) AS fingerprint, n AS rows FROM (SELECT count(*) AS n, sum(w0) AS s0, sum(w1) AS s1, sum(w2) AS s2, sum(w3) AS s3, bit_xor(w0) AS x0, bit_xor(w1) AS x1, bit_xor(w2) AS x2, bit_xor(w3) AS x3
FROM (SELECT CAST('0x' || h[1:15] AS BIGINT) AS w0, CAST('0x' || h[16:30] AS BIGINT) AS w1, CAST('0x' || h[31:45] AS BIGINT) AS w2, CAST('0x' || h[46:60] AS BIGINT) AS w3 FROM (SELECT sha256(concat_ws(chr(0), coalesce(CAST(quote_id AS VARCHAR), ''), coalesce(CAST(minute_of_day AS VARCHAR), ''), coalesce(quote_hash, ''))) AS h FROM quotes)))""")
def d22_fingerprint(spark, sf):
    return C.fingerprint(table(spark, sf, "quotes"), ["quote_id", "minute_of_day", "quote_hash"])


@query("SELECT r.import_run_id, r.run_status, count(p.provenance_id) AS rows, count(DISTINCT p.provenance_id) AS imports, count(p.provenance_id) FILTER (p.created_at > r.finished_at) AS late FROM import_runs r LEFT JOIN quote_provenance p ON p.import_run_id = r.import_run_id GROUP BY 1, 2")
def d24_run_counters(spark, sf):
    """Sums by run before the join: the runs' table is small whatever the imports."""
    runs = table(spark, sf, "import_runs").select("import_run_id", "run_status", "finished_at")
    rows = table(spark, sf, "quote_provenance").select("import_run_id", "provenance_id", "created_at").join(runs, "import_run_id")
    sums = rows.groupBy("import_run_id").agg(F.count("*").alias("rows"), F.count_distinct("provenance_id").alias("imports"), F.count_if(F.col("created_at") > F.col("finished_at")).alias("late"))
    return runs.select("import_run_id", "run_status").join(sums, "import_run_id", "left").fillna(0)


_AFTER = "SELECT minute, usable + coalesce(available, 0) AS usable FROM (" + _COVER + ") c LEFT JOIN (SELECT minute_of_day AS minute, count(*) AS available FROM scanned_candidates WHERE minute_of_day IS NOT NULL GROUP BY 1) o USING (minute)"


@query(f"WITH b AS (SELECT minute % 720 AS pair, CAST(sum(greatest(0, 7 - usable)) AS BIGINT) AS lack_before FROM ({_COVER}) GROUP BY 1), a AS (SELECT minute % 720 AS pair, CAST(sum(greatest(0, 7 - usable)) AS BIGINT) AS lack_after FROM ({_AFTER}) GROUP BY 1) SELECT pair, lack_before, lack_after, lack_before - lack_after AS gain FROM b JOIN a USING (pair)")
def d25_paired(spark, sf):
    before = covered(spark, sf)
    offered = table(spark, sf, "scanned_candidates").filter("minute_of_day is not null").groupBy(F.col("minute_of_day").alias("minute")).agg(F.count("*").alias("available"))
    after = before.join(offered, "minute", "left").fillna(0, ["available"]).withColumn("usable", F.col("usable") + F.col("available"))
    return C.paired(before, after)


@query(f"SELECT minute, usable, coalesce(available, 0) AS available, least(greatest(0, 7 - usable), coalesce(available, 0)) AS taken, usable + least(greatest(0, 7 - usable), coalesce(available, 0)) AS reached FROM ({_COVER}) c LEFT JOIN (SELECT minute_of_day AS minute, count(*) AS available FROM scanned_candidates WHERE minute_of_day IS NOT NULL GROUP BY 1) o USING (minute)")
def f09_fill_gain(spark, sf):
    offered = table(spark, sf, "scanned_candidates").filter("minute_of_day is not null").groupBy(F.col("minute_of_day").alias("minute")).agg(F.count("*").alias("available"))
    return C.fill_gain(covered(spark, sf), offered)


@query(f"SELECT *, row_number() OVER (ORDER BY usable, total, authors, titles, minute) AS rank FROM ({_COVER})")
def f01_target_rank(spark, sf):
    return C.target_rank(covered(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT minute, usable, CASE WHEN usable <= 2 THEN 6 - usable WHEN usable <= 4 THEN 3 WHEN usable <= 6 THEN 2 ELSE 0 END AS band FROM ({_COVER})")
def b19_sparse_band(spark, sf):
    return covered(spark, sf).select("minute", "usable", S.sparse_band(F.col("usable")).cast("bigint").alias("band"))


@query("""SELECT count(*) AS quotes, count(DISTINCT minute_of_day) AS minutes, count(DISTINCT nullif(trim(author), '')) AS authors, count(DISTINCT nullif(trim(title), '')) AS titles, count(*) FILTER (quality_status LIKE 'VERIFIED%') AS verified, count(*) FILTER (sfw) AS sfw, count(*) FILTER (sfw IS NULL) AS unlabelled,
  count(*) FILTER (highlight_start IS NULL) AS unmarked, min(length(quote)) AS shortest, max(length(quote)) AS longest, round(avg(length(quote)), 6) AS mean_length, count(DISTINCT source_name) AS sources FROM quotes""")
def d03_corpus_report(spark, sf):
    """The corpus in numbers, in one aggregation."""
    return C.corpus_report(table(spark, sf, "quotes"))


_SHORT = f"SELECT count(*) FILTER (usable = 0) AS empty, count(*) FILTER (usable < 3) AS below_3, count(*) FILTER (usable < 7) AS below_7, CAST(sum(greatest(0, 7 - usable)) AS BIGINT) AS missing, CAST(sum(usable) AS BIGINT) AS usable FROM"


@query(f"""WITH c AS ({_COVER}), o AS (SELECT minute_of_day AS minute, count(*) AS n FROM scanned_candidates WHERE minute_of_day IS NOT NULL GROUP BY 1), a AS (SELECT c.minute, c.usable + coalesce(o.n, 0) AS usable FROM c LEFT JOIN o USING (minute)),
x AS ({_SHORT} c), y AS ({_SHORT} a)
SELECT 'empty' AS metric, x.empty AS before, y.empty AS after, y.empty - x.empty AS change FROM x, y UNION ALL SELECT 'below_3', x.below_3, y.below_3, y.below_3 - x.below_3 FROM x, y UNION ALL SELECT 'below_7', x.below_7, y.below_7, y.below_7 - x.below_7 FROM x, y
UNION ALL SELECT 'missing', x.missing, y.missing, y.missing - x.missing FROM x, y UNION ALL SELECT 'usable', x.usable, y.usable, y.usable - x.usable FROM x, y""")
def d26_before_and_after(spark, sf):
    """What the candidates would change in the measures of coverage."""
    before = covered(spark, sf).select("minute", "usable")
    offered = table(spark, sf, "scanned_candidates").filter("minute_of_day is not null").groupBy(F.col("minute_of_day").alias("minute")).agg(F.count("*").alias("n"))
    after = before.join(offered, "minute", "left").select("minute", (F.col("usable") + F.coalesce("n", F.lit(0))).alias("usable"))
    return C.metric_rows(before, after, ["empty", "below_3", "below_7", "missing", "usable"])
