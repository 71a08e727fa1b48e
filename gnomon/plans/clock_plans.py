"""Queries of clock-time expressions: over all passages, and over sentences made from timestamps, whose minute SQL knows by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions import gates
from gnomon.functions import scalars as S
from gnomon.functions.clock import SCRIPTURE, times
from gnomon.session import spread, table

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


@query()
def c01_c11_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading of every quote."""
    rows = spread(table(spark, sf, "quotes").select("quote_id", "quote")).select("quote_id", F.posexplode(times(F.col("quote"))).alias("place", "r"))
    return rows.select("quote_id", "place", F.col("r.start").alias("start_char"), F.col("r.end").alias("end_char"), "r.text", "r.minute", "r.confidence", "r.rule", F.array_join(F.transform("r.options", lambda x: x.cast("string")), "|").alias("options"), "r.reason")


@query()
def c22_display_minutes(spark, sf):
    """The minutes that a candidate may be shown at: those of its one reading, if it has one that is exact or leaves two options."""
    rows = spread(table(spark, sf, "scanned_candidates").select("cand_id", "quote")).select("cand_id", times(F.col("quote")).alias("r")).filter(F.size("r") == 1).select("cand_id", F.col("r")[0].alias("r"))
    minutes = F.coalesce(F.when(F.col("r.minute").isNotNull(), F.array("r.minute")), F.col("r.options"))
    return rows.select("cand_id", F.explode(minutes).alias("minute"))


@query()
def c16_agreement(spark, sf):
    """How far the readings of a quote agree with its own minute."""
    rows = spread(table(spark, sf, "quotes").select("minute_of_day", "quote")).select("minute_of_day", times(F.col("quote")).alias("r"))
    exact = F.exists("r", lambda x: x["minute"] == F.col("minute_of_day"))
    option = F.exists("r", lambda x: F.array_contains(x["options"], F.col("minute_of_day")))
    kind = F.when(F.size("r") == 0, "none").when(exact, "exact").when(option, "option").otherwise("other")
    return rows.groupBy(kind.alias("agreement")).agg(F.count("*").alias("n"))


def made(spark: SparkSession, sf: str, sentence) -> DataFrame:
    """Sentences made from the minute of each event."""
    rows = spread(table(spark, sf, "events").select("event_id", "ts")).select("event_id", (F.hour("ts") * 60 + F.minute("ts")).cast("int").alias("m"))
    hour = F.floor(F.col("m") / 60).cast("int")
    return rows.withColumn("text", sentence(hour, (F.col("m") % 60).cast("int")))


def _twelve(hour: Column) -> Column:
    return F.pmod(hour + 11, F.lit(12)) + 1


_M = "CAST(hour(ts) * 60 + minute(ts) AS INT)"


@query(f"SELECT event_id, {_M} AS minute, CASE WHEN hour(ts) < 12 THEN 'EXACT_AM' ELSE 'EXACT_PM' END AS confidence FROM events")
def c05_round_trip_numeric(spark, sf):
    text = made(spark, sf, lambda h, m: F.concat(F.lit("At "), F.format_string("%d:%02d ", _twelve(h), m), F.when(h < 12, "a.m.").otherwise("p.m."), F.lit(", the porter closed the gate.")))
    return text.select("event_id", F.explode(times(F.col("text"))).alias("r")).select("event_id", "r.minute", "r.confidence")


def _part(hour: Column) -> Column:
    return F.when(hour < 12, " in the morning.").when(hour < 18, " in the afternoon.").otherwise(" in the evening.")


@query(f"SELECT event_id, {_M} AS minute FROM events")
def c04_round_trip_relative(spark, sf):
    """Minutes past and to an hour, and whole hours, resolved by the part of the day: every minute of the day."""

    def said(h: Column, m: Column) -> Column:
        past, to = S.number_words(_twelve(h)), S.number_words(_twelve(h) % 12 + 1)
        minutes = lambda n: F.concat(S.number_words(n), F.when(n == 1, " minute").otherwise(" minutes"))
        told = F.when(m == 0, F.concat(past, F.lit(" o’clock"))).when(m <= 30, F.concat(minutes(m), F.lit(" past "), past)).otherwise(F.concat(minutes(60 - m), F.lit(" to "), to))
        return F.concat(F.lit("It was "), told, _part(h))

    return made(spark, sf, said).select("event_id", F.explode(times(F.col("text"))).alias("r")).select("event_id", "r.minute")


@query("SELECT event_id, CAST(o.minute AS INT) AS minute FROM events, UNNEST([(hour(ts) % 12) * 60, (hour(ts) % 12) * 60 + 720]) AS o(minute)")
def c06_round_trip_oclock(spark, sf):
    """Without a part of the day an hour is two minutes of the day."""
    text = made(spark, sf, lambda h, m: F.concat(F.lit("The clock struck; it was "), S.number_words(_twelve(h)), F.lit(" o’clock and raining.")))
    return text.select("event_id", F.explode(times(F.col("text"))).alias("r")).select("event_id", F.explode("r.options").alias("minute"))


@query("SELECT 'INVALID' AS confidence, 'reference:CHAPTER_VERSE' AS reason, count(*) AS n FROM events")
def c10_references(spark, sf):
    """Chapter and verse look like times and are none."""
    text = made(spark, sf, lambda h, m: F.concat(F.lit("He turned to chapter "), F.format_string("%d:%02d", h, m), F.lit(" and read on.")))
    return text.select(F.explode(times(F.col("text"))).alias("r")).groupBy("r.confidence", "r.reason").agg(F.count("*").alias("n"))


@query("SELECT 'APPROXIMATE' AS confidence, count(*) AS n FROM events")
def c03_approximate(spark, sf):
    text = made(spark, sf, lambda h, m: F.concat(F.lit("They left at about "), S.number_words(_twelve(h)), F.lit(" o’clock.")))
    return text.select(F.explode(times(F.col("text"))).alias("r")).groupBy("r.confidence").agg(F.count("*").alias("n"))


@query("SELECT 'RANGE' AS confidence, count(*) AS n FROM events")
def c11_ranges(spark, sf):
    text = made(spark, sf, lambda h, m: F.concat(F.lit("The fair ran from "), F.format_string("%d:%02d", h, m), F.lit(" to "), F.format_string("%d:%02d", (h + 1) % 24, m), F.lit(" that day.")))
    return text.select(F.explode(times(F.col("text"))).alias("r")).groupBy("r.confidence").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\d{1,2}[:.]\d{2}|o.clock|midnight|noon')")
def b59_prefilter(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").rlike(r"(?i)\d{1,2}[:.]\d{2}|o.clock|midnight|noon")).select("doc_id")


@query()
def c27_scan_documents(spark, sf):
    """Documents to paragraphs to readings: paragraph, place, and the text of the paragraphs beside it."""
    from gnomon.operators.ordering import neighbours

    parts = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", r"\R\s*\R")).alias("paragraph", "text"))
    near = neighbours(parts, "doc_id", [F.asc("paragraph")], "text")
    return near.select("doc_id", "paragraph", F.length("before").alias("before"), F.length("behind").alias("behind"), F.explode(times(F.col("text"))).alias("r")).select("doc_id", "paragraph", "before", "behind", F.col("r.start").alias("start_char"), "r.text", "r.minute", "r.confidence")


@query()
def b26_b30_context(spark, sf):
    """The context of each candidate's highlight in its passage, with scores and the grounds to reject it."""
    from gnomon.functions.passages import extent_column, ground_column, scored

    rows = spread(table(spark, sf, "scanned_candidates").select("cand_id", "quote", "highlight_start", "highlight_end")).select("*", extent_column("quote", "highlight_start", "highlight_end").alias("c"), ground_column("quote").alias("ground"))
    cut = lambda a, b: F.substring(F.col("quote"), a + 1, b - a)
    s = scored(cut(F.col("c.start"), F.col("c.end")), cut(F.col("highlight_start"), F.col("highlight_end")))
    return rows.select("cand_id", F.col("c.start").alias("start_char"), F.col("c.end").alias("end_char"), s.alias("s"), "ground").select("cand_id", "start_char", "end_char", "s.context_score", "s.literary_score", "s.reason", "ground")


@query(
    r"""SELECT cand_id, CAST(greatest(0, least(100, 40 + CASE WHEN n BETWEEN 80 AND 350 THEN 35 WHEN n BETWEEN 40 AND 600 THEN 22 ELSE -30 END + CASE WHEN regexp_matches(quote, '^[\p{Lu}“‘"'']') THEN 10 ELSE 0 END
  + CASE WHEN ends THEN 10 ELSE 0 END - CASE WHEN twice THEN 30 ELSE 0 END)) AS DOUBLE) AS context_score,
  CAST(greatest(0, least(100, 25 + CASE WHEN len(w) >= 8 THEN 30 ELSE 0 END + CASE WHEN length(regexp_replace(quote, '\P{L}+', '', 'g')) >= 0.55 * greatest(n, 1) THEN 20 ELSE 0 END + CASE WHEN regexp_matches(quote, '[,;:“"]') THEN 15 ELSE 0 END
  + CASE WHEN len(list_distinct(w)) >= least(len(w), 10) THEN 10 ELSE 0 END - CASE WHEN listing THEN 60 ELSE 0 END)) AS DOUBLE) AS literary_score,
  CASE WHEN n < 40 THEN 'too short' WHEN n > 600 THEN 'too long' WHEN twice THEN 'phrase repeats' WHEN listing THEN 'listing' WHEN regexp_matches(quote, '^\P{L}*\p{Ll}') THEN 'begins inside a sentence' WHEN NOT ends THEN 'no end of sentence' END AS reason
FROM (SELECT *, length(quote) AS n, regexp_extract_all(lower(quote), '\p{L}+(?:[’'']\p{L}+)?') AS w, regexp_matches(quote, '[.?!][”’]?$') AS ends,
  length(quote) - length(replace(lower(quote), lower(time_text), '')) > length(time_text) AS twice,
  regexp_matches(quote, '^(?i:chapter\s+[0-9ivxlc]+|contents|copyright|isbn|table\s+of|http\S+|attendance\s*:|hours\s*:|time\s*[,.:])') AS listing FROM scanned_candidates WHERE quote IS NOT NULL AND time_text IS NOT NULL)"""
)
def b28_scores(spark, sf):
    """The two scores of each candidate's whole passage, and the first ground to reject it."""
    from gnomon.functions.passages import scored

    rows = table(spark, sf, "scanned_candidates").filter("quote is not null and time_text is not null")
    return rows.select("cand_id", scored(F.col("quote"), F.col("time_text")).alias("s")).select("cand_id", "s.context_score", "s.literary_score", "s.reason")


@query()
def b49_b50_excerpts(spark, sf):
    """Shorter forms of each quote around its highlight."""
    from gnomon.functions.passages import excerpt_column

    rows = spread(table(spark, sf, "quotes").select("quote_id", "quote", "highlight_start", "highlight_end")).select("quote_id", F.posexplode(excerpt_column("quote", "highlight_start", "highlight_end")).alias("place", "e"))
    return rows.select("quote_id", "place", "e.text", "e.highlight_start", "e.highlight_end")


@query()
def b29_sentence_of_highlight(spark, sf):
    """The length of the sentence that holds a quote's highlight."""
    from gnomon.functions.passages import span_column

    rows = table(spark, sf, "quotes").filter("highlight_start is not null").select("quote_id", "highlight_start", "highlight_end", span_column("quote").alias("s"))
    own = F.filter("s", lambda x: (x[0] <= F.col("highlight_start")) & (F.col("highlight_end") <= x[1]))
    return rows.select("quote_id", F.when(F.size(own) > 0, own[0][1] - own[0][0]).alias("chars"))


def _sql_shown(text: str) -> str:
    bare = f"translate(lower({text}), '“”‘’—–', '\"\"' || chr(39) || chr(39) || '--')"
    return f"regexp_replace(trim(regexp_replace(regexp_replace({bare}, '\\s+', ' ', 'g'), ' ([,.;:!?])', '\\1', 'g'), ' '), '\\.+$', '')"


@query(f"SELECT a.provenance_id, {_sql_shown('a.raw_title')} = {_sql_shown('q.title')} AS same FROM quote_provenance a JOIN quotes q USING (quote_id)")
def b56_same_when_shown(spark, sf):
    """Whether the titles of imports and quotes look the same, of all pairs; null where a title is."""
    from gnomon.functions.passages import same_when_shown

    p, q = table(spark, sf, "quote_provenance").select("provenance_id", "quote_id", "raw_title"), table(spark, sf, "quotes").select("quote_id", "title")
    return p.join(q, "quote_id").select("provenance_id", same_when_shown(F.col("raw_title"), F.col("title")).alias("same"))


@query("""WITH e AS (SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(hour(ts) * 60 + minute(ts) AS INT) AS t FROM events)
SELECT event_id, f.form, f.kind, f.action, f.reason, f.confidence, f.minutes FROM e, UNNEST([
  {'form': 'numeric', 'kind': 'CLOCK_TIME_EXACT', 'action': 'KEEP', 'reason': 'CLOCK_GRAMMAR_NUMERIC', 'confidence': 'HIGH', 'minutes': CAST(t AS VARCHAR)},
  {'form': 'wrong', 'kind': 'CLOCK_TIME_EXACT', 'action': 'QUARANTINE', 'reason': 'HIGHLIGHT_SEMANTIC_MISMATCH', 'confidence': 'HIGH', 'minutes': CAST(t AS VARCHAR)},
  {'form': 'dot', 'kind': 'CLOCK_TIME_EXACT', 'action': 'KEEP', 'reason': 'CLOCK_GRAMMAR_HISTORICAL_DOT', 'confidence': 'HIGH', 'minutes': CAST(t AS VARCHAR)},
  {'form': 'spoken', 'kind': 'CLOCK_TIME_AMBIGUOUS', 'action': 'KEEP', 'reason': CASE WHEN m = 0 THEN 'CLOCK_GRAMMAR_OCLOCK' ELSE 'CLOCK_GRAMMAR_RELATIVE' END, 'confidence': 'MEDIUM', 'minutes': (t % 720) || ',' || (t % 720 + 720)},
  {'form': 'military', 'kind': 'CLOCK_TIME_EXACT', 'action': 'KEEP', 'reason': CASE WHEN h < 10 THEN 'CLOCK_GRAMMAR_MILITARY' ELSE 'CLOCK_GRAMMAR_COMPACT_24H' END, 'confidence': 'HIGH', 'minutes': CAST(t AS VARCHAR)},
  {'form': 'chapter', 'kind': 'SECTION_OR_REFERENCE', 'action': 'QUARANTINE', 'reason': 'REFERENCE_CHAPTER', 'confidence': 'HIGH', 'minutes': ''},
  {'form': 'duration', 'kind': 'DURATION', 'action': 'QUARANTINE', 'reason': 'DURATION_FOR_MINUTES', 'confidence': 'HIGH', 'minutes': ''},
  {'form': 'about', 'kind': 'UNKNOWN', 'action': 'QUARANTINE', 'reason': 'APPROXIMATE_CLOCK_EXPRESSION', 'confidence': 'HIGH', 'minutes': ''},
  {'form': 'range', 'kind': 'UNKNOWN', 'action': 'QUARANTINE', 'reason': 'CLOCK_RANGE_EXPRESSION', 'confidence': 'HIGH', 'minutes': ''},
  {'form': 'later', 'kind': 'RELATIVE_DURATION', 'action': 'QUARANTINE', 'reason': 'RELATIVE_LATER', 'confidence': 'HIGH', 'minutes': ''}]) AS u(f)""")
def c12_c16_grammar(spark, sf):
    """Ten ways to use the minute of each event in a sentence, and what each highlight is."""
    from gnomon.functions.claims import judged

    rows = spread(table(spark, sf, "events").select("event_id", "ts")).select("event_id", F.hour("ts").alias("h"), F.minute("ts").alias("m"))
    h, m = F.col("h"), F.col("m")
    half, twelve = F.when(h < 12, "a.m.").otherwise("p.m."), _twelve(h)
    digits = F.format_string("%d:%02d", twelve, m)
    minutes = lambda n: F.concat(S.number_words(n), F.when(n == 1, " minute").otherwise(" minutes"))
    spoken = F.when(m == 0, F.concat(S.number_words(twelve), F.lit(" o’clock"))).when(m <= 30, F.concat(minutes(m), F.lit(" past "), S.number_words(twelve))).otherwise(F.concat(minutes(60 - m), F.lit(" to "), S.number_words(twelve % 12 + 1)))
    forms = [
        ("numeric", "It was ", F.concat_ws(" ", digits, half), " when the train left.", 0),
        ("wrong", "It was ", F.concat_ws(" ", digits, half), " when the train left.", 7),
        ("dot", "At ", F.concat_ws(" ", F.translate(digits, ":", "."), half), " the train left.", 0),
        ("spoken", "It was ", spoken, " when the train left.", 0),
        ("military", "It was ", F.format_string("%02d%02d hours", h, m), " when the train left.", 0),
        ("chapter", "He had read chapter ", digits, " aloud.", 0),
        ("duration", "They had waited for ", S.number_words(twelve), " minutes.", 0),
        ("about", "They had left at about ", F.concat(S.number_words(twelve), F.lit(" o’clock")), ".", 0),
        ("range", "The fair ran ", digits, "–3:15 that day.", 0),
        ("later", "He rose. ", F.concat(S.number_words(twelve), F.lit(" minutes")), " later he left.", 0),
    ]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("form"), F.concat(F.lit(a), p, F.lit(b)).alias("text"), F.lit(len(a)).alias("start"), (F.lit(len(a)) + F.length(p)).alias("end"), F.pmod(h * 60 + m + off, F.lit(1440)).alias("claimed")) for name, a, p, b, off in forms)))
    found = rows.select("event_id", each.alias("x")).select("event_id", "x.form", judged(F.col("x.text"), F.col("x.start"), F.col("x.end"), F.col("x.claimed")).alias("d"))
    return found.select("event_id", "form", "d.kind", "d.action", "d.reason", "d.confidence", F.array_join(F.transform("d.minutes", lambda t: t.cast("string")), ",").alias("minutes"))


@query()
def c12_c16_claims(spark, sf):
    """Whether each highlighted phrase is the time that its quote claims."""
    from gnomon.functions.claims import judged

    rows = spread(table(spark, sf, "quotes").select("quote_id", "quote", "highlight_start", "highlight_end", "minute_of_day")).select("quote_id", judged(F.col("quote"), F.col("highlight_start"), F.col("highlight_end"), F.col("minute_of_day")).alias("d"))
    return rows.select("quote_id", "d.kind", "d.action", F.array_join(F.transform("d.minutes", lambda x: x.cast("string")), ",").alias("minutes"), "d.reason", "d.confidence")


@query()
def e19_prior_and_now(spark, sf):
    """Reviewers' judgements beside what the phrase says now: counts of each pair."""
    from gnomon.functions.claims import judged
    from gnomon.operators.references import whole_number

    prior = table(spark, sf, "english_v2_manual_adjudications").select(whole_number(F.col("quote_id")).alias("quote_id"), F.col("original_minute").alias("minute"), "adjudication_action").distinct()
    held = table(spark, sf, "quotes").join(prior, "quote_id")
    rows = held.select("adjudication_action", judged(F.col("quote"), F.col("highlight_start"), F.col("highlight_end"), F.col("minute")).alias("d"))
    return rows.groupBy("adjudication_action", "d.action", "d.kind").agg(F.count("*").alias("n"))


@query(r"""SELECT quote_id, regexp_matches(quote, '(?i)\b(' || (SELECT string_agg(w, '|') FROM (VALUES %s) AS t(w)) || ')\.?\s+\d{1,3}:\d{1,3}') OR regexp_matches(quote, '(^|[.!?]\s+)[A-Z][^.!?]{0,45},\s*\d{1,3}:\d{1,3}\b')
  OR (regexp_matches(substring(quote, 1, highlight_start), '(^|[.!?][”’"]?\s+)$') AND regexp_matches(substring(quote, highlight_end + 1), '^\s*[),]')) AS citation FROM quotes WHERE quote IS NOT NULL AND highlight_start IS NOT NULL""" % ", ".join(f"('{w}')" for w in sorted(SCRIPTURE)))
def b35_citations(spark, sf):
    """Whether each highlight looks like a citation."""
    rows = table(spark, sf, "quotes").filter("quote is not null and highlight_start is not null")
    return rows.select("quote_id", gates.citation_shaped(F.col("quote"), F.col("highlight_start"), F.col("highlight_end")).alias("citation"))


@query("""SELECT cand_id, CASE WHEN NOT coalesce(list_contains([possible_minute_am, possible_minute_pm, minute_of_day], m), false) THEN 'no option' WHEN printf('%02d:%02d', m // 60, m % 60) <> coalesce(shown, '') THEN 'other than shown'
  WHEN coalesce(trim(parser_rule), '') = '' OR coalesce(trim(time_confidence), '') = '' OR coalesce(trim(author), '') = '' THEN 'no evidence' END AS fault
FROM (SELECT *, coalesce(minute_of_day, CASE WHEN cand_id % 3 = 0 THEN possible_minute_am + 1 ELSE possible_minute_pm END) AS m, CASE WHEN cand_id % 5 = 0 THEN NULL ELSE printf('%02d:%02d', coalesce(minute_of_day, possible_minute_pm) // 60, coalesce(minute_of_day, possible_minute_pm) % 60) END AS shown FROM scanned_candidates)""")
def b34_resolutions(spark, sf):
    """Whether the resolution of each candidate holds, with some that are made not to."""
    rows = table(spark, sf, "scanned_candidates")
    minute = F.coalesce("minute_of_day", F.when(F.col("cand_id") % 3 == 0, F.col("possible_minute_am") + 1).otherwise(F.col("possible_minute_pm")))
    shown = F.when(F.col("cand_id") % 5 != 0, S.minute_to_time(F.coalesce("minute_of_day", "possible_minute_pm")))
    options = F.array("possible_minute_am", "possible_minute_pm", "minute_of_day")
    return rows.select("cand_id", gates.resolution_fault(minute, options, shown, F.col("parser_rule"), F.col("time_confidence"), F.col("author")).alias("fault"))


@query()
def b31_context_faults(spark, sf):
    """Why the passage of each candidate isn't fit to be a recovered context."""
    rows = spread(table(spark, sf, "scanned_candidates").select("cand_id", "quote")).withColumn("n", F.size(times(F.col("quote"))))
    return rows.select("cand_id", gates.context_fault(F.col("quote"), F.col("n")).alias("fault"))


@query()
def b52_repairable(spark, sf):
    """Of every highlight, whether it claims another minute and may be put right by its own phrase, and the minutes that it says."""
    from gnomon.functions.claims import MISMATCH, judged

    rows = spread(table(spark, sf, "quotes").select("quote_id", "quote", "highlight_start", "highlight_end", "minute_of_day").filter("highlight_start is not null"))
    at = (F.col("quote"), F.col("highlight_start"), F.col("highlight_end"))
    claimed = rows.withColumn("d", judged(*at, F.col("minute_of_day")))
    own = claimed.withColumn("own", judged(*at, F.coalesce(F.try_element_at("d.minutes", F.lit(1)), F.col("minute_of_day"))))
    ok = (F.col("d.reason") == MISMATCH) & gates.repairable(S.highlighted(*at), F.substring(F.col("quote"), F.lit(1), F.col("highlight_start")), F.col("own.reason"))
    return own.select("quote_id", ok.alias("repairable"), F.array_join(F.transform("d.minutes", lambda x: x.cast("string")), ",").alias("minutes"))


@query()
def c20_c23_assessed(spark, sf):
    """What becomes of the candidates whose time has two halves, with their passage behind another sentence as the source."""
    from gnomon.functions.timelines import assessed

    rows = spread(table(spark, sf, "scanned_candidates").filter("possible_minute_am is not null").select("cand_id", "quote", "highlight_start", "highlight_end", "duplicate_status"))
    fault = F.when(F.col("duplicate_status").isin("EXACT", "NORMALIZED"), "duplicate")
    found = rows.select("cand_id", assessed(F.col("quote"), F.col("highlight_start"), F.col("highlight_end"), F.concat(F.lit("It had rained since breakfast. "), F.col("quote")), fault).alias("d"))
    return found.select("cand_id", "d.decision", "d.minute", "d.reason")


@query()
def c25_matching_reading(spark, sf):
    """The quotes of which exactly one reading is the phrase and the minute that they claim."""
    rows = spread(table(spark, sf, "quotes").select("quote_id", "quote", "time_text", "minute_of_day")).withColumn("r", times(F.col("quote")))
    own = F.filter("r", lambda x: (x["text"] == F.col("time_text")) & (x["minute"] == F.col("minute_of_day")))
    return rows.filter(F.size(own) == 1).select("quote_id", own[0]["start"].alias("start_char"), own[0]["rule"].alias("rule"))


@query()
def c28_process_documents(spark, sf):
    """English documents, whose times the reader knows, to candidates: each reading of each paragraph with the whole sentences around it, its scores, a hash, and its duplicate status against the quotes."""
    from gnomon.functions.passages import extent_column, scored
    from gnomon.operators.ordering import duplicate_status

    parts = spread(table(spark, sf, "documents").filter("lang = 'en' and text is not null").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", r"\R\s*\R")).alias("paragraph", "text"))
    found = parts.select("doc_id", "paragraph", "text", F.explode(times(F.col("text"))).alias("r")).filter("r.minute is not null or r.options is not null")
    found = found.withColumn("e", extent_column("text", "r.start", "r.end"))
    found = found.select("doc_id", "paragraph", F.col("r.start").alias("start_char"), "r.minute", "r.text", F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("quote"))
    found = found.withColumn("s", scored(F.col("quote"), F.col("text"))).withColumn("id", F.xxhash64("doc_id", "paragraph", "start_char"))
    status = duplicate_status(table(spark, sf, "quotes").select(F.col("quote_id").alias("id"), F.col("minute_of_day").alias("minute"), F.col("quote").alias("text")), found.select("id", "minute", F.col("quote").alias("text")))
    return found.join(status, "id").select("doc_id", "paragraph", "start_char", "minute", F.sha2("quote", 256).alias("hash"), "s.context_score", "s.literary_score", "s.reason", "status")
