import pytest

from gnomon.functions import grammar as G


@pytest.mark.parametrize(
    "phrase, code, minutes",
    [
        ("8:41", "NUMERIC", (521, 1241)),
        ("19:02", "NUMERIC", (1142,)),
        ("9:20 p.m.", "NUMERIC", (1280,)),
        ("6.55 A.M.", "HISTORICAL_DOT", (415,)),
        ("0352 hours", "MILITARY", (232,)),
        ("1745 hours", "COMPACT_24H", (1065,)),
        ("817 PM", "COMPACT_12H", (1217,)),
        ("10h35", "EUROPEAN_24H", (635,)),
        ("14 hours and 9 minutes", "HOUR_MINUTE_UNITS", (849,)),
        ("five 1/2 o'clock", None, None),
        ("5 1/2 o'clock", "FRACTION_OCLOCK", (330, 1050)),
        ("six o’clock and four minutes", "OCLOCK_PLUS_MINUTES", (364, 1084)),
        ("4 minutes and 10 seconds past 8", "PRECISE_RELATIVE", (484, 1204)),
        ("twenty-two past seven", "RELATIVE", (442, 1162)),
        ("a quarter before four", "RELATIVE", (225, 945)),
        ("half-past two in the afternoon", "RELATIVE", (870,)),
        ("a minute past midnight", "RELATIVE", (1,)),
        ("six till eight", "RELATIVE", (474, 1194)),
        ("four and a quarter", "OFFSET_QUARTER", (255, 975)),
        ("two twenty o'clock", "WRITTEN_OCLOCK", (140, 860)),
        ("by nine of the clock", "OCLOCK", (540, 1260)),
        ("clocks were striking fifteen", "STRIKE", (900,)),
        ("midday", "NAMED", (720,)),
        ("twenty-one hundred hours", "WRITTEN_MILITARY", (1260,)),
        ("six oh nine", "WRITTEN", (369, 1089)),
        ("eight forty-four P.M.", "WRITTEN", (1244,)),
        ("three at night", "BARE_CONTEXTUAL", (180,)),
        ("the red house", None, None),
        ("33:10", None, None),
        ("13:05 a.m.", None, None),
        ("seventy past two", None, None),
        ("", None, None),
    ],
)
def test_shapes(phrase, code, minutes):
    found = G.read(phrase)
    assert (found and (found.code, found.minutes)) == (code and (code, minutes))


def test_every_minute_reads_back(spark):
    """Every way that is written for a minute is read as that minute."""
    from pyspark.sql import functions as F

    from gnomon.functions.scalars import minute_variants

    rows = spark.range(1440).select(F.col("id").cast("int").alias("m"), F.explode(minute_variants(F.col("id").cast("int"))).alias("p"))
    bad = [(r.m, r.p) for r in rows.collect() if not (x := G.read(r.p)) or r.m not in x.minutes or x.told != (len(x.minutes) == 1)]
    assert bad == []
