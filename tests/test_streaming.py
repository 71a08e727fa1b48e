from datetime import datetime

from gnomon.streaming import ticks as T


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    ended = q.awaitTermination(60)
    q.stop()
    assert ended
    return spark.sql(f"select * from {name}").collect()


def source(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def t(text):
    return datetime.fromisoformat(f"2026-01-01 {text}")


def test_first_of_minute(spark, tmp_path):
    rows = [(1, t("10:00:01"), "a"), (1, t("10:00:30"), "b"), (1, t("10:01:00"), "c"), (2, t("10:00:59"), "d")]
    found = run(spark, T.first_of_minute(source(spark, tmp_path / "a", rows, "device long, ts timestamp, kind string")), "first_of_minute")
    assert len(found) == 3 and len({(r.device, r.minute_at) for r in found}) == 3


def test_shown_per_hour(spark, tmp_path):
    rows = [(1, t("10:00:01"), "a"), (1, t("10:59:30"), "a"), (1, t("11:01:00"), "a")]
    found = run(spark, T.shown_per_hour(source(spark, tmp_path / "b", rows, "device long, ts timestamp, kind string")), "per_hour", "complete")
    assert sorted(r.n for r in found) == [1, 2]


def test_rested(spark, tmp_path):
    rows = [(1, 5, t("10:00:00")), (1, 5, t("10:30:00")), (1, 6, t("10:31:00")), (2, 5, t("10:10:00")), (1, 5, t("12:00:00"))]
    found = run(spark, T.rested(source(spark, tmp_path / "c", rows, "device long, item long, ts timestamp"), 3600), "rested")
    assert sorted((r.device, r.item, r.ts.strftime("%H:%M"), r.rested) for r in found) == [(1, 5, "10:00", True), (1, 5, "10:30", False), (1, 5, "12:00", True), (1, 6, "10:31", True), (2, 5, "10:10", True)]
