from helpers import rows, t

from tidegrain.streaming import daily

SCHEMA = "source string, as_of timestamp_ntz, mentions bigint"


def test_batches_merge_and_late_rows_are_kept(spark, tmp_path):
    root = str(tmp_path)
    for k, day in enumerate(("2025-01-01", "2025-01-02", "2025-01-01")):
        spark.createDataFrame([("s", t(day), 1 + k)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/log.parquet")
    got = daily.run_daily(spark, root, "log", keys=["source"], at="as_of", amount="mentions")
    assert [(str(r[1]), r[2], r[3]) for r in rows(got)] == [("2025-01-01", 2, 4), ("2025-01-02", 1, 2)]


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    write = daily.partial_sink(str(tmp_path), ["source"], "as_of", "mentions")
    batch = spark.createDataFrame([("s", t("2025-01-01"), 5)], SCHEMA)
    write(batch, 0)
    write(batch, 0)
    assert rows(daily.merged(spark, str(tmp_path), ["source"]).select("n", "amount")) == [(1, 5)]


def test_an_empty_stream_has_no_rows_and_a_second_run_resumes(spark, tmp_path):
    root, folder = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/log.parquet")
    named = dict(keys=["source"], at="as_of", amount="mentions", folder=folder)
    assert rows(daily.run_daily(spark, root, "log", **named)) == []
    for n in (1, 2):
        spark.createDataFrame([("s", t("2025-01-01"), n)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/log.parquet")
        got = rows(daily.run_daily(spark, root, "log", **named).select("n", "amount"))
    assert got == [(2, 3)]
