import pytest
from helpers import rows, t
from pyspark.sql import functions as F

from tidegrain.sources import store

SCHEMA = "row_id bigint, k string, amount bigint, as_of timestamp_ntz, observed_at timestamp_ntz, supersedes bigint"


@pytest.fixture
def s(spark, tmp_path):
    return store.LogStore(spark, str(tmp_path), {"price": {"negative": "amount >= 0"}})


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_append_view_and_quarantine(spark, s):
    got = s.append("price", frame(spark, (1, "a", 540, t("2025-01-01"), t("2025-01-01"), None), (2, "a", -1, t("2025-01-01"), t("2025-01-01"), None), (3, "a", 5, t("2025-02-01"), t("2025-01-01"), None), (4, "a", None, t("2025-01-01"), t("2025-01-02"), None)))
    assert got == {"accepted": 2, "quarantined": 2}
    assert [r[0] for r in rows(s.view("price", t("2025-01-01")).select("row_id"))] == [1]
    assert rows(spark.read.parquet(s._path("price", "quarantine")).select("row_id", F.col("broken")[0])) == [(2, "negative"), (3, "observed_before_as_of")]


def test_supersede_keeps_both_and_checks_the_order(spark, s):
    s.append("price", frame(spark, (1, "a", 540, t("2025-01-01"), t("2025-01-01"), None)))
    s.supersede("price", frame(spark, (2, "a", 545, t("2025-01-01"), t("2025-01-03"), 1)))
    assert [r[0] for r in rows(s.view("price", t("2025-01-02")).select("amount"))] == [540]
    assert [r[0] for r in rows(s.view("price", t("2025-01-03")).select("amount"))] == [545]
    for bad in ((3, "a", 1, t("2025-01-01"), t("2025-01-01"), 1), (3, "a", 1, t("2025-01-01"), t("2025-01-09"), 99)):
        with pytest.raises(ValueError):
            s.supersede("price", frame(spark, bad))
    assert s.append_with_ids("price", frame(spark, (0, "b", 1, t("2025-01-01"), t("2025-01-09"), None)).drop("row_id"), ["k"])["accepted"] == 1
    assert s.view("price", t("2025-02-01")).agg(F.max("row_id")).first()[0] == 3


def test_the_cutoff_prunes_partitions(spark, s):
    s.append("price", frame(spark, *[(i, "a", i, t(f"2025-01-0{i}"), t(f"2025-01-0{i}"), None) for i in range(1, 8)]))
    plan = s.view("price", t("2025-01-02"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(observed_day" in plan


def test_first_seen_wins(spark, s):
    d = spark.createDataFrame([("x", 1, t("2025-01-02")), ("x", 2, t("2025-01-01")), ("y", 3, t("2025-01-01"))], "uid string, v int, observed_at timestamp_ntz")
    assert s.insert_first_seen("cards", d, "uid", ["observed_at"]) == 2
    assert s.insert_first_seen("cards", d.withColumn("v", F.lit(9)), "uid", ["observed_at"]) == 0
    assert rows(spark.read.parquet(s._path("cards")).select("uid", "v")) == [("x", 2), ("y", 3)]


def test_preserve_pages_and_rules(spark):
    today, before = spark.createDataFrame([("a", 1)], "g string, v int"), spark.createDataFrame([("a", 8), ("b", 9)], "g string, v int")
    assert rows(store.preserve(today, before, "g")) == [("a", 1, False), ("b", 9, True)]
    holes = spark.createDataFrame([(None, 1)], "g string, v int")
    assert rows(store.preserve(holes, holes, "g")) == [(None, 1, False)]
    pages = spark.createDataFrame([("done", 1, True, None, 5), ("done", 2, False, None, 3), ("cut", 1, True, 10, 5), ("told", 1, None, 5, 5)], "k string, page int, has_more boolean, total int, rows int")
    assert rows(store.complete_pages(pages, "k").select("k", "complete")) == [("cut", False), ("done", True), ("told", True)]
    facts = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "z", "q"), (4, None, None)], "id int, a string, b string")
    rules = spark.createDataFrame([(10, "x", None), (11, "x", "p"), (12, None, None), (13, None, None)], "rule int, a string, b string")
    assert rows(store.most_specific(facts, rules, ["a", "b"], "id")) == [(1, 11), (2, 10), (3, 12), (4, 12)]
    assert rows(store.most_specific(facts, rules.limit(0), ["a", "b"], "id")) == []
