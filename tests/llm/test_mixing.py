import random
from collections import defaultdict

from tidegrain.llm import mixing, queries

SIZES = "key bigint, source string, tokens bigint, h int, rank int"
WEIGHTS = "source string, target_share double, max_repeats int, tokens int"


def frames(spark, sizes, weights):
    return spark.createDataFrame([(*s, 0, 0) for s in sizes], SIZES), spark.createDataFrame([(*w, 0) for w in weights], WEIGHTS)


def corpus(seed=1):
    r = random.Random(seed)
    return [(i, r.choices(["a", "b", "c", "unlisted", None], [60, 30, 3, 5, 2])[0], r.randrange(1, 60)) for i in range(4000)]


def test_shares_repeats_and_whole_documents(spark):
    s, w = frames(spark, corpus(), [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.19, 5), ("empty", 0.01, 9)])
    got = mixing.mix(s, w, block=100).collect()
    tokens, times = defaultdict(int), defaultdict(set)
    size = {(k, src): t for k, src, t in corpus()}
    for r in got:
        tokens[r["source"]] += r["tokens"]
        assert r["tokens"] == size[r["key"], r["source"]] and r["repeat"] not in times[r["key"]]
        times[r["key"]].add(r["repeat"])
    total = sum(tokens.values())
    for src, share in (("a", 0.5), ("b", 0.3), ("c", 0.19)):
        assert abs(tokens[src] / total - share / 0.99) < 0.02, (src, tokens)
    assert max(max(v) for v in times.values()) < 5 and set(tokens) == {"a", "b", "c"}


def test_a_source_that_runs_out_is_used_as_often_as_allowed(spark):
    s, w = frames(spark, corpus(), [("a", 0.2, 1), ("c", 0.8, 3)])
    own = sum(t for _, src, t in corpus() if src == "c")
    by = {r["source"]: r for r in mixing.shares(mixing.mix(s, w, total=50_000, block=100), w).collect()}
    assert by["c"]["tokens"] == 3 * own and by["c"]["repeats"] == 3


def test_every_stretch_holds_the_shares(spark):
    plan = spark.createDataFrame([("a", 0.0, 0.5), ("b", 0.5, 0.8), ("c", 0.8, 2.0)], "source string, low double, upto double")
    sched = sorted(mixing.schedule(plan, 3000).collect())
    assert [r["slot"] for r in sched] == list(range(3000))
    for lo in range(0, 3000, 500):
        part = [r["source"] for r in sched[lo : lo + 500]]
        assert abs(part.count("a") - 250) < 6 and abs(part.count("b") - 150) < 6
    for src in "abc":
        assert [r["rank"] for r in sched if r["source"] == src] == list(range(sum(r["source"] == src for r in sched)))


def test_prefix_sums_in_buckets_equal_one_sum(spark, monkeypatch):
    s, w = frames(spark, corpus(), [("a", 0.5, 1), ("b", 0.5, 2)])
    plan, _ = mixing.plan(s, w)
    monkeypatch.setattr(mixing, "BUCKET", 100)
    for src in "ab":
        at = 0
        for r in sorted(mixing.starts(s, plan, 0).where(f"source = '{src}'").collect(), key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["tokens"]


def test_any_number_of_sources(spark):
    """Far more sources than cells: every slot has exactly one, in proportion to the shares."""
    n = 12_000
    s = spark.range(n).selectExpr("id AS key", "concat('s', id) AS source", "10L AS tokens")
    w = spark.range(n).selectExpr("concat('s', id) AS source", "CASE WHEN id < 10 THEN 100.0D ELSE 1.0D END AS target_share", "400 AS max_repeats")
    sources, slots = mixing.plan(s, w, total=13_000 * 10, block=10)
    got = mixing.schedule(sources, slots).groupBy("source").count().collect()
    by = {r["source"]: r["count"] for r in got}
    assert slots == 13_000 and sum(by.values()) == 13_000
    assert all(abs(by[f"s{i}"] - 13_000 * 100 / 12_990) < 3 for i in range(10)) and max(by[k] for k in by if int(k[1:]) >= 10) <= 3


def test_nulls_and_empty_tables(spark):
    for sizes, weights in (([], [("a", 1.0, 1)]), ([(1, "a", 5)], []), ([(1, None, 5), (2, "a", 0)], [("a", 1.0, 1), (None, 0.5, 1), ("b", None, None)])):
        s, w = frames(spark, sizes, weights)
        assert mixing.mix(s, w).count() == 0
        assert all(r["actual_share"] == 0 for r in mixing.shares(mixing.mix(s, w), w).collect())


def test_a_small_source_neither_ends_nor_empties_the_mix(spark, tmp_path):
    documents = [(i, "a" if i % 3 else "b", "card price sold today " * 400) for i in range(600)] + [(999, "tiny", "ten words here")]
    spark.createDataFrame(documents, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.6, 1), ("b", 0.38, 2), ("tiny", 0.02, 5)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/source_weights.parquet")
    by = {r["source"]: r for r in queries.p9_shares(spark, str(tmp_path)).collect()}
    assert abs(by["a"]["actual_share"] - 0.6 / 0.98) < 0.05 and abs(by["b"]["actual_share"] - 0.38 / 0.98) < 0.05
    assert by["a"]["documents"] > 300 and by["tiny"]["repeats"] == 5 and by["tiny"]["short_by"] > 0.01
