import datetime as dt
from decimal import Decimal

from helpers import rows, t
from pyspark.sql import functions as F

from tidegrain.operators import pit, stats

LOG = "row_id bigint, k string, v bigint, as_of timestamp_ntz, observed_at timestamp_ntz, supersedes bigint"


def log(spark):
    d = t
    return spark.createDataFrame(
        [(1, "a", 540, d("2025-01-01"), d("2025-01-01"), None), (2, "a", 541, d("2025-01-01"), d("2025-01-03"), 1), (3, "a", 542, d("2025-01-01"), d("2025-01-05"), 2), (4, "b", 7, d("2025-01-02"), d("2025-01-02"), None)], LOG)


def at(x):
    return F.lit(x).cast("timestamp_ntz")


def test_as_of_view_follows_chains(spark):
    see = lambda x: [r[0] for r in rows(pit.as_of_view(log(spark), at(x)).select("row_id"))]
    assert see("2025-01-01") == [1] and see("2025-01-03") == [2, 4] and see("2025-01-09") == [3, 4]


def test_the_view_never_sees_the_future(spark):
    for x in ("2025-01-01", "2025-01-02", "2025-01-04"):
        full, cut = pit.as_of_view(log(spark), at(x)), pit.as_of_view(log(spark).where(F.col("observed_at") <= at(x)), at(x))
        assert full.exceptAll(cut).count() == 0 and cut.exceptAll(full).count() == 0


def test_coverage_of_days(spark):
    d = spark.createDataFrame([("c", t(f"2025-01-0{x}")) for x in (1, 2, 2, 4, 5)] + [(None, t("2025-01-01"))], "k string, as_of timestamp_ntz")
    assert rows(pit.day_coverage(d, "k").select("present", "consecutive", "missing")) == [(4, 2, 1)]


def test_restatement_and_rules(spark):
    got = pit.restatement(log(spark), ["k"], "v", at("2025-01-01"), at("2025-01-09"))
    assert rows(got) == [("a", 540, 542, "changed"), ("b", None, 7, "added")]
    assert rows(pit.violations(log(spark), {"big": F.col("v") < 541, "null": F.col("supersedes") > 5})) == [("big", 2), ("null", 2)]


def test_exclusive_quartiles(spark):
    one = spark.range(1)
    q = lambda p, *v: one.select(stats.exclusive_quantile(F.array(*[F.lit(float(x)) for x in v]), p)).first()[0]
    assert [q(p, 1, 2, 3, 4, 10) for p in (0.25, 0.5, 0.75)] == [1.5, 3.0, 7.0] and q(0.25, 1) is None


def test_seal_detects_changed_rows(spark):
    df = log(spark)
    day, cols = F.to_date("observed_at"), ["row_id", "k", "v"]
    stored = stats.seal(stats.day_digests(df, day, cols))
    assert rows(stats.first_broken_day(stored, df, day, cols)) == [(None,)]
    changed = df.withColumn("v", F.when(F.col("row_id") == 2, 999).otherwise(F.col("v")))
    assert str(rows(stats.first_broken_day(stored, changed, day, cols))[0][0]) == "2025-01-03"


def test_least_squares_recovers_a_plane_and_refuses_a_singular_one(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z")).withColumn("y", 3 + 2 * F.col("x") - F.col("z"))
    assert [round(b, 6) for b in stats.ordinary_least_squares(df, "y", ["x", "z"])] == [3, 2, -1]
    try:
        stats.ordinary_least_squares(df.withColumn("w", 2 * F.col("x")), "y", ["x", "w"])
        raise AssertionError("a singular design must be refused")
    except ValueError as e:
        assert "singular" in str(e)


def test_last_rate(spark):
    facts = [(1, "p", "2025-01-03 10:00", "2025-01-03 12:00"), (2, "p", "2024-12-31", "2025-06-01"), (3, "q", "2025-01-03", "2025-01-03"), (4, "p", "2025-01-05", "2025-01-05"), (5, "p", "2027-05-05", "2027-05-05"), (6, "p", "2025-01-05", "2025-01-07"), (7, None, "2025-01-05", "2025-01-07"), (8, "p", None, "2025-01-07")]
    facts = spark.createDataFrame([(i, k, a and t(a), b and t(b)) for i, k, a, b in facts], "fact int, fx string, as_of timestamp_ntz, observed_at timestamp_ntz")
    rates = [(1, "p", "2025-01-01", "2025-01-01", None), (2, "p", "2025-01-03 18:00", "2025-01-03 18:00", None), (3, "p", "2025-01-04", "2025-01-04", None), (4, "p", "2025-01-04", "2025-01-06", 3), (5, "p", "2025-01-04", "2025-01-04", None)]
    rates = spark.createDataFrame([(i, k, t(a), t(b), s) for i, k, a, b, s in rates], "row_id int, pair string, as_of timestamp_ntz, observed_at timestamp_ntz, supersedes int")
    # an evening's rate serves no morning price, a later correction no earlier one; years without a rate do not end the last one
    got = rows(pit.last_rate(facts, rates, fact_id="fact", fact_pair="fx", at="as_of", known="observed_at"))
    assert got == [(1, 1), (4, 5), (5, 4), (6, 4)]
    assert rows(pit.last_rate(facts, rates.limit(0), fact_id="fact", fact_pair="fx", at="as_of", known="observed_at")) == []


def test_last_rate_equals_brute_force(spark):
    import random

    r = random.Random(8)
    day = lambda n: t("2024-01-01") + dt.timedelta(hours=n)
    rates = [(i, r.choice("pq"), day(h := r.randrange(20_000)), day(h + r.randrange(900)), None) for i in range(120)]
    rates += [(200 + i, *(x := r.choice(rates))[1:3], x[3] + dt.timedelta(hours=r.randrange(1, 500)), x[0]) for i in range(30)]
    facts = [(i, r.choice("pqz"), day(h := r.randrange(-500, 30_000)), day(h + r.randrange(300))) for i in range(300)]
    gone = {}
    for x in rates:
        if x[4] is not None:
            gone[x[4]] = min(gone.get(x[4], x[3]), x[3])
    want = []
    for i, k, at, known in facts:
        fit = [(x[2], x[3], x[0]) for x in rates if x[1] == k and x[2] <= at and x[3] <= known and not (x[0] in gone and gone[x[0]] <= known)]
        want += [(i, max(fit)[2])] if fit else []
    f = spark.createDataFrame(facts, "fact int, fx string, as_of timestamp_ntz, observed_at timestamp_ntz")
    d = spark.createDataFrame(rates, "row_id int, pair string, as_of timestamp_ntz, observed_at timestamp_ntz, supersedes int")
    assert rows(pit.last_rate(f, d, fact_id="fact", fact_pair="fx", at="as_of", known="observed_at")) == sorted(want, key=str)


def test_gaps_runs_and_decisions(spark):
    d = spark.createDataFrame([("a", t(f"2025-01-0{i}")) for i in (1, 2, 5, 7)] + [(None, t("2025-01-01")), ("b", None)], "k string, as_of timestamp_ntz")
    assert [(r[0], str(r[1]), str(r[2]), r[3]) for r in rows(pit.missing_days(d, "k"))] == [("a", "2025-01-03", "2025-01-04", 2), ("a", "2025-01-06", "2025-01-06", 1)]
    log = spark.createDataFrame([("r1", "running", 1), ("r1:done", "ok", 2), ("r2", "running", 3)], "run string, status string, at int")
    assert rows(pit.run_states(log, "run", "status", "at")) == [("r1", "ok", 2), ("r2", "running", 3)]
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "i int, s string")
    assert rows(pit.differing(a, a)) == [(0,)] and rows(pit.differing(a, a.distinct())) == [(1,)] and rows(pit.differing(a.limit(0), a.limit(0))) == [(0,)]


def test_medians_hold_no_group(spark):
    d = spark.createDataFrame([("a", 1.0)] * 3 + [("a", 5.0), ("a", None), (None, 2.0), (None, 4.0)], "k string, v double")
    assert rows(stats.medians(d, ["k"], "v")) == [("a", 1.0), (None, 3.0)] and rows(stats.medians(d.limit(0), ["k"], "v")) == []


def test_ranked_is_a_total_order(spark):
    d = spark.createDataFrame([(i % 3, f"k{i}") for i in range(60)], "v int, k string")
    got = stats.ranked(d, "v", "k").collect()
    import hashlib

    want = {k: n for n, (v, k) in enumerate(sorted(((i % 3, f"k{i}") for i in range(60)), key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest())), 1)}
    assert {r["k"]: r["place"] for r in got} == want


def test_digests_tell_shifted_fields_apart(spark):
    d = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("~", None), (None, "~"), ("", None)], "x string, y string")
    assert d.select(stats.row_digest(["x", "y"])).distinct().count() == 5


def test_distributed_quartiles_equal_sorted_ones(spark):
    import random

    r = random.Random(4)
    data = [(k, r.choice([r.gauss(0, 3), 1.5, 1.5, 2.0]) if k != "few" else 7.0) for k in ["a"] * 501 + ["b"] * 200 + ["few"] + ["two"] * 2] + [("a", None)]
    df = spark.createDataFrame(data, "k string, v double")
    arrays = df.where("v IS NOT NULL").groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("a"), F.median("v").alias("m"))
    want = {x["k"]: (x["m"], x["q1"], x["q3"]) for x in arrays.select("k", "m", stats.exclusive_quantile(F.col("a"), 0.25).alias("q1"), stats.exclusive_quantile(F.col("a"), 0.75).alias("q3")).collect()}
    got = {x["k"]: (x["median"], x["q1"], x["q3"]) for x in stats.quartiles(df, ["k"], "v").collect()}
    near = lambda a, b: (a is None and b is None) or abs(a - b) < 1e-9
    assert got.keys() == want.keys() and all(near(x, y) for k in want for x, y in zip(want[k], got[k]))
