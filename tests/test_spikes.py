import datetime as dt
import random

from helpers import t

from tidegrain.operators import spikes

SCHEMA = "row_id bigint, s string, as_of timestamp_ntz, observed_at timestamp_ntz, v double, fix bigint, _block int, spike int, _u string"


def flags(spark, values, block=spikes.BLOCK, extra=()):
    base = t("2025-01-01")
    data = [(i, "a", base + dt.timedelta(days=i), base + dt.timedelta(days=i), v, None, 0, 0, None) for i, v in enumerate(values)] + [(*e, 0, 0, None) for e in extra]
    df = spark.createDataFrame(data, SCHEMA)
    got = spikes.flag_readings(df, series=["s"], as_of="as_of", observed="observed_at", row_id="row_id", value="v", common="v", correction="fix", block=block).collect()
    return {k: sorted(r["row_id"] for r in got if r[k]) for k in ("impossible", "stuck", "spike")}


def noisy(n, seed=0):
    r = random.Random(seed)
    return [round(100 * (1 + r.gauss(0, 0.03)), 2) for _ in range(n)]


def test_spikes_of_one_to_three_readings(spark):
    v = noisy(60)
    v[10] = 300.0
    v[20], v[21] = 30.0, 31.0
    v[40], v[41], v[42] = 250.0, 255.0, 260.0
    assert flags(spark, v) == {"impossible": [], "stuck": [], "spike": [10, 20, 21, 40, 41, 42]}


def test_a_lasting_move_is_no_spike(spark):
    v = noisy(30) + [3 * x for x in noisy(30, 1)]
    assert flags(spark, v)["spike"] == []


def test_stuck_runs_and_bounds(spark):
    v = noisy(50)
    v[10:16] = [101.0] * 6
    v[30:35] = [99.0] * 5
    v[40], v[41], v[42] = 0.0, -3.0, 99999999.0
    assert flags(spark, v) == {"impossible": [40, 41, 42], "stuck": [10, 11, 12, 13, 14, 15], "spike": []}


def test_blocks_change_nothing(spark):
    v = noisy(200)
    for i in (9, 50, 99, 100, 101, 150):
        v[i] = 400.0
    v[60:67] = [100.0] * 7
    assert flags(spark, v, block=25) == flags(spark, v)


def test_redeliveries_and_corrections_share_the_position(spark):
    v = noisy(40)
    v[20] = 500.0
    at = t("2025-01-01") + dt.timedelta(days=20)
    later = at + dt.timedelta(days=1)
    got = flags(spark, v, extra=[(100, "a", at, later, 500.0, None), (101, "a", at, later, 101.0, 20)])
    assert got["spike"] == [20, 100]


def test_null_short_and_empty(spark):
    assert flags(spark, []) == {"impossible": [], "stuck": [], "spike": []}
    assert flags(spark, [5.0]) == {"impossible": [], "stuck": [], "spike": []}
    assert flags(spark, [None, 0.0, float("nan"), None])["impossible"][0] == 1


def test_a_cut_series_keeps_its_own_scale(spark):
    r = random.Random(3)
    v = [round(100 * (1 + r.gauss(0, 0.005 if i < 100 else 0.08)), 2) for i in range(200)]
    v[50], v[60], v[150] = 120.0, 108.0, 160.0
    whole = flags(spark, v)
    assert whole["spike"] and flags(spark, v, block=25) == whole
    assert flags(spark, v, block=90) == whole


def test_four_readings_in_a_row_are_a_level(spark):
    v = noisy(60)
    v[20:24] = [300.0, 301.0, 302.0, 303.0]
    assert flags(spark, v)["spike"] == []


def test_ends_of_a_series(spark):
    v = noisy(40)
    v[0], v[38], v[39] = 300.0, 20.0, 21.0
    assert flags(spark, v)["spike"] == [0, 38, 39]
    v = noisy(40)
    v[1:4] = [300.0, 310.0, 305.0]  # the first reading is sound though its next three are not
    assert flags(spark, v)["spike"] == [1, 2, 3]


def test_details_add_up_to_the_reading(spark):
    """reading = approximation + details: what the levels take off is what flag_readings judges."""
    from pyspark.sql import functions as F

    v = noisy(50)
    v[25] = 500.0
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i bigint, v double")
    day = F.expr("timestamp_ntz '2025-01-01 00:00:00' + make_dt_interval(cast(i as int))")
    rows = rows.select(F.lit("s").alias("_s"), F.struct("i").alias("_keep"), F.col("i").alias("_id"), day.alias("_as_of"), day.alias("_observed"), F.col("v").alias("_v"), F.lit(False).alias("_fix"), F.lit(False).alias("_bad"), F.log("v").alias("_x"))
    got = {r["_id"]: r["_detail"] for r in spikes.transform(spikes.whole_series(rows)).select("_id", "_detail").collect()}

    import math

    y = [math.log(x) for x in v]
    head, tail = sorted(y[:8]), sorted(y[-8:])
    head, tail = (head[3] + head[4]) / 2, (tail[3] + tail[4]) / 2
    for j in range(spikes.LEVELS):
        near = lambda i, k: head if i + k < 0 else tail if i + k >= len(y) else y[i + k]  # noqa: E731, B023
        y = [max(min(near(i, -(2**j)), near(i, 2**j)), min(max(near(i, -(2**j)), near(i, 2**j)), y[i])) for i in range(len(y))]
    assert all(abs(got[i] - (math.log(v[i]) - y[i])) < 1e-9 for i in range(len(v)))


def test_any_block_gives_the_same_rows_on_whole_tables(spark, sf):
    from tidegrain.plans import problems

    r = problems.readings(spark, sf)
    named = dict(series=("record_table", *problems.SERIES), as_of="as_of", observed="observed_at", row_id="record_id", value="value", common="common", correction="supersedes", keep=["record_table"])
    bad = lambda b: {(x[0], x[1]) for x in spikes.flag_readings(r, block=b, **named).where("impossible OR stuck OR spike").select("record_table", "record_id").collect()}
    assert bad(3) == bad(40) == bad(spikes.BLOCK) != set()


def test_a_series_of_one_block_is_judged_where_it_is_sorted(spark):
    """One exchange, one sort led by a number, seven passes; nothing but flagged rows is written."""
    from pyspark.sql import functions as F

    from tidegrain import session

    v = noisy(60)
    v[10], v[20] = 300.0, 0.0
    rows = spark.createDataFrame([(i, "a", float(x)) for i, x in enumerate(v)], "row_id bigint, s string, v double").select("*", F.expr("timestamp_ntz '2025-01-01 00:00:00' + make_dt_interval(cast(row_id as int))").alias("at"))
    mine = session._WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(mine)
    got = spikes.flag_readings(rows, series=["s"], as_of="at", observed="at", row_id="row_id", value="v", common="v", flagged_only=True)
    assert sorted(r["row_id"] for r in got.collect()) == [10, 20]
    assert sum(spark.read.parquet(p).count() for p in mine[before:]) == 1  # the impossible one is not judged

    usable = rows.select("s", F.col("s").alias("_s"), F.struct("s").alias("_keep"), F.col("row_id").alias("_id"), F.col("at").alias("_as_of"), F.col("at").alias("_observed"), F.col("v").alias("_v"), F.lit(False).alias("_fix"), F.lit(False).alias("_bad"), F.log("v").alias("_x"))
    plan = spikes.transform(spikes.whole_series(usable))._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange "), plan.count("Sort ["), plan.count("Sort [_h#"), plan.count("Window [")) == (1, 1, 1, 7)


def test_a_short_last_block_and_short_blocks_see_both_ends(spark):
    """The neighbours of readings next to a block's end may lie beyond the end of the series, in any block."""
    for n, block in ((27, 25), (31, 25), (53, 25), (40, 3)):
        v = noisy(n, 5)
        v[2], v[block - 1], v[n - 4], v[n - 1] = 300.0, 30.0, 290.0, 310.0
        assert details(spark, v, block) == details(spark, v)


def details(spark, values, block=spikes.BLOCK):
    base = t("2025-01-01")
    df = spark.createDataFrame([(i, "a", base + dt.timedelta(days=i), v) for i, v in enumerate(values)], "row_id bigint, s string, at timestamp_ntz, v double")
    return sorted(map(tuple, spikes.flag_readings(df, series=["s"], as_of="at", observed="at", row_id="row_id", value="v", common="v", block=block).collect()))
