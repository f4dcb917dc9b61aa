from helpers import rows, t

from tidegrain.operators import late

SCHEMA = "row_id bigint, card string, src string, as_of timestamp_ntz, observed_at timestamp_ntz, n bigint, backfilled boolean, supersedes bigint, day int, batch int"
NAMED = dict(keys=["card", "src"], as_of="as_of", amount="n", content=["card", "src", "as_of", "n"])


def read(spark, data):
    log = spark.createDataFrame([(*r, 0, 0) for r in data], SCHEMA)
    p = late.partials(late.contributions(log, **NAMED), NAMED["keys"])
    return rows(late.published(p, NAMED["keys"]).select("card", "at_end", "at_cutoff", "refused"))


def test_cut_off_and_midnight(spark):
    d = t("2025-01-01T10:00:00")
    data = [
        (1, "in", "s", d, t("2025-01-01T23:59:59"), 1, False, None), (2, "midnight", "s", d, t("2025-01-02"), 1, False, None),
        (3, "at cut-off", "s", d, t("2025-01-05"), 1, False, None), (4, "late", "s", d, t("2025-01-05T00:00:01"), 1, False, None),
    ]
    assert read(spark, data) == [("at cut-off", 0, 1, 0), ("in", 1, 1, 0), ("late", 0, 0, 1), ("midnight", 0, 1, 0)]


def test_corrections_redeliveries_backfill_and_nulls(spark):
    d = t("2025-01-01T10:00:00")
    data = [
        (1, "fixed", "s", d, d, 5, False, None), (2, "fixed", "s", d, t("2025-01-02T10:00:00"), 7, False, 1),
        (3, "twice", "s", d, d, 4, None, None), (4, "twice", "s", d, t("2025-01-03"), 4, None, None),
        (5, "back", "s", d, d, 9, True, None), (6, None, "s", d, d, 9, False, None), (7, "null", "s", d, d, None, False, None), (8, "x", "s", None, d, 1, False, None),
        (9, "too late", "s", d, d, 2, False, None), (10, "too late", "s", d, t("2025-02-01"), 3, False, 9),
    ]
    assert read(spark, data) == [("fixed", 5, 7, 0), ("null", 0, 0, 0), ("too late", 2, 2, 1), ("twice", 4, 4, 0)]
    assert read(spark, []) == []


def test_merge_refuses_closed_periods_and_equals_one_run(spark):
    d = t("2025-01-01T10:00:00")
    data = [(i, "a", "s", d, t(f"2025-01-{1 + i:02d}T12:00:00"), 10**i, False, None) for i in range(6)]
    log = spark.createDataFrame([(*r, 0, 0) for r in data], SCHEMA)
    part = lambda w: late.partials(late.contributions(log.where(w), **NAMED), NAMED["keys"])
    empty = part("row_id < 0")
    stored = late.merge(late.merge(empty, part("row_id <= 2"), NAMED["keys"]), part("row_id > 2"), NAMED["keys"])
    assert rows(late.published(stored, NAMED["keys"]).select("at_end", "at_cutoff", "refused")) == [(1, 1111, 0)]
    assert rows(late.refused(part("true")).agg({"amount": "sum"})) == [(110000,)]
