import datetime as dt
import random

from helpers import rows, t

from tidegrain.operators import asof

SERIES = ["card", "grader"]
LOG = "row_id bigint, card string, grader string, as_of timestamp_ntz, observed_at timestamp_ntz, supersedes bigint, _from int, level int"
EVENTS = "alert string, card string, grader string, at timestamp_ntz, row_id int, _k1 int"


def run(spark, log, events):
    a = spark.createDataFrame([(*r, 0, 0) for r in log], LOG)
    e = spark.createDataFrame([(*r, 0, 0) for r in events], EVENTS)
    return rows(asof.known_as_of(e, a, event_id="alert", at="at", series=SERIES))


def brute(log, events):
    out = []
    for alert, card, grader, at in events:
        if at is None:
            continue
        known = [r for r in log if r[4] is not None and r[3] is not None and r[4] <= at]
        gone = {r[5] for r in log if r[5] is not None and r[4] is not None and r[4] <= at}
        fit = [r for r in known if (r[1], r[2]) == (card, grader) and r[0] not in gone]
        if fit:
            out.append((alert, max(fit, key=lambda r: (r[3], r[4], r[0]))[0]))
    return sorted(out, key=str)


def test_random_logs_equal_brute_force(spark):
    for seed in range(3):
        r = random.Random(seed)
        base = t("2025-01-01")
        log, events = [], []
        for i in range(150):
            x = base + dt.timedelta(hours=r.randrange(24 * 60))
            log.append((i, r.choice(["a", "b", None]), r.choice(["P", None]), x, x + dt.timedelta(minutes=r.choice([0, 30, 60, 5000, 60000])), None))
        for i in range(150, 190):
            o = r.choice(log)
            log.append((i, o[1], o[2], o[3], o[4] + dt.timedelta(minutes=r.choice([0, 60, 9000])), o[0]))
        for i in range(80):
            at = r.choice(log)[4] + dt.timedelta(minutes=r.choice([-1, 0, 0, 1, 700]))
            events.append((f"e{i}", r.choice(["a", "b", None]), r.choice(["P", None]), at))
        assert run(spark, log, events) == brute(log, events)


def test_ends_are_half_open(spark):
    log = [(1, "a", None, t("2025-01-01"), t("2025-01-01"), None), (2, "a", None, t("2025-01-01"), t("2025-01-02"), 1)]
    events = [("before", "a", None, t("2025-01-01T23:59:59")), ("at", "a", None, t("2025-01-02")), ("early", "a", None, t("2024-12-31")), ("none", "a", None, None)]
    assert run(spark, log, events) == [("at", 2), ("before", 1)]


def test_far_times_ties_and_empty_tables(spark):
    log = [(1, "a", None, t("1700-01-01"), t("1700-01-01"), None), (2, "a", None, t("1700-01-01"), t("1700-01-01"), None), (3, "a", None, t("2500-01-01"), t("2500-01-01"), None), (4, "a", None, None, t("2020-01-01"), None)]
    events = [("x", "a", None, t("1750-01-01")), ("y", "a", None, t("2600-01-01"))]
    assert run(spark, log, events) == [("x", 2), ("y", 3)]
    assert run(spark, [], events) == [] and run(spark, log, []) == []
