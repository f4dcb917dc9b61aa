import datetime as dt
import random

import pytest
from helpers import rows, t

from tidegrain.operators import rolling

SCHEMA = "row_id bigint, who string, amount bigint, as_of timestamp_ntz, observed_at timestamp_ntz, supersedes bigint, entity string, day int, total_7 double"
NAMED = dict(entity="who", as_of="as_of", amount="amount", content=["who", "as_of", "amount"])


def frame(spark, data):
    return spark.createDataFrame([(i, w, a, x, o, s, "clash", 0, 0.0) for i, w, a, x, o, s in data], SCHEMA)


def brute(data, periods=(7, 30)):
    gone = {s for *_, s in data if s is not None}
    cur = {(w, x, a) for i, w, a, x, o, s in data if i not in gone and w is not None and x is not None}
    days = {}
    for w, x, a in cur:
        days.setdefault(w, {}).setdefault(x.date(), 0)
        days[w][x.date()] += a or 0
    out = set()
    for w, d in days.items():
        day = min(d)
        while day <= max(d):
            out.add((w, day, *[sum(d.get(day - dt.timedelta(k), 0) for k in range(p)) for p in periods]))
            day += dt.timedelta(1)
    return out


def got(df):
    return {(r["entity"], r["day"], r["total_7"], r["total_30"]) for r in df.collect()}


def some_log(seed, n=120):
    r = random.Random(seed)
    data = []
    for i in range(n):
        x = t("2025-01-01") + dt.timedelta(days=r.randrange(70), hours=r.randrange(24))
        data.append((i, r.choice("abc"), r.choice([0, 1, 5, None]), x, x + dt.timedelta(days=r.choice([0, 0, 1, 40])), None))
    for i in range(n, n + 15):
        o = data[r.randrange(n)]
        data.append((i, o[1], r.randrange(9), o[3], o[4] + dt.timedelta(days=r.choice([1, 30])), o[0]))
    for i in range(n + 15, n + 25):
        o = data[r.randrange(n + 15)]
        data.append((i, o[1], o[2], o[3], o[4] + dt.timedelta(hours=3), o[5]))
    return data


@pytest.mark.parametrize("known_at", [(), ("2025-02-01 00:00:00",), ("2025-01-20 00:00:00", "2025-03-01 00:00:00"), ("2024-06-01 00:00:00", "2025-01-10 00:00:00", "2025-01-11 00:00:00", "2025-02-15 00:00:00", "2026-01-01 00:00:00")])
def test_versions_equal_a_full_computation(spark, known_at):
    for seed in (1, 2):
        data = some_log(seed)
        assert got(rolling.rolling_totals(frame(spark, data), known_at=known_at, **NAMED)) == brute(data)


def test_days_added_far_after_the_stored_state(spark):
    data = [(1, "a", 5, t("2025-01-01"), t("2025-01-01"), None), (2, "a", 3, t("2025-01-05"), t("2025-03-01"), None), (3, "a", 1, t("2025-02-20"), t("2025-03-01"), None)]
    assert got(rolling.rolling_totals(frame(spark, data), known_at=("2025-02-01",), **NAMED)) == brute(data)


def test_withdrawn_days_leave_the_state(spark):
    data = [(1, "a", 5, t("2025-01-01"), t("2025-01-01"), None), (2, "a", 9, t("2025-01-09"), t("2025-01-09"), None), (3, "a", 4, t("2025-01-02"), t("2025-02-02"), 2)]
    assert got(rolling.rolling_totals(frame(spark, data), known_at=("2025-02-01",), **NAMED)) == brute(data)


def test_nulls_empty_and_only_unplaced_rows(spark):
    assert rows(rolling.rolling_totals(frame(spark, []), known_at=("2025-01-01",), **NAMED)) == []
    data = [(1, None, 5, t("2025-01-01"), t("2025-01-01"), None), (2, "a", 5, None, t("2025-01-01"), None)]
    assert rows(rolling.rolling_totals(frame(spark, data), **NAMED)) == []


def test_a_version_writes_only_what_its_arrivals_touch(spark, tmp_path):
    data = [(i, w, 2, t("2025-01-01") + dt.timedelta(days=i), t("2025-01-01") + dt.timedelta(days=i), None) for w in "ab" for i in range(100)]
    data = [(n, *d[1:]) for n, d in enumerate(data)] + [(900, "a", 7, t("2025-01-11"), t("2025-06-01"), None), (901, "a", 1, t("2025-04-12"), t("2025-06-01"), None), (902, "c", 1, t("2025-01-01"), t("2025-06-01"), None)]
    out = rolling.rolling_totals(frame(spark, data), known_at=("2025-05-01 00:00:00",), folder=str(tmp_path), **NAMED)
    assert got(out) == brute(data)
    second = [(r["entity"], str(r["day"])) for r in spark.read.parquet(f"{tmp_path}/state/2").collect()]
    assert len(second) == 30 + 2 + 1  # the corrected day and the 29 after it, two days after the end, a new entity; nothing of b
    assert {e for e, _ in second} == {"a", "c"} and min(d for e, d in second if e == "a") == "2025-01-11"


def test_a_state_resumes_from_its_folder(spark, tmp_path):
    data = some_log(5)
    staged = rolling.by_version(rolling.arrivals(frame(spark, data), **NAMED), ("2025-02-01 00:00:00",))
    first = rolling.RollingState(spark, str(tmp_path))
    first.arrive(staged.where("version = 1"))
    first.advance(1)
    later = rolling.RollingState(spark, str(tmp_path))
    later.arrive(staged.where("version = 2"))
    later.versions = [1]
    later.advance(2)
    assert got(later.read()) == brute(data)


def test_a_version_reads_each_table_once(spark, tmp_path, monkeypatch):
    """The plan of a version does not repeat its inputs; copies of them made the driver plan hundreds of operators."""
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def watched(self, path, *a, **k):
        plans.append((path, self._df._jdf.queryExecution().optimizedPlan().collectLeaves().size()))
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    data = some_log(3)
    assert got(rolling.rolling_totals(frame(spark, data), known_at=("2025-02-01 00:00:00",), folder=str(tmp_path), **NAMED)) == brute(data)
    leaves = {path.split("/state/")[1]: n for path, n in plans if "/state/" in path}
    assert leaves == {"1": 1, "2": 3}  # arrivals; and the ends of the entities, stored rows
