"""Every query with an oracle gives the oracle's rows."""

import pytest
from helpers import duck, table_of

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
OWN = [n for n in ORACLES if not n.startswith(("p3_", "p6_", "p8_", "p9_", "p10_"))]


@pytest.mark.parametrize("name", OWN)
def test_query_equals_oracle(spark, sf, name):
    got = entry.queries()[name](spark, sf)
    want = duck(sf).sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table_of(got.columns, got.collect()) == table_of(want.columns, want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["game", "grader", "pairs", "members", "ratio", "refused"]


def test_every_query_without_oracle_runs(spark, sf):
    for name in ("p2_found", "p2_rates", "p2_amounts", "p4_found", "p4_readings", "resolve_by_matching_blocks", "identity_normal_name", "payload_body_classes"):
        assert entry.queries()[name](spark, sf).count() > 0, name
