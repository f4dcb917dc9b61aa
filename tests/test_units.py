import datetime as dt
import json

import pytest
from helpers import t

from tidegrain.operators import units

FX = "row_id bigint, pair string, rate decimal(18,8), as_of timestamp_ntz, observed_at timestamp_ntz, source string, supersedes bigint"


@pytest.fixture(scope="module")
def fx(spark):
    from decimal import Decimal

    out, i = [], 0
    for d in range(60):
        day = t("2025-01-01") + dt.timedelta(days=d)
        for pair, rate in (("EUR/USD", 1.05 + d / 1000), ("USD/JPY", 150 + d / 10), ("USD/HKD", 7.8), ("GBP/USD", 1.27)):
            i += 1
            out.append((i, pair, Decimal(str(round(rate, 6))), day, day, "x", None))
    return spark.createDataFrame(out, FX)


def test_rates_in_every_convention(spark, fx):
    from decimal import Decimal

    data, want = [], {}
    at = t("2025-01-20")
    for cur, usd in (("EUR", 1.069), ("JPY", 1 / 151.9)):
        for name, s, e in units.RATE_UNITS:
            for k in range(12):
                r = (usd if s > 0 else 1 / usd) * 10**e * (1 + (k - 6) / 20000)
                data.append((len(data), cur, Decimal(f"{r:.8f}"), at, at, 1, 2))
                want[len(data) - 1] = name
    data += [(900, "EUR", None, at, at, 1, 2), (901, None, Decimal("1.1"), at, at, 1, 2), (902, "XYZ", Decimal("1.1"), None, at, 1, 2), (903, "EUR", Decimal("0"), at, at, 1, 2), (904, "USD", Decimal("1"), at, at, 1, 2)]
    df = spark.createDataFrame(data, "row_id bigint, currency string, fx_rate_used decimal(18,8), fx_as_of timestamp_ntz, as_of timestamp_ntz, lo int, usd int")
    got = {r["row_id"]: r for r in units.rate_units(df, fx).collect()}
    assert len(got) == len(data)
    for i, name in want.items():
        if name != "direct_per100" or got[i]["currency"] != "JPY":  # eight decimals leave too few digits there
            assert got[i]["rate_unit"] == name, (i, got[i])
    assert abs(got[0]["rate_usd"] - 1.069) < 1e-3 and got[904]["rate_unit"] == "direct"
    assert all(got[i]["rate_unit"] is None for i in (900, 901, 902, 903)) and got[901]["rate_uncertain"] and not got[900]["rate_uncertain"]


def test_empty_rates(spark, fx):
    df = spark.createDataFrame([], "row_id bigint, currency string, fx_rate_used decimal(18,8), fx_as_of timestamp_ntz, as_of timestamp_ntz")
    assert units.rate_units(df, fx).count() == 0


QUOTE = "quote_id bigint, card_uid string, source string, as_of timestamp_ntz, observed_at timestamp_ntz, body string, level int, mu int"
SNAP = "card_uid string, grade string, amount decimal(18,4), currency string"


def body(price, currency="USD", **more):
    return json.dumps({"data": {"marketPrice": price, "currency": currency, **more}})


def run(spark, fx, data, snaps):
    from decimal import Decimal

    q = spark.createDataFrame([(i, c, s, a, a, b, 0, 0) for i, (c, s, a, b) in enumerate(data)], QUOTE)
    p = spark.createDataFrame([(c, "raw", Decimal(str(v)), k) for c, v, k in snaps], SNAP)
    return {r["quote_id"]: r for r in units.amount_units(q, p, fx).collect()}


def test_units_told_by_the_payload(spark, fx):
    at = t("2025-01-20")
    cases = [
        (body(42.5), 42.5, "USD", False), (body("42.50"), 42.5, "USD", False), (body("$42.50"), 42.5, "USD", True), (body("1.058,25 €", None), 1058.25, "EUR", True),
        (body("9,249p", "GBP"), 92.49, "GBP", True), (body(2314, "GBX"), 23.14, "GBP", True), (body("1.5万円", None), 15000.0, "JPY", True), (body("¥1,092"), 1092.0, "JPY", True),
        (body(5208, "USD", unit="cents"), 52.08, "USD", True), (body(9.9, "JPY", priceUnit="千円"), 9900.0, "JPY", True), (body("港幣 1,003.26", None), 1003.26, "HKD", True), (body("104326 仙", "HKD"), 1043.26, "HKD", True),
        (body("10283¢", None), 102.83, "USD", True),
    ]
    got = run(spark, fx, [("c", "s", at, b) for b, *_ in cases], [("c", 42.0, "USD")])
    for i, (b, amount, currency, restated) in enumerate(cases):
        assert (got[i]["native_amount"], got[i]["unit_currency"], got[i]["restated"]) == (amount, currency, restated), b
    assert float(got[3]["usd_amount"]) == round(1058.25 * 1.069, 2)


def test_a_source_that_changes_its_unit(spark, fx):
    data, minor = [], set()
    for d in range(50):
        at = t("2025-01-01") + dt.timedelta(days=d)
        for k in range(6):
            price = (20 + 13 * k) * (1 + ((d * 7 + k) % 11 - 5) / 100)
            if d >= 25:
                minor.add(len(data))
            data.append((f"c{k}", "s", at + dt.timedelta(hours=k), body(round(price * 100) if d >= 25 else round(price, 2), "EUR")))
    wild = len(data)
    data.append(("c1", "s", t("2025-02-10"), body(33, "EUR")))  # a wild reading in minor units
    minor.add(wild)
    zero = len(data)
    data.append(("c1", "s", t("2025-01-10"), body(0, "EUR")))
    got = run(spark, fx, data, [(f"c{k}", (20 + 13 * k) * 1.07, "USD") for k in range(6)])
    assert {i for i, r in got.items() if r["restated"]} == minor
    assert got[zero]["unit_scale"] == 0


def test_null_and_broken_payloads(spark, fx):
    at = t("2025-01-20")
    bodies = [None, "", "not json", '{"error": "quota", "data": null}', '{"data": {}}', body(None), body(""), body("call us"), body(1e12), body(5.0, None)]
    got = run(spark, fx, [(None, None, at, b) for b in bodies] + [("c", "s", None, body(5.0))], [])
    assert len(got) == len(bodies) + 1
    assert not any(got[i]["restated"] for i in range(7)) and got[7]["native_amount"] is None and got[7]["restated"]
    assert run(spark, fx, [], []) == {}
