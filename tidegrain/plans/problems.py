"""Queries of the general data-processing problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain.operators import asof, late, rolling, spikes, units
from tidegrain.session import small, written
from tidegrain.sources.tables import table

#: What makes a redelivered mention row: the same content under another id.
MENTION_CONTENT = ("card_uid", "platform", "source", "as_of", "mentions", "engagement")
#: The knowledge times at which versions of the rolling state close; each advances the one before.
STATE_CLOSES = ("2025-01-01 00:00:00", "2025-07-01 00:00:00", "2026-01-01 00:00:00", "2026-07-01 00:00:00")
SERIES = ("card_uid", "source", "marketplace", "grade", "grader")


def rolling_state(spark: SparkSession, root: str) -> DataFrame:
    return rolling.rolling_totals(table(spark, root, "sentiment"), entity="card_uid", as_of="as_of", amount="mentions", content=MENTION_CONTENT, known_at=STATE_CLOSES)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Days with mentions in the last 30 days and none in the last 7."""
    state = rolling_state(spark, root)
    return state.where("total_7 = 0 AND total_30 > 0").select(F.col("entity").alias("card_uid"), F.date_format("day", "yyyy-MM-dd").alias("as_of_day"))


def p1_rolling(spark: SparkSession, root: str) -> DataFrame:
    """Totals and averages of mentions per card and day over the last 7 and 30 days."""
    s = rolling_state(spark, root)
    return s.select(
        F.col("entity").alias("card_uid"), F.date_format("day", "yyyy-MM-dd").alias("as_of_day"), F.col("amount").alias("mentions"), "total_7", "total_30", F.round("avg_7", 6).alias("avg_7"), F.round("avg_30", 6).alias("avg_30")
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Rates and quoted prices recorded in another unit than the common one."""
    rates = p2_rates_full(spark, root).where("rate_unit != 'direct'")
    amounts = p2_amounts_full(spark, root).where("restated")
    return rates.select(F.lit("price_snapshot").alias("record_table"), F.col("row_id").alias("record_id")).unionByName(
        amounts.select(F.lit("price_quote").alias("record_table"), F.col("quote_id").alias("record_id"))
    )


def p2_rates_full(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "price_snapshot").select("row_id", "currency", "fx_rate_used", "fx_as_of", "as_of")
    return units.rate_units(rows.where("fx_rate_used IS NOT NULL"), table(spark, root, "fx_rate"))


def p2_amounts_full(spark: SparkSession, root: str) -> DataFrame:
    quotes = table(spark, root, "price_quote").select("quote_id", "card_uid", "source", "as_of", "observed_at", "body")
    return units.amount_units(quotes, table(spark, root, "price_snapshot"), table(spark, root, "fx_rate"))


def p2_rates(spark: SparkSession, root: str) -> DataFrame:
    """Every recorded rate as dollars per unit, with the unit assigned and its posterior."""
    return p2_rates_full(spark, root).select("row_id", "currency", "rate_unit", F.round("rate_posterior", 6).alias("rate_posterior"), "rate_uncertain", "rate_usd")


def p2_amounts(spark: SparkSession, root: str) -> DataFrame:
    """Every quoted price in dollars and cents, with the unit assigned and its posterior."""
    return p2_amounts_full(spark, root).select("quote_id", "unit_currency", "unit_scale", F.round("unit_posterior", 6).alias("unit_posterior"), "unit_uncertain", "native_amount", "usd_amount")


def readings(spark: SparkSession, root: str) -> DataFrame:
    """Readings of both price tables in whole native units (``value``) and at a fixed dollar rate (``common``).

    Payloads are restated once and written; the rest is scanned by each reader.
    """
    snapshots, quotes, fx = (table(spark, root, n) for n in ("price_snapshot", "price_quote", "fx_rate"))
    usual = small(units.mean_rates(fx))
    s = snapshots.select(F.lit("price_snapshot").alias("record_table"), F.col("row_id").alias("record_id"), *SERIES, "as_of", "observed_at", "supersedes", F.col("amount").cast("double").alias("value"), F.col("currency").alias("_sign"))
    q = units.amount_units(quotes.select("quote_id", "card_uid", "source", "as_of", "observed_at", "body"), snapshots, fx)
    none = F.lit(None)
    q = q.select(
        F.lit("price_quote").alias("record_table"), F.col("quote_id").alias("record_id"), "card_uid", "source", *[none.cast("string").alias(c) for c in SERIES[2:]],
        "as_of", "observed_at", none.cast("bigint").alias("supersedes"), F.col("native_amount").alias("value"), F.col("unit_currency").alias("_sign"),
    )
    both = s.unionByName(written(q)).join(usual, "_sign", "left")
    return both.withColumn("common", F.col("value") * F.pow(F.lit(10.0), F.coalesce("_usd_log", F.lit(0.0)))).drop("_sign", "_usd_log")


def flagged_readings(spark: SparkSession, root: str) -> DataFrame:
    return spikes.flag_readings(
        readings(spark, root), series=("record_table", *SERIES), as_of="as_of", observed="observed_at", row_id="record_id", value="value", common="common", correction="supersedes", keep=["record_table"], flagged_only=True
    )


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Readings that cannot be real."""
    return flagged_readings(spark, root).select("record_table", "record_id")


def p4_readings(spark: SparkSession, root: str) -> DataFrame:
    """Flagged readings with the reason and the detail coefficient in robust scales."""
    return flagged_readings(spark, root).select("record_table", "record_id", "impossible", "stuck", "spike", F.round("detail", 3).alias("detail"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Per alert the price row that was known and in force when it fired."""
    return asof.known_as_of(table(spark, root, "alert_ledger"), table(spark, root, "price_snapshot"), event_id="alert_id", at="fired_at", series=SERIES)


def _mention_partials(spark: SparkSession, root: str) -> DataFrame:
    keys = ("card_uid", "source")
    return late.partials(late.contributions(table(spark, root, "sentiment"), keys=keys, as_of="as_of", amount="mentions", content=MENTION_CONTENT), keys)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Periods whose mentions at the day's end differ from those at the cut-off."""
    got = late.published(_mention_partials(spark, root), ("card_uid", "source")).where("at_end != at_cutoff")
    return got.select("card_uid", "source", F.date_format("day", "yyyy-MM-dd").alias("as_of_day"))


def p7_published(spark: SparkSession, root: str) -> DataFrame:
    """Mentions per card, source and day as published, as corrected, and what came too late."""
    got = late.published(_mention_partials(spark, root), ("card_uid", "source"))
    return got.select("card_uid", "source", F.date_format("day", "yyyy-MM-dd").alias("as_of_day"), "at_end", "at_cutoff", "refused")


QUERIES = {
    "p1_found": p1_found,
    "p1_rolling": p1_rolling,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p2_amounts": p2_amounts,
    "p4_found": p4_found,
    "p4_readings": p4_readings,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_published": p7_published,
}
