"""Quantities recorded in different units, converted to common ones.

Two operators share one idea, a mixture on the logarithmic scale whose components sit at known
offsets, the logarithms of the conversion factors, so that only weights and spreads are fitted:

* :func:`rate_units`: exchange rates against a reference rate. Components are the two directions
  times the scales 1, 100 and 10 000.
* :func:`amount_units`: amounts in free-form payloads. What the text says (symbols, unit words, the
  currency label, fields named unit) decides where it says anything. The rest is compared with the
  item's usual level in whole units; components are whole, minor (1/100) and thousand units. The
  weights belong to a source and the days around the reading, so a source that changes its unit at
  some date is followed and a single wild reading follows its source's unit, not its value.

Both fit on counts per narrow bin of all rows (a mergeable aggregate whose size is bounded by bins,
currencies, sources and days, not by rows), never on the rows themselves.

Defined cases: null, empty and unparsable values get unit null; zero, negative and placeholder
values take the unit of their channel's weights; unknown currencies or items without any level fall
back on the weights; ``uncertain`` marks posteriors under ``SURE``; repeated rows count as often as
they occur; empty tables give empty results; only named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.operators.corrections import never_replaced
from tidegrain.session import small, written

#: Distance from a component, in log10, beyond which readings are fitted as outliers.
NEAR = 0.05
#: Posterior from which a unit counts as settled.
SURE = 0.95

# --- exchange rates -----------------------------------------------------------------------------

#: Name, direction (1 quote per unit, -1 units per quote), log10 scale.
RATE_UNITS = (
    ("direct", 1, 0),
    ("inverse", -1, 0),
    ("direct_x100", 1, 2),
    ("inverse_x100", -1, 2),
    ("direct_x10000", 1, 4),
    ("inverse_x10000", -1, 4),
    ("direct_per100", 1, -2),
    ("inverse_per100", -1, -2),
)


def reference_rates(fx: DataFrame, quote: str = "USD") -> DataFrame:
    """``(currency, day, usd)``: current rate of each currency in ``quote``, days between two filled forward.

    Readers take the first or last day's rate for days beyond either end. The table of daily reference rates is small by nature: one row per currency and day.
    """
    cur = never_replaced(fx.where("rate > 0"))
    base, other = F.substring("pair", 1, 3), F.substring("pair", 5, 3)
    cur = cur.select(
        F.when(other == quote, base).when(base == quote, other).alias("currency"),
        F.to_date("as_of").alias("day"),
        F.when(other == quote, F.col("rate").cast("double")).otherwise(1 / F.col("rate").cast("double")).alias("usd"),
        "observed_at",
    ).where("currency IS NOT NULL AND day IS NOT NULL")
    daily = cur.groupBy("currency", "day").agg(F.max_by("usd", "observed_at").alias("usd"))
    nxt = F.lead("day").over(Window.partitionBy("currency").orderBy("day"))
    return daily.withColumn("until", F.coalesce(F.date_sub(nxt, 1), "day")).select("currency", F.explode(F.sequence("day", F.greatest("day", "until"))).alias("day"), "usd")


def fit_offsets(x: np.ndarray, count: np.ndarray, spread: float = 0.005, outlier: float = 1e-3, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and common spread of a mixture whose residuals per component are the columns of ``x``."""
    k = x.shape[1]
    w, total = np.full(k, 1.0 / k), max(count.sum(), 1)
    for _ in range(rounds):
        dens = w * np.exp(-0.5 * (x / spread) ** 2) / (spread * 2.5066)
        resp = dens / (dens.sum(1, keepdims=True) + outlier * 0.1)
        mass = (resp * count[:, None]).sum(0)
        w = (mass + 1e-3) / (mass.sum() + 1e-3 * k)
        spread = float(np.sqrt(max((resp * x**2 * count[:, None]).sum() / max(mass.sum(), 1.0), 1e-8)))
        spread = min(max(spread, 3e-4), 0.02)
    return w, spread if total else 0.005


def rate_units(rows: DataFrame, fx: DataFrame, *, rate: str = "fx_rate_used", currency: str = "currency", at: str = "fx_as_of", fallback_at: str = "as_of", quote: str = "USD", bin_width: float = 1e-3) -> DataFrame:
    """``rows`` with ``rate_unit, rate_posterior, rate_uncertain`` and the rate restated in ``rate_usd``.

    Rows without a rate keep nulls. The reference table is joined on (currency, day).
    """
    ref = reference_rates(fx, quote)
    edge = ref.groupBy(F.col("currency").alias("_u_cur")).agg(F.min("day").alias("_u_lo"), F.max("day").alias("_u_hi"))
    day = F.to_date(F.coalesce(F.col(at), F.col(fallback_at)))
    got = rows.join(edge, F.col(currency) == F.col("_u_cur"), "left")
    got = got.withColumn("_u_day", F.least(F.greatest(day, F.col("_u_lo")), F.col("_u_hi"))).drop("_u_cur", "_u_lo", "_u_hi")
    ref = ref.select(F.col("currency").alias("_u_cur"), F.col("day").alias("_u_rday"), F.col("usd").alias("_u_usd"))
    got = got.join(ref, (F.col(currency) == F.col("_u_cur")) & (F.col("_u_day") == F.col("_u_rday")), "left").drop("_u_cur", "_u_rday", "_u_day")
    lr, lu = F.log10(F.when(F.col(rate) > 0, F.col(rate).cast("double"))), F.coalesce(F.log10("_u_usd"), F.when(F.col(currency) == quote, 0.0))
    got = got.withColumn("_d", lr - lu).withColumn("_i", lr + lu).drop("_u_usd")
    # Bins near a component only, all others being one: at most (2 * 4 * NEAR / bin_width + 1) squared whatever the data.
    near_bin = lambda c: F.when(F.abs(c - F.greatest(F.least(F.round(c / 2) * 2, F.lit(4.0)), F.lit(-2.0))) <= NEAR, F.round(c / bin_width))
    hist = got.where("_d IS NOT NULL").groupBy(near_bin(F.col("_d")).alias("d"), near_bin(F.col("_i")).alias("i")).count().toPandas()
    far = lambda v: np.nan_to_num(v.to_numpy(float) * bin_width, nan=99.0)
    x = np.stack([far(hist.d if s > 0 else hist.i) - e for _, s, e in RATE_UNITS], 1) if len(hist) else np.zeros((0, len(RATE_UNITS)))
    w, spread = fit_offsets(x, hist["count"].to_numpy(float) if len(hist) else np.zeros(0))
    dens = [F.lit(float(w[j])) * F.exp(-0.5 * F.pow(((F.col("_d") if s > 0 else F.col("_i")) - e) / spread, 2)) for j, (_, s, e) in enumerate(RATE_UNITS)]
    got = got.withColumn("_p", F.when(F.col("_d").isNotNull(), F.array(*dens)))
    total = F.aggregate("_p", F.lit(0.0), lambda a, v: a + v)
    best = F.array_max("_p")
    # Beyond every component the nearest one is taken and marked uncertain.
    near = F.array(*[F.abs((F.col("_d") if s > 0 else F.col("_i")) - e) for _, s, e in RATE_UNITS])
    j = F.when(total > 0, F.array_position("_p", best)).otherwise(F.array_position(near, F.array_min(near)))
    names = F.array(*[F.lit(n) for n, _, _ in RATE_UNITS])
    got = got.withColumn("rate_unit", F.when(F.col("_d").isNotNull(), F.element_at(names, j.cast("int"))))
    got = got.withColumn("rate_posterior", F.when(total > 0, best / total).when(F.col("_d").isNotNull(), F.lit(0.0)))
    got = got.withColumn("rate_uncertain", F.col(rate).isNotNull() & (F.coalesce(F.col("rate_posterior"), F.lit(0.0)) < SURE))
    r = F.col(rate).cast("double")
    usd = F.lit(None).cast("double")
    for n, s, e in RATE_UNITS:
        usd = F.when(F.col("rate_unit") == n, r / 10.0**e if s > 0 else 10.0**e / r).otherwise(usd)
    return got.withColumn("rate_usd", F.round(usd, 8)).drop("_d", "_i", "_p")


# --- amounts in payloads ------------------------------------------------------------------------

#: Words and signs for a currency, then for a unit, as found in price payloads.
CURRENCY_SIGNS = (
    (r"HK\$|港幣|港币|港元|仙", "HKD"),
    (r"US\$|\bUSD\b|¢", "USD"),
    (r"€|\bEUR\b|(?i:euro)", "EUR"),
    (r"£|\bGBP\b|(?i:\bpence\b)|\dp$", "GBP"),
    (r"人民币|\bCNY\b|\bRMB\b|元", "CNY"),
    (r"¥|￥|円|\bJPY\b|(?i:\byen\b)", "JPY"),
    (r"\$", "USD"),
)
ISO_CURRENCIES = ("USD", "EUR", "GBP", "JPY", "HKD", "CNY")
MINOR_CODES = {"GBp": "GBP", "GBX": "GBP", "USX": "USD", "EUX": "EUR", "ZAc": "ZAR"}
UNIT_WORDS = (
    (r"(?i)cents?\b|\bminor\b|pence|\bpenny\b|¢|仙|^p$|centime", -2),
    (r"(?i)thousand|\b1,?000\b|千|^k\b", 3),
    (r"万|(?i:\b10,?000\b)", 4),
    (r"(?i)\bmajor\b|\bwhole\b|\bunits?\b|dollars?\b|euros?\b|pounds?\b|\byen\b|円", 0),
)
TEXT_UNITS = ((r"¢|仙|\dp$|(?i:cents?\b|pence\b)", -2), (r"千|(?i:\dk$)", 3), (r"万", 4))

#: Components of an unhinted number: log10 of whole units per recorded unit.
SCALES = (0, -2, 3)
LEVEL_BIN = 0.05
WINDOW_DAYS = 4
#: Share of a source's readings under which a unit is not taken for one of its units.
SPARSE = 0.02
OUTLIER = 0.02


def _signed(text: Column) -> Column:
    """The decimal number in ``text`` with grouping removed; a comma before one or two last digits is decimal."""
    bare = F.regexp_extract(F.regexp_replace(text, "[\\s\u00a0']", ""), r"(-?[0-9][0-9.,]*)", 1)
    comma_decimal = bare.rlike(r",[0-9]{1,2}$")
    plain = F.when(comma_decimal, F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(bare, ",", ""))
    return plain.try_cast("double")


def parse_amounts(quotes: DataFrame, *, body: str = "body") -> DataFrame:
    """``quotes``, its body replaced by ``_text, _plain, _value, _label, _iso, _sign, _said``: what the payload itself says.

    ``_said`` is the log10 of whole units per recorded unit as far as the payload tells, else null.
    """
    fields = F.from_json(F.col(body), "struct<data: struct<marketPrice: string, currency: string, unit: string, priceUnit: string>>")
    q = quotes.withColumn("_data", fields["data"]).drop(body)
    q = q.withColumn("_text", F.trim("_data.marketPrice")).withColumn("_label", F.trim("_data.currency"))
    q = q.withColumn("_unit", F.trim(F.coalesce("_data.unit", "_data.priceUnit"))).drop("_data")
    q = q.withColumn("_text", F.when(F.col("_text") != "", F.col("_text")))
    q = q.withColumn("_plain", F.col("_text").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
    q = q.withColumn("_value", F.when(F.col("_plain"), F.col("_text").try_cast("double")).otherwise(_signed(F.col("_text"))))
    said = F.lit(None).cast("int")
    for pattern, e in reversed(UNIT_WORDS):
        said = F.when(F.col("_unit").rlike(pattern), F.lit(e)).otherwise(said)
    text_said = F.when(F.col("_text").isNotNull() & ~F.col("_plain"), F.lit(0))
    for pattern, e in reversed(TEXT_UNITS):
        text_said = F.when(~F.col("_plain") & F.col("_text").rlike(pattern), F.lit(e)).otherwise(text_said)
    label_said = F.when(F.col("_label").isin(*MINOR_CODES), F.lit(-2))
    q = q.withColumn("_said", F.coalesce(said, F.when(text_said.isNotNull() & (text_said != 0), text_said), label_said, text_said))
    sign = F.lit(None).cast("string")
    for pattern, c in reversed(CURRENCY_SIGNS):
        sign = F.when(~F.col("_plain") & F.col("_text").rlike(pattern), F.lit(c)).otherwise(sign)
    labelled = F.lit(None).cast("string")
    for code, c in MINOR_CODES.items():
        labelled = F.when(F.col("_label") == code, F.lit(c)).otherwise(labelled)
    iso = F.when(F.col("_label").rlike("^[A-Z]{3}$") & ~F.col("_label").isin(*MINOR_CODES), F.col("_label"))
    return q.withColumn("_iso", iso).withColumn("_sign", F.coalesce(sign, labelled, iso)).drop("_unit")


def levels(quotes: DataFrame, snapshots: DataFrame, usd: DataFrame) -> DataFrame:
    """``(card_uid, _level)``: median log10 of dollars per card over ungraded snapshots and payloads that tell their unit."""
    s = snapshots.where("amount > 0 AND grade = 'raw'").select("card_uid", F.col("currency").alias("_sign"), F.log10(F.col("amount").cast("double")).alias("x"))
    q = quotes.where("_said IS NOT NULL AND _value > 0").select("card_uid", "_sign", (F.log10("_value") + F.col("_said")).alias("x"))
    both = s.unionByName(q).join(small(usd), "_sign").select("card_uid", (F.col("x") + F.col("_usd_log")).alias("x"))
    return both.groupBy("card_uid").agg(F.percentile_approx("x", 0.5, 200).alias("_level"))


def mean_rates(fx: DataFrame, quote: str = "USD") -> DataFrame:
    """``(_sign, _usd_log)``: mean log10 dollars per unit; one row per currency."""
    ref = reference_rates(fx, quote).groupBy(F.col("currency").alias("_sign")).agg(F.avg(F.log10("usd")).alias("_usd_log"))
    return ref.unionByName(fx.sparkSession.createDataFrame([(quote, 0.0)], "_sign string, _usd_log double"))


def _fit_channel(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weights per day of one channel (source and currency), from counts per (day, bin, form).

    The group holds one row per day, bin and form, bounded by days and bins.
    """
    days = np.unique(pdf.day_no.to_numpy())
    at = np.searchsorted(days, pdf.day_no.to_numpy())
    x = pdf.bin.to_numpy(float) * LEVEL_BIN
    known = ~np.isnan(x)
    n = pdf.n.to_numpy(float)
    whole_form = pdf.integral.to_numpy(bool)
    k = len(SCALES)
    shape = np.stack([np.where(whole_form, 0.3, 0.7), np.where(whole_form, 0.999, 0.001), np.where(whole_form, 0.1, 0.9)], 1)
    w = np.full((len(days), k), 1.0 / k)
    mu, sd = 0.0, 0.25
    off = np.array([-s for s in SCALES], float)
    for _ in range(15):
        r = x[:, None] - mu - off[None, :]
        lik = (1 - OUTLIER) * np.exp(-0.5 * (r / sd) ** 2) / (sd * 2.5066) + OUTLIER / 8
        lik = np.where(known[:, None], lik, 1.0) * shape
        resp = lik * w[at]
        resp /= resp.sum(1, keepdims=True)
        core = resp * (np.abs(np.nan_to_num(r, nan=9.0)) < 4 * sd)
        mass = (core * n[:, None]).sum()
        if mass > 0:
            mu += float((core * np.nan_to_num(r) * n[:, None]).sum() / mass)
            sd = min(max(float(np.sqrt((core * np.nan_to_num(r) ** 2 * n[:, None]).sum() / mass)), 0.05), 0.4)
        per_day = np.zeros((len(days), k))
        np.add.at(per_day, at, resp * n[:, None])
        total = np.vstack([np.zeros((1, k)), np.cumsum(per_day, 0)])
        lo, hi = np.searchsorted(days, days - WINDOW_DAYS, "left"), np.searchsorted(days, days + WINDOW_DAYS, "right")
        near = total[hi] - total[lo] + 0.02 * per_day.sum(0) / max(per_day.sum(), 1)
        # A sparse prior: what a reading or two suggest is no unit of the source.
        near = np.maximum(near - 1.5 - SPARSE * near.sum(1, keepdims=True), 0.0)
        near = np.where(near.sum(1, keepdims=True) > 0, near, 1e-2 * per_day.sum(0) / max(per_day.sum(), 1))  # too few readings near: the channel's
        w = (near + 1e-4) / (near.sum(1, keepdims=True) + 1e-4 * k)
    out = {"day_no": days, "mu": mu, "sd": sd}
    for j in range(k):
        out[f"w{j}"] = w[:, j]
    frame = pd.DataFrame(out)
    frame.insert(0, "_sign", pdf["_sign"].iloc[0])
    frame.insert(0, "source", pdf["source"].iloc[0])
    return frame


def amount_units(quotes: DataFrame, snapshots: DataFrame, fx: DataFrame, *, body: str = "body", quote: str = "USD") -> DataFrame:
    """``quotes`` with the unit of ``data.marketPrice`` and its amount in whole dollars and cents.

    Adds ``unit_currency``, ``unit_scale`` (log10 of whole units per recorded unit), ``unit_posterior``,
    ``unit_uncertain``, ``native_amount`` (whole units of that currency), ``usd_amount`` decimal(18,2),
    and ``restated``: not null, and not a plain number in whole units of the ISO currency named.
    """
    q = written(parse_amounts(quotes, body=body))  # parsed once, then read for levels, weights and amounts
    usual = mean_rates(fx, quote)
    level = levels(q, snapshots, usual)
    q = q.join(level, "card_uid", "left").join(small(usual), "_sign", "left")
    x = F.when(F.col("_value") > 0, F.log10("_value") + F.col("_usd_log") - F.col("_level"))
    q = q.withColumn("_x", x).withColumn("_day_no", F.datediff(F.to_date("as_of"), F.lit("1970-01-01").cast("date")))
    q = q.withColumn("_integral", F.col("_value") == F.floor("_value"))
    silent = q.where("_value IS NOT NULL AND _said IS NULL")
    counts = silent.groupBy("source", "_sign", F.col("_day_no").alias("day_no"), F.round(F.greatest(F.least("_x", F.lit(9.0)), F.lit(-9.0)) / LEVEL_BIN).alias("bin"), F.col("_integral").alias("integral")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where("source IS NOT NULL AND day_no IS NOT NULL")
    fitted = counts.groupBy("source", "_sign").applyInPandas(_fit_channel, "source string, _sign string, day_no int, mu double, sd double, w0 double, w1 double, w2 double")
    fitted = fitted.select(F.col("source").alias("_f_source"), F.col("_sign").alias("_f_sign"), F.col("day_no").alias("_f_day"), *[F.col(c).alias(f"_{c}") for c in ("mu", "sd", "w0", "w1", "w2")])
    q = q.join(fitted, (q["source"] == fitted["_f_source"]) & q["_sign"].eqNullSafe(fitted["_f_sign"]) & (q["_day_no"] == fitted["_f_day"]), "left").drop("_f_source", "_f_sign", "_f_day")
    form = [F.when(F.col("_integral"), 0.3).otherwise(0.7), F.when(F.col("_integral"), 0.999).otherwise(0.001), F.when(F.col("_integral"), 0.1).otherwise(0.9)]
    dens = []
    for j, s in enumerate(SCALES):
        r = (F.col("_x") - F.col("_mu") + F.lit(float(s))) / F.col("_sd")
        lik = F.when(F.col("_x").isNotNull(), (1 - OUTLIER) * F.exp(-0.5 * r * r) / (F.col("_sd") * 2.5066) + OUTLIER / 8).otherwise(F.lit(1.0))
        dens.append(F.coalesce(F.col(f"_w{j}"), F.lit([0.98, 0.01, 0.01][j])) * lik * form[j])
    q = q.withColumn("_p", F.array(*dens))
    total = F.aggregate("_p", F.lit(0.0), lambda a, v: a + v)
    pick = F.element_at(F.array(*[F.lit(s) for s in SCALES]), F.array_position("_p", F.array_max("_p")).cast("int"))
    has = F.col("_value").isNotNull()
    q = q.withColumn("unit_scale", F.when(has, F.coalesce(F.col("_said"), pick)).cast("int"))
    q = q.withColumn("unit_posterior", F.when(has & F.col("_said").isNotNull(), F.lit(1.0)).when(has, F.array_max("_p") / total))
    q = q.withColumn("unit_currency", F.when(has, F.col("_sign")))
    q = q.withColumn("unit_uncertain", F.col("_text").isNotNull() & (F.coalesce(F.col("unit_posterior"), F.lit(0.0)) < SURE))
    q = q.withColumn("native_amount", F.round(F.col("_value") * F.pow(F.lit(10.0), F.col("unit_scale")), 4))
    ref = reference_rates(fx, quote).select(F.col("currency").alias("_r_cur"), F.col("day").alias("_r_day"), F.col("usd").alias("_r_usd"))
    edge = ref.groupBy(F.col("_r_cur").alias("_e_cur")).agg(F.min("_r_day").alias("_lo"), F.max("_r_day").alias("_hi"))
    q = q.join(small(edge), F.col("unit_currency") == F.col("_e_cur"), "left")
    q = q.withColumn("_day", F.least(F.greatest(F.to_date("as_of"), F.col("_lo")), F.col("_hi"))).drop("_e_cur", "_lo", "_hi")
    q = q.join(ref, (F.col("unit_currency") == F.col("_r_cur")) & (F.col("_day") == F.col("_r_day")), "left")
    rate = F.when(F.col("unit_currency") == quote, F.lit(1.0)).otherwise(F.col("_r_usd"))
    q = q.withColumn("usd_amount", F.round(F.col("native_amount") * rate, 2).try_cast("decimal(18,2)"))
    whole = F.col("_plain") & F.col("_iso").isNotNull() & (F.col("unit_scale") == 0) & (F.col("_sign") == F.col("_iso"))
    q = q.withColumn("restated", F.col("_text").isNotNull() & ~F.coalesce(whole, F.lit(False)))
    drop = ["_text", "_label", "_plain", "_value", "_said", "_iso", "_sign", "_x", "_day_no", "_integral", "_p", "_level", "_usd_log", "_mu", "_sd", "_w0", "_w1", "_w2", "_r_cur", "_r_day", "_r_usd", "_day"]
    return q.drop(*drop)
