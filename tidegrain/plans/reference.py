"""Queries over the driver's tables, one or more per operator of the engine, with their SQL oracles.

Each query is registered next to its oracle. Counts are bigint, doubles rounded, and nothing is
limited but the two reports whose size is their definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrain.functions import text as X
from tidegrain.operators import pit, stats
from tidegrain.sources import store
from tidegrain.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


KEY = ("card_uid", "grade", "grader", "marketplace", "source")
CUTOFF = "2025-07-01 00:00:00"
LATER = "2026-01-01 00:00:00"

_VIEW = """(SELECT * FROM {t} p WHERE p.observed_at <= TIMESTAMP '{c}' AND NOT EXISTS
  (SELECT 1 FROM {t} s WHERE s.supersedes = p.row_id AND s.observed_at <= TIMESTAMP '{c}'))"""


def _view(t: str, c: str) -> str:
    return _VIEW.format(t=t, c=c)


def _latest(t: str, c: str) -> str:
    return f"""(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY card_uid, grade, grader, marketplace, source
      ORDER BY as_of DESC, observed_at DESC, row_id DESC) AS rn FROM {_view(t, c)}) WHERE rn = 1)"""


# --- point in time --------------------------------------------------------------------------------


@query(f"SELECT row_id, card_uid, CAST(amount AS DOUBLE) AS amount, currency, as_of, observed_at FROM {_view('price_snapshot', CUTOFF)}")
def pit_asof_view(spark, root):
    """Price rows known and not superseded at a date."""
    v = pit.as_of_view(table(spark, root, "price_snapshot"), ts(CUTOFF))
    return v.select("row_id", "card_uid", F.col("amount").cast("double").alias("amount"), "currency", "as_of", "observed_at")


@query(f"SELECT card_uid, grade, grader, marketplace, source, row_id, CAST(amount AS DOUBLE) AS amount, currency FROM {_latest('price_snapshot', CUTOFF)}")
def pit_current_price(spark, root):
    """The current price of every series at a date."""
    v = pit.as_of_view(table(spark, root, "price_snapshot").select(*KEY, "row_id", "amount", "currency", "as_of", "observed_at", "supersedes"), ts(CUTOFF))
    return pit.current(v, KEY).select(*KEY, "row_id", F.col("amount").cast("double").alias("amount"), "currency")


@query("SELECT card_uid, arg_min(source, (observed_at, row_id)) AS source, min(observed_at) AS observed_at FROM price_snapshot GROUP BY card_uid")
def pit_first_seen_dim(spark, root):
    """The first observation of every card."""
    return pit.first_seen(table(spark, root, "price_snapshot"), "card_uid", ["source", "observed_at"])


@query(f"""SELECT coalesce(b.card_uid, a.card_uid) AS card_uid, coalesce(b.grade, a.grade) AS grade, coalesce(b.grader, a.grader) AS grader,
  coalesce(b.marketplace, a.marketplace) AS marketplace, coalesce(b.source, a.source) AS source, CAST(b.amount AS DOUBLE) AS before, CAST(a.amount AS DOUBLE) AS after,
  CASE WHEN b.card_uid IS NULL THEN 'added' WHEN a.card_uid IS NULL THEN 'dropped' WHEN a.amount IS NOT DISTINCT FROM b.amount THEN 'kept' ELSE 'changed' END AS state
  FROM {_latest('price_snapshot', CUTOFF)} b FULL JOIN {_latest('price_snapshot', LATER)} a ON b.card_uid = a.card_uid AND b.grade = a.grade
  AND b.grader IS NOT DISTINCT FROM a.grader AND b.marketplace = a.marketplace AND b.source = a.source""")
def pit_restatement_delta(spark, root):
    """How every series' current price changed between two knowledge times."""
    got = pit.restatement(table(spark, root, "price_snapshot"), KEY, "amount", ts(CUTOFF), ts(LATER))
    return got.withColumn("before", F.col("before").cast("double")).withColumn("after", F.col("after").cast("double"))


@query("""WITH d AS (SELECT DISTINCT card_uid, CAST(as_of AS DATE) AS day FROM sentiment WHERE card_uid IS NOT NULL AND as_of IS NOT NULL),
  i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY card_uid ORDER BY day) AS INT) AS island FROM d),
  r AS (SELECT card_uid, island, count(*) AS n, min(day) AS lo, max(day) AS hi FROM i GROUP BY ALL)
  SELECT card_uid, strftime(min(lo), '%Y-%m-%d') AS first_day, strftime(max(hi), '%Y-%m-%d') AS last_day, CAST(sum(n) AS BIGINT) AS present, max(n) AS consecutive,
  CAST(max(hi) - min(lo) + 1 - sum(n) AS BIGINT) AS missing FROM r GROUP BY card_uid""")
def pit_day_coverage(spark, root):
    """Days with mentions, gaps and longest run per card."""
    d = pit.day_coverage(table(spark, root, "sentiment"), "card_uid")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return d.select("card_uid", day("first_day"), day("last_day"), F.col("present").cast("bigint").alias("present"), "consecutive", F.col("missing").cast("bigint").alias("missing"))


#: The row rules of the price log as SQL conditions that both engines read; a null passes.
_PRICE_SQL = {
    "observed_before_as_of": "observed_at >= as_of", "negative_amount": "amount >= 0", "rate_without_date": "(fx_rate_used IS NULL) = (fx_as_of IS NULL)",
    "raw_with_grader": "(grade = 'raw') = (grader IS NULL)", "graded_condition": "grade = 'raw' OR condition = 'graded'", "negative_sample": "sample_size >= 0",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS violations FROM price_snapshot WHERE NOT coalesce({c}, true)" for n, c in _PRICE_SQL.items()))
def pit_invariant_violations(spark, root):
    """How many price rows break each row rule."""
    return pit.violations(table(spark, root, "price_snapshot"), {n: F.expr(c) for n, c in _PRICE_SQL.items()})


@query("""SELECT currency, count(*) AS rows, count(*) FILTER (WHERE ok) AS accepted FROM (SELECT currency, """ + " AND ".join(f"coalesce({c}, true)" for c in _PRICE_SQL.values()) + """ AS ok
  FROM price_snapshot) GROUP BY currency""")
def pit_append_gate(spark, root):
    """Rows accepted and quarantined by the append gate per currency."""
    g = pit.gate(table(spark, root, "price_snapshot"), {n: F.expr(c) for n, c in _PRICE_SQL.items()})
    return g.groupBy("currency").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("broken") == 0).alias("accepted"))


@query("SELECT source, count(*) AS orphans FROM price_snapshot p WHERE NOT EXISTS (SELECT 1 FROM cards c WHERE c.card_uid = p.card_uid) GROUP BY source")
def pit_orphan_keys(spark, root):
    """Price rows of cards missing from the catalogue, per source."""
    return pit.orphans(table(spark, root, "price_snapshot"), "card_uid", table(spark, root, "cards"), "card_uid").groupBy("source").agg(F.count(F.lit(1)).alias("orphans"))


def _links(spark, root):
    """Events as links with a confidence."""
    e = table(spark, root, "events")
    how = F.when(F.col("event_type") == "purchase", "manual").when(F.col("event_type") == "view", "exact").otherwise("fuzzy")
    return e.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("record"), how.alias("resolved_by"), F.round(F.col("value") / 500, 3).alias("confidence"), F.col("ts").alias("observed_at"), F.lit(None).cast("bigint").alias("supersedes"))


_LINKS = "(SELECT event_id AS row_id, user_id AS record, CASE event_type WHEN 'purchase' THEN 'manual' WHEN 'view' THEN 'exact' ELSE 'fuzzy' END AS resolved_by, round(value / 500, 3) AS confidence, ts AS observed_at FROM events)"


@query(f"SELECT resolved_by, count(*) AS links, count(DISTINCT record) AS records FROM {_LINKS} WHERE observed_at <= TIMESTAMP '2024-01-20' AND (resolved_by IN ('manual', 'exact') OR confidence >= 0.9) GROUP BY 1")
def pit_signal_ready(spark, root):
    """Links usable at a date: manual, exact, or fuzzy with confidence."""
    ready = pit.signal_ready(_links(spark, root), ts("2024-01-20 00:00:00"))
    return ready.groupBy("resolved_by").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("record").alias("records"))


@query(f"SELECT row_id, record, confidence, observed_at FROM {_LINKS} WHERE observed_at <= TIMESTAMP '2024-01-20' AND resolved_by = 'fuzzy' AND confidence < 0.9 ORDER BY observed_at DESC, row_id DESC LIMIT 50")
def pit_review_queue(spark, root):
    """The fifty newest links that need review; fifty is the report's size."""
    return pit.review_queue(_links(spark, root), ts("2024-01-20 00:00:00")).select("row_id", "record", "confidence", "observed_at")


@query("""WITH p AS (SELECT row_id, amount, as_of, observed_at, CASE currency WHEN 'EUR' THEN 'EUR/USD' WHEN 'GBP' THEN 'GBP/USD' ELSE 'USD/' || currency END AS pair FROM price_snapshot WHERE currency <> 'USD'),
  g AS (SELECT supersedes, min(observed_at) AS until FROM fx_rate WHERE supersedes IS NOT NULL GROUP BY 1),
  h AS (SELECT p.row_id, f.rate, f.as_of, row_number() OVER (PARTITION BY p.row_id ORDER BY f.as_of DESC, f.observed_at DESC, f.row_id DESC) AS rn FROM p JOIN fx_rate f ON f.pair = p.pair AND f.as_of <= p.as_of AND f.observed_at <= p.observed_at LEFT JOIN g ON g.supersedes = f.row_id WHERE g.until IS NULL OR g.until > p.observed_at)
  SELECT p.row_id, round(CAST(amount AS DOUBLE) * CASE WHEN pair LIKE 'USD/%' THEN 1 / CAST(rate AS DOUBLE) ELSE CAST(rate AS DOUBLE) END, 4) AS usd, h.as_of AS rate_at, date_diff('second', h.as_of, p.as_of) > 86400 AS stale FROM p LEFT JOIN h ON h.row_id = p.row_id AND rn = 1""")
def fx_asof_convert(spark, root):
    """Foreign prices in dollars at the last rate at or before their time, as it was known when the price was."""
    p, fx = table(spark, root, "price_snapshot").where("currency != 'USD'"), table(spark, root, "fx_rate")
    pair = F.when(F.col("currency").isin("EUR", "GBP"), F.concat("currency", F.lit("/USD"))).otherwise(F.concat(F.lit("USD/"), "currency"))
    p = p.select("row_id", "amount", "as_of", "observed_at", pair.alias("pair"))
    rate = pit.last_rate(p.withColumnRenamed("row_id", "fact"), fx, fact_id="fact", fact_pair="pair", at="as_of", known="observed_at")
    r = rate.join(fx.select("row_id", F.col("rate").cast("double").alias("rate"), F.col("as_of").alias("rate_at")), "row_id").drop("row_id")
    got = p.join(r, p["row_id"] == r["fact"], "left")
    per = F.when(F.col("pair").startswith("USD/"), 1 / F.col("rate")).otherwise(F.col("rate"))
    return got.select("row_id", F.round(F.col("amount").cast("double") * per, 4).alias("usd"), "rate_at", (F.timestamp_diff("SECOND", "rate_at", "as_of") > 86400).alias("stale"))


@query("SELECT pair, CAST(arg_max(rate, (as_of, observed_at, row_id)) AS DOUBLE) AS rate, max(as_of) AS as_of FROM fx_rate GROUP BY pair")
def fx_latest(spark, root):
    """The latest rate of every pair."""
    order = F.struct("as_of", "observed_at", "row_id")
    return table(spark, root, "fx_rate").groupBy("pair").agg(F.max_by("rate", order).cast("double").alias("rate"), F.max("as_of").alias("as_of"))


# --- grouped statistics ---------------------------------------------------------------------------

_PAIRS = f"""m AS (SELECT card_uid, split_part(card_uid, ':', 1) AS game, currency, date_trunc('month', as_of) AS month, grader, median(CAST(amount AS DOUBLE)) AS v
    FROM {_view('price_snapshot', LATER)} WHERE grade = '10' AND grader IS NOT NULL GROUP BY ALL),
  p AS (SELECT o.game, o.grader, o.card_uid, o.v / b.v AS ratio FROM m o JOIN m b ON o.card_uid = b.card_uid AND o.currency = b.currency AND o.month = b.month AND b.grader = 'PSA' AND b.v > 0 WHERE o.grader <> 'PSA'),
  g AS (SELECT game, grader, count(*) AS pairs, count(DISTINCT card_uid) AS members, median(ratio) AS med, list_sort(list(ratio)) AS a FROM p GROUP BY ALL)"""
_QUART = "(a[greatest(1, least(len(a) - 1, CAST(floor((len(a) + 1) * {p}) AS INT)))] + ((len(a) + 1) * {p} - greatest(1, least(len(a) - 1, CAST(floor((len(a) + 1) * {p}) AS INT)))) * (a[greatest(1, least(len(a) - 1, CAST(floor((len(a) + 1) * {p}) AS INT))) + 1] - a[greatest(1, least(len(a) - 1, CAST(floor((len(a) + 1) * {p}) AS INT)))]))"


def _ratios(spark, root):
    v = pit.as_of_view(table(spark, root, "price_snapshot"), ts(LATER)).where("grade = '10' AND grader IS NOT NULL")
    rows = v.select("card_uid", F.split_part("card_uid", F.lit(":"), F.lit(1)).alias("game"), "currency", F.date_trunc("month", F.col("as_of").cast("timestamp")).alias("month"), "grader", F.col("amount").cast("double").alias("amount"))
    return stats.paired_ratios(rows, unit=("card_uid", "currency", "month"), role="grader", base="PSA", value="amount", bucket=("game",), member="card_uid", least_pairs=20, least_members=8)


@query(f"WITH {_PAIRS} SELECT game, grader, pairs, members, CASE WHEN pairs >= 20 AND members >= 8 THEN round(med, 4) END AS ratio, CASE WHEN NOT (pairs >= 20 AND members >= 8) THEN 'sample_below_minimum' END AS refused FROM g")
def ratio_table(spark, root):
    """Median price ratios of graders to the base grader per game, published from a least sample on."""
    return _ratios(spark, root).select("game", "grader", "pairs", "members", "ratio", "refused")


@query(f"WITH {_PAIRS} SELECT game, grader, CASE WHEN pairs >= 20 AND members >= 8 THEN round({_QUART.format(p='0.25')}, 4) END AS q1, CASE WHEN pairs >= 20 AND members >= 8 THEN round({_QUART.format(p='0.75')}, 4) END AS q3 FROM g")
def ratio_exclusive_iqr(spark, root):
    """Exclusive quartiles of the same ratios."""
    return _ratios(spark, root).select("game", "grader", "q1", "q3")


@query(f"WITH {_PAIRS}, asked(game, grader) AS (VALUES ('pkmn', 'CGC'), ('optcg', 'SGC'), ('gundam', 'CGC')) SELECT k.game, k.grader, CASE WHEN pairs >= 20 AND members >= 8 THEN round(med, 4) END AS ratio, CASE WHEN pairs IS NULL THEN 'no_history' WHEN NOT (pairs >= 20 AND members >= 8) THEN 'sample_below_minimum' END AS refused FROM asked k LEFT JOIN g ON k.game = g.game AND k.grader = g.grader")
def ratio_lookup(spark, root):
    """Single buckets or the reason for refusing them; a coarser bucket never stands in."""
    asked = spark.createDataFrame([("pkmn", "CGC"), ("optcg", "SGC"), ("gundam", "CGC")], "game string, grader string")
    t = _ratios(spark, root)
    return asked.join(t, ["game", "grader"], "left").select("game", "grader", "ratio", F.when(F.col("pairs").isNull(), "no_history").otherwise(F.col("refused")).alias("refused"))


_DAILY = """d AS (SELECT card_uid, split_part(card_uid, ':', 1) AS game, CAST(as_of AS DATE) AS day, CAST(sum(mentions) AS DOUBLE) AS m FROM sentiment WHERE NOT backfilled GROUP BY ALL),
  gd AS (SELECT game, day, sum(m) AS m FROM d GROUP BY ALL)"""
_Z = "CASE WHEN count(m) OVER w >= 2 AND stddev_samp(m) OVER w > 0 THEN (m - avg(m) OVER w) / stddev_samp(m) OVER w END"


@query(f"""WITH {_DAILY}, z AS (SELECT card_uid, game, day, {_Z} AS z FROM d WINDOW w AS (PARTITION BY card_uid ORDER BY day RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
  gz AS (SELECT game, day, {_Z} AS z FROM gd WINDOW w AS (PARTITION BY game ORDER BY day RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
  SELECT z.card_uid, strftime(z.day, '%Y-%m-%d') AS day, round(z.z - gz.z, 4) AS own_minus_game FROM z JOIN gz USING (game, day) WHERE z.z IS NOT NULL AND gz.z IS NOT NULL""")
def trend_double_demeaned_z(spark, root):
    """Mentions per card and day against the card's and the game's trailing 28 days; backfilled rows excluded."""
    s = table(spark, root, "sentiment").where("NOT backfilled")
    d = s.groupBy("card_uid", F.split_part("card_uid", F.lit(":"), F.lit(1)).alias("game"), F.to_date("as_of").alias("day")).agg(F.sum("mentions").cast("double").alias("m"))
    g = stats.trailing_z(d.groupBy("game", "day").agg(F.sum("m").alias("m")), ["game"], "day", "m", 28).select("game", "day", F.col("z").alias("gz"))
    own = stats.trailing_z(d, ["card_uid"], "day", "m", 28)
    both = own.join(g, ["game", "day"]).where("z IS NOT NULL AND gz IS NOT NULL")
    return both.select("card_uid", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.col("z") - F.col("gz"), 4).alias("own_minus_game"))


_LONG = "(SELECT rule, horizon, excess FROM alert_ledger UNPIVOT INCLUDE NULLS (excess FOR horizon IN (excess_7d, excess_30d, excess_90d)))"


@query(f"SELECT rule, horizon, count(excess) AS n, round(avg(CASE WHEN excess IS NOT NULL THEN CAST(excess > 0 AS INT) END), 6) AS hit_rate, round(median(CAST(excess AS DOUBLE)), 6) AS median_excess, CASE WHEN count(excess) < 10 THEN 'low' ELSE 'ok' END AS confidence FROM {_LONG} GROUP BY 1, 2")
def ledger_hit_rates(spark, root):
    """Hit rate and median excess per rule and horizon; what has not matured is left out."""
    return stats.hit_rates(table(spark, root, "alert_ledger").select("rule", "excess_7d", "excess_30d", "excess_90d"), ["rule"], ["excess_7d", "excess_30d", "excess_90d"])


@query("SELECT alert_id, CAST(excess_90d AS DOUBLE) AS excess_90d FROM alert_ledger WHERE excess_90d IS NOT NULL ORDER BY excess_90d, alert_id LIMIT 5")
def ledger_worst_five(spark, root):
    """The five worst alerts after 90 days; five is the report's size."""
    a = table(spark, root, "alert_ledger").where("excess_90d IS NOT NULL")
    return a.orderBy("excess_90d", "alert_id").limit(5).select("alert_id", F.col("excess_90d").cast("double").alias("excess_90d"))


@query("SELECT alert_id, horizon, CAST(excess AS DOUBLE) AS excess FROM alert_ledger UNPIVOT (excess FOR horizon IN (excess_7d, excess_30d, excess_90d))")
def wide_to_long(spark, root):
    """Alert outcomes as one row per horizon, nulls dropped."""
    a = table(spark, root, "alert_ledger").select("alert_id", "excess_7d", "excess_30d", "excess_90d")
    return a.unpivot("alert_id", ["excess_7d", "excess_30d", "excess_90d"], "horizon", "excess").where("excess IS NOT NULL").select("alert_id", "horizon", F.col("excess").cast("double").alias("excess"))


@query("""WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem),
  r AS (SELECT p_brand, l_extendedprice - (i + s * l_quantity) AS e FROM lineitem JOIN part ON l_partkey = p_partkey, b)
  SELECT p_brand AS brand, count(*) AS n, round(avg(e), 2) AS mean_residual FROM r GROUP BY 1""")
def regression_residuals(spark, root):
    """Mean residual per brand of a regression of price on quantity over all lines."""
    li = table(spark, root, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    r = stats.residuals(li, "l_extendedprice", ["l_quantity"]).join(table(spark, root, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return r.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("residual"), 2).alias("mean_residual"))


_TEXT = "concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(length(CAST({c} AS VARCHAR)), ':', {c}) END" for c in ("row_id", "card_uid", "mentions", "engagement", "source", "supersedes")) + ")"
SEALED = ("row_id", "card_uid", "mentions", "engagement", "source", "supersedes")


@query(f"""WITH RECURSIVE h AS (SELECT CAST(observed_at AS DATE) AS day, sha256({_TEXT}) AS h FROM sentiment),
  s AS (SELECT day, count(*) AS n, """ + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR) AS p{i}" for i in range(4)) + """ FROM h GROUP BY day),
  d AS (SELECT day, n, sha256(concat_ws('|', CAST(n AS VARCHAR), p0, p1, p2, p3)) AS digest, row_number() OVER (ORDER BY day) AS rn FROM s),
  c AS (SELECT rn, day, n, sha256(digest) AS chain FROM d WHERE rn = 1 UNION ALL SELECT d.rn, d.day, d.n, sha256(c.chain || d.digest) FROM c JOIN d ON d.rn = c.rn + 1)
  SELECT strftime(day, '%Y-%m-%d') AS day, n, chain FROM c""")
def seal_chain(spark, root):
    """A seal per arrival day that covers the content of every row and of all days before."""
    s = stats.seal(stats.day_digests(table(spark, root, "sentiment"), F.to_date("observed_at"), SEALED))
    return s.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "chain")


# --- quality --------------------------------------------------------------------------------------

_QDAY = "q AS (SELECT card_uid, grade, grader, marketplace, source, CAST(as_of AS DATE) AS day, avg(CAST(amount AS DOUBLE)) AS v FROM price_snapshot WHERE amount > 0 GROUP BY ALL)"


@query(f"""WITH {_QDAY}, z AS (SELECT source, CASE WHEN count(v) OVER w >= 5 AND stddev_samp(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_samp(v) OVER w END AS z FROM q
  WINDOW w AS (PARTITION BY card_uid, grade, grader, marketplace, source ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
  SELECT source, count(*) AS days, count(*) FILTER (WHERE abs(z) > 5) AS jumps FROM z GROUP BY source""")
def quality_price_sigma(spark, root):
    """Days whose price lies over five deviations from the series' trailing 90 days, per source."""
    p = table(spark, root, "price_snapshot").where("amount > 0")
    d = p.groupBy(*KEY, F.to_date("as_of").alias("day")).agg(F.avg(F.col("amount").cast("double")).alias("v"))
    z = stats.trailing_z(d, KEY, "day", "v", 90, least=5)
    return z.groupBy("source").agg(F.count(F.lit(1)).alias("days"), F.count_if(F.abs("z") > 5).alias("jumps"))


@query("""WITH d AS (SELECT card_uid, grade, grader, currency, CAST(as_of AS DATE) AS day, source, median(CAST(amount AS DOUBLE)) AS v FROM price_snapshot WHERE amount > 0 GROUP BY ALL)
  SELECT a.source AS source_a, b.source AS source_b, count(*) AS pairs, count(*) FILTER (WHERE abs(a.v - b.v) / least(a.v, b.v) > 0.3) AS diverging
  FROM d a JOIN d b ON a.card_uid = b.card_uid AND a.grade = b.grade AND a.grader IS NOT DISTINCT FROM b.grader AND a.currency = b.currency AND a.day = b.day AND a.source < b.source GROUP BY 1, 2""")
def quality_source_divergence(spark, root):
    """Pairs of sources whose price of one card, grade and day differ by over 30 %."""
    keys = ("card_uid", "grade", "grader", "currency")
    p = table(spark, root, "price_snapshot").where("amount > 0").select(*keys, F.to_date("as_of").alias("day"), "source", F.col("amount").cast("double").alias("x"))
    d = stats.medians(p, [*keys, "day", "source"], "x").withColumnRenamed("median", "v")
    b = d.select(*[F.col(c).alias(f"b_{c}") for c in (*keys, "day", "source")], F.col("v").alias("bv"))
    cond = (d["day"] == b["b_day"]) & (d["source"] < b["b_source"])
    for c in keys:
        cond = cond & d[c].eqNullSafe(b[f"b_{c}"])
    pairs = d.join(b, cond)
    apart = F.abs(F.col("v") - F.col("bv")) / F.least("v", "bv") > 0.3
    return pairs.groupBy(F.col("source").alias("source_a"), F.col("b_source").alias("source_b")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(apart).alias("diverging"))


@query("""WITH o AS (SELECT source, observed_at, lag(observed_at) OVER (PARTITION BY source ORDER BY observed_at) AS before FROM (SELECT DISTINCT source, date_trunc('hour', observed_at) AS observed_at FROM price_snapshot))
  SELECT source, count(*) FILTER (WHERE observed_at - before > INTERVAL 48 HOUR) AS gaps, CAST(max(date_diff('hour', before, observed_at)) AS BIGINT) AS longest_hours FROM o GROUP BY source""")
def quality_snapshot_gap(spark, root):
    """Gaps of over 48 hours between arrivals per source, at one row per source and hour."""
    h = table(spark, root, "price_snapshot").select("source", F.date_trunc("hour", F.col("observed_at").cast("timestamp")).alias("h")).distinct()
    gap = (F.unix_timestamp("h") - F.unix_timestamp(F.lag("h").over(Window.partitionBy("source").orderBy("h")))) / 3600
    return h.withColumn("gap", gap).groupBy("source").agg(F.count_if(F.col("gap") > 48).alias("gaps"), F.max("gap").cast("bigint").alias("longest_hours"))


@query("""WITH d AS (SELECT CAST(as_of AS DATE) AS day, count(DISTINCT card_uid) AS cards FROM sentiment GROUP BY 1)
  SELECT strftime(day, '%Y-%m-%d') AS day, cards, lag(cards) OVER (ORDER BY day) AS before FROM d QUALIFY cards < 0.98 * lag(cards) OVER (ORDER BY day)""")
def quality_count_drop(spark, root):
    """Days with over 2 % fewer cards than the day before; the window runs over one row per day."""
    d = table(spark, root, "sentiment").groupBy(F.to_date("as_of").alias("day")).agg(F.count_distinct("card_uid").alias("cards"))
    d = d.withColumn("before", F.lag("cards").over(Window.orderBy("day"))).where("cards < 0.98 * before")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "cards", "before")


@query("SELECT source, count(*) AS rows, count(*) FILTER (WHERE date_diff('second', observed_at, TIMESTAMP '2026-07-01') > 86400) AS stale FROM price_quote WHERE observed_at <= TIMESTAMP '2026-07-01' GROUP BY source")
def quality_staleness(spark, root):
    """Quotes older than a day at a reference time, per source."""
    q = table(spark, root, "price_quote").where(F.col("observed_at") <= ts("2026-07-01 00:00:00"))
    age = F.timestamp_diff("SECOND", "observed_at", ts("2026-07-01 00:00:00"))
    return q.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(age > 86400).alias("stale"))


# --- catalogue, payloads, sets --------------------------------------------------------------------

@query("""SELECT game, language, source, n FROM (SELECT *, row_number() OVER (PARTITION BY game, language ORDER BY CASE source WHEN 'cardrail' THEN 1 WHEN 'openpull' THEN 2 WHEN 'lantern_index' THEN 3 ELSE 4 END, source) AS rn
  FROM (SELECT game, language, source, count(*) AS n FROM cards GROUP BY ALL)) WHERE rn = 1""")
def catalog_first_source(spark, root):
    """Per game and language the first source in order of priority that delivered anything; never merged."""
    prio = F.when(F.col("source") == "cardrail", 1).when(F.col("source") == "openpull", 2).when(F.col("source") == "lantern_index", 3).otherwise(4)
    n = table(spark, root, "cards").groupBy("game", "language", "source").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("game", "language").orderBy(prio, "source")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query("SELECT source, external_id, max(target_id) AS target_id, arg_max(name, (observed_at, target_id)) AS name FROM targets WHERE external_id IS NOT NULL GROUP BY 1, 2")
def catalog_last_wins(spark, root):
    """Records of one external id folded, the last observed winning."""
    g = table(spark, root, "targets").where("external_id IS NOT NULL").groupBy("source", "external_id")
    return g.agg(F.max("target_id").alias("target_id"), F.max_by("name", F.struct("observed_at", "target_id")).alias("name"))


@query("""WITH have AS (SELECT DISTINCT rarity FROM cards WHERE rarity IS NOT NULL), vocab AS (SELECT DISTINCT rarity FROM rarity_vocabulary)
  SELECT rarity, 'unused' AS state FROM (FROM vocab EXCEPT FROM have) UNION ALL SELECT rarity, 'unmapped' FROM (FROM have EXCEPT FROM vocab)""")
def vocabulary_diff(spark, root):
    """Entries no card uses and values that are no entry."""
    have, vocab = table(spark, root, "cards").where("rarity IS NOT NULL").select("rarity"), table(spark, root, "rarity_vocabulary").select("rarity")
    return vocab.exceptAll(vocab.intersect(have)).distinct().withColumn("state", F.lit("unused")).unionByName(have.subtract(vocab).withColumn("state", F.lit("unmapped")))


@query("""SELECT source, CASE WHEN body IS NULL THEN 'no_response' WHEN NOT json_valid(body) THEN 'unreadable' WHEN json_exists(body, '$.error') THEN 'error' WHEN body->>'$.data.marketPrice' IS NULL THEN 'empty' ELSE 'ok' END AS class, count(*) AS n FROM price_quote GROUP BY ALL""")
def payload_classes(spark, root):
    """Provider answers by class: none, unreadable, error, empty or ok."""
    body = F.col("body")
    ok = F.get_json_object(body, "$.data.marketPrice").isNotNull()
    kind = F.when(body.isNull(), "no_response").when(F.try_parse_json(body).isNull(), "unreadable").when(F.get_json_object(body, "$.error").isNotNull(), "error").when(~ok, "empty").otherwise("ok")
    return table(spark, root, "price_quote").groupBy("source", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT source, unnest(json_keys(body, '$.data')) AS key FROM price_quote WHERE json_valid(body) AND json_type(body, '$.data') = 'OBJECT') SELECT source, key, count(*) AS n FROM k GROUP BY ALL""")
def payload_keys(spark, root):
    """Which fields payloads have, per source; absent and null differ."""
    keys = F.explode(F.json_object_keys(F.get_json_object("body", "$.data")))
    return table(spark, root, "price_quote").select("source", keys.alias("key")).groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source, max(CAST(body->>'$.rate_limit.daily_remaining' AS BIGINT)) AS most_left, min(CAST(body->>'$.rate_limit.daily_remaining' AS BIGINT)) AS least_left, count(*) AS answers FROM price_quote
  WHERE json_valid(body) AND body->>'$.rate_limit.daily_remaining' IS NOT NULL GROUP BY source""")
def payload_quota(spark, root):
    """Quota left as payloads report it."""
    left = F.get_json_object("body", "$.rate_limit.daily_remaining").cast("bigint")
    q = table(spark, root, "price_quote").select("source", left.alias("l")).where("l IS NOT NULL")
    return q.groupBy("source").agg(F.max("l").alias("most_left"), F.min("l").alias("least_left"), F.count(F.lit(1)).alias("answers"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1")
def json_props_extract(spark, root):
    """Events by a field of their JSON properties."""
    e = table(spark, root, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("SELECT grader, rule, count(*) AS alerts, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM alert_ledger WHERE grader IS NOT NULL GROUP BY 1, 2")
def inverse_index(spark, root):
    """For each grader and rule the sources that cite it."""
    a = table(spark, root, "alert_ledger").where("grader IS NOT NULL").groupBy("grader", "rule")
    return a.agg(F.count(F.lit(1)).alias("alerts"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("""WITH s AS (SELECT game, language, bool_and(foil IS NULL) AS untested, bool_or(foil IS NULL) AS some_untested, bool_and(coalesce(foil, false)) AS all_full, bool_and(NOT coalesce(foil, false)) AS all_none FROM cards GROUP BY ALL)
  SELECT game, language, CASE WHEN untested THEN 'UNTESTED' WHEN some_untested THEN 'PARTIAL' WHEN all_full THEN 'FULL' WHEN all_none THEN 'NONE' ELSE 'PARTIAL' END AS status FROM s""")
def status_rollup(spark, root):
    """Three-valued evidence per game and language rolled up; unknown is neither true nor false."""
    g = table(spark, root, "cards").groupBy("game", "language").agg(
        F.bool_and(F.col("foil").isNull()).alias("u"), F.bool_or(F.col("foil").isNull()).alias("s"), F.bool_and(F.coalesce("foil", F.lit(False))).alias("f"), F.bool_and(~F.coalesce("foil", F.lit(False))).alias("n"))
    status = F.when(F.col("u"), "UNTESTED").when(F.col("s"), "PARTIAL").when(F.col("f"), "FULL").when(F.col("n"), "NONE").otherwise("PARTIAL")
    return g.select("game", "language", status.alias("status"))


# --- events ---------------------------------------------------------------------------------------


@query("SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def events_daily(spark, root):
    """Events per type and day."""
    e = table(spark, root, "events").groupBy("event_type", F.window("ts", "1 day").alias("w"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value")).select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "value")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS f FROM events),
  s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g), t AS (SELECT user_id, sid, count(*) AS events FROM s GROUP BY 1, 2)
  SELECT user_id, count(*) AS sessions, max(events) AS longest FROM t GROUP BY 1""")
def events_sessions(spark, root):
    """Sessions per user, split at half an hour without events."""
    s = table(spark, root, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("events"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest"))


@query("SELECT strftime(CAST(as_of AS DATE), '%Y-%m-%d') AS day, source, count(*) AS n, CAST(sum(mentions) AS BIGINT) AS mentions FROM sentiment WHERE NOT backfilled GROUP BY 1, 2")
def stream_daily_mentions(spark, root):
    """Mentions per source and day, aggregated by a stream over the log and merged per batch."""
    from tidegrain.streaming import daily

    got = daily.run_daily(spark, root, "sentiment", keys=["source"], at="as_of", amount="mentions", keep="NOT backfilled")
    return got.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "source", "n", F.col("amount").alias("mentions"))


@query("SELECT CAST(l_returnflag AS VARCHAR) AS returnflag, l_linestatus AS linestatus, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY CUBE (1, 2)")
def cube_revenue(spark, root):
    """Revenue by return flag and line status with all subtotals (an extension)."""
    li = table(spark, root, "lineitem").cube(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    return li.agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# --- sources --------------------------------------------------------------------------------------


@query("""SELECT row_id, CASE WHEN source = 'manual' AND currency = 'USD' THEN 3 WHEN source = 'manual' THEN 2 WHEN currency = 'JPY' THEN 4 ELSE 1 END AS rule FROM price_snapshot""")
def rule_match(spark, root):
    """Every price row with the most specific rule of a table of rules that may leave fields open."""
    rules = spark.createDataFrame([(1, None, None), (2, "manual", None), (3, "manual", "USD"), (4, None, "JPY")], "rule int, source string, currency string")
    return store.most_specific(table(spark, root, "price_snapshot").select("row_id", "source", "currency"), rules, ["source", "currency"], "row_id")


_DAY_OF = "(SELECT card_uid, source, mentions FROM sentiment WHERE CAST(as_of AS DATE) = DATE '{}')"


@query(f"""WITH today AS {_DAY_OF.format('2026-06-01')}, before AS {_DAY_OF.format('2026-05-31')}
  SELECT card_uid, count(*) AS rows, CAST(sum(mentions) AS BIGINT) AS mentions, false AS preserved FROM today GROUP BY 1
  UNION ALL SELECT card_uid, count(*), CAST(sum(mentions) AS BIGINT), true FROM before WHERE card_uid NOT IN (SELECT card_uid FROM today) GROUP BY 1""")
def preserve_empty_runs(spark, root):
    """A day's rows, with the day before standing in for the cards that brought none."""
    s = table(spark, root, "sentiment").select("card_uid", "source", "mentions", F.to_date("as_of").alias("day"))
    one = lambda d: s.where(F.col("day") == F.lit(d).cast("date")).drop("day")
    kept = store.preserve(one("2026-06-01"), one("2026-05-31"), "card_uid")
    return kept.groupBy("card_uid", "preserved").agg(F.count(F.lit(1)).alias("rows"), F.sum("mentions").alias("mentions"))
