"""Queries on what is known how well: evidence per card, separation of languages, decisions, runs, look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrain.functions import text as X
from tidegrain.operators import pit, stats
from tidegrain.plans.reference import CUTOFF, KEY, LATER, _LINKS, _links, _view, query, ts
from tidegrain.sources.tables import table

MIN_SAMPLE = 5


def rolled_up(status: Column) -> Column:
    """One status of many: untested only if all are, partial if some are, else full or none if all agree."""
    every = lambda v: F.bool_and(status == v)
    return F.when(every("UNTESTED"), "UNTESTED").when(F.bool_or(status == "UNTESTED"), "PARTIAL").when(every("FULL"), "FULL").when(every("NONE"), "NONE").otherwise("PARTIAL")


def _rolled(c: str) -> str:
    return f"CASE WHEN bool_and({c} = 'UNTESTED') THEN 'UNTESTED' WHEN bool_or({c} = 'UNTESTED') THEN 'PARTIAL' WHEN bool_and({c} = 'FULL') THEN 'FULL' WHEN bool_and({c} = 'NONE') THEN 'NONE' ELSE 'PARTIAL' END"


_USABLE = "(body IS NOT NULL AND json_valid(body) AND NOT json_exists(body, '$.error'))"
_GRADES = ("10", "9", "8")
_SCORES = f"""q AS (SELECT card_uid, bool_or({_USABLE}) AS usable, count(*) FILTER (WHERE {_USABLE} AND body->>'$.data.marketPrice' IS NOT NULL) AS prices, count(DISTINCT CASE WHEN {_USABLE} AND body->>'$.data.marketPrice' IS NOT NULL THEN source END) AS sources FROM price_quote GROUP BY 1),
  g AS (SELECT card_uid, """ + ", ".join(f"max(CASE WHEN grade = '{n}' THEN CASE WHEN amount IS NOT NULL AND sample_size > 0 THEN 3 WHEN amount IS NOT NULL OR sample_size IS NOT NULL THEN 2 END END) AS s{n}" for n in _GRADES) + """, CAST(sum(CASE WHEN grade IN ('10', '9', '8') THEN sample_size END) AS BIGINT) AS sales FROM price_snapshot GROUP BY 1),
  score AS (SELECT c.card_uid, c.game || ':' || c.language AS combo, CASE WHEN c.image_url IS NOT NULL AND c.artist IS NOT NULL AND c.rarity IS NOT NULL AND c.release_date IS NOT NULL THEN 'FULL' ELSE 'PARTIAL' END AS catalog,
    CASE WHEN NOT coalesce(q.usable, false) THEN 'UNTESTED' WHEN q.prices = 0 THEN 'NONE' WHEN q.sources >= 2 THEN 'FULL' ELSE 'PARTIAL' END AS price, """ + ", ".join(f"CASE WHEN g.card_uid IS NULL THEN 'UNTESTED' WHEN g.s{n} = 3 THEN 'FULL' WHEN g.s{n} = 2 THEN 'PARTIAL' ELSE 'NONE' END AS grade_{n}" for n in _GRADES) + """, g.sales FROM cards c LEFT JOIN q USING (card_uid) LEFT JOIN g USING (card_uid))"""


def scores(spark: SparkSession, root: str) -> DataFrame:
    """What each card's sources prove: an answer that failed proves nothing, only one that is empty proves absence."""
    body = F.col("body")
    fine = body.isNotNull() & F.try_parse_json(body).isNotNull() & F.get_json_object(body, "$.error").isNull()
    fine = F.coalesce(fine, F.lit(False))
    priced = fine & F.get_json_object(body, "$.data.marketPrice").isNotNull()
    q = table(spark, root, "price_quote").groupBy("card_uid").agg(F.bool_or(fine).alias("usable"), F.count_if(priced).alias("prices"), F.count_distinct(F.when(priced, F.col("source"))).alias("sources"))
    both, some = F.col("amount").isNotNull() & (F.col("sample_size") > 0), F.col("amount").isNotNull() | F.col("sample_size").isNotNull()
    rank = F.when(both, 3).when(some, 2)
    g = table(spark, root, "price_snapshot").groupBy("card_uid").agg(*[F.max(F.when(F.col("grade") == n, rank)).alias(f"s{n}") for n in _GRADES], F.sum(F.when(F.col("grade").isin(*_GRADES), F.col("sample_size"))).alias("sales"), F.lit(True).alias("seen"))
    c = table(spark, root, "cards").join(q, "card_uid", "left").join(g, "card_uid", "left")
    told = lambda cols: [F.col(x).isNotNull() for x in cols]
    full = told(["image_url", "artist", "rarity", "release_date"])
    whole = full[0] & full[1] & full[2] & full[3]
    price = F.when(~F.coalesce("usable", F.lit(False)), "UNTESTED").when(F.col("prices") == 0, "NONE").when(F.col("sources") >= 2, "FULL").otherwise("PARTIAL")
    grade = lambda n: F.when(F.col("seen").isNull(), "UNTESTED").when(F.col(f"s{n}") == 3, "FULL").when(F.col(f"s{n}") == 2, "PARTIAL").otherwise("NONE")
    return c.select("card_uid", F.concat_ws(":", "game", "language").alias("combo"), F.when(whole, "FULL").otherwise("PARTIAL").alias("catalog"), price.alias("price"), *[grade(n).alias(f"grade_{n}") for n in _GRADES], "sales")


@query(f"WITH {_SCORES} SELECT card_uid, combo, catalog, price, grade_10, grade_9, grade_8, sales FROM score")
def evidence_scores(spark, root):
    """Evidence per card from catalogue, quotes and graded sales."""
    return scores(spark, root)


@query(f"WITH {_SCORES} SELECT combo, count(*) AS cards, " + ", ".join(f"{_rolled(c)} AS {c}" for c in ("catalog", "price", "grade_10", "grade_9", "grade_8")) + f""", round(median(sales), 6) AS median_sales,
  CASE WHEN count(sales) = 0 THEN CASE WHEN bool_and(grade_10 = 'UNTESTED') THEN 'UNTESTED' ELSE 'NONE' END WHEN median(sales) >= {MIN_SAMPLE} THEN 'FULL' WHEN median(sales) > 0 THEN 'PARTIAL' ELSE 'NONE' END AS sample FROM score GROUP BY 1""")
def evidence_by_combo(spark, root):
    """Evidence rolled up per game and language, with the median of graded sales and whether it suffices."""
    s = scores(spark, root)
    roll = s.groupBy("combo").agg(F.count(F.lit(1)).alias("cards"), *[rolled_up(F.col(c)).alias(c) for c in ("catalog", "price", "grade_10", "grade_9", "grade_8")], F.bool_and(F.col("grade_10") == "UNTESTED").alias("_u"))
    got = roll.join(stats.medians(s, ["combo"], "sales"), "combo", "left")
    m = F.col("median")
    sample = F.when(m.isNull(), F.when(F.col("_u"), "UNTESTED").otherwise("NONE")).when(m >= MIN_SAMPLE, "FULL").when(m > 0, "PARTIAL").otherwise("NONE")
    return got.withColumn("sample", sample).withColumn("median_sales", F.round("median", 6)).drop("_u", "median")


@query("""WITH p AS (SELECT card_uid, max(CAST(amount AS DOUBLE)) AS price FROM price_snapshot WHERE grade = 'raw' GROUP BY 1),
  r AS (SELECT c.game, c.artist, c.language, arg_min({'uid': c.card_uid, 'price': p.price, 'name': c.name_en}, c.card_uid) AS s FROM cards c LEFT JOIN p USING (card_uid) WHERE c.artist IS NOT NULL GROUP BY 1, 2, 3),
  v AS (SELECT a.game, a.language, CASE WHEN a.s.name IS NULL AND b.s.name IS NULL THEN 'UNTESTED' WHEN a.s.name IS NULL OR b.s.name IS NULL THEN 'PARTIAL' WHEN a.s.name = b.s.name THEN 'NONE' WHEN a.s.price <> b.s.price THEN 'FULL' ELSE 'PARTIAL' END AS verdict
    FROM r a JOIN r b ON a.game = b.game AND a.artist = b.artist AND a.language <> b.language)
  SELECT game, language, count(*) AS pairs, CASE WHEN bool_or(verdict = 'NONE') THEN 'NONE' ELSE """ + _rolled("verdict") + """ END AS separation FROM v GROUP BY 1, 2""")
def evidence_language_separation(spark, root):
    """Whether printings in different languages stay apart: an artist's representative per language against the other languages'; one collision decides."""
    p = table(spark, root, "price_snapshot").where("grade = 'raw'").groupBy("card_uid").agg(F.max(F.col("amount").cast("double")).alias("price"))
    c = table(spark, root, "cards").where("artist IS NOT NULL").join(p, "card_uid", "left")
    rep = c.groupBy("game", "artist", "language").agg(F.min_by(F.struct("card_uid", "price", F.col("name_en").alias("name")), "card_uid").alias("s"))  # one row per language
    a, b = rep.select("game", "artist", "language", "s"), rep.select(F.col("game").alias("bg"), F.col("artist").alias("ba"), F.col("language").alias("bl"), F.col("s").alias("t"))
    pairs = a.join(b, (F.col("game") == F.col("bg")) & (F.col("artist") == F.col("ba")) & (F.col("language") != F.col("bl")))
    x, y = F.col("s.name"), F.col("t.name")
    verdict = F.when(x.isNull() & y.isNull(), "UNTESTED").when(x.isNull() | y.isNull(), "PARTIAL").when(x == y, "NONE").when(F.col("s.price") != F.col("t.price"), "FULL").otherwise("PARTIAL")
    v = pairs.select("game", "language", verdict.alias("v")).groupBy("game", "language")
    return v.agg(F.count(F.lit(1)).alias("pairs"), F.when(F.bool_or(F.col("v") == "NONE"), "NONE").otherwise(rolled_up(F.col("v"))).alias("separation"))


#: Entries as a provider lists its games, and what a game and a language are called there.
ENTRIES = ((1, "pocket monsters"), (2, "pocket monsters japan"), (3, "pocket monsters simplified chinese"), (4, "one pirate"), (5, "one pirate japanese"), (6, "rift arena"), (7, "rift arena japan"))
GAME_WORDS = (("pkmn", "pocket monsters"), ("optcg", "one pirate"), ("riftbound", "rift arena"))
LANGUAGE_WORDS = (("JP", "japan"), ("CN-S", "simplified"), ("CN-T", "traditional"))


@query("""WITH e(id, name) AS (VALUES (1, 'pocket monsters'), (2, 'pocket monsters japan'), (3, 'pocket monsters simplified chinese'), (4, 'one pirate'), (5, 'one pirate japanese'), (6, 'rift arena'), (7, 'rift arena japan')), c AS (SELECT DISTINCT game, language FROM cards)
  SELECT c.game, c.language, (SELECT min(e.id) FROM e WHERE contains(e.name, CASE c.game WHEN 'pkmn' THEN 'pocket monsters' WHEN 'optcg' THEN 'one pirate' ELSE 'rift arena' END)
    AND CASE c.language WHEN 'EN' THEN NOT regexp_matches(e.name, 'japan|simplified|traditional') WHEN 'JP' THEN contains(e.name, 'japan') WHEN 'CN-S' THEN contains(e.name, 'simplified') ELSE contains(e.name, 'traditional') END) AS entry FROM c""")
def evidence_game_mapping(spark, root):
    """The provider's entry for every game and language by words of its name; English is the one without a language."""
    words = lambda c, pairs: F.coalesce(*[F.when(c == k, F.lit(w)) for k, w in pairs])
    entries = spark.createDataFrame(list(ENTRIES), "entry int, name string")
    tagged = entries.withColumn("tag", F.coalesce(*[F.when(F.col("name").contains(w), F.lit(k)) for k, w in LANGUAGE_WORDS], F.lit("EN"))).withColumn("listed", F.coalesce(*[F.when(F.col("name").contains(w), F.lit(k)) for k, w in GAME_WORDS]))
    best = tagged.groupBy("listed", "tag").agg(F.min("entry").alias("entry"))
    c = table(spark, root, "cards").select("game", "language").distinct()
    return c.join(best, (F.col("game") == F.col("listed")) & (F.col("language") == F.col("tag")), "left").select("game", "language", "entry")


# --- decisions, runs, look-ahead ------------------------------------------------------------------


@query(f"""WITH l AS (SELECT row_id, record, resolved_by, confidence, observed_at FROM {_LINKS}), q AS (SELECT * FROM l WHERE observed_at <= TIMESTAMP '2024-01-20' AND resolved_by = 'fuzzy' AND confidence < 0.9),
  after AS (SELECT record, resolved_by FROM l WHERE observed_at <= TIMESTAMP '2024-01-20' AND row_id NOT IN (SELECT row_id FROM q WHERE row_id % 2 = 0) UNION ALL SELECT record, 'manual' FROM q WHERE row_id % 2 = 0)
  SELECT resolved_by, count(*) AS links FROM after GROUP BY 1""")
def review_decisions(spark, root):
    """Links after every second one in need of review was confirmed by hand, which appends and supersedes."""
    links, at = _links(spark, root), ts("2024-01-20 00:00:00")
    weak = pit.as_of_view(links, at).where("resolved_by = 'fuzzy' AND confidence < 0.9 AND row_id % 2 = 0")
    after = links.unionByName(pit.decisions(weak, ts("2024-01-21 00:00:00"), offset=1_000_000_000))
    return pit.as_of_view(after.where((F.col("observed_at") <= at) | (F.col("resolved_by") == "manual") & (F.col("row_id") >= 1_000_000_000)), ts("2024-01-21 00:00:00")).groupBy("resolved_by").agg(F.count(F.lit(1)).alias("links"))


@query("""WITH r AS (SELECT source || ':' || strftime(CAST(observed_at AS DATE), '%Y-%m-%d') AS run, source, min(observed_at) AS started, max(observed_at) AS finished, count(*) AS n FROM price_quote WHERE source IS NOT NULL AND observed_at IS NOT NULL GROUP BY 1, 2)
  SELECT source, count(*) AS runs, count(*) FILTER (WHERE n < 3) AS unfinished, max(CASE WHEN n >= 3 THEN finished END) AS last_done FROM r GROUP BY 1""")
def run_bookkeeping(spark, root):
    """Runs kept as two rows each, one at the start and one when done; runs of under three answers never got their second row."""
    q = table(spark, root, "price_quote").where("source IS NOT NULL AND observed_at IS NOT NULL")
    r = q.groupBy("source", F.date_format("observed_at", "yyyy-MM-dd").alias("day")).agg(F.min("observed_at").alias("started"), F.max("observed_at").alias("finished"), F.count(F.lit(1)).alias("n"))
    run = F.concat_ws(":", "source", "day")
    log = r.select("source", run.alias("run"), F.lit("running").alias("status"), F.col("started").alias("at")).unionByName(r.where("n >= 3").select("source", F.concat(run, F.lit(":done")).alias("run"), F.lit("ok").alias("status"), F.col("finished").alias("at")))
    state = pit.run_states(log, "run", "status", "at", keep=["source"])
    done = F.col("status") == "ok"
    return state.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.count_if(~done).alias("unfinished"), F.max(F.when(done, F.col("at"))).alias("last_done"))


CUTOFFS = ("2024-10-01 00:00:00", "2025-03-15 12:00:00", "2025-07-01 00:00:00", "2026-02-01 06:30:00")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{c}', CAST(0 AS BIGINT))" for v in ("as_of_view", "current", "first_seen", "day_coverage") for c in CUTOFFS) + ") t(\"view\", \"at\", differing)")
def look_ahead_equivalence(spark, root):
    """That no view at a date changes when the rows observed after it are taken away: the rows that differ, per view and date."""
    full = table(spark, root, "price_snapshot").select(*KEY, "row_id", "amount", "as_of", "observed_at", "supersedes")
    out = None
    for c in CUTOFFS:
        at = ts(c)
        views = {
            "as_of_view": lambda log: pit.as_of_view(log, at), "current": lambda log: pit.current(pit.as_of_view(log, at), KEY),
            "first_seen": lambda log: pit.first_seen(log.where(F.col("observed_at") <= at), "card_uid", ["source", "observed_at"]), "day_coverage": lambda log: pit.day_coverage(pit.as_of_view(log, at), "card_uid"),
        }
        for name, view in views.items():
            n = pit.differing(view(full), view(full.where(F.col("observed_at") <= at))).select(F.lit(name).alias("view"), F.lit(c).alias("at"), "differing")
            out = n if out is None else out.unionByName(n)
    return out


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN ts WHEN 'purchase' THEN ts - INTERVAL 9 HOUR WHEN 'click' THEN ts + INTERVAL 330 MINUTE ELSE ts END AS utc FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events)""")
def timestamps_to_utc(spark, root):
    """Texts of times with Z, with offsets or without any as times in UTC."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_type") == "view", "Z").when(F.col("event_type") == "purchase", "+09:00").when(F.col("event_type") == "click", "-05:30").otherwise("")
    return table(spark, root, "events").select("event_id", X.utc_time(F.concat(text, zone)).alias("utc"))


@query("""WITH d AS (SELECT DISTINCT card_uid, CAST(as_of AS DATE) AS day FROM sentiment WHERE card_uid IS NOT NULL AND as_of IS NOT NULL), n AS (SELECT card_uid, day, lead(day) OVER (PARTITION BY card_uid ORDER BY day) AS nxt FROM d)
  SELECT card_uid, strftime(day + 1, '%Y-%m-%d') AS from_day, strftime(nxt - 1, '%Y-%m-%d') AS to_day, CAST(nxt - day - 1 AS BIGINT) AS days FROM n WHERE nxt - day > 1""")
def pit_missing_days(spark, root):
    """The days without mentions of every card, as ranges between its first and last day."""
    return pit.missing_days(table(spark, root, "sentiment"), "card_uid").select("card_uid", F.date_format("from_day", "yyyy-MM-dd").alias("from_day"), F.date_format("to_day", "yyyy-MM-dd").alias("to_day"), F.col("days").cast("bigint").alias("days"))


@query(f"""SELECT p.row_id, c.rarity, coalesce(CAST(year(c.release_date) AS VARCHAR), 'unknown') AS era, CAST(p.amount AS DOUBLE) AS amount FROM {_view('price_snapshot', CUTOFF)} p JOIN cards c USING (card_uid)""")
def price_with_card(spark, root):
    """Prices known at a date with their card's rarity and era."""
    v = pit.as_of_view(table(spark, root, "price_snapshot").select("row_id", "card_uid", "amount", "observed_at", "supersedes"), ts(CUTOFF))
    c = table(spark, root, "cards").select("card_uid", "rarity", F.coalesce(F.year("release_date").cast("string"), F.lit("unknown")).alias("era"))
    return v.join(c, "card_uid").select("row_id", "rarity", "era", F.col("amount").cast("double").alias("amount"))


# Patterns of rarity bands, first match wins, as both engines read them.
BANDS = (
    ("chase", r"secret|hyper|special illustration|\bsar\b|\bsir\b|manga|signature|treasure|\btr\b|serial|\bsec\b|\bur\b|\bhr\b"),
    ("premium", r"illustration|ultra|\balt\b|alternate|parallel|full art|art rare|\bar\b|\bsr\b"), ("rare", r"holo|rare|leader"),
)
_BAND = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(rarity, '')), '{p}') THEN '{b}'" for b, p in BANDS) + " ELSE 'base' END"
_BUCKET = f"""m AS (SELECT card_uid, currency, date_trunc('month', as_of) AS month, grader, median(CAST(amount AS DOUBLE)) AS v FROM {_view('price_snapshot', LATER)} WHERE grade = '10' AND grader IS NOT NULL GROUP BY ALL),
  p AS (SELECT o.grader, o.card_uid, o.v / b.v AS ratio FROM m o JOIN m b ON o.card_uid = b.card_uid AND o.currency = b.currency AND o.month = b.month AND b.grader = 'PSA' AND b.v > 0 WHERE o.grader <> 'PSA'),
  g AS (SELECT c.game, {_BAND} AS band, coalesce(CAST(year(c.release_date) AS VARCHAR), 'unknown') AS era, grader, count(*) AS pairs, count(DISTINCT p.card_uid) AS members, median(ratio) AS med FROM p JOIN cards c USING (card_uid) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_BUCKET} SELECT game, band, era, grader, pairs, members, CASE WHEN pairs >= 20 AND members >= 8 THEN round(med, 4) END AS ratio, CASE WHEN NOT (pairs >= 20 AND members >= 8) THEN 'sample_below_minimum' END AS refused FROM g")
def ratio_by_bucket(spark, root):
    """Median price ratios of graders to the base grader per game, rarity band and era of the card."""
    v = pit.as_of_view(table(spark, root, "price_snapshot"), ts(LATER)).where("grade = '10' AND grader IS NOT NULL")
    r, band = F.lower(F.coalesce("rarity", F.lit(""))), F.lit("base")
    for name, pattern in reversed(BANDS):
        band = F.when(r.rlike(pattern), name).otherwise(band)
    c = table(spark, root, "cards").select("card_uid", "game", band.alias("band"), F.coalesce(F.year("release_date").cast("string"), F.lit("unknown")).alias("era"))
    rows = v.select("card_uid", "currency", F.date_trunc("month", F.col("as_of").cast("timestamp")).alias("month"), "grader", F.col("amount").cast("double").alias("amount")).join(c, "card_uid")
    got = stats.paired_ratios(rows, unit=("card_uid", "currency", "month"), role="grader", base="PSA", value="amount", bucket=("game", "band", "era"), member="card_uid", least_pairs=20, least_members=8)
    return got.select("game", "band", "era", "grader", "pairs", "members", "ratio", "refused")


# --- ranks and changes ----------------------------------------------------------------------------


@query("""WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem), r AS (SELECT p_brand AS brand, round(avg(l_extendedprice - (i + s * l_quantity)), 2) AS residual FROM lineitem JOIN part ON l_partkey = p_partkey, b GROUP BY 1)
  SELECT brand, residual, row_number() OVER (ORDER BY residual, brand) AS place FROM r""")
def residual_ranking(spark, root):
    """Brands by their mean residual, cheapest against the regression first; the rank runs over one row per brand."""
    li = table(spark, root, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    r = stats.residuals(li, "l_extendedprice", ["l_quantity"]).join(table(spark, root, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    b = r.groupBy(F.col("p_brand").alias("brand")).agg(F.round(F.avg("residual"), 2).alias("residual"))
    return b.withColumn("place", F.row_number().over(Window.orderBy("residual", "brand")).cast("bigint"))


@query("""SELECT alert_id, CAST(excess_30d AS DOUBLE) AS excess_30d, place FROM (SELECT alert_id, excess_30d, row_number() OVER (ORDER BY excess_30d, md5(alert_id)) AS place, count(*) OVER () AS n FROM alert_ledger WHERE excess_30d IS NOT NULL) WHERE place <= floor(n / 4) + 1""")
def bottom_quarter(spark, root):
    """The weaker quarter of the alerts by their 30 days, ties by a digest; no task ranks them all."""
    a = table(spark, root, "alert_ledger").where("excess_30d IS NOT NULL").select("alert_id", F.col("excess_30d").cast("double").alias("excess_30d"))
    n = a.agg(F.floor(F.count(F.lit(1)) / 4).alias("_q"))  # one row
    return stats.ranked(a, "excess_30d", "alert_id").join(F.broadcast(n)).where(F.col("place") <= F.col("_q") + 1).select("alert_id", "excess_30d", "place")


_DAYV = "d AS (SELECT card_uid, grade, grader, marketplace, source, currency, CAST(as_of AS DATE) AS day, max(CAST(amount AS DOUBLE)) AS v FROM price_snapshot WHERE amount > 0 GROUP BY ALL)"


@query(f"""WITH {_DAYV}, w AS (SELECT *, lag(v) OVER k AS pv, lag(day) OVER k AS pd FROM d WINDOW k AS (PARTITION BY card_uid, grade, grader, marketplace, source, currency ORDER BY day))
  SELECT card_uid, grade, grader, marketplace, source, currency, strftime(day, '%Y-%m-%d') AS day, round((v - pv) / pv * 100, 4) AS change_pct FROM w WHERE pd = day - 1""")
def change_in_a_day(spark, root):
    """How much the price of a series changed against the day before, in percent."""
    p = table(spark, root, "price_snapshot").where("amount > 0").groupBy(*KEY, "currency", F.to_date("as_of").alias("day")).agg(F.max(F.col("amount").cast("double")).alias("v"))
    w = Window.partitionBy(*KEY, "currency").orderBy("day")
    got = p.withColumn("pv", F.lag("v").over(w)).withColumn("pd", F.lag("day").over(w)).where(F.col("pd") == F.date_sub("day", 1))
    return got.select(*KEY, "currency", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round((F.col("v") - F.col("pv")) / F.col("pv") * 100, 4).alias("change_pct"))


@query("""WITH d AS (SELECT card_uid, grade, grader, marketplace, source, CAST(as_of AS DATE) AS day, max(sample_size) AS n FROM price_snapshot WHERE sample_size IS NOT NULL AND grade <> 'raw' GROUP BY ALL),
  w AS (SELECT *, lag(n) OVER (PARTITION BY card_uid, grade, grader, marketplace, source ORDER BY day) AS before FROM d) SELECT source, count(*) AS days, count(*) FILTER (WHERE n < before) AS falls FROM w GROUP BY 1""")
def quality_falling_counts(spark, root):
    """Counts that may only grow but fall from one day to the next, per source."""
    d = table(spark, root, "price_snapshot").where("sample_size IS NOT NULL AND grade != 'raw'").groupBy(*KEY, F.to_date("as_of").alias("day")).agg(F.max("sample_size").alias("n"))
    falls = F.col("n") < F.lag("n").over(Window.partitionBy(*KEY).orderBy("day"))
    return d.withColumn("fell", falls).groupBy("source").agg(F.count(F.lit(1)).alias("days"), F.count_if("fell").alias("falls"))


@query("""WITH f AS (SELECT 'price' AS field, 86400 AS most, source, max(observed_at) AS seen FROM price_snapshot WHERE observed_at <= TIMESTAMP '2026-07-01' GROUP BY source UNION ALL SELECT 'population', 604800, source, max(observed_at) FROM price_snapshot WHERE sample_size IS NOT NULL AND observed_at <= TIMESTAMP '2026-07-01' GROUP BY source)
  SELECT field, source, CAST(date_diff('second', seen, TIMESTAMP '2026-07-01') AS BIGINT) AS age_seconds, date_diff('second', seen, TIMESTAMP '2026-07-01') > most AS stale FROM f""")
def staleness_by_field(spark, root):
    """Age of every source's newest value per field, against the field's own limit."""
    p = table(spark, root, "price_snapshot").where(F.col("observed_at") <= ts("2026-07-01 00:00:00"))
    one = lambda name, most, rows: rows.groupBy("source").agg(F.max("observed_at").alias("seen")).select(F.lit(name).alias("field"), F.lit(most).alias("most"), "source", "seen")
    both = one("price", 86400, p).unionByName(one("population", 604800, p.where("sample_size IS NOT NULL")))
    age = F.timestamp_diff("SECOND", "seen", ts("2026-07-01 00:00:00"))
    return both.select("field", "source", age.alias("age_seconds"), (age > F.col("most")).alias("stale"))


_CITED = "(SELECT alert_id, rule, unnest(string_split(estimate_basis || ',' || coalesce(grader, 'none'), ',')) AS cited FROM alert_ledger WHERE estimate_basis IS NOT NULL)"


@query(f"""WITH c AS {_CITED}, listed(cited) AS (SELECT DISTINCT grader FROM price_snapshot WHERE grader IS NOT NULL)
  SELECT cited, rule, count(*) AS uses, count(DISTINCT alert_id) AS alerts, bool_and(cited NOT IN (SELECT cited FROM listed)) AS orphan FROM c GROUP BY 1, 2""")
def citation_index(spark, root):
    """For everything alerts cite the rules that cite it and how often, and whether no source is listed under that name."""
    a = table(spark, root, "alert_ledger").where("estimate_basis IS NOT NULL")
    c = a.select("alert_id", "rule", F.explode(F.split(F.concat_ws(",", "estimate_basis", F.coalesce("grader", F.lit("none"))), ",")).alias("cited"))
    g = c.groupBy("cited", "rule").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("alert_id").alias("alerts"))
    listed = table(spark, root, "price_snapshot").where("grader IS NOT NULL").select(F.col("grader").alias("_l")).distinct()
    return g.join(listed, F.col("cited") == F.col("_l"), "left").select("cited", "rule", "uses", "alerts", F.col("_l").isNull().alias("orphan"))


@query("""WITH h AS (SELECT row_id, observed_at, mentions, row_id % 1000 = 7 AS changed FROM sentiment) SELECT strftime(CAST(min(CASE WHEN changed THEN observed_at END) AS DATE), '%Y-%m-%d') AS first_broken FROM h""")
def seal_verify(spark, root):
    """The first day whose stored seal no longer follows from the log, after a few mentions in it were changed."""
    cols = ("row_id", "card_uid", "mentions", "source")
    log = table(spark, root, "sentiment")
    stored = stats.seal(stats.day_digests(log, F.to_date("observed_at"), cols))
    changed = log.withColumn("mentions", F.when(F.col("row_id") % 1000 == 7, F.coalesce("mentions", F.lit(0)) + 1).otherwise(F.col("mentions")))
    return stats.first_broken_day(stored, changed, F.to_date("observed_at"), cols).select(F.date_format("first_broken", "yyyy-MM-dd").alias("first_broken"))
