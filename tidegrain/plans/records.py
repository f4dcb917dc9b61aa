"""Queries on sources and sinks: payloads, records, landing, caches, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrain.functions import identity as I  # noqa: E741
from tidegrain.functions import text as X
from tidegrain.operators import pit
from tidegrain.plans.reference import CUTOFF, LATER, query, ts
from tidegrain.session import new_folder
from tidegrain.sources import payloads as P
from tidegrain.sources import store
from tidegrain.sources.tables import table


def _quotes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "price_quote")


@query("""WITH b AS (SELECT quote_id, source, card_uid, CASE WHEN json_valid(body) THEN body->>'$.data.marketPrice' END AS p FROM price_quote WHERE body IS NOT NULL AND json_valid(body) AND json_type(body, '$.data') = 'OBJECT')
  SELECT quote_id, 'xref' AS kind, source, card_uid, CAST(NULL AS DOUBLE) AS amount FROM b UNION ALL SELECT quote_id, 'price', source, card_uid, CAST(p AS DOUBLE) FROM b WHERE regexp_matches(p, '^-?[0-9]+(\\.[0-9]+)?$')""")
def record_emission(spark, root):
    """One link per answer with data, and a price where it states a plain number."""
    q = _quotes(spark, root).select("quote_id", "source", "card_uid", F.get_json_object("body", "$.data").alias("d"), F.get_json_object("body", "$.data.marketPrice").alias("p")).where("d LIKE '{%'")
    link = q.select("quote_id", F.lit("xref").alias("kind"), "source", "card_uid", F.lit(None).cast("double").alias("amount"))
    return link.unionByName(q.where(F.col("p").rlike(r"^-?[0-9]+(\.[0-9]+)?$")).select("quote_id", F.lit("price").alias("kind"), "source", "card_uid", F.col("p").cast("double").alias("amount")))


_ROUTED = "SELECT source, CASE WHEN body IS NULL THEN 'gap' WHEN json_valid(body) AND json_type(body, '$.data') = 'OBJECT' THEN 'price' WHEN json_valid(body) AND json_exists(body, '$.error') THEN 'error' END AS kind FROM price_quote"


@query(f"SELECT source, CASE WHEN kind IN ('price', 'gap') THEN kind ELSE 'unrouted' END AS sink, count(*) AS n FROM ({_ROUTED}) GROUP BY 1, 2")
def route_records(spark, root):
    """Answers routed to their sinks by kind; what no sink takes is counted, not lost."""
    body = F.col("body")
    kind = F.when(body.isNull(), "gap").when(F.get_json_object("body", "$.data").startswith("{"), "price").when(F.get_json_object("body", "$.error").isNotNull(), "error")
    parts = P.route(_quotes(spark, root).select("source", kind.alias("kind")), "kind", ("price", "gap"))
    out = None
    for sink, rows in parts.items():
        got = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.lit(sink).alias("sink"), "n")
        out = got if out is None else out.unionByName(got)
    return out


_SALES = """(SELECT card_uid, grader, grade, max(amount) AS price, count(*) AS n FROM price_snapshot WHERE grade <> 'raw' AND grader IS NOT NULL AND amount IS NOT NULL AND card_uid IS NOT NULL GROUP BY 1, 2, 3)"""


def _answers(spark: SparkSession, root: str) -> DataFrame:
    """Answers per card with sales by grade and populations, keys spelled in three ways; a card has few grades."""
    p = table(spark, root, "price_snapshot").where("grade != 'raw' AND grader IS NOT NULL AND amount IS NOT NULL AND card_uid IS NOT NULL").groupBy("card_uid", "grader", "grade").agg(F.max("amount").alias("price"), F.count(F.lit(1)).alias("n"))
    spelled = F.when(F.length("grade") == 1, F.concat(F.lower("grader"), F.lit("_"), "grade")).when(F.col("grade").contains("."), F.concat_ws(" ", "grader", "grade")).otherwise(F.concat("grader", "grade"))
    one = F.concat(F.lit('"'), spelled, F.lit('":{"median":'), F.col("price").cast("string"), F.lit(',"count":'), F.col("n").cast("string"), F.lit("}"))
    pop = p.groupBy("card_uid", "grader").agg(F.concat_ws(",", F.collect_list(F.concat(F.lit('"'), "grade", F.lit('":'), F.col("n").cast("string")))).alias("g"), F.concat_ws(",", F.collect_list(one)).alias("s"))
    joined = pop.groupBy("card_uid").agg(F.concat_ws(",", F.collect_list("s")).alias("s"), F.concat_ws(",", F.collect_list(F.concat(F.lit('"'), F.lower("grader"), F.lit('":{'), "g", F.lit(',"raw":7,"9":null}')))).alias("p"))
    return joined.select("card_uid", F.concat(F.lit('{"salesByGrade":{"weird":{"median":1},'), "s", F.lit('},"populationByGrader":{'), "p", F.lit("}}")).alias("body"))


@query(f"SELECT card_uid, grader, grade, CAST(price AS DOUBLE) AS price, n AS sample FROM {_SALES}")
def sales_by_grade(spark, root):
    """Sales per grader and grade read back out of answers made from the price log; odd keys are skipped."""
    got = P.graded_sales(_answers(spark, root), "body", ["card_uid"])
    return got.select("card_uid", "grader", "grade", F.col("price").cast("double").alias("price"), F.col("sample").cast("bigint").alias("sample"))


@query(f"SELECT card_uid, grader, grade, n AS count FROM {_SALES} WHERE grade <> '9'")
def population_by_grade(spark, root):
    """Populations per grader and grade from the same answers; of a grade stated twice the answer's last, empty one counts."""
    got = P.populations(_answers(spark, root), "body", ["card_uid"])
    return got.where("grade != '9'").select("card_uid", "grader", "grade", "count")


@query("SELECT card_uid, artist, rarity FROM (SELECT card_uid, nullif(artist, '') AS artist, nullif(rarity, '') AS rarity FROM cards)")
def attributes_any_case(spark, root):
    """Artist and rarity from attribute maps whose keys differ in case and name by game."""
    key = F.when(F.col("game") == "pkmn", "ILLUSTRATOR").when(F.col("game") == "optcg", "artist").otherwise("Artist")
    m = F.create_map(key, F.col("artist"), F.when(F.col("game") == "pkmn", "Rarity").otherwise("RARITY"), F.col("rarity"), F.lit("other"), F.lit("x"))
    c = table(spark, root, "cards").select("card_uid", m.alias("m"))
    return c.select("card_uid", P.attribute(F.col("m"), "Artist", "Illustrator").alias("artist"), P.attribute(F.col("m"), "Rarity").alias("rarity"))


FIELDS = {"loose_price": ("raw", None), "graded_price": ("9", "PSA"), "manual_only_price": ("10", "PSA")}


@query("""WITH w AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS loose_price, CASE WHEN p_size % 5 = 0 THEN 0 ELSE CAST(round(p_retailprice * 250) AS BIGINT) END AS graded_price, CASE WHEN p_size % 3 <> 0 THEN CAST(round(p_retailprice * 400) AS BIGINT) END AS manual_only_price FROM part)
  SELECT p_partkey, CASE f WHEN 'loose_price' THEN 'raw' WHEN 'graded_price' THEN '9' ELSE '10' END AS grade, CASE f WHEN 'loose_price' THEN NULL ELSE 'PSA' END AS grader, round(m / 100.0, 2) AS amount FROM (UNPIVOT w ON loose_price, graded_price, manual_only_price INTO NAME f VALUE m) WHERE m <> 0""")
def minor_units_to_long(spark, root):
    """Wide records in minor units as one row per grade in whole units; null and 0 are no price."""
    cents = lambda by: F.round(F.col("p_retailprice") * by).cast("bigint")
    wide = table(spark, root, "part").select("p_partkey", cents(100).alias("loose_price"), F.when(F.col("p_size") % 5 == 0, 0).otherwise(cents(250)).alias("graded_price"), F.when(F.col("p_size") % 3 != 0, cents(400)).alias("manual_only_price"))
    got = P.minor_to_long(wide, ["p_partkey"], FIELDS)
    return got.withColumn("amount", F.col("amount").cast("double"))


@query(f"""WITH l AS (SELECT pair, arg_max(rate, (as_of, observed_at, row_id)) AS rate, max(as_of) AS as_of FROM fx_rate WHERE rate IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT pair, CAST(as_of AS DATE) AS day FROM fx_rate WHERE observed_at < TIMESTAMP '{LATER}')
  SELECT pair, CAST(rate AS DOUBLE) AS rate, as_of FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.pair = l.pair AND k.day = CAST(l.as_of AS DATE))""")
def fx_new_points(spark, root):
    """The latest rate of every pair, unless its day was known before."""
    fx = table(spark, root, "fx_rate")
    latest = fx.where("rate IS NOT NULL").groupBy("pair").agg(F.max_by("rate", F.struct("as_of", "observed_at", "row_id")).cast("double").alias("rate"), F.max("as_of").alias("as_of"))
    known = fx.where(F.col("observed_at") < ts(LATER)).select("pair", F.to_date("as_of").alias("day")).distinct()
    return latest.withColumn("day", F.to_date("as_of")).join(known, ["pair", "day"], "left_anti").select("pair", "rate", "as_of")


@query("""WITH s AS (SELECT game, language, source, count(*) AS whole, count(rarity) AS part FROM cards GROUP BY 1, 2, 3), o AS (SELECT *, part > 0 AND part < whole AS honoured, source <> 'lantern_index' AS verified FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY game, language ORDER BY verified DESC, honoured DESC, whole DESC, source) AS place FROM o)
  SELECT game, language, source, CASE WHEN honoured THEN 'filter' ELSE 'every_card' END AS strategy, verified, whole AS cards FROM r WHERE place = 1""")
def catalog_strategies(spark, root):
    """Per game and language the source that enumerates it: verified ones first, then those whose rarity filter is honoured."""
    s = table(spark, root, "cards").groupBy("game", "language", "source").agg(F.count(F.lit(1)).alias("cards"), F.count("rarity").alias("part"))
    s = s.withColumn("honoured", (F.col("part") > 0) & (F.col("part") < F.col("cards"))).withColumn("verified", F.col("source") != "lantern_index")
    w = Window.partitionBy("game", "language").orderBy(F.desc("verified"), F.desc("honoured"), F.desc("cards"), "source")
    return s.withColumn("place", F.row_number().over(w)).where("place = 1").select("game", "language", "source", F.when(F.col("honoured"), "filter").otherwise("every_card").alias("strategy"), "verified", "cards")


@query("""WITH h AS (SELECT game, lower(set_code) AS s, number, arg_min(name, (observed_at, target_id)) AS name FROM targets WHERE name IS NOT NULL AND set_code IS NOT NULL AND number IS NOT NULL GROUP BY 1, 2, 3)
  SELECT card_uid, coalesce(c.name_en, h.name) AS name, CASE WHEN c.name_en IS NOT NULL THEN 'own' WHEN h.name IS NOT NULL THEN 'first_hit' ELSE 'none' END AS told_by FROM cards c LEFT JOIN h ON c.name_en IS NULL AND c.game = h.game AND lower(c.set_code) = h.s AND c.number = h.number""")
def enrich_first_hit(spark, root):
    """Names missing in the catalogue from the first listing of the same set and number."""
    h = table(spark, root, "targets").where("name IS NOT NULL AND set_code IS NOT NULL AND number IS NOT NULL").groupBy(F.col("game").alias("hg"), F.lower("set_code").alias("hs"), F.col("number").alias("hn")).agg(F.min_by("name", F.struct("observed_at", "target_id")).alias("hit"))
    c = table(spark, root, "cards")
    got = c.join(h, F.col("name_en").isNull() & (F.col("game") == F.col("hg")) & (F.lower("set_code") == F.col("hs")) & (F.col("number") == F.col("hn")), "left")
    return got.select("card_uid", F.coalesce("name_en", "hit").alias("name"), F.when(F.col("name_en").isNotNull(), "own").when(F.col("hit").isNotNull(), "first_hit").otherwise("none").alias("told_by"))


FIXTURES = (("^gradebook/pkmn", ("first", "second", "later")), ("/optcg:", ("only",)), (".*", ("default",)))


@query("""WITH r AS (SELECT quote_id, source || '/' || card_uid AS url, row_number() OVER (PARTITION BY source || '/' || card_uid ORDER BY observed_at, quote_id) AS n FROM price_quote WHERE card_uid IS NOT NULL AND source IS NOT NULL)
  SELECT quote_id, CASE WHEN regexp_matches(url, '^gradebook/pkmn') THEN CASE n WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'later' END WHEN regexp_matches(url, '/optcg:') THEN 'only' ELSE 'default' END AS reply FROM r""")
def replay_responses(spark, root):
    """Requests answered from fixtures by the first pattern that fits, the n-th request by the n-th answer."""
    q = _quotes(spark, root).where("card_uid IS NOT NULL AND source IS NOT NULL").select("quote_id", F.concat_ws("/", "source", "card_uid").alias("url"), "observed_at")
    return P.replay(q, "url", ["observed_at", "quote_id"], FIXTURES).select("quote_id", "reply")


SETTINGS = {"cache": {"max_age_days": 7, "force": False}, "gate": {"precision": 0.98, "recall": 0.9, "floor": None}, "name": "daily"}


@query("SELECT * FROM (VALUES ('cache.max_age_days', '7', 'int'), ('cache.force', 'False', 'bool'), ('gate.precision', '0.98', 'float'), ('gate.recall', '0.9', 'float'), ('gate.floor', NULL, 'null'), ('name', 'daily', 'str')) t(path, value, kind)")
def setting_rows(spark, root):
    """Nested settings as rows of path, value and kind."""
    return spark.createDataFrame(P.setting_rows(SETTINGS), "path string, value string, kind string")


@query("SELECT source, game || ':' || language AS combo, count(DISTINCT card_uid) AS cards FROM cards WHERE game IS NOT NULL AND language IS NOT NULL GROUP BY 1, 2")
def cache_round_trip(spark, root):
    """The catalogue written as pages of JSON per source and read back, regrouped by combination without repeats."""
    c = table(spark, root, "cards").where("game IS NOT NULL AND language IS NOT NULL").select("source", "card_uid", "game", "language")
    p = P.pages(c.unionByName(c), ["source"], ["card_uid", "game", "language"], "card_uid")
    back = p.select("source", F.explode(F.from_json("body", "array<struct<card_uid: string, game: string, language: string>>")).alias("c"))
    return back.select("source", F.concat_ws(":", "c.game", "c.language").alias("combo"), "c.card_uid").distinct().groupBy("source", "combo").agg(F.count(F.lit(1)).alias("cards"))


@query("SELECT source, strftime(CAST(observed_at AS DATE), '%Y-%m-%d') AS day, count(*) AS answers, count(body) AS bodies FROM price_quote WHERE source IS NOT NULL AND observed_at IS NOT NULL GROUP BY 1, 2")
def raw_landing(spark, root):
    """Payloads landed unparsed per source and month, counted by day from where they landed."""
    folder = new_folder(spark, "landing")
    q = _quotes(spark, root).where("source IS NOT NULL AND observed_at IS NOT NULL")
    P.landed(q, "source", "observed_at", folder)
    back = spark.read.schema("quote_id bigint, observed_at timestamp_ntz, body string, source string, month string").parquet(folder)
    return back.groupBy("source", F.date_format("observed_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("answers"), F.count("body").alias("bodies"))


@query("""WITH g AS (SELECT game, language, source, count(*) AS cards, count(*) FILTER (WHERE observed_at IS NULL) AS undated FROM cards GROUP BY 1, 2, 3)
  SELECT source, CAST(sum(cards) AS BIGINT) AS cards, CAST(sum(undated) AS BIGINT) AS undated, sum(cards) > 0 AND sum(undated) = 0 AS persistable FROM g GROUP BY 1""")
def persistable(spark, root):
    """Whether a source's catalogue may replace the cached one: it has cards and all of them are dated."""
    g = table(spark, root, "cards").groupBy("source").agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("observed_at").isNull()).alias("undated"))
    return g.withColumn("persistable", (F.col("cards") > 0) & (F.col("undated") == 0))


@query("""WITH g AS (SELECT source, count(*) AS cards, date_diff('second', max(observed_at), TIMESTAMP '2026-07-01') / 86400.0 AS age FROM cards GROUP BY 1), n AS (SELECT DISTINCT source FROM targets)
  SELECT n.source, round(CASE WHEN age < 0 THEN 0 ELSE age END, 6) AS age_days, CASE WHEN g.source IS NULL THEN 'absent' WHEN cards = 0 THEN 'empty' WHEN age IS NULL THEN 'undated' WHEN greatest(age, 0) >= 30 THEN 'stale' ELSE 'fresh' END AS state FROM n LEFT JOIN g ON n.source = g.source""")
def cache_states(spark, root):
    """State and age of the cached catalogue of every source that lists records."""
    age = F.greatest(F.timestamp_diff("SECOND", F.max("observed_at"), ts("2026-07-01 00:00:00")) / 86400, F.lit(0.0))
    g = table(spark, root, "cards").groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("cards"), age.alias("age"))
    got = table(spark, root, "targets").select("source").distinct().join(g, F.col("source") == F.col("_s"), "left")
    return got.select("source", F.round("age", 6).alias("age_days"), I.cache_state(F.col("_s").isNotNull(), F.col("cards"), F.col("age"), 30).alias("state"))


MONEY = r"[$£¥€]\s?[0-9]|\b[0-9]+\.[0-9]{2}\b|(?i:\b(USD|JPY|EUR|GBP)\s?[0-9])"


@query("SELECT source, count(*) AS documents, count(*) FILTER (WHERE regexp_matches(text, '[$£¥€]\\s?[0-9]|\\b[0-9]+\\.[0-9]{2}\\b|(?i:\\b(USD|JPY|EUR|GBP)\\s?[0-9])')) AS leaking FROM documents GROUP BY 1")
def money_shapes(spark, root):
    """Texts with something shaped like an amount of money, per source, as a report must not show."""
    return table(spark, root, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("text").rlike(MONEY)).alias("leaking"))


@query()
def payload_body_classes(spark, root):
    """Answers by class of body, made to fail, to be empty or to be of odd shape for some statuses."""
    q = _quotes(spark, root).withColumn("status", F.when(F.col("quote_id") % 97 == 0, 503).otherwise(200))
    return q.groupBy("source", P.body_class(F.col("body"), F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT quote_id, coalesce(body->>'$.data.conditions.nearMint', CAST(NULL AS VARCHAR)) AS near_mint FROM price_quote WHERE body IS NOT NULL AND json_valid(body)")
def payload_find(spark, root):
    """A field found at any depth of the payload under any spelling of its name."""
    q = _quotes(spark, root).where(F.col("body").isNotNull() & F.try_parse_json("body").isNotNull())
    return q.select("quote_id", P.find_field(F.col("body"), "near_mint").alias("near_mint"))


@query("""WITH v AS (SELECT source, body FROM price_quote WHERE body IS NOT NULL AND json_valid(body)),
  a AS (SELECT source, unnest(json_keys(body)) AS path FROM v WHERE json_type(body) = 'OBJECT'), b AS (SELECT source, 'data.' || unnest(json_keys(body, '$.data')) FROM v WHERE json_type(body, '$.data') = 'OBJECT'), c AS (SELECT source, 'rate_limit.' || unnest(json_keys(body, '$.rate_limit')) FROM v WHERE json_type(body, '$.rate_limit') = 'OBJECT'),
  d AS (SELECT source, 'data.conditions.' || unnest(json_keys(body, '$.data.conditions')) FROM v WHERE json_type(body, '$.data.conditions') = 'OBJECT')
  SELECT source, path, count(*) AS n FROM (FROM a UNION ALL FROM b UNION ALL FROM c UNION ALL FROM d) GROUP BY 1, 2""")
def payload_paths(spark, root):
    """The paths of all fields of all payloads, to the sixth level, and how often each occurs per source."""
    q = _quotes(spark, root).where("body IS NOT NULL")
    return q.select("source", F.explode(P.key_paths(F.col("body"))).alias("path")).groupBy("source", "path").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE hash_part WHEN 0 THEN 'absent' WHEN 1 THEN 'null' ELSE 'stated' END AS shape, count(*) AS n, count(*) FILTER (WHERE hash_part = 1 AND rarity IS NULL) AS sealed FROM (SELECT rarity, length(card_uid) % 3 AS hash_part FROM cards) GROUP BY 1""")
def payload_sealed(spark, root):
    """Products told from cards: a type field that is there and null, with no rarity; an absent one tells nothing."""
    part = F.length("card_uid") % 3
    rarity = F.when(F.col("rarity").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("rarity"), F.lit('"')))
    hit = F.concat(F.lit('{"id":1,"rarity":'), rarity, F.when(part == 0, "").when(part == 1, ',"cardType":null').otherwise(',"cardType":"Unit"'), F.lit("}"))
    shape = F.when(part == 0, "absent").when(part == 1, "null").otherwise("stated")
    return table(spark, root, "cards").groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.count_if(P.sealed_product(hit)).alias("sealed"))


@query("""SELECT a.game, count(*) AS pairs, count(*) FILTER (WHERE a.foil <> b.foil) AS differ, count(*) FILTER (WHERE a.foil IS NULL OR b.foil IS NULL) AS unknown FROM cards a JOIN (SELECT game, set_code, number, bool_or(foil) AS foil FROM cards GROUP BY 1, 2, 3) b ON a.game = b.game AND a.set_code = b.set_code AND a.number = b.number GROUP BY 1""")
def foil_compared(spark, root):
    """Foil of each card against its number's; unknown on either side is no difference."""
    c = table(spark, root, "cards")
    b = c.groupBy(F.col("game").alias("bg"), F.col("set_code").alias("bs"), F.col("number").alias("bn")).agg(F.bool_or("foil").alias("bf"))
    both = c.join(b, (F.col("game") == F.col("bg")) & (F.col("set_code") == F.col("bs")) & (F.col("number") == F.col("bn")))
    return both.groupBy("game").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("foil") != F.col("bf")).alias("differ"), F.count_if(F.col("foil").isNull() | F.col("bf").isNull()).alias("unknown"))


@query("SELECT card_uid, game, rarity FROM cards WHERE game = 'pkmn' AND coalesce(CAST(year(release_date) AS VARCHAR), 'unknown') = '2023'")
def optional_filters(spark, root):
    """Rows by filters of which any may be left out."""
    c = table(spark, root, "cards")
    return pit.matching(c, {"game": "pkmn", "rarity": None, "era": "2023"}, {"game": F.col("game"), "rarity": F.col("rarity"), "era": I.era(F.col("release_date"))}).select("card_uid", "game", "rarity")


@query(f"""SELECT card_uid, count(*) AS rows, count(DISTINCT source) AS sources FROM (SELECT * FROM price_snapshot p WHERE p.observed_at <= TIMESTAMP '{CUTOFF}' AND NOT EXISTS (SELECT 1 FROM price_snapshot s WHERE s.supersedes = p.row_id AND s.observed_at <= TIMESTAMP '{CUTOFF}')) WHERE observed_at >= as_of GROUP BY 1""")
def store_round_trip(spark, root):
    """The price log appended to a store behind its gate and read as known at a date."""
    import datetime as dt

    s = store.LogStore(spark, new_folder(spark, "store"))
    s.append("price", table(spark, root, "price_snapshot"))
    v = s.view("price", dt.datetime.fromisoformat(CUTOFF))
    return v.groupBy("card_uid").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source").alias("sources"))


@query("""WITH r AS (SELECT * FROM fx_rate WHERE row_id % 7 = 3 AND rate IS NOT NULL)
  SELECT pair, count(*) AS rows, round(sum(CAST(rate AS DOUBLE)), 4) AS total FROM (SELECT pair, rate FROM fx_rate f WHERE NOT EXISTS (SELECT 1 FROM fx_rate x WHERE x.supersedes = f.row_id) AND row_id NOT IN (SELECT row_id FROM r) UNION ALL SELECT pair, CAST(rate * 2 AS DECIMAL(18,8)) FROM r) GROUP BY 1""")
def store_supersede(spark, root):
    """Rates corrected through the store: each seventh doubled by a row that points to it, as known a year after."""
    import datetime as dt

    s, fx = store.LogStore(spark, new_folder(spark, "store")), table(spark, root, "fx_rate")
    s.append("fx", fx)
    old = fx.where("row_id % 7 = 3 AND rate IS NOT NULL")
    fixed = old.withColumn("supersedes", F.col("row_id")).withColumn("rate", (F.col("rate") * 2).cast("decimal(18,8)")).withColumn("observed_at", F.expr("observed_at + INTERVAL 300 DAYS")).drop("row_id")
    s.supersede("fx", fixed, order=["supersedes"])
    v = s.view("fx", dt.datetime(2027, 12, 31))
    return v.groupBy("pair").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("rate").cast("double")), 4).alias("total"))
