"""Queries on which printing a record means: numbers, variants, sets, resolution, candidates for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrain.functions import identity as I  # noqa: E741
from tidegrain.functions import text as X
from tidegrain.operators import resolve as R
from tidegrain.plans.reference import query
from tidegrain.sources.tables import table


# SQL of the number grammar, written for another regular-expression engine.
_UP = "upper(trim(number))"
_KIND = f"""CASE WHEN regexp_matches({_UP}, '^[0-9]+[A-Z]?\\*?\\s*/\\s*[0-9]+$') THEN 'card' WHEN regexp_matches({_UP}, '^R[0-9]+[A-Z]?\\*?$') THEN 'rune' WHEN regexp_matches({_UP}, '^T[0-9]+[A-Z]?$') THEN 'token'
  WHEN regexp_matches({_UP}, '^[A-Z]{{2,4}}-[0-9]+[A-Z]?\\*?$') THEN 'prefixed' WHEN regexp_matches({_UP}, '^[0-9]+[A-Z]?\\*?$') THEN 'bare' ELSE 'unreadable' END"""
_READ = f"""kind, CASE WHEN kind <> 'unreadable' THEN TRY_CAST(regexp_extract(split_part({_UP}, '/', 1), '([0-9]+)[A-Z]?\\*?\\s*$', 1) AS INT) END AS idx, CASE WHEN kind = 'card' THEN TRY_CAST(trim(split_part({_UP}, '/', 2)) AS INT) END AS total,
  CASE WHEN kind <> 'unreadable' THEN nullif(lower(regexp_extract(split_part({_UP}, '/', 1), '[0-9]([A-Z])\\*?\\s*$', 1)), '') END AS suffix, CASE WHEN kind <> 'unreadable' THEN contains(number, '*') END AS starred"""


def _parsed(rows: str) -> str:
    return f"(SELECT *, {_READ} FROM (SELECT *, {_KIND} AS kind FROM {rows}))"


@query(f"SELECT target_id, kind, idx, total, suffix, starred, idx > total AS above FROM {_parsed('targets')} WHERE number IS NOT NULL")
def identity_parse_number(spark, root):
    """Collector numbers taken apart, and whether they exceed the set's size."""
    p = table(spark, root, "targets").where("number IS NOT NULL").select("target_id", X.collector_number(F.col("number")).alias("p"))
    return p.select("target_id", "p.kind", "p.idx", "p.total", "p.suffix", "p.starred", X.above_set_size(F.col("p")).alias("above"))


@query("SELECT target_id, regexp_replace(regexp_replace(upper(replace(number, ' ', '')), '^0+([0-9])', '\\1'), '([/-])0+([0-9])', '\\1\\2', 'g') AS number FROM targets")
def identity_normal_number(spark, root):
    """Numbers in normal form, the total kept."""
    return table(spark, root, "targets").select("target_id", X.normal_number(F.col("number")).alias("number"))


@query("""SELECT card_uid, concat_ws(':', game, set_code, number, variant, language) = card_uid AS rebuilt, split_part(card_uid, ':', 4) AS variant FROM cards
  WHERE len(string_split(card_uid, ':')) = 5 AND NOT list_contains(string_split(card_uid, ':'), '')""")
def identity_uid(spark, root):
    """Keys taken apart and built again from their parts."""
    c = table(spark, root, "cards").withColumn("p", X.key_parts(F.col("card_uid"))).where("p IS NOT NULL")
    built = X.build_key(*[F.col(n) for n in ("game", "set_code", "number", "variant", "language")])
    return c.select("card_uid", (built == F.col("card_uid")).alias("rebuilt"), F.col("p.variant").alias("variant"))


_TOTALS = "(SELECT game, set_code, max(TRY_CAST(split_part(number, '/', 2) AS INT)) AS size FROM cards GROUP BY 1, 2)"
_SET = "lower(regexp_replace(regexp_replace(set_code, '^set ', ''), '[^A-Za-z0-9]', '', 'g'))"


def _set_key(c: str):
    return F.lower(F.regexp_replace(F.regexp_replace(c, "^set ", ""), "[^A-Za-z0-9]", ""))


def _set_sizes(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "cards").groupBy("game", "set_code").agg(F.max(F.split_part("number", F.lit("/"), F.lit(2)).try_cast("int")).alias("size"))
    return c.select(F.col("game").alias("s_game"), F.lower("set_code").alias("s_set"), "size")


@query(f"""WITH t AS {_parsed('targets')}, c AS {_parsed('cards')}, p AS (
    SELECT t.target_id, c.card_uid, t.kind AS tk, c.kind AS ck, t.idx AS ti, c.idx AS ci, t.total AS tt, c.total AS ct, t.suffix AS ts, c.suffix AS cs, t.starred AS tr, c.starred AS cr, t.number AS tn, c.number AS cn, s.size
    FROM t JOIN c ON t.game = c.game AND lower(regexp_replace(regexp_replace(t.set_code, '^set ', ''), '[^A-Za-z0-9]', '', 'g')) = lower(c.set_code) AND t.idx = c.idx LEFT JOIN {_TOTALS} s ON s.game = c.game AND s.set_code = c.set_code),
  w AS (SELECT *, CASE WHEN tk = 'bare' AND ck = 'bare' THEN 'two_bare_numbers' WHEN (tt IS NULL) <> (ct IS NULL) AND CASE WHEN ct IS NULL THEN ck ELSE tk END <> 'bare' THEN 'other_scheme' WHEN (tt IS NULL) <> (ct IS NULL) AND size IS NULL THEN 'total_unknown' END AS refused FROM p)
  SELECT target_id, card_uid, refused, CASE WHEN refused IS NULL THEN CASE WHEN tt IS NULL AND ct IS NULL THEN lower(trim(tn)) = lower(trim(cn)) ELSE ti = ci AND ts IS NOT DISTINCT FROM cs AND tr = cr AND coalesce(tt, size) = coalesce(ct, size) END END AS same FROM w""")
def identity_same_printing(spark, root):
    """Whether a record and the entries of its set with its index are one printing; null with the reason where that cannot be told."""
    t = table(spark, root, "targets").select("target_id", "game", _set_key("set_code").alias("set"), "number", X.collector_number(F.col("number"))["idx"].alias("idx"))
    c = table(spark, root, "cards").select("card_uid", F.col("game").alias("cg"), F.lower("set_code").alias("cs"), F.col("number").alias("cn"), X.collector_number(F.col("number"))["idx"].alias("ci"))
    c = c.join(_set_sizes(spark, root), (F.col("cg") == F.col("s_game")) & (F.col("cs") == F.col("s_set")), "left")
    both = t.join(c, (t["game"] == c["cg"]) & (t["set"] == c["cs"]) & (t["idx"] == c["ci"])).withColumn("r", X.same_printing(F.col("cn"), F.col("number"), F.col("size")))
    return both.select("target_id", "card_uid", "r.same", "r.refused")


@query(f"""SELECT target_id, CASE WHEN size IS NULL THEN NULL WHEN idx IS NULL THEN NULL WHEN total IS NOT NULL THEN trim(number) ELSE lpad(CAST(idx AS VARCHAR), CAST(greatest(len(CAST(size AS VARCHAR)), 3, len(CAST(idx AS VARCHAR))) AS INT), '0') || coalesce(suffix, '') || CASE WHEN starred THEN '*' ELSE '' END
    || '/' || lpad(CAST(size AS VARCHAR), CAST(greatest(len(CAST(size AS VARCHAR)), 3) AS INT), '0') END AS printed, CASE WHEN size IS NULL THEN 'total_unknown' WHEN idx IS NULL THEN 'no_index' END AS refused
  FROM {_parsed('targets')} t LEFT JOIN {_TOTALS} s ON s.game = t.game AND lower(s.set_code) = {_SET.replace('set_code', 't.set_code')} WHERE number IS NOT NULL""")
def identity_printed_number(spark, root):
    """Numbers as printed, completed by their set's size, refused where it is unknown."""
    t = table(spark, root, "targets").where("number IS NOT NULL").select("target_id", "game", _set_key("set_code").alias("set"), "number")
    both = t.join(_set_sizes(spark, root), (F.col("game") == F.col("s_game")) & (F.col("set") == F.col("s_set")), "left")
    return both.withColumn("r", X.printed_number(F.col("number"), F.col("size"))).select("target_id", "r.printed", "r.refused")


def _ladder(column: str, names_only: bool, language: str) -> str:
    arms = []
    for token, pattern, named in I.RARITY_PATTERNS:
        if named or not names_only:
            value = f"CASE WHEN {language} IN ('JP', 'CN-S', 'CN-T') THEN 'sar' ELSE 'sir' END" if token == "sir" else f"'{token}'"
            arms.append(f"WHEN regexp_matches({column}, '{pattern}') THEN {value}")
    return "CASE " + " ".join(arms) + " END"


def _variant_sql(game: str, language: str, rarity: str = "rarity", name: str = "name") -> str:
    r, n = f"lower(coalesce({rarity}, ''))", f"lower(coalesce({name}, ''))"
    return f"CASE WHEN regexp_matches({r}, '[+★☆]') THEN 'parallel' WHEN {game} = 'optcg' AND trim({r}) = 'pr' THEN 'parallel' ELSE coalesce({_ladder(r, False, language)}, {_ladder(n, True, language)}, 'base') END"


@query(f"""WITH p AS {_parsed('targets')} SELECT target_id, by_number, by_id, by_rarity, coalesce(by_number, by_id, by_rarity) AS variant FROM (SELECT target_id,
    CASE WHEN coalesce(game = 'riftbound', true) THEN CASE WHEN starred THEN 'signature' WHEN suffix = 'a' THEN 'alt_art' WHEN suffix = 'b' THEN 'promo' WHEN idx > total THEN 'overnumbered' END END AS by_number,
    CASE WHEN coalesce(game = 'optcg', true) AND regexp_matches(external_id, '_[a-zA-Z][0-9]*$') THEN CASE lower(regexp_extract(external_id, '_([a-zA-Z])[0-9]*$', 1)) WHEN 'p' THEN 'parallel' WHEN 'r' THEN 'reprint' ELSE 'unknown_' || lower(regexp_extract(external_id, '_([a-zA-Z])[0-9]*$', 1)) END
      || CASE WHEN regexp_extract(external_id, '_([a-zA-Z])[0-9]*$', 1) IN ('p', 'P', 'r', 'R') AND regexp_extract(external_id, '([0-9]*)$', 1) = '1' THEN '' ELSE regexp_extract(external_id, '([0-9]*)$', 1) END END AS by_id,
    {_variant_sql('game', 'language')} AS by_rarity FROM p)""")
def identity_variant(spark, root):
    """Variants as number, id and rarity tell them, and the one that counts."""
    t = table(spark, root, "targets")
    c = {n: F.col(n) for n in ("number", "external_id", "rarity", "name", "language", "game")}
    none = F.lit(None).cast("int")
    return t.select("target_id", I.variant_of_number(c["number"], none, c["game"]).alias("by_number"), I.variant_of_id(c["external_id"], c["game"]).alias("by_id"), I.variant_of_rarity(c["rarity"], c["name"], c["language"], c["game"]).alias("by_rarity"),
                    I.variant_of(c["number"], none, c["external_id"], c["rarity"], c["name"], c["language"], c["game"]).alias("variant"))


_ALLOWED = " ".join(f"WHEN '{g}' THEN ['{own}']" for g, own in ((g, "', '".join((*I.SHARED_VARIANTS, *v))) for g, v in I.GAME_VARIANTS.items()))


@query(f"SELECT game, variant, count(*) AS cards, list_contains(CASE game {_ALLOWED} ELSE [] END, variant) OR coalesce(regexp_matches(variant, '^(parallel|reprint)([2-9]|[1-9][0-9]+)$'), false) AS known FROM cards GROUP BY 1, 2")
def identity_is_variant(spark, root):
    """Variants in use per game and whether the game has them."""
    g = table(spark, root, "cards").groupBy("game", "variant").agg(F.count(F.lit(1)).alias("cards"))
    return g.withColumn("known", I.is_variant(F.col("variant"), F.col("game")))


@query("""SELECT set_code, language, game, CASE WHEN game = 'pkmn' AND language = 'EN' AND set_code = 'sv151' THEN 'sv03.5' WHEN game = 'pkmn' AND language = 'EN' AND set_code = 'swsh07' THEN 'swsh7' ELSE set_code END AS canonical,
  CASE WHEN lower(right(trim(set_code), 1)) = 'f' AND len(trim(set_code)) > 1 THEN left(trim(set_code), len(trim(set_code)) - 1) END AS parent_set, count(*) AS n FROM (SELECT * FROM (SELECT game, language, set_code FROM targets) UNION ALL SELECT game, language, set_code || 'F' FROM cards WHERE language = 'CN-T'
  UNION ALL SELECT * FROM (VALUES ('pkmn', 'EN', 'sv151'), ('pkmn', 'EN', 'swsh07'), ('pkmn', 'JP', 'sv151'))) GROUP BY ALL""")
def identity_set_codes(spark, root):
    """Set codes in the catalogue's spelling, and the Japanese parent of Traditional Chinese ones."""
    cols = ("game", "language", "set_code")
    chinese = table(spark, root, "cards").where("language = 'CN-T'").select("game", "language", F.concat("set_code", F.lit("F")).alias("set_code"))
    aliases = spark.createDataFrame([("pkmn", "EN", "sv151"), ("pkmn", "EN", "swsh07"), ("pkmn", "JP", "sv151")], "game string, language string, set_code string")
    n = table(spark, root, "targets").select(*cols).unionByName(chinese).unionByName(aliases).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*cols, I.set_code_of(F.col("game"), F.col("language"), F.col("set_code")).alias("canonical"), I.parent_set_code(F.col("set_code")).alias("parent_set"), "n")


_HITS = """(SELECT card_uid, CASE length(name_en) % 4 WHEN 0 THEN '{"set_id":"' || set_code || '","id":"x"}' WHEN 1 THEN '{"set":{"id":"' || set_code || '"},"id":"x-1"}' WHEN 2 THEN '{"id":"' || set_code || '-' || number || '","localId":"' || number || '"}' ELSE '{"set":"","id":"' || set_code || '-zz"}' END AS hit, set_code
  FROM cards WHERE name_en IS NOT NULL)"""


@query(f"SELECT card_uid, set_code FROM {_HITS}")
def identity_set_code_in_payload(spark, root):
    """Set codes read out of payloads of four shapes, made from the catalogue."""
    c = table(spark, root, "cards").where("name_en IS NOT NULL")
    body = F.expr("""CASE length(name_en) % 4 WHEN 0 THEN '{"set_id":"' || set_code || '","id":"x"}' WHEN 1 THEN '{"set":{"id":"' || set_code || '"},"id":"x-1"}' WHEN 2 THEN '{"id":"' || set_code || '-' || number || '","localId":"' || number || '"}' ELSE '{"set":"","id":"' || set_code || '-zz"}' END""")
    return c.select("card_uid", I.set_code_in(body).alias("set_code"))


@query("SELECT rarity, lower(regexp_replace(rarity, '[^\\pL\\pN]', '', 'g')) AS rarity_key, count(*) AS n FROM targets WHERE rarity IS NOT NULL GROUP BY 1")
def identity_rarity_key(spark, root):
    """Rarities by the letters and digits of any script."""
    r = table(spark, root, "targets").where("rarity IS NOT NULL").groupBy("rarity").agg(F.count(F.lit(1)).alias("n"))
    return r.select("rarity", I.rarity_key(F.col("rarity")).alias("rarity_key"), "n")


@query("""SELECT c.card_uid, coalesce(nullif(c.rarity, ''), e.rarity) AS rarity, CASE WHEN nullif(c.rarity, '') IS NOT NULL THEN 'self' WHEN e.rarity IS NOT NULL THEN 'en_fallback' ELSE 'absent' END AS told_by, coalesce(CAST(year(c.release_date) AS VARCHAR), 'unknown') AS era
  FROM cards c LEFT JOIN (SELECT game, set_code, number, variant, min(nullif(rarity, '')) AS rarity FROM cards WHERE language = 'EN' GROUP BY 1, 2, 3, 4) e ON c.language <> 'EN' AND c.game = e.game AND c.set_code = e.set_code AND c.number = e.number AND c.variant = e.variant""")
def identity_rarity_source(spark, root):
    """Each card's rarity with who told it, borrowed from the English card where its own is missing, and its era."""
    c = table(spark, root, "cards")
    keys = ("game", "set_code", "number", "variant")
    e = c.where("language = 'EN'").groupBy(*[F.col(k).alias(f"e_{k}") for k in keys]).agg(F.min(F.nullif("rarity", F.lit(""))).alias("e_rarity"))
    cond = F.col("language") != "EN"
    for k in keys:
        cond = cond & (c[k] == e[f"e_{k}"])
    got = c.join(e, cond, "left").withColumn("r", I.rarity_with_source(F.col("rarity"), F.col("e_rarity")))
    return got.select("card_uid", "r.rarity", "r.told_by", I.era(F.col("release_date")).alias("era"))


@query(f"""SELECT target_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), '^$', '') AS loose, TRY_CAST(nullif(replace(regexp_extract(replace(name, ' ', ''), '(-?[0-9][0-9,]*\\.?[0-9]*)', 1), ',', ''), '') AS DOUBLE) AS first_number FROM targets WHERE name IS NOT NULL""")
def identity_loose_names(spark, root):
    """Names as loose keys and the first number in them."""
    t = table(spark, root, "targets").where("name IS NOT NULL")
    return t.select("target_id", X.loose_key(F.col("name")).alias("loose"), X.number_in(F.col("name")).alias("first_number"))


@query()
def identity_normal_name(spark, root):
    """Names without marks, case, punctuation and noise words."""
    return table(spark, root, "targets").select("target_id", X.normal_name(F.col("name")).alias("name"))


@query("""WITH g AS (SELECT game, language, number, row_number() OVER (PARTITION BY source, external_id ORDER BY observed_at, target_id) AS n, lag(number) OVER w AS before, lag(target_id) OVER w AS b, target_id FROM targets WHERE number IS NOT NULL AND external_id IS NOT NULL WINDOW w AS (PARTITION BY source, external_id ORDER BY observed_at, target_id))
  SELECT target_id, b AS before_id, lower(trim(before)) = lower(trim(number)) AS same_text FROM g WHERE b IS NOT NULL""")
def identity_repeats(spark, root):
    """Each record against the one before it with the same external id."""
    w = Window.partitionBy("source", "external_id").orderBy("observed_at", "target_id")
    t = table(spark, root, "targets").where("number IS NOT NULL AND external_id IS NOT NULL").select("target_id", "number", F.lag("target_id").over(w).alias("before_id"), F.lag("number").over(w).alias("_b"))
    return t.where("before_id IS NOT NULL").select("target_id", "before_id", (F.lower(F.trim("_b")) == F.lower(F.trim("number"))).alias("same_text"))


_STAGE = f"""CASE WHEN game IS NULL THEN 'no_game' WHEN number IS NULL AND set_code IS NULL THEN 'no_identity' WHEN number IS NULL THEN 'no_number' WHEN set_code IS NULL THEN 'no_set_code' WHEN {_KIND} = 'unreadable' THEN 'unreadable_number'
  WHEN language IS NULL THEN 'no_language' WHEN rarity IS NULL THEN 'rarity_absent' WHEN name IS NULL THEN 'no_name' WHEN contains(set_code, ':') OR contains(number, ':') THEN 'bad_key' ELSE 'parsed' END"""


@query(f"SELECT game || ':' || coalesce(language, '?') AS combo, {_STAGE} AS stage, count(*) AS n FROM targets GROUP BY ALL")
def catalog_funnel(spark, root):
    """Where records leave the way into the catalogue, per combination of game and language, in one pass."""
    kind = X.collector_number(F.col("number"))["kind"]
    null = lambda c: F.col(c).isNull()
    stage = (
        F.when(null("game"), "no_game").when(null("number") & null("set_code"), "no_identity").when(null("number"), "no_number").when(null("set_code"), "no_set_code").when(kind == "unreadable", "unreadable_number")
        .when(null("language"), "no_language").when(null("rarity"), "rarity_absent").when(null("name"), "no_name").when(F.col("set_code").contains(":") | F.col("number").contains(":"), "bad_key").otherwise("parsed")
    )
    return table(spark, root, "targets").groupBy(F.concat_ws(":", "game", F.coalesce("language", F.lit("?"))).alias("combo"), stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT card_uid, game || ':' || language AS combo, coalesce(card_uid <> '' AND game <> '' AND set_code <> '' AND number <> '' AND variant <> '' AND language <> '', false) AS complete FROM cards")
def identity_complete(spark, root):
    """Whether all six parts of a card's identity are there, and its combination key."""
    whole = F.lit(True)
    for c in ("card_uid", "game", "set_code", "number", "variant", "language"):
        whole = whole & (F.col(c) != "")
    return table(spark, root, "cards").select("card_uid", F.concat_ws(":", "game", "language").alias("combo"), F.coalesce(whole, F.lit(False)).alias("complete"))


# --- resolution -----------------------------------------------------------------------------------

LINKED_BY = "2026-06-01 00:00:00"
_LANG = "CASE lower(trim(language)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.LANGUAGE_NAMES.items()) + " END"
_NORM = "regexp_replace(regexp_replace(upper(replace(trim(number), ' ', '')), '^0+([0-9])', '\\1'), '([/-])0+([0-9])', '\\1\\2', 'g')"
_BI = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substr({0}, i, 2)))"
_WORDS = "list_distinct(string_split({}, ' '))"
_SIM = f"""CASE WHEN x = '' OR y = '' THEN 0.0 ELSE greatest(len(list_intersect({_WORDS.format('x')}, {_WORDS.format('y')})) / len(list_distinct(list_concat({_WORDS.format('x')}, {_WORDS.format('y')}))),
    2 * len(list_intersect({_BI.format('x')}, {_BI.format('y')})) / (len({_BI.format('x')}) + len({_BI.format('y')}))) END"""
_CARD_NAME = "CASE WHEN language = 'EN' THEN name_en ELSE coalesce(name_jp, name_en) END"


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Cards with the name in their own language."""
    return table(spark, root, "cards").withColumn("name", F.expr(_CARD_NAME))


def records(spark: SparkSession, root: str) -> DataFrame:
    """Targets with languages as codes and the variant their rarity tells."""
    t = table(spark, root, "targets").withColumn("language", I.lookup(F.lower(F.trim("language")), I.LANGUAGE_NAMES))
    none = F.lit(None).cast("string")
    told = F.when(F.col("rarity").isNotNull(), I.variant_of_rarity(F.col("rarity"), F.col("name"), none, none))
    return t.withColumn("variant", told).withColumn("foil", F.lit(None).cast("boolean"))


def known_links(spark: SparkSession, root: str) -> DataFrame:
    """``(source, external_id, card_uid)``: ids whose record of before ``LINKED_BY`` had one card's set, number and language."""
    keys = [F.lower("set_code").alias("_s"), *R.pool_key("game", "language", "number")]
    one = table(spark, root, "cards").select(*keys, "card_uid").groupBy("_s", "_g", "_l", "_n").agg(F.min("card_uid").alias("card_uid"), F.count(F.lit(1)).alias("_c")).where("_c = 1").drop("_c")
    old = records(spark, root).where(F.col("observed_at") < F.lit(LINKED_BY).cast("timestamp_ntz")).where("external_id IS NOT NULL")
    return old.select("source", "external_id", *keys).join(one, ["_s", "_g", "_l", "_n"]).select("source", "external_id", "card_uid").distinct()


def resolved(spark: SparkSession, root: str, similar=R.spelling) -> DataFrame:
    links = known_links(spark, root)
    return R.resolve(records(spark, root), catalogue(spark, root), links.where("source = 'slabcount'"), links.where("source != 'slabcount'"), similar=similar)


_RES = f"""t AS (SELECT target_id, source, external_id, game, {_LANG} AS language, number, set_code, name, observed_at, {_NORM} AS n, CASE WHEN rarity IS NOT NULL THEN {_variant_sql("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")} END AS variant FROM targets),
  c AS (SELECT card_uid, game, language, set_code, box_code, variant, {_NORM} AS n, {_CARD_NAME} AS name FROM cards),
  one AS (SELECT lower(set_code) AS s, game, language, n, min(card_uid) AS card_uid FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
  links AS (SELECT source, external_id, min(one.card_uid) AS card_uid FROM t JOIN one ON lower(t.set_code) = one.s AND t.game = one.game AND t.language = one.language AND t.n = one.n WHERE external_id IS NOT NULL AND observed_at < TIMESTAMP '{LINKED_BY}' GROUP BY 1, 2),
  sure AS (SELECT target_id, links.card_uid, CASE WHEN links.source = 'slabcount' THEN 'manual' ELSE 'exact' END AS how FROM t JOIN links USING (source, external_id)),
  pairs AS (SELECT target_id, card_uid, lower(coalesce(t.name, '')) AS x, lower(coalesce(c.name, '')) AS y, CASE WHEN coalesce(t.set_code, '') <> '' AND upper(t.set_code) <> upper(c.set_code) AND NOT coalesce(upper(t.set_code) = upper(c.box_code), false) THEN 0.55 ELSE 1.0 END AS f1,
      CASE WHEN t.variant <> lower(c.variant) THEN 0.65 ELSE 1.0 END AS f2 FROM t JOIN c ON t.game = c.game AND t.language = c.language AND t.n = c.n WHERE target_id NOT IN (SELECT target_id FROM sure)),
  scored AS (SELECT target_id, card_uid, round({_SIM} * f1::DOUBLE * f2::DOUBLE, 4) AS confidence FROM pairs),
  ranked AS (SELECT *, row_number() OVER w AS rn, lead(confidence) OVER w AS nx FROM scored WINDOW w AS (PARTITION BY target_id ORDER BY confidence DESC, card_uid)),
  fuzzy AS (SELECT t.target_id, r.card_uid, r.confidence, CASE WHEN NOT coalesce(game IN ('optcg', 'pkmn', 'riftbound'), false) THEN 'unknown_game' WHEN t.language IS NULL THEN 'no_language' WHEN r.card_uid IS NULL THEN 'empty_pool' WHEN confidence - nx < 0.05 THEN 'ambiguous' WHEN confidence < 0.6 THEN 'below_floor' ELSE 'fuzzy' END AS reason
    FROM t LEFT JOIN ranked r ON r.target_id = t.target_id AND rn = 1 WHERE t.target_id NOT IN (SELECT target_id FROM sure)),
  res AS (SELECT target_id, card_uid, 1.0::DOUBLE AS confidence, how AS resolved_by, how AS reason FROM sure
    UNION ALL SELECT target_id, CASE WHEN reason = 'fuzzy' THEN card_uid END, CASE WHEN reason IN ('unknown_game', 'no_language', 'empty_pool') THEN 0.0 ELSE confidence END, CASE WHEN reason = 'fuzzy' THEN 'fuzzy' END, reason FROM fuzzy)"""


@query(f"WITH {_RES} SELECT target_id, card_uid, confidence, resolved_by, reason FROM res")
def resolve_cascade(spark, root):
    """Every record's card by override, known link or the best scored entry of its pool, or why it is refused."""
    return resolved(spark, root).drop("candidates")


@query(f"WITH {_RES} SELECT f.target_id, f.reason, string_agg(r.card_uid, ',' ORDER BY r.rn) AS candidates FROM fuzzy f JOIN (SELECT target_id, card_uid, rn FROM ranked WHERE rn <= 5) r USING (target_id) WHERE reason IN ('ambiguous', 'below_floor') GROUP BY 1, 2")
def resolve_refused(spark, root):
    """Records refused though they had candidates, with the best five."""
    return resolved(spark, root).where("reason IN ('ambiguous', 'below_floor')").select("target_id", "reason", "candidates")


@query(f"WITH {_RES} SELECT coalesce(resolved_by, 'none') AS resolved_by, count(*) AS n, count(*) FILTER (WHERE resolved_by IN ('manual', 'exact') OR (resolved_by = 'fuzzy' AND confidence >= 0.9)) AS usable, count(*) FILTER (WHERE resolved_by = 'fuzzy' AND confidence < 0.9) AS needs_review FROM res GROUP BY 1")
def resolve_usability(spark, root):
    """Links per kind, how many may be used and how many need review."""
    r = resolved(spark, root)
    ok = R.usable(F.col("resolved_by"), F.col("confidence"))
    return r.groupBy(F.coalesce("resolved_by", F.lit("none")).alias("resolved_by")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("usable"), F.count_if((F.col("resolved_by") == "fuzzy") & ~ok).alias("needs_review"))


@query()
def resolve_by_matching_blocks(spark, root):
    """The same cascade with the matching-blocks similarity of names in normal form."""
    return resolved(spark, root, similar=X.with_name_similarity).drop("candidates")


@query(f"""WITH {_RES}, p2 AS (SELECT target_id, c.card_uid, lower(coalesce(t.name, '')) AS x, lower(coalesce(c.name, '')) AS y FROM t JOIN c ON t.game = c.game AND t.language = c.language AND t.n = c.n JOIN sure USING (target_id)),
  s2 AS (SELECT target_id, card_uid, round({_SIM}, 4) AS z FROM p2), b2 AS (SELECT target_id, card_uid, z, row_number() OVER (PARTITION BY target_id ORDER BY z DESC, card_uid) AS rn FROM s2 WHERE z >= 0.6)
  SELECT count(*) FILTER (WHERE b2.target_id IS NOT NULL) AS used, count(*) FILTER (WHERE b2.card_uid = sure.card_uid) AS correct, round(coalesce(count(*) FILTER (WHERE b2.card_uid = sure.card_uid) / nullif(count(*) FILTER (WHERE b2.target_id IS NOT NULL), 0), 1.0), 6) AS precision,
    round(count(*) FILTER (WHERE b2.card_uid = sure.card_uid) / count(*), 6) AS recall, round(pow(0.05, 1.0 / count(*) FILTER (WHERE b2.target_id IS NOT NULL)), 6) AS bound_if_perfect FROM sure LEFT JOIN b2 ON sure.target_id = b2.target_id AND rn = 1""")
def resolve_precision(spark, root):
    """Precision and recall of names within the pool on records whose id links them, with the bound a perfect score would have."""
    r = resolved(spark, root).where("resolved_by IN ('manual', 'exact')").select(F.col("target_id").alias("_did"), F.col("card_uid").alias("truth"))
    told = records(spark, root).select(F.col("target_id").alias("_did"), *R.TOLD).withColumn("set_code", F.lit(None).cast("string")).withColumn("variant", F.lit(None).cast("string")).join(r, "_did").select("*", *R.pool_key("game", "language", "number"))
    s = R.scored(told.drop("truth"), catalogue(spark, root)).where(F.col("confidence") >= R.FLOOR)
    best = s.groupBy("_did").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "card_uid")).alias("b"))
    both = r.join(best, "_did", "left")
    hit = F.count_if(F.col("b.card_uid") == F.col("truth"))
    used = F.count("b")
    return both.agg(used.alias("used"), hit.alias("correct"), F.round(F.coalesce(hit / F.nullif(used, F.lit(0)), F.lit(1.0)), 6).alias("precision"), F.round(hit / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("recall"), F.round(F.pow(F.lit(0.05), 1 / F.nullif(used, F.lit(0))), 6).alias("bound_if_perfect"))


@query(f"""WITH {_RES}, p AS (SELECT lower(trim(a.name)) AS x, lower(trim(c.name)) AS y FROM sure JOIN t a USING (target_id) JOIN c ON c.card_uid = sure.card_uid)
  SELECT CASE WHEN coalesce(length(x), 0) = 0 OR coalesce(length(y), 0) = 0 THEN 'UNKNOWN' WHEN contains(x, y) OR contains(y, x) THEN 'AGREE' ELSE 'DISAGREE' END AS verdict, count(*) AS n FROM p GROUP BY 1""")
def names_three_valued(spark, root):
    """Whether the names of linked pairs agree, disagree or cannot be compared."""
    e = resolved(spark, root).where("resolved_by IN ('manual', 'exact')").select("target_id", "card_uid")
    both = e.join(table(spark, root, "targets").select("target_id", "name"), "target_id").join(catalogue(spark, root).select("card_uid", F.col("name").alias("c_name")), "card_uid")
    return both.groupBy(X.three_valued(F.col("name"), F.col("c_name")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT target_id, game, upper(replace(name, ' ', '')) AS nm, number FROM targets WHERE target_id % 50 = 0 AND name IS NOT NULL AND number IS NOT NULL),
  c AS (SELECT card_uid, game, upper(replace(name_en, ' ', '')) AS nm, number FROM cards WHERE name_en IS NOT NULL),
  a AS (SELECT q.game, regexp_replace(upper(replace(trim(q.number), ' ', '')), '(^|[/-])0+([0-9])', '\\1\\2', 'g') = regexp_replace(upper(replace(trim(c.number), ' ', '')), '(^|[/-])0+([0-9])', '\\1\\2', 'g') AS blocked FROM q JOIN c ON q.game = c.game AND q.nm = c.nm)
  SELECT game, count(*) AS pairs, count(*) FILTER (WHERE blocked) AS in_pool FROM a GROUP BY 1""")
def resolve_pool_recall(spark, root):
    """Of the pairs of equal name, one record of fifty against all entries, how many share the number that makes a pool."""
    squeezed = lambda c: F.upper(F.regexp_replace(c, " ", ""))
    q = table(spark, root, "targets").where("target_id % 50 = 0 AND name IS NOT NULL AND number IS NOT NULL").select("target_id", "game", squeezed("name").alias("nm"), X.normal_number(F.trim("number")).alias("n"))
    c = table(spark, root, "cards").where("name_en IS NOT NULL").select("game", squeezed("name_en").alias("nm"), X.normal_number(F.trim("number")).alias("cn"))
    return q.join(c, ["game", "nm"]).groupBy("game").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") == F.col("cn")).alias("in_pool"))


# --- candidates for review and labels -------------------------------------------------------------

_IDEAS = f"""c AS (SELECT card_uid, game, language, set_code, box_code, lower(variant) AS variant, regexp_replace(regexp_replace(upper(replace(trim(number), ' ', '')), '^0+([0-9])', '\\1'), '([/-])0+([0-9])', '\\1\\2', 'g') AS n, lower(coalesce({_CARD_NAME}, '')) AS name, nullif(lower(trim(artist)), '') AS artist FROM cards),
  self_pairs AS (SELECT a.card_uid AS id, b.card_uid, a.name AS x, b.name AS y, CASE WHEN coalesce(a.set_code, '') <> '' AND upper(a.set_code) <> upper(b.set_code) AND NOT coalesce(upper(a.set_code) = upper(b.box_code), false) THEN 0.55 ELSE 1.0 END AS f1, CASE WHEN a.variant <> b.variant THEN 0.65 ELSE 1.0 END AS f2
    FROM c a JOIN c b ON a.game = b.game AND a.language = b.language AND a.n = b.n),
  self_scored AS (SELECT id, card_uid, round({_SIM} * f1::DOUBLE * f2::DOUBLE, 4) AS z FROM self_pairs),
  self_ranked AS (SELECT *, row_number() OVER w AS rn, lead(z) OVER w AS nx FROM self_scored WINDOW w AS (PARTITION BY id ORDER BY z DESC, card_uid)),
  sure_of AS (SELECT c.card_uid, CASE WHEN game IN ('optcg', 'pkmn', 'riftbound') AND language IN ('EN', 'JP', 'CN-S', 'CN-T') AND s.card_uid IS NOT NULL THEN z ELSE 0.0 END AS confidence, CASE WHEN z - nx < 0.05 THEN 'ambiguous' WHEN z < 0.6 THEN 'below_floor' WHEN s.card_uid = c.card_uid THEN 'itself' ELSE 'other' END AS outcome, game || ':' || language AS combo
    FROM c LEFT JOIN self_ranked s ON s.id = c.card_uid AND rn = 1),
  weakest AS (SELECT card_uid FROM (SELECT card_uid, row_number() OVER (ORDER BY confidence, md5(card_uid)) AS place FROM sure_of) WHERE place <= (SELECT floor(count(*) / 4) + 1 FROM cards)),
  ideas AS (
    SELECT card_uid, 0 AS o, CAST(NULL AS VARCHAR) AS parent, k - 1 AS siblings FROM c JOIN (SELECT game AS g, n AS gn, count(*) AS k FROM c GROUP BY 1, 2 HAVING count(DISTINCT language) > 1) ON game IS NOT DISTINCT FROM g AND n IS NOT DISTINCT FROM gn
    UNION ALL SELECT card_uid, 0, CASE WHEN k = 1 THEN only_one END, CASE WHEN k = 1 THEN 1 ELSE 0 END FROM c LEFT JOIN (SELECT game AS g, artist AS ga, count(*) AS k, min(card_uid) AS only_one FROM c WHERE language = 'JP' AND artist IS NOT NULL GROUP BY 1, 2) ON game = g AND artist = ga WHERE language = 'CN-S'
    UNION ALL SELECT card_uid, 1, NULL, k - 1 FROM c JOIN (SELECT game AS g, language AS l, name AS gn, count(*) AS k FROM c WHERE name <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT set_code) > 1) ON game = g AND language = l AND name = gn
    UNION ALL SELECT card_uid, 2, NULL, k - 1 FROM c JOIN (SELECT game AS g, language AS l, n AS gn, count(*) AS k FROM c GROUP BY 1, 2, 3 HAVING count(DISTINCT variant) > 1) ON game = g AND language = l AND n IS NOT DISTINCT FROM gn
    UNION ALL SELECT card_uid, 3, NULL, k - 1 FROM c JOIN (SELECT game AS g, language AS l, name AS gn, count(*) AS k FROM c GROUP BY 1, 2, 3 HAVING count(*) > 1) ON game = g AND language = l AND name = gn WHERE variant = 'promo' OR upper(set_code) LIKE 'P%'
    UNION ALL SELECT card_uid, 4, NULL, 0 FROM weakest),
  best_idea AS (SELECT card_uid, min(o) AS o, max(parent) AS parent, arg_max(siblings, (-o, siblings)) AS siblings FROM ideas GROUP BY 1),
  review AS (SELECT b.card_uid, s.combo, CASE b.o WHEN 0 THEN 'same_art_across_languages' WHEN 1 THEN 'reprint_across_sets' WHEN 2 THEN 'alt_art_vs_base' WHEN 3 THEN 'promo_vs_set' ELSE 'lowest_confidence' END AS priority, b.o, b.parent, CAST(b.siblings AS BIGINT) AS siblings, s.confidence FROM best_idea b JOIN sure_of s USING (card_uid))"""
QUOTA = 20


@query(f"WITH {_IDEAS} SELECT card_uid, combo, priority, parent, siblings, confidence FROM review")
def candidates_ideas(spark, root):
    """Cards worth a review with their hardest reason, the parent a renumbered one has, and the size of its group."""
    return R.review_ideas(catalogue(spark, root))


@query(f"WITH {_IDEAS}, q AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY o, confidence, card_uid) AS place FROM review) SELECT combo, place, card_uid, priority, confidence FROM q WHERE place <= {QUOTA}")
def candidates_quota(spark, root):
    """The first twenty candidates of every combination, hardest first; twenty is the quota."""
    return R.within_quota(R.review_ideas(catalogue(spark, root)), QUOTA).select("combo", F.col("place").cast("bigint").alias("place"), "card_uid", "priority", "confidence")


#: Labels wanted per combination.
WANTED = {"pkmn:EN": 40, "pkmn:JP": 35, "optcg:EN": 35, "optcg:JP": 35, "optcg:CN-S": 30, "pkmn:CN-S": 30, "pkmn:CN-T": 25, "riftbound:EN": 20}
_WANTED = ", ".join(f"('{k}', {v})" for k, v in WANTED.items())


@query(f"WITH {_IDEAS}, h AS (SELECT combo, least(count(*), {QUOTA}) AS have FROM review GROUP BY 1) SELECT w.combo, CAST(w.want AS BIGINT) AS want, coalesce(have, 0) AS have, w.want - coalesce(have, 0) AS short FROM (VALUES {_WANTED}) w(combo, want) LEFT JOIN h USING (combo) WHERE coalesce(have, 0) < want")
def candidates_shortfall(spark, root):
    """Combinations for which the candidates within the quota do not reach what is wanted."""
    have = R.within_quota(R.review_ideas(catalogue(spark, root)), QUOTA).groupBy("combo").agg(F.count(F.lit(1)).alias("have"))
    want = spark.createDataFrame(list(WANTED.items()), "combo string, want bigint")
    got = want.join(have, "combo", "left").select("combo", "want", F.coalesce("have", F.lit(0)).alias("have"))
    return got.where("have < want").withColumn("short", F.col("want") - F.col("have"))


@query(f"WITH {_IDEAS} SELECT combo, outcome, count(*) AS n FROM sure_of GROUP BY 1, 2")
def resolve_merge_check(spark, root):
    """Whether every catalogue entry resolves to itself, to another one, or to none and why."""
    c = catalogue(spark, root)
    told = c.select(F.col("card_uid").alias("_did"), "game", "language", "number", "set_code", "variant", F.lit(None).cast("boolean").alias("foil"), "name").select("*", *R.pool_key("game", "language", "number"))
    d = R.decided(told, R.scored(told, c))
    outcome = F.when(F.col("reason") != "fuzzy", F.col("reason")).when(F.col("card_uid") == F.col("_did"), "itself").otherwise("other")
    return d.join(told.select("_did", F.concat_ws(":", "game", "language").alias("combo")), "_did").groupBy("combo", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


CONFIDENCES = ("verified", "single_source", "in_repo", "unstated")
#: Numbers seen for a card that belong to another market: game, set code, name, number.
CONFUSABLE = (("pkmn", "s7R", "Rayquaza VMAX", "083/069"),)
_LABELS = f"""(SELECT card_uid, game, set_code, number, CASE WHEN foil THEN 'sr' ELSE variant END AS variant, language, {_CARD_NAME} AS name, source, CASE source WHEN 'openpull' THEN 'verified' WHEN 'cardrail' THEN 'single_source' WHEN 'lantern_index' THEN 'rumour' ELSE 'unstated' END AS confidence, language = 'JP' AS labelled FROM cards)"""


def label_faults() -> "F.Column":
    """What is wrong with a row of labels, in order, as an array of names; empty for rows that may enter."""
    req = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing_{c}")) for c in ("card_uid", "game", "set_code", "number", "variant", "language", "name", "source", "confidence")]
    built = X.build_key(*[F.col(c) for c in ("game", "set_code", "number", "variant", "language")])
    confusable = F.lit(False)
    for game, set_code, name, number in CONFUSABLE:
        confusable = confusable | ((F.col("game") == game) & (F.col("set_code") == set_code) & (F.col("name") == name) & (F.col("number") == number))
    rest = [
        F.when(~F.col("confidence").isin(*CONFIDENCES), F.lit("confidence")), F.when(~I.is_variant(F.col("variant"), F.col("game")), F.lit("variant")), F.when(built != F.col("card_uid"), F.lit("card_uid")), F.when(confusable, F.lit("confusable_number")),
        F.when(F.col("labelled") & ~F.col("confidence").isin("verified", "single_source"), F.lit("already_labelled")),
    ]
    return F.array_compact(F.array(*req, *rest))


_FAULTS = "list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, '') = '' THEN 'missing_{c}' END" for c in ("card_uid", "game", "set_code", "number", "variant", "language", "name", "source", "confidence")) + f""",
  CASE WHEN confidence NOT IN ('verified', 'single_source', 'in_repo', 'unstated') THEN 'confidence' END, CASE WHEN NOT (list_contains(CASE game {_ALLOWED} ELSE [] END, variant) OR regexp_matches(variant, '^(parallel|reprint)([2-9]|[1-9][0-9]+)$')) THEN 'variant' END,
  CASE WHEN concat_ws(':', game, set_code, number, variant, language) <> card_uid THEN 'card_uid' END, CASE WHEN game = 'pkmn' AND set_code = 's7R' AND name = 'Rayquaza VMAX' AND number = '083/069' THEN 'confusable_number' END,
  CASE WHEN labelled AND confidence NOT IN ('verified', 'single_source') THEN 'already_labelled' END], lambda x: x IS NOT NULL)"""


def _labels(spark: SparkSession, root: str) -> DataFrame:
    c = catalogue(spark, root)
    stated = F.when(F.col("source") == "openpull", "verified").when(F.col("source") == "cardrail", "single_source").when(F.col("source") == "lantern_index", "rumour").otherwise("unstated")
    return c.select("card_uid", "game", "set_code", "number", F.when(F.col("foil"), "sr").otherwise(F.col("variant")).alias("variant"), "language", "name", "source", stated.alias("confidence"), (F.col("language") == "JP").alias("labelled"))


@query(f"SELECT card_uid, array_to_string({_FAULTS}, ',') AS faults FROM {_LABELS}")
def labels_faults(spark, root):
    """Rows offered as labels, made from the catalogue with foil cards mislabelled, and what is wrong with each."""
    return _labels(spark, root).select("card_uid", F.array_join(label_faults(), ",").alias("faults"))


@query(f"""WITH l AS (SELECT *, len({_FAULTS}) = 0 AS fine FROM {_LABELS}), g AS (SELECT game || ':' || language AS combo, count(*) FILTER (WHERE fine) AS pool, count(*) FILTER (WHERE fine AND confidence = 'verified') AS have FROM l GROUP BY 1)
  SELECT w.combo, CAST(w.want AS BIGINT) AS want, coalesce(pool, 0) AS pool, coalesce(have, 0) AS have, CASE WHEN coalesce(have, 0) >= want THEN 'ok' WHEN coalesce(have, 0) < 20 THEN 'below floor' ELSE 'short' END AS state FROM (VALUES {_WANTED}) w(combo, want) LEFT JOIN g USING (combo)""")
def labels_gate(spark, root):
    """Verified labels per combination against what is wanted and the floor of twenty."""
    g = _labels(spark, root).where(F.size(label_faults()) == 0).groupBy(F.concat_ws(":", "game", "language").alias("combo")).agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.col("confidence") == "verified").alias("have"))
    got = spark.createDataFrame(list(WANTED.items()), "combo string, want bigint").join(g, "combo", "left").select("combo", "want", F.coalesce("pool", F.lit(0)).alias("pool"), F.coalesce("have", F.lit(0)).alias("have"))
    return got.withColumn("state", F.when(F.col("have") >= F.col("want"), "ok").when(F.col("have") < 20, "below floor").otherwise("short"))
