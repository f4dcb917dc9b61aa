"""Records resolved to catalogue entries: override, known link, else the best scored entry of the record's pool.

The pool of a record are the entries with its game, language and normalised number, an equality join; all of
a pool is scored. Descriptions are scored once however many records repeat them, so a hot description costs
one pool. A record is refused, with the reason, where its game or language is unknown, its pool is empty, its
two best entries lie within ``GAP``, or the best one is under ``FLOOR``.

Defined cases: null names score 0; ties end with the smallest key, which ``GAP`` turns into a refusal; repeated
records each get their row; of repeated overrides or links for one id the smallest key counts; empty tables give
an empty result, an empty catalogue refuses everything; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions import identity as I  # noqa: E741
from tidegrain.functions import text as X
from tidegrain.operators.stats import ranked

GAP, FLOOR, TOP = 0.05, 0.6, 5
#: Factors for a set, a variant or a foil stated otherwise.
SET_DIFFERS, VARIANT_DIFFERS, FOIL_DIFFERS = 0.55, 0.65, 0.8
TOLD = ("game", "language", "number", "set_code", "variant", "foil", "name")


def _bigrams(s: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(s, i, 2)))


def spelling(pairs: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """Similarity the engine has functions for: the larger of the words' overlap and the Dice index of letter pairs."""
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    u, v = _bigrams(x), _bigrams(y)
    dice = 2 * F.size(F.array_intersect(u, v)) / (F.size(u) + F.size(v))
    return pairs.withColumn(to, F.when((x == "") | (y == ""), 0.0).otherwise(F.greatest(X.word_overlap(x, y), dice)))


def pool_key(game: str, language: str, number: str) -> list[Column]:
    return [F.col(game).alias("_g"), F.col(language).alias("_l"), X.normal_number(F.trim(number)).alias("_n")]


def scored(told: DataFrame, cards: DataFrame, similar: Callable[..., DataFrame] = spelling) -> DataFrame:
    """``(_did, card_uid, confidence, set_differs, variant_differs, foil_differs)`` for every entry of every description's pool."""
    c = cards.select(*pool_key("game", "language", "number"), "card_uid", F.upper("set_code").alias("c_set"), F.upper("box_code").alias("c_box"), F.lower("variant").alias("c_variant"), F.col("foil").alias("c_foil"), F.col("name").alias("c_name"))
    pairs = similar(told.join(c, ["_g", "_l", "_n"]), "name", "c_name", "_sim")
    stated = F.nullif(F.upper("set_code"), F.lit(""))
    other_set = F.coalesce((stated != F.col("c_set")) & ~F.coalesce(stated == F.col("c_box"), F.lit(False)), F.lit(False))
    other_variant = F.coalesce(F.nullif(F.lower("variant"), F.lit("")) != F.col("c_variant"), F.lit(False))
    other_foil = F.coalesce(F.col("foil") != F.col("c_foil"), F.lit(False))
    factor = lambda cond, by: F.when(cond, F.lit(by)).otherwise(1.0)
    confidence = F.round(F.col("_sim") * factor(other_set, SET_DIFFERS) * factor(other_variant, VARIANT_DIFFERS) * factor(other_foil, FOIL_DIFFERS), 4)
    return pairs.select("_did", "card_uid", confidence.alias("confidence"), other_set.alias("set_differs"), other_variant.alias("variant_differs"), other_foil.alias("foil_differs"))


def decided(told: DataFrame, score: DataFrame) -> DataFrame:
    """``(_did, card_uid, confidence, resolved_by, reason, candidates)``, one row per description."""
    order = Window.partitionBy("_did").orderBy(F.desc("confidence"), "card_uid")
    top = score.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= TOP)
    place = lambda i, c: F.max(F.when(F.col("_place") == i, F.col(c)))
    best = top.groupBy("_did").agg(place(1, "card_uid").alias("_uid"), place(1, "confidence").alias("_best"), place(2, "confidence").alias("_next"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "card_uid"))), lambda s: s["card_uid"]), ",").alias("candidates"))
    got = told.select("_did", "game", "language").join(best, "_did", "left")
    reason = (
        F.when(~F.coalesce(F.col("game").isin(*I.GAMES), F.lit(False)), "unknown_game").when(~F.coalesce(F.col("language").isin(*I.LANGUAGES), F.lit(False)), "no_language").when(F.col("_uid").isNull(), "empty_pool")
        .when(F.col("_best") - F.col("_next") < GAP, "ambiguous").when(F.col("_best") < FLOOR, "below_floor").otherwise("fuzzy")
    )
    got = got.withColumn("reason", reason)
    fine = F.col("reason") == "fuzzy"
    unasked = F.col("reason").isin("unknown_game", "no_language", "empty_pool")
    return got.select("_did", F.when(fine, F.col("_uid")).alias("card_uid"), F.when(unasked, 0.0).otherwise(F.col("_best")).alias("confidence"), F.when(fine, "fuzzy").alias("resolved_by"), "reason", F.when(~unasked, F.col("candidates")).alias("candidates"))


def resolve(records: DataFrame, cards: DataFrame, overrides: DataFrame, links: DataFrame, key: str = "target_id", similar: Callable[..., DataFrame] = spelling) -> DataFrame:
    """``(key, card_uid, confidence, resolved_by, reason, candidates)`` for every record.

    ``records (key, source, external_id, game, language, number, set_code, variant, foil, name)``;
    ``cards (card_uid, game, language, number, set_code, box_code, variant, foil, name)``; ``overrides`` and
    ``links (source, external_id, card_uid)``.
    """
    known = lambda t, name: t.where("external_id IS NOT NULL").groupBy("source", "external_id").agg(F.min("card_uid").alias(name))
    did = F.sha2(F.to_json(F.struct(*TOLD)), 256)
    r = records.select(key, "source", "external_id", *TOLD).withColumn("_did", did)
    r = r.join(known(overrides, "_manual"), ["source", "external_id"], "left").join(known(links, "_exact"), ["source", "external_id"], "left")
    told = r.where("_manual IS NULL AND _exact IS NULL").select("_did", *TOLD).distinct().select("*", *pool_key("game", "language", "number"))
    fuzzy = decided(told, scored(told, cards, similar))
    sure = F.coalesce("_manual", "_exact")
    got = r.join(fuzzy, "_did", "left")
    how = F.when(F.col("_manual").isNotNull(), "manual").when(F.col("_exact").isNotNull(), "exact")
    return got.select(key, F.coalesce(sure, "card_uid").alias("card_uid"), F.when(sure.isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce(how, "resolved_by").alias("resolved_by"), F.coalesce(how, "reason").alias("reason"), "candidates")


def usable(resolved_by: Column, confidence: Column, least: float = 0.9) -> Column:
    """Manual and exact links always, fuzzy ones from ``least`` on."""
    return F.coalesce(resolved_by.isin("manual", "exact") | ((resolved_by == "fuzzy") & (confidence >= least)), F.lit(False))


# --- candidates for review ------------------------------------------------------------------------

PRIORITIES = ("same_art_across_languages", "reprint_across_sets", "alt_art_vs_base", "promo_vs_set", "lowest_confidence")
RENUMBERED = ("CN-S",)


def self_confidence(cards: DataFrame) -> DataFrame:
    """``(card_uid, confidence)``: how sure the resolver is of the catalogue's own entries."""
    told = cards.select(F.col("card_uid").alias("_did"), "game", "language", "number", "set_code", "variant", F.lit(None).cast("boolean").alias("foil"), "name").select("*", *pool_key("game", "language", "number"))
    return decided(told, scored(told, cards)).select(F.col("_did").alias("card_uid"), "confidence")


def review_ideas(cards: DataFrame) -> DataFrame:
    """``(card_uid, combo, priority, parent, siblings, confidence)``: each card's hardest reason to be reviewed.

    Groups are only counted, never collected; ``siblings`` is the number of other cards in the group.
    """
    c = cards.select("card_uid", "game", "language", "set_code", "variant", X.normal_number(F.trim("number")).alias("number"), F.lower(F.coalesce("name", F.lit(""))).alias("name"), F.nullif(F.lower(F.trim("artist")), F.lit("")).alias("artist"))
    none = F.lit(None).cast("string")

    def group(keys: list[str], rows: DataFrame, **counts: Column) -> DataFrame:
        g = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"), *[v.alias(k) for k, v in counts.items()])
        cond = F.lit(True)
        for k in keys:
            cond = cond & c[k].eqNullSafe(g[f"_{k}"])
        return c.join(g, cond)

    idea = lambda rows, place, parent=none, n=F.col("_n") - 1: rows.select("card_uid", F.lit(place).alias("_order"), parent.alias("parent"), n.cast("bigint").alias("siblings"))
    many = lambda col: F.count_distinct(col)
    languages = group(["game", "number"], c, k=many("language")).where("k > 1")
    artists = c.where("language = 'JP' AND artist IS NOT NULL").groupBy(F.col("game").alias("_game"), F.col("artist").alias("_artist")).agg(F.count(F.lit(1)).alias("_n"), F.min("card_uid").alias("_only"))
    renumbered = c.where(F.col("language").isin(*RENUMBERED)).join(artists, (F.col("game") == F.col("_game")) & (F.col("artist") == F.col("_artist")), "left")
    reprints = group(["game", "language", "name"], c.where("name != ''"), k=many("set_code")).where("k > 1")
    variants = group(["game", "number", "language"], c, k=many("variant")).where("k > 1")
    promos = group(["game", "language", "name"], c).where("_n > 1 AND (variant = 'promo' OR upper(set_code) LIKE 'P%')")
    sure = self_confidence(cards)
    n = cards.agg(F.floor(F.count(F.lit(1)) / 4).alias("_quarter"))  # one row
    weakest = ranked(sure, "confidence", "card_uid").join(F.broadcast(n)).where(F.col("place") <= F.col("_quarter") + 1)
    only = F.when(F.col("_n") == 1, F.col("_only"))
    all_ideas = idea(languages, 0)
    for more in (idea(renumbered, 0, only, only.isNotNull().cast("int")), idea(reprints, 1), idea(variants, 2), idea(promos, 3), idea(weakest, 4, none, F.lit(0))):
        all_ideas = all_ideas.unionByName(more)
    best = all_ideas.groupBy("card_uid").agg(F.min("_order").alias("_order"), F.max("parent").alias("parent"), F.max_by("siblings", F.struct(-F.col("_order"), "siblings")).alias("siblings"))
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    return best.join(sure, "card_uid").join(cards.select("card_uid", F.concat_ws(":", "game", "language").alias("combo")), "card_uid").select("card_uid", "combo", F.element_at(names, F.col("_order") + 1).alias("priority"), "parent", "siblings", "confidence")


def within_quota(ideas: DataFrame, quota: int) -> DataFrame:
    """The first ``quota`` ideas of every combo, hardest reason first, then the least sure."""
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    order = Window.partitionBy("combo").orderBy(place, "confidence", "card_uid")
    return ideas.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota)
