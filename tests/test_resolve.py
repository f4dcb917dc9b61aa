from helpers import rows
from pyspark.sql import functions as F

from tidegrain.operators import resolve as R

RECORDS = "target_id bigint, source string, external_id string, game string, language string, number string, set_code string, variant string, foil boolean, name string, card_uid string"
CARDS = "card_uid string, game string, language string, number string, set_code string, box_code string, variant string, foil boolean, name string, artist string"
LINKS = "source string, external_id string, card_uid string"


def cards(spark, *more):
    c = [("a", "pkmn", "EN", "007/100", "s1", None, "base", True, "Dusk Luhaku", None), ("b", "pkmn", "EN", "7/100", "s2", "bx", "base", None, "Dusk Luhaku", None), ("c", "pkmn", "EN", "9/100", "s1", None, "base", None, "Marbo Pitak", None), ("d", "pkmn", "EN", "9/100", "s1", None, "alt_art", None, "Marbo Pitak", None)]
    return spark.createDataFrame(c + list(more), CARDS)


def test_cascade_penalties_and_refusals(spark):
    data = [
        (1, "x", "1", "pkmn", "EN", "8", "s1", None, None, "z"), (2, "x", "2", "pkmn", "EN", "8", "s1", None, None, "z"), (3, "x", "3", "pkmn", "EN", "7/100", "s1", None, None, "dunsk luhaku"),
        (4, "x", "4", "pkmn", "EN", "7/100", None, None, None, "dusk luhaku"), (5, "x", "5", "pkmn", "EN", "9/100", "s1", "alt_art", None, "Marbo Pitak"), (6, "x", "6", "pkmn", None, "9/100", "s1", None, None, "Marbo Pitak"),
        (7, "x", "7", "none", "EN", "9/100", "s1", None, None, "Marbo Pitak"), (8, "x", "8", "pkmn", "JP", "9/100", "s1", None, None, "Marbo Pitak"), (9, "x", "9", "pkmn", "EN", "9/100", "s9", "promo", False, "Marbo Pit"),
        (10, "x", None, "pkmn", "EN", "7/100", "BX", None, False, "Dusk Luhaku"), (11, None, None, None, None, None, None, None, None, None), (12, "x", "12", "pkmn", "EN", "7/100", "s1", None, None, ""),
    ]
    records = spark.createDataFrame([(*d, "clash") for d in data], RECORDS)
    over, links = spark.createDataFrame([("x", "1", "m")], LINKS), spark.createDataFrame([("x", "1", "e"), ("x", "2", "e"), ("x", "2", "f")], LINKS)
    got = {r["target_id"]: r for r in R.resolve(records, cards(spark), over, links).collect()}
    short = {k: (r["card_uid"], r["resolved_by"], r["reason"]) for k, r in got.items()}
    assert short[1] == ("m", "manual", "manual") and short[2] == ("e", "exact", "exact")
    assert short[3] == ("a", "fuzzy", "fuzzy")  # a typo in the first letters; the other set is marked down
    assert short[4] == (None, None, "ambiguous") and got[4]["candidates"] == "a,b"
    assert short[5] == ("d", "fuzzy", "fuzzy")
    assert short[6][2] == "no_language" and short[7][2] == short[11][2] == "unknown_game" and short[8][2] == "empty_pool" and got[6]["confidence"] == 0.0
    assert short[9][2] == "ambiguous" and short[12][2] == "ambiguous" and got[12]["confidence"] == 0.0
    assert short[10] == ("b", "fuzzy", "fuzzy") and got[10]["confidence"] == 1.0  # its box code counts as its set; unknown foil takes nothing off
    assert len(got) == 12


def test_empty_tables(spark):
    r, c, k = spark.createDataFrame([], RECORDS), cards(spark).limit(0), spark.createDataFrame([], LINKS)
    assert R.resolve(r, cards(spark), k, k).count() == 0
    one = spark.createDataFrame([(1, "x", "1", "pkmn", "EN", "8", "s1", None, None, "z", None)], RECORDS)
    assert rows(R.resolve(one, c, k, k).select("reason")) == [("empty_pool",)]
    assert R.review_ideas(c).count() == 0


def test_repeated_records_each_get_a_row(spark):
    one = (1, "x", None, "pkmn", "EN", "7/100", "s1", None, None, "Dusk Luhaku", None)
    k = spark.createDataFrame([], LINKS)
    got = R.resolve(spark.createDataFrame([one, one, (2, *one[1:])], RECORDS), cards(spark), k, k)
    assert rows(got.select("target_id", "card_uid")) == [(1, "a"), (1, "a"), (2, "a")]


def test_ideas_take_the_hardest_reason(spark):
    more = [("j", "pkmn", "JP", "7/100", "s1", None, "base", None, "ダスク", "Ann "), ("z", "pkmn", "CN-S", "55/90", "cs", None, "base", None, "夕", "ann"), ("p", "pkmn", "EN", "1", "P1", None, "promo", None, "Solo", None)]
    got = {r["card_uid"]: r for r in R.review_ideas(cards(spark, *more)).collect()}
    assert got["a"]["priority"] == got["j"]["priority"] == "same_art_across_languages" and got["j"]["siblings"] == 2
    assert got["z"]["parent"] == "j" and got["c"]["priority"] == "alt_art_vs_base" and got["c"]["siblings"] == 1
    quota = R.within_quota(R.review_ideas(cards(spark, *more)), 1)
    assert quota.groupBy("combo").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count() == 0
