from pyspark.sql import functions as F

from tidegrain.functions import identity as I  # noqa: E741


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def L(v):
    return F.lit(v).cast("string")


def test_variants_of_numbers(spark):
    of = lambda n, size, game: one(spark, I.variant_of_number(L(n), F.lit(size).cast("int"), L(game)))
    assert of("227*/221", None, "riftbound") == "signature" and of("119a/298", None, "riftbound") == "alt_art" and of("119b/298", None, None) == "promo"
    assert of("227/221", None, "riftbound") == "overnumbered" and of("OGN-301", 298, "riftbound") == "overnumbered"
    assert of("OGN-301", None, "riftbound") is None and of("170/151", None, "pkmn") is None


def test_variants_of_ids(spark):
    of = lambda i, game: one(spark, I.variant_of_id(L(i), L(game)))
    assert of("EB01-006_p1", "optcg") == of("EB01-006_p", None) == "parallel" and of("EB01-006_P3", "optcg") == "parallel3" and of("EB01-006_r2", "optcg") == "reprint2"
    assert of("EB01-006_x4", "optcg") == "unknown_x4" and of("EB01-006", "optcg") is None and of("cel25c-15_A1", "pkmn") is None


def test_variants_of_rarities(spark):
    of = lambda r, n=None, lang=None, game=None: one(spark, I.variant_of_rarity(L(r), L(n), L(lang), L(game)))
    assert of("LR    +") == of("SR★★") == "parallel" and of("PR", game="optcg") == "parallel" and of("PR", game="other") == "base"
    assert of("Special Illustration Rare") == "sir" and of("SIR", lang="JP") == "sar" and of("Illustration rare") == "ar" and of("TR") == "treasure_rare"
    assert of("overnumbered serial") == "overnumbered" and of(None, "Luffy (Manga)") == "manga_rare" and of(None, "SAR of the sea") == "base" and of(None) == "base"


def test_which_variants_a_game_has(spark):
    has = lambda v, game: one(spark, I.is_variant(L(v), L(game)))
    assert has("sr", "pkmn") and not has("sr", "optcg") and has("sr", None) and has("parallel7", "optcg") and not has("parallel1", "optcg") and not has("holo2", "pkmn") and not has(None, "pkmn") and not has("", "pkmn")


def test_sets_rarities_and_grades(spark):
    assert one(spark, I.set_code_of(L("pkmn"), L("EN"), L("swsh07"))) == "swsh7" and one(spark, I.set_code_of(L("pkmn"), L("JP"), L("swsh07"))) == "swsh07"
    assert one(spark, I.parent_set_code(L("SV2aF"))) == "SV2a" and one(spark, I.parent_set_code(L("sv2a"))) is None and one(spark, I.parent_set_code(L("F"))) is None
    code = lambda hit: one(spark, I.set_code_in(L(hit)))
    assert code('{"set_id":"a1"}') == "a1" and code('{"set":{"code":"b2"}}') == "b2" and code('{"set":"c3"}') == "c3" and code('{"id":"swshp-SWSH001","localId":"SWSH001"}') == "swshp" and code('{"id":"a-b-9"}') == "a-b" and code("{}") == ""
    assert one(spark, I.rarity_key(L("Ｒare★ 日本!"))) == "ｒare日本"
    assert tuple(one(spark, I.rarity_with_source(L(""), L("Rare")))) == ("Rare", "en_fallback") and tuple(one(spark, I.rarity_with_source(L(None), L(None)))) == (None, "absent")
    grade = lambda k: tuple(one(spark, I.grade_in(L(k))))
    assert grade("PSA10") == grade("psa_10") == ("PSA", "10") and grade("CGC 9.5") == ("CGC", "9.5") and grade("PSA mint") == ("PSA", None) and grade("weird") == (None, None)


def test_cache_states(spark):
    state = lambda p, c, a, force=False: one(spark, I.cache_state(F.lit(p).cast("boolean"), F.lit(c).cast("int"), F.lit(a).cast("double"), 7, force))
    assert [state(None, None, None), state(True, 0, 1), state(True, 5, None), state(True, 5, 7), state(True, 5, 6.9), state(True, 5, 1, True)] == ["absent", "empty", "undated", "stale", "fresh", "forced"]
