"""Which printing of a card a record means: variants, set codes, rarities and grades as Column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrain.functions import text as X

GAMES = ("optcg", "pkmn", "riftbound")
LANGUAGES = ("EN", "JP", "CN-S", "CN-T")
#: Language names and codes as sources write them.
LANGUAGE_NAMES = {"en": "EN", "eng": "EN", "english": "EN", "jp": "JP", "ja": "JP", "jpn": "JP", "japanese": "JP", "zh-hans": "CN-S", "cn-s": "CN-S", "zh-cn": "CN-S", "zh-hant": "CN-T", "cn-t": "CN-T", "zh-tw": "CN-T"}
#: Variants of all games, then of single games.
SHARED_VARIANTS = ("alt_art", "base", "holo", "parallel", "promo", "reprint", "serialized")
GAME_VARIANTS = {
    "optcg": ("manga_rare", "treasure_rare"),
    "pkmn": ("ar", "gold_secret", "hr", "rainbow_secret", "sar", "sir", "sr", "ssr", "ur"),
    "riftbound": ("overnumbered", "signature", "sp"),
}
#: Variants that carry a number from 2 on.
NUMBERED = ("parallel", "reprint")
#: Patterns in a rarity that tell the variant, first match wins; the third field: tried on names too.
RARITY_PATTERNS = (
    ("treasure_rare", r"treasure|\btr\b", True), ("manga_rare", r"\bmanga\b", True), ("signature", r"\bsignature\b", True), ("overnumbered", r"overnumber", True), ("serialized", r"serial|\bnumbered\b", True),
    ("sir", r"special illustration|\bsir\b", False), ("sar", r"special art rare|\bsar\b", False), ("ar", r"\billustration rare\b|\bart rare\b|\bar\b", False), ("promo", r"\bpromo\b", True), ("parallel", r"parallel", True),
    ("alt_art", r"\balt(?:ernate)?\b|\bshowcase\b", True),
)
#: Other spellings of set codes, by game and language.
SET_ALIASES = {("pkmn", "EN", "sv151"): "sv03.5", ("pkmn", "EN", "swsh07"): "swsh7"}
#: Grades as sources write them.
GRADES = {"raw": "raw", "ungraded": "raw", "loose": "raw", "10.0": "10", "9.0": "9", "8.0": "8"} | {str(g): str(g) for g in range(1, 11)} | {f"{g}.5": f"{g}.5" for g in range(1, 10)}
GRADERS = ("PSA", "CGC", "BGS", "SGC", "TAG")


def lookup(column: Column, table: Mapping[str, str]) -> Column:
    """The value of a small fixed table for ``column``, null where it has none."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), column)


def _applies(game: Column, only: str) -> Column:
    """Whether a rule of one game applies: an unknown game takes every rule."""
    return F.coalesce(game == only, F.lit(True))


def variant_of_number(number: Column, set_size: Column, game: Column) -> Column:
    """What the number tells: a star, a suffix or an index above the set (one game only); null where it tells nothing."""
    p = X.collector_number(number)
    told = F.when(p["starred"], "signature").when(p["suffix"] == "a", "alt_art").when(p["suffix"] == "b", "promo").when(X.above_set_size(p, set_size), "overnumbered")
    return F.when(_applies(game, "riftbound"), told)


def variant_of_id(external_id: Column, game: Column) -> Column:
    """What a source's own id tells in its last ``_`` part (one game only); letters without a meaning stay apart from base."""
    letter, index = F.lower(F.regexp_extract(external_id, "_([a-zA-Z])([0-9]*)$", 1)), F.regexp_extract(external_id, "_([a-zA-Z])([0-9]*)$", 2)
    stem = lookup(letter, {"p": "parallel", "r": "reprint"})
    told = F.when(stem.isNull(), F.concat(F.lit("unknown_"), letter, index)).when(index.isin("", "1"), stem).otherwise(F.concat(stem, index))
    return F.when(_applies(game, "optcg") & (letter != ""), told)


def variant_of_rarity(rarity: Column, name: Column, language: Column, game: Column) -> Column:
    """What the rarity tells, else the name, else ``base``."""
    r, n = F.lower(F.coalesce(rarity, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    told = F.lit(None).cast("string")
    for token, pattern, named in reversed(RARITY_PATTERNS):
        told = F.when(n.rlike(pattern), token).otherwise(told) if named else told
    for token, pattern, _ in reversed(RARITY_PATTERNS):
        value = F.when(language.isin("JP", "CN-S", "CN-T"), "sar").otherwise("sir") if token == "sir" else F.lit(token)
        told = F.when(r.rlike(pattern), value).otherwise(told)
    return F.when(r.rlike(r"[+★☆]"), "parallel").when((game == "optcg") & (F.trim(r) == "pr"), "parallel").otherwise(F.coalesce(told, F.lit("base")))


def variant_of(number: Column, set_size: Column, external_id: Column, rarity: Column, name: Column, language: Column, game: Column) -> Column:
    """The number's word before the id's before the rarity's."""
    return F.coalesce(variant_of_number(number, set_size, game), variant_of_id(external_id, game), variant_of_rarity(rarity, name, language, game))


def is_variant(token: Column, game: Column) -> Column:
    """Whether a game has this variant; an unknown game (null) has those of all."""
    listed = token.isin(*SHARED_VARIANTS)
    for g, own in GAME_VARIANTS.items():
        listed = listed | (token.isin(*own) & _applies(game, g))
    stem, index = F.regexp_extract(token, "^(.*?)([0-9]+)$", 1), F.regexp_extract(token, "^(.*?)([0-9]+)$", 2)
    return F.coalesce(listed | (stem.isin(*NUMBERED) & ~index.isin("0", "1")), F.lit(False))


def set_code_of(game: Column, language: Column, code: Column) -> Column:
    """A set code in the catalogue's spelling; codes without an alias pass."""
    known = lookup(F.concat_ws(":", game, language, code), {":".join(k): v for k, v in SET_ALIASES.items()})
    return F.coalesce(known, code)


def parent_set_code(code: Column) -> Column:
    """The Japanese parent of a Traditional Chinese set code (its suffix F removed), null for others."""
    return F.nullif(F.regexp_extract(F.trim(code), "^(.+)[fF]$", 1), F.lit(""))


def set_code_in(hit: Column) -> Column:
    """The set code in a payload: set_id, set as text or object, else the id without its local part or its last ``-`` part."""
    at = lambda p: F.nullif(F.get_json_object(hit, p), F.lit(""))
    ident, local = at("$.id"), F.coalesce(at("$.localId"), at("$.local_id"))
    whole = F.when(~F.coalesce(at("$.set"), F.lit("")).startswith("{"), at("$.set"))
    object_part = F.coalesce(at("$.set.id"), at("$.set.code"))
    cut = F.when(ident.endswith(F.concat(F.lit("-"), local)), F.substr(ident, F.lit(1), F.length(ident) - F.length(local) - 1))
    return F.coalesce(at("$.set_id"), object_part, whole, cut, F.nullif(F.regexp_extract(ident, "^(.*)-[^-]*$", 1), F.lit("")), F.lit(""))


def rarity_key(rarity: Column) -> Column:
    """A rarity's letters and digits of any script in lower case."""
    return F.regexp_replace(F.lower(rarity), r"[^\p{L}\p{N}]", "")


def era(release_date: Column) -> Column:
    """The year as text, ``unknown`` without a date."""
    return F.coalesce(F.year(release_date).cast("string"), F.lit("unknown"))


def rarity_with_source(own: Column, parent: Column) -> Column:
    """``(rarity, told_by)``: the card's own rarity, else its English parent's, else none."""
    o, p = F.nullif(own, F.lit("")), F.nullif(parent, F.lit(""))
    return F.struct(F.coalesce(o, p).alias("rarity"), F.when(o.isNotNull(), "self").when(p.isNotNull(), "en_fallback").otherwise("absent").alias("told_by"))


def grade_in(key: Column) -> Column:
    """``(grader, grade)`` of keys like ``PSA10``, ``psa_10`` or ``CGC 9.5``; nulls for what is none."""
    t = F.upper(F.trim(F.translate(key, "_-", "  ")))
    grader = F.nullif(F.regexp_extract(t, f"^({'|'.join(GRADERS)})", 1), F.lit(""))
    return F.struct(grader.alias("grader"), lookup(F.lower(F.trim(F.regexp_replace(t, f"^({'|'.join(GRADERS)})", ""))), GRADES).alias("grade"))


def cache_state(present: Column, cards: Column, age_days: Column, most_days: float, force: bool = False) -> Column:
    """absent, empty, undated, stale, forced or fresh."""
    fresh = "forced" if force else "fresh"
    return F.when(~F.coalesce(present, F.lit(False)), "absent").when(F.coalesce(cards, F.lit(0)) == 0, "empty").when(age_days.isNull(), "undated").when(age_days >= most_days, "stale").otherwise(fresh)
