"""Matching entities across sources without keys, with a confidence per match.

Soft-logic linkage: every candidate pair (record, entity) has a truth value between 0 and 1. Weighted
rules on agreement of number, set, total, name, rarity, language and variant pull it up or down by
squared hinge losses; exclusivity allows a record one entity in sum; transitivity ties the values of
records that describe the same printing. The sum is strictly convex and is minimised by the alternating
direction method of multipliers: the rules on one pair, exclusivity and transitivity each have their own copy of the
value, copies agree by averaging. The first is solved exactly in place by Newton steps on its piecewise quadratic,
exclusivity needs the sum over a record's candidates, transitivity the mean per hub (the printing the records share), a
mergeable aggregate that is brought back to the records. Rounds go on until no value moves by more than ``TOLERANCE``.

Values and their rules are partitioned by record once; a round only exchanges (record, entity, hub, value) of hubs that
have more than one record. All candidates take part, however little their own rules support them.

Candidates come from equality joins on normal forms (set and index; index and total; set and name
grams where the number is missing). Records equal in every descriptive field are solved once. The
value reached is the confidence; a record is matched to its best entity from ``ACCEPT`` on.

Defined cases: nulls in any field leave their rules out; records without any candidate or without
support are unmatched; repeated records each get their match; ties go to the smallest key; names of
any length are compared whole; empty tables give an empty result; only named columns are read.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrain.session import cut

#: Change of a value in a round under which the solver ends, and the penalty.
TOLERANCE, PENALTY = 5e-3, 4.0
#: Rounds after which the solver gives up; the values change by less than the tolerance long before.
MOST_ROUNDS = 200
NEWTON_STEPS = 6
#: Truth value from which a record is matched.
ACCEPT = 0.5

#: Language names and codes as sources write them.
LANGUAGES = {"en": "EN", "eng": "EN", "english": "EN", "jp": "JP", "ja": "JP", "jpn": "JP", "japanese": "JP", "zh-hans": "CN-S", "cn-s": "CN-S", "zh-cn": "CN-S", "zh-hant": "CN-T", "cn-t": "CN-T", "zh-tw": "CN-T"}
#: Patterns in a listing's name that tell a variant, most specific first.
VARIANT_WORDS = (
    (r"(?i)\bmanga\b", "manga_rare"), (r"(?i)\bparallel\b", "parallel"), (r"(?i)\bsign(ed|ature)\b", "signature"), (r"(?i)\bovernumber", "overnumbered"),
    (r"(?i)\bpromo\b", "promo"), (r"(?i)\b(SIR|special art)\b", "sir"), (r"(?i)(\balt(ernate)? art\b|\bAA\b)", "alt_art"),
)
#: Notes of sellers that are no part of a name.
SELLER_NOTES = r"(?i)(\(see scan\)|\*[^*]*\*|\btcg single\b|\b1x\b|\bNM\b|\bpack fresh\b|\(promo print\)|\bpromo print\b|\bpromo\b|\(special art\)|\bspecial art\b|\bSIR\b|\bAA\b|\balternate art\b|\balt art\b|\bmanga (art|panel|alt)\b|\bparallel( art| foil)?\b|\bsigned foil\b|\bmanga\b|\bsignature\b|\bovernumbered\b|\[[^]]*\]|\([^)]*\))"
#: Variants that a record must name itself.
NAMED_ONLY = ("parallel", "manga_rare")

#: Rule weights: pull up on agreement, pull down on disagreement.
WEIGHTS = {"prior": (0.0, 0.35), "number": (1.0, 4.0), "set": (0.6, 4.0), "total": (0.4, 2.0), "name": (1.2, 1.5), "name_alone": (2.0, 5.0), "rarity": (0.3, 0.15), "language": (0.1, 6.0), "variant": (0.3, 8.0)}
TRANSITIVITY = 0.3


def _romanised(text: str) -> str:
    """Kana spelled out from their Unicode names, other characters as they are, all in lower case."""
    out: list[str] = []
    for ch in unicodedata.normalize("NFKC", text):
        name = unicodedata.name(ch, "")
        if name.startswith(("KATAKANA LETTER ", "HIRAGANA LETTER ")):
            kana = name.split()[-1].lower()
            if " SMALL " in name:
                if kana != "tu" and out and out[-1] and out[-1][-1] in "aeiou":
                    out[-1] = out[-1][:-1]
                    out.append(kana)
                continue
            out.append(kana)
        elif ch != "ー":
            out.append(ch.lower())
    return "".join(out)


_SOUNDS = (("tsu", "tu"), ("sh", "s"), ("th", "s"), ("ch", "t"), ("ph", "f"), ("hu", "fu"), ("x", "ks"), ("c", "k"), ("q", "k"), ("j", "z"), ("di", "zi"))


def skeleton(token: str) -> str:
    """The consonants of a token by sound, the same for kana and for Latin spellings of them."""
    latin = token.isascii()
    s = _romanised(token)
    if latin and s.endswith("r"):
        s = s[:-1]
    for a, b in _SOUNDS:
        s = s.replace(a, b)
    s = s.replace("l", "r")
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^bcdfghjkmnprstvwyz]", "", s))


def name_parts(names: pd.Series) -> pd.DataFrame:
    """``plain`` (words sorted, notes removed), ``kana`` (whether not Latin), ``sounds`` (skeletons), ``grams``."""
    rows = []
    for n in names:
        if not n:
            rows.append((None, None, [], []))
            continue
        s = unicodedata.normalize("NFKC", n)
        s = re.sub(SELLER_NOTES, " ", s)
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) or "゙" <= c <= "゚")
        s = unicodedata.normalize("NFC", s).lower()
        words = re.findall(r"[^\W_]+", s)
        if any(not w.isascii() for w in words):
            words = [x for w in words for x in re.findall(r"[a-z0-9]+|[^a-z0-9]+", w)]
        kana = any(not w.isascii() for w in words)
        sounds = sorted({k for w in words if len(w) > 2 and len(k := skeleton(w)) > 1})
        longest = max(words, key=len, default="")
        grams = sorted({longest[i : i + 3] for i in range(max(len(longest) - 2, 1))}) if longest else []
        rows.append((" ".join(sorted(words)) or None, kana, sounds, grams))
    return pd.DataFrame(rows, columns=["plain", "kana", "sounds", "grams"])


_WORDS = T.ArrayType(T.StringType())
_PARTS = T.StructType([T.StructField("plain", T.StringType()), T.StructField("kana", T.BooleanType()), T.StructField("sounds", _WORDS), T.StructField("grams", _WORDS)])


@F.pandas_udf(_PARTS)
def parts_of(names: pd.Series) -> pd.DataFrame:
    return name_parts(names)


def set_key(code: Column) -> Column:
    """Letters and number of a set code, whatever its case, marks, leading zeros or o for 0."""
    s = F.lower(F.regexp_replace(F.regexp_replace(code, r"(?i)^\s*set\s+", ""), r"[^A-Za-z0-9]", ""))
    letters, digits = F.regexp_extract(s, "^([a-z]+?)([0-9o]*)$", 1), F.translate(F.regexp_extract(s, "^([a-z]+?)([0-9o]*)$", 2), "o", "0")
    key = F.concat(letters, F.regexp_replace(digits, "^0+", ""))
    return F.when(s == "", None).when(letters == "", s).otherwise(key)


def number_parts(number: Column) -> Column:
    """``prefix`` (set code inside the number), ``index``, ``total``, ``star``, ``parallel`` of a collector number."""
    n = F.upper(F.regexp_replace(F.regexp_replace(number, r"(?i)^\s*(no\.?|#)\s*", ""), r"\s*([/-])\s*", "$1"))
    parallel = n.rlike(r"_P[0-9]+$")
    n = F.regexp_replace(n, r"_P[0-9]+$", "")
    long = r"^([A-Z]+[0-9O]{2})[- ]?([0-9]{3})$"
    plain = r"^([0-9]+)(\*?)(?:[/-]([0-9]+))?$"
    code = F.regexp_extract(n, long, 1)
    index = F.coalesce(F.nullif(F.regexp_extract(n, long, 2), F.lit("")), F.nullif(F.regexp_extract(n, plain, 1), F.lit("")))
    return F.struct(
        set_key(F.nullif(code, F.lit(""))).alias("prefix"), index.try_cast("int").alias("index"),
        F.nullif(F.regexp_extract(n, plain, 3), F.lit("")).try_cast("int").alias("total"), (F.regexp_extract(n, plain, 2) == "*").alias("star"), F.coalesce(parallel, F.lit(False)).alias("parallel"),
    )


def _language(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        out = F.when(F.lower(F.trim(code)) == k, F.lit(v)).otherwise(out)
    return out


def _rarity_key(rarity: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(rarity), "[^a-z0-9]", ""), F.lit(""))


def prepare_records(records: DataFrame) -> DataFrame:
    """Distinct descriptive contents of ``records`` in normal form, with ``rid``, and the hub they share."""
    fields = ["game", "language", "set_code", "number", "rarity", "name"]
    d = records.select(*fields).distinct()
    d = d.withColumn("rid", F.sha2(F.to_json(F.struct(*fields)), 256)).withColumn("p", number_parts(F.col("number"))).withColumn("nm", parts_of("name"))
    told = F.lit(None).cast("string")
    for pattern, v in reversed(VARIANT_WORDS):
        told = F.when(F.col("name").rlike(pattern), F.lit(v)).otherwise(told)
    told = F.when(F.col("p.parallel") & ~F.coalesce(told == "manga_rare", F.lit(False)), F.lit("parallel")).when(F.col("p.star"), F.lit("signature")).otherwise(told)
    out = d.select(
        "rid", *[F.col(f).alias(f"f_{f}") for f in fields], F.col("game").alias("game"), F.coalesce(set_key(F.col("set_code")), "p.prefix").alias("set"), F.col("p.index").alias("index"), F.col("p.total").alias("total"),
        F.col("p.star").alias("star"), F.when(F.col("number").isNotNull(), F.col("p.star")).alias("star_told"), _language(F.col("language")).alias("language"), told.alias("variant"), _rarity_key(F.col("rarity")).alias("rarity"), "nm",
    )
    hub = F.sha2(F.to_json(F.struct("game", "set", "index", "variant", "star", F.when(F.col("index").isNull() | F.col("set").isNull(), F.struct("total", "nm.plain", "rarity")))), 256)
    return out.withColumn("hub", hub)


def prepare_entities(entities: DataFrame) -> DataFrame:
    """Catalogue entries in the same normal form."""
    d = entities.withColumn("p", number_parts(F.col("number"))).withColumn("en", parts_of("name_en")).withColumn("jp", parts_of("name_jp"))
    return d.select(
        F.col("card_uid"), F.col("game").alias("c_game"), set_key(F.col("set_code")).alias("c_set"), F.col("p.index").alias("c_index"), F.col("p.total").alias("c_total"), F.col("p.star").alias("c_star"),
        F.col("language").alias("c_language"), F.col("variant").alias("c_variant"), _rarity_key(F.col("rarity")).alias("c_rarity"), "en", "jp",
    )


def candidates(r: DataFrame, c: DataFrame) -> DataFrame:
    """``(rid, card_uid)`` that share one of the blocking keys; no key is left to all pairs of a group."""
    key = lambda *cols: F.concat_ws("|", *cols)  # noqa: E731  concat_ws skips nulls, so callers filter them
    rk = [
        r.where("set IS NOT NULL AND index IS NOT NULL").select("rid", key(F.lit("a"), "game", "set", "index").alias("k")),
        r.where("set IS NULL AND index IS NOT NULL AND total IS NOT NULL").select("rid", key(F.lit("b"), "game", "index", "total").alias("k")),
        r.where("set IS NULL AND index IS NOT NULL AND total IS NULL").select("rid", "game", "index", F.explode("nm.sounds").alias("g")).select("rid", key(F.lit("c"), "game", "index", "g").alias("k")),
        r.where("set IS NOT NULL AND index IS NULL").select("rid", "game", "set", F.explode(F.concat("nm.sounds", "nm.grams")).alias("g")).select("rid", key(F.lit("d"), "game", "set", "g").alias("k")),
    ]
    sounds, grams = F.array_union("en.sounds", "jp.sounds"), F.array_union("en.grams", "jp.grams")
    ck = [
        c.select("card_uid", key(F.lit("a"), "c_game", "c_set", "c_index").alias("k")),
        c.where("c_total IS NOT NULL").select("card_uid", key(F.lit("b"), "c_game", "c_index", "c_total").alias("k")),
        c.select("card_uid", "c_game", "c_index", F.explode(sounds).alias("g")).select("card_uid", key(F.lit("c"), "c_game", "c_index", "g").alias("k")),
        c.select("card_uid", "c_game", "c_set", F.explode(F.array_union(sounds, grams)).alias("g")).select("card_uid", key(F.lit("d"), "c_game", "c_set", "g").alias("k")),
    ]
    left, right = rk[0], ck[0]
    for a, b in zip(rk[1:], ck[1:]):
        left, right = left.unionByName(a), right.unionByName(b)
    return left.join(right, "k").select("rid", "card_uid").distinct()


def _alike(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def name_similarity() -> Column:
    """Of the record's name to the catalogue's: by spelling where both have the script, else by sound."""
    same = lambda side: F.when(F.col("nm.kana") == F.col(f"{side}.kana"), _alike(F.col("nm.plain"), F.col(f"{side}.plain")))
    heard = F.array_union(F.coalesce("en.sounds", F.array()), F.coalesce("jp.sounds", F.array()))
    sound = F.when((F.size("nm.sounds") > 0) & (F.size(heard) > 0), F.when(F.arrays_overlap("nm.sounds", heard), F.lit(0.9)).otherwise(F.lit(0.1)))
    return F.coalesce(F.greatest(same("en"), same("jp")), sound)


def rules(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``rules``, an array of (level, weight, side) of their hinge losses, and where these pull ``z``.

    A rule of side 1 costs weight * (level - value) ** 2 below its level, one of side -1 the same above it.
    """
    agree = {
        "number": F.when(F.col("index").isNotNull() & F.col("c_index").isNotNull(), (F.col("index") == F.col("c_index")) & F.coalesce(F.col("star_told") == F.col("c_star"), F.lit(True))),
        "set": F.col("set") == F.col("c_set"),
        "total": F.col("total") == F.col("c_total"),
        "language": F.col("language") == F.col("c_language"),
        "rarity": F.col("rarity") == F.col("c_rarity"),
        "variant": F.when(F.col("variant").isNotNull() & F.col("index").isNotNull() & ~F.col("variant").isin(*NAMED_ONLY) & ~F.col("c_variant").isin(*NAMED_ONLY), None)
        .when(F.col("variant").isNotNull(), F.col("variant") == F.col("c_variant")).when(F.col("c_variant").isin(*NAMED_ONLY), F.lit(False)),
    }
    up = [F.when(agree[k], _rule(F.lit(1.0), F.lit(WEIGHTS[k][0]), 1)) for k in agree]
    down = [F.when(~agree[k], _rule(F.lit(0.0), F.lit(WEIGHTS[k][1]), -1)) for k in agree]
    sim = name_similarity()
    numbered = F.coalesce(agree["number"], F.lit(False))
    # Without a number, alike in most letters is no support yet: names share titles and endings.
    sim = F.when(numbered | sim.isNull(), sim).otherwise(F.least(F.greatest((sim - 0.7) / 0.25, F.lit(0.0)), F.lit(1.0)))
    for pull, k, side in ((up, 0, 1), (down, 1, -1)):  # without a number the name carries the match
        weight = F.when(numbered, WEIGHTS["name"][k]).otherwise(WEIGHTS["name_alone"][k])
        pull.append(F.when(sim.isNotNull(), _rule(sim, weight, side)))
    down.append(_rule(F.lit(0.0), F.lit(WEIGHTS["prior"][1]), -1))
    pairs = pairs.withColumn("rules", F.filter(F.array(*up, *down), lambda s: s.isNotNull()))
    weigh = lambda f: F.aggregate("rules", F.lit(0.0), lambda acc, p: acc + f(p))
    return pairs.withColumn("z", weigh(lambda p: p["weight"] * p["level"]) / weigh(lambda p: p["weight"]))


def _rule(level: Column, weight: Column, side: int) -> Column:
    return F.struct(level.alias("level"), weight.alias("weight"), F.lit(float(side)).alias("side"))


def _nearest(rules: Column, v: Column) -> Column:
    """The value that minimises the rules' losses plus ``PENALTY`` / 2 times its squared distance to ``v``."""
    start = lambda: F.struct((F.lit(PENALTY) * v).alias("n"), F.lit(PENALTY).alias("d"))

    def step(y: Column, _: Column) -> Column:
        broken = lambda p: p["side"] * (p["level"] - y) > 0
        add = lambda acc, p: F.when(broken(p), F.struct((acc["n"] + 2 * p["weight"] * p["level"]).alias("n"), (acc["d"] + 2 * p["weight"]).alias("d"))).otherwise(acc)
        return F.aggregate(rules, start(), add, lambda acc: acc["n"] / acc["d"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), v, step)


def _hub_means(s: DataFrame) -> DataFrame:
    """``(rid, means)``: per record of a shared hub the mean value of each of its entities over the hub's records."""
    told = s.where("shared").select("rid", "hub", "card_uid", "z")
    mean = told.groupBy("hub", "card_uid").agg(F.avg("z").alias("h"))
    back = told.select("rid", "hub", "card_uid").join(mean, ["hub", "card_uid"])
    return back.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("card_uid", "h"))).alias("means"))  # the candidates of one record


def solve(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``(rid, card_uid, hub, truth)``: the minimum, to within ``tolerance`` a round.

    ``pairs (rid, card_uid, hub, rules, z)``. Per pair: ``z`` the consensus, one scaled dual per copy.
    """
    rho, w = PENALTY, TRANSITIVITY
    records = pairs.groupBy("hub").agg(F.count_distinct("rid").alias("_r")).where("_r > 1").select(F.col("hub").alias("_hub"))
    zero = F.lit(0.0)
    s = pairs.join(records, F.col("hub") == F.col("_hub"), "left").select("rid", "card_uid", "hub", F.col("_hub").isNotNull().alias("shared"), "rules", "z", zero.alias("u"), zero.alias("ue"), zero.alias("uh"), F.lit(1.0).alias("moved"))
    s = cut(s.repartition("rid"))
    own = Window.partitionBy("rid")  # the candidates of one record
    for _ in range(MOST_ROUNDS):
        z, v = F.col("z"), F.col("z") - F.col("uh")
        r = s.join(_hub_means(s), "rid", "left").withColumn("spent", F.sum(z - F.col("ue")).over(own)).withColumn("n", F.count(F.lit(1)).over(own))
        h = F.when(F.col("shared"), F.col("means")[F.col("card_uid")])
        r = r.select(
            "rid", "card_uid", "hub", "shared", "rules", "z", "u", "ue", "uh", _nearest(F.col("rules"), z - F.col("u")).alias("y"),
            (z - F.col("ue") - F.greatest(F.col("spent") - 1, zero) / F.col("n")).alias("ye"), F.coalesce((2 * w * h + rho * v) / (2 * w + rho), v).alias("yh"),
        )
        mean = (F.col("y") + F.col("u") + F.col("ye") + F.col("ue") + F.col("yh") + F.col("uh")) / 3
        r = r.withColumn("zn", F.least(F.greatest(mean, zero), F.lit(1.0)))
        s = r.select("rid", "card_uid", "hub", "shared", "rules", F.col("zn").alias("z"), *[(F.col(d) + F.col(y) - F.col("zn")).alias(d) for d, y in (("u", "y"), ("ue", "ye"), ("uh", "yh"))], F.abs(F.col("zn") - z).alias("moved"))
        s = cut(s)  # every round reads it three times
        if (s.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return s.select("rid", "card_uid", "hub", F.col("z").alias("truth"))


def link(records: DataFrame, entities: DataFrame, key: str = "target_id") -> DataFrame:
    """``(key, card_uid, confidence)``: each record that lists an entity of the catalogue."""
    r = cut(prepare_records(records))
    c = cut(prepare_entities(entities))
    pairs = candidates(r, c).join(r, "rid").join(c, "card_uid")
    truth = solve(rules(pairs).select("rid", "card_uid", "hub", "rules", "z"))
    first = Window.partitionBy("rid").orderBy(F.desc("truth"), "card_uid")
    best = truth.where(F.col("truth") >= ACCEPT).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    fields = ["game", "language", "set_code", "number", "rarity", "name"]
    every = records.select(key, F.sha2(F.to_json(F.struct(*fields)), 256).alias("rid"))
    return every.join(best.select("rid", "card_uid", "truth"), "rid").select(key, "card_uid", F.round("truth", 4).alias("confidence"))
