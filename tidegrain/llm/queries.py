"""Queries of the text and record problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain.llm import encoding, linkage, mixing, packing, tokens, vocabulary
from tidegrain.llm.oracles import ORACLES  # noqa: F401
from tidegrain.sources.tables import table


def p3_links(spark: SparkSession, root: str) -> DataFrame:
    """Every target that lists a catalogued card, with the confidence of the match."""
    return linkage.link(table(spark, root, "targets"), table(spark, root, "cards"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Every target with the card it lists."""
    return p3_links(spark, root).select("target_id", "card_uid")


def _rarities(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "targets").where("game = 'pkmn'").select(F.col("target_id").alias("id"), F.col("rarity").alias("value"))
    vocab = table(spark, root, "rarity_vocabulary").where("game = 'pokemon'").select(F.col("rarity_id").alias("entry_id"), F.col("rarity").alias("entry"))
    tied = spark.sql(
        """
        WITH t AS (SELECT target_id AS id, lower(regexp_replace(regexp_replace(set_code, '^set ', ''), '[^A-Za-z0-9]', '')) AS s, CAST(regexp_extract(number, '([0-9]{1,9})[*]?( *[/-] *[0-9]+)?$', 1) AS BIGINT) AS i
          FROM {targets} WHERE game = 'pkmn' AND number RLIKE '[0-9]{1,9}[*]?( *[/-] *[0-9]+)?$'),
        c AS (SELECT lower(regexp_replace(set_code, '[^A-Za-z0-9]', '')) AS s, CAST(regexp_extract(number, '([0-9]{1,9})[*]?( *[/-] *[0-9]+)?$', 1) AS BIGINT) AS i, rarity AS entry
          FROM {cards} WHERE game = 'pkmn' AND rarity IS NOT NULL AND variant NOT IN ('parallel', 'manga_rare') AND number RLIKE '[0-9]{1,9}[*]?( *[/-] *[0-9]+)?$')
        SELECT id, entry FROM t JOIN c ON t.s = c.s AND t.i = c.i""".replace("{1,9}", "{{1,9}}"),
        targets=table(spark, root, "targets"), cards=table(spark, root, "cards"),
    )
    return vocabulary.map_to_vocabulary(rows, vocab, tied)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Per target of game pkmn the rarity entry meant, -1 where none is."""
    return _rarities(spark, root).select(F.col("id").alias("target_id"), F.col("entry_id").cast("int").alias("rarity_id"))


def _sizes(spark: SparkSession, root: str, *keep: str) -> DataFrame:
    return mixing.prepared(tokens.with_sizes(table(spark, root, "documents"), ["doc_id", *keep]))


def p8_pack(spark: SparkSession, root: str) -> DataFrame:
    """Every document, or piece of one longer than a container, with its container."""
    packed = packing.pack(_sizes(spark, root), "doc_id", "tokens")
    return packed.select("doc_id", "piece", F.col("size").alias("tokens"), "container")


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """Containers by how full they are, in tenths, with the share of their capacity used."""
    one = p8_pack(spark, root).groupBy("container").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    by = one.groupBy(F.ceil(F.col("used") * 10 / packing.CAPACITY).alias("tenths"))
    return by.agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"))


def _mixed(spark: SparkSession, root: str) -> DataFrame:
    sizes = _sizes(spark, root, "source").select(F.col("doc_id").alias("key"), "source", "tokens")
    weights = table(spark, root, "source_weights")
    return mixing.mix(sizes, weights, total=mixing.corpus_total(sizes, weights))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    """The documents of the mix in order of their slots."""
    return _mixed(spark, root).select("slot", "source", F.col("key").alias("doc_id"), "repeat", "tokens")


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return mixing.shares(_mixed(spark, root), table(spark, root, "source_weights"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that were damaged by a wrong decoding."""
    return encoding.find_damage(table(spark, root, "documents")).where("damaged").select("doc_id")


def p10_restored(spark: SparkSession, root: str) -> DataFrame:
    """Damaged documents with the encodings involved and the text as far as it can be restored."""
    return encoding.find_damage(table(spark, root, "documents")).where("damaged").select("doc_id", "states", "restored", "lossless")


QUERIES = {
    "p3_found": p3_found,
    "p3_links": p3_links,
    "p6_found": p6_found,
    "p8_pack": p8_pack,
    "p8_containers": p8_containers,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
