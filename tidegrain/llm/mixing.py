"""Mixing sources to target shares of the total size along a low-discrepancy schedule.

Slot i of the mix takes the point frac((i + 1/2) / golden ratio) through the cumulative target shares;
so every stretch of the mix holds the sources in their shares. A source's slots are ranked, its
documents, in an order shuffled by hash, are laid end to end and cut into blocks of equal size, and
rank r takes block r; after its last document a source starts again, at most ``max_repeats`` times in
all. A document belongs to the block in which it begins and is never split.

The total is, unless given, the largest at which every source that has documents still reaches its
share within its repeats; given a larger one, sources run out and their later slots stay empty. The
queries give ``corpus_total``, so that no scarce source decides how much of the others is used.

No source is summed or ranked in one task: prefix sums and ranks are taken within buckets of bounded
size and offset by one row per source and bucket. Sources are a table like any other, of any number of rows: a
slot finds its source through the cell of a grid in which its point lies, an equality join, and an exact test of the
source's half-open interval; only the number of slots reaches the driver.

Defined cases: sources without a weight, and documents without a source or of size 0, take no part;
listed sources without documents get no slot, the others keep their proportions; null shares or
repeats count as 0; repeated ids are separate documents; empty tables give an empty result; only
named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.session import cut, small

BLOCK_TOKENS = 4096
#: Cells of the grid over the cumulative shares.
CELLS = 4096
#: Documents or slots that one task orders.
BUCKET = 50_000
GOLDEN = (math.sqrt(5) - 1) / 2


def corpus_total(sizes: DataFrame, weights: DataFrame) -> int:
    """The size of all documents whose source is listed with a share and repeats."""
    listed = weights.where("target_share > 0 AND max_repeats > 0").select("source")
    return sizes.where("tokens > 0").join(listed, "source", "left_semi").agg(F.sum("tokens")).first()[0] or 0


def plan(sizes: DataFrame, weights: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS) -> tuple[DataFrame, int]:
    """``(source, size, n, low, upto, repeats)`` per source with documents and a weight, and the number of slots."""
    found = sizes.where("source IS NOT NULL AND tokens > 0").groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n"))
    listed = weights.where("target_share > 0 AND max_repeats > 0 AND source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    use = listed.join(found, "source")
    order = Window.orderBy("source")  # one row per source
    before = F.coalesce(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    every = F.sum("share").over(Window.partitionBy(F.lit(0)))
    use = cut(use.select("source", "size", "n", "repeats", "share", every.alias("_all"), (before / every).alias("low"), F.lead(F.lit(0)).over(order).isNull().alias("_last")))
    upto = F.when(F.col("_last"), 2.0).otherwise(F.col("low") + F.col("share") / F.col("_all"))
    reach = use.agg(F.min(F.col("size") * F.col("repeats") * F.col("_all") / F.col("share"))).first()[0]
    slots = 0 if reach is None else int(reach // block) if total is None else math.ceil(total / block)
    # An interval begins where the one before it ends, to the last bit.
    low = F.coalesce(F.lag(upto).over(order), F.lit(0.0))
    return use.select("source", "size", "n", low.alias("low"), upto.alias("upto"), "repeats"), slots


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """``(slot, source, rank)``: the source of every slot and its rank among the source's slots."""
    cell = lambda c: F.floor(F.least(c, F.lit(1.0)) * CELLS)
    grid = sources.select(F.col("source").alias("source"), "low", "upto", F.explode(F.sequence(cell(F.col("low")), cell(F.col("upto")))).alias("cell"))
    point = F.pmod((F.col("id") + F.lit(0.5)) * F.lit(GOLDEN), F.lit(1.0))
    s = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", cell(F.col("point")))
    s = s.join(small(grid), "cell").where((F.col("low") <= F.col("point")) & (F.col("point") < F.col("upto"))).select("slot", "source", F.floor(F.col("slot") / BUCKET).alias("chunk"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = s.groupBy("source", "chunk").count().select("source", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    return s.withColumn("inside", inside).join(offset, ["source", "chunk"]).select("slot", "source", (F.col("offset") + F.col("inside")).alias("rank"))


def starts(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``(source, key, tokens, start, size, repeats)``: documents in shuffled order with the size before each."""
    order = F.xxhash64("key", F.lit(seed))
    d = sizes.where("tokens > 0").select("source", "key", "tokens").join(small(sources.select("source", "size", "n", "repeats")), "source").withColumn("h", order)
    d = d.withColumn("bucket", F.pmod(F.shiftright("h", 7), F.greatest(F.ceil(F.col("n") / BUCKET), F.lit(1))))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("inside", inside).join(offset, ["source", "bucket"]).select("source", "key", "tokens", (F.col("offset") + F.col("inside")).alias("start"), "size", "repeats")


def mix(sizes: DataFrame, weights: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """``(slot, source, key, repeat, tokens)``: the documents of the mix, slot by slot.

    ``sizes (key, source, tokens)``; ``weights (source, target_share, max_repeats)``.
    """
    sources, slots = plan(sizes, weights, total, block)
    turn = starts(sizes, sources, seed).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    turn = turn.withColumn("rank", F.floor((F.col("start") + F.col("repeat") * F.col("size")) / block))
    got = turn.join(schedule(sources, slots), ["source", "rank"])
    return got.select("slot", "source", "key", F.col("repeat").cast("int").alias("repeat"), "tokens")


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """Per listed source its target, the share reached and what it falls short by, its size in the mix and the most repeats used."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max(F.col("repeat") + 1).alias("repeats"))
    all_tokens = got.agg(F.sum("tokens").alias("all"))  # one row
    out = weights.select("source", "target_share", "max_repeats").join(got, "source", "left").join(small(all_tokens))
    actual = F.coalesce(F.round(F.col("tokens") / F.col("all"), 6), F.lit(0.0))
    return out.select(
        "source", "target_share", actual.alias("actual_share"), F.greatest(F.round(F.col("target_share") - actual, 6), F.lit(0.0)).alias("short_by"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("repeats", F.lit(0)).alias("repeats"), "max_repeats",
    )


def prepared(sizes: DataFrame) -> DataFrame:
    """``sizes`` written once, as the plan and the mix both read it."""
    return cut(sizes)
