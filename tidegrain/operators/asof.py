"""As-of join on knowledge time: for each event the row that was known and in force.

Each row is in force from ``observed`` until it is replaced, or until a row of the same series that
wins over it and is never replaced becomes known; after that it can never be the answer. Both ends
together give short half-open intervals. They are decomposed into dyadic nodes, (level, index) pairs:
the one or two neighbours, at the level of the interval's own length, that cover it. An event carries
the one node of every level that encloses it, so the join is an equi-join on (series, level, index);
an exact half-open test and a mergeable maximum in the order of precedence follow. No range join, no
sort of a whole series. A series travels as 96 bits of hashes of its columns, nulls included.

Defined cases: null series columns equal null; events or rows without a time never match; events
without a match are left out; ties end with the highest row id; repeated rows are alternatives with
the same precedence, of which the highest id wins; empty inputs give an empty result; only named
columns are read, so extra or clashing ones do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.operators.corrections import replaced_at

#: Levels of the dyadic tree; the leaves are LEAF_SECONDS wide and the tree spans ORIGIN + 2**LEVELS leaves.
LEVELS = 22
LEAF_SECONDS = 3600
ORIGIN = "1800-01-01 00:00:00"


def leaf(ts: Column) -> Column:
    """The leaf that holds ``ts``, clamped to the tree; null for null."""
    seconds = F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(F.lit(ORIGIN).cast("timestamp"))
    inside = F.least(F.greatest(F.floor(seconds / LEAF_SECONDS), F.lit(0)), F.lit(2**LEVELS - 1)).cast("bigint")
    return F.when(ts.isNotNull(), inside)  # least and greatest skip nulls


def cover(lo: Column, hi: Column) -> Column:
    """The dyadic nodes that cover the leaves ``lo .. hi - 1``: one or two of (level, index).

    The level is the lowest whose nodes are as long as the interval, so two neighbours suffice.
    """
    level = F.least(F.ceil(F.log2(F.greatest(hi - lo, F.lit(1)))), F.lit(LEVELS)).cast("int")
    node = lambda at: F.struct(level.alias("level"), F.floor(at / F.pow(F.lit(2.0), level)).cast("bigint").alias("index"))
    return F.array_distinct(F.array(node(lo), node(hi - 1)))


def enclosing(at: Column) -> Column:
    """The node of every level that encloses leaf ``at``."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.struct(level.cast("int").alias("level"), F.floor(at / F.pow(F.lit(2.0), level)).cast("bigint").alias("index")))


def series_key(series: Sequence[str]) -> list[Column]:
    """Two hashes, 64 and 32 bits, of the columns and of which of them are null."""
    parts = [x for c in series for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts).alias("_k1"), F.hash(*parts).alias("_k2")]


def reigns(log: DataFrame, series: Sequence[str], *, as_of: str = "as_of", observed: str = "observed_at", row_id: str = "row_id", supersedes: str = "supersedes") -> DataFrame:
    """``_k1, _k2, _as_of, _row_id`` and the half-open ``[_from, _until)``; ``_until`` null is open.

    ``_until`` is the replacement or the first time a never-replaced row of higher precedence was known.
    That running minimum is taken within (series, quarter of as_of) and carried over by one row per quarter,
    so no series is sorted whole.
    """
    rows = log.select(*series_key(series), F.col(as_of).alias("_as_of"), F.col(observed).alias("_from"), F.col(row_id).alias("_row_id"))
    rows = rows.where(F.col("_from").isNotNull() & F.col("_as_of").isNotNull())
    gone = replaced_at(log, supersedes, observed)
    rows = rows.join(gone, rows["_row_id"] == gone["replaced_id"], "left").drop("replaced_id")
    firm = F.when(F.col("replaced_at").isNull(), F.col("_from"))
    block = ["_k1", "_k2", "_quarter"]
    rows = rows.withColumn("_quarter", (F.year("_as_of") * 4 + F.quarter("_as_of")).cast("int")).repartition(*block)  # serves the window and the aggregate
    quarter = rows.groupBy(*block).agg(F.min(firm).alias("_quarter_firm"))
    later = Window.partitionBy("_k1", "_k2").orderBy(F.desc("_quarter")).rowsBetween(Window.unboundedPreceding, -1)
    quarter = quarter.select(*block, F.min("_quarter_firm").over(later).alias("_later_firm"))
    inside = Window.partitionBy(*block).orderBy(F.desc("_as_of"), F.desc("_from"), F.desc("_row_id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside_firm", F.min(firm).over(inside)).join(quarter, block, "left")
    until = F.least("replaced_at", "_inside_firm", "_later_firm")  # least skips nulls
    return rows.select("_k1", "_k2", "_as_of", "_row_id", "_from", until.alias("_until")).where(F.col("_until").isNull() | (F.col("_from") < F.col("_until")))


def known_as_of(events: DataFrame, log: DataFrame, *, event_id: str, at: str, series: Sequence[str], as_of: str = "as_of", observed: str = "observed_at", row_id: str = "row_id", supersedes: str = "supersedes") -> DataFrame:
    """``(event_id, row_id)``: per event the row of its series known and in force at ``at``.

    Of several the latest ``as_of``, then the latest ``observed``, then the highest ``row_id``.
    """
    rows = reigns(log, series, as_of=as_of, observed=observed, row_id=row_id, supersedes=supersedes)
    end = F.coalesce(leaf(F.col("_until")) + 1, F.lit(2**LEVELS))
    nodes = rows.withColumn("_n", F.explode(cover(leaf(F.col("_from")), end))).select("_k1", "_k2", F.col("_n.level").alias("_level"), F.col("_n.index").alias("_index"), "_as_of", "_row_id", "_from", "_until")
    asked = events.where(F.col(at).isNotNull()).select(F.col(event_id).alias("_event"), F.col(at).alias("_at"), *series_key(series), F.explode(enclosing(leaf(F.col(at)))).alias("_e"))
    asked = asked.select("_event", "_at", "_k1", "_k2", F.col("_e.level").alias("_level"), F.col("_e.index").alias("_index"))
    hit = asked.join(nodes, ["_k1", "_k2", "_level", "_index"]).where((F.col("_from") <= F.col("_at")) & (F.col("_until").isNull() | (F.col("_at") < F.col("_until"))))
    best = hit.groupBy("_event").agg(F.max(F.struct("_as_of", "_from", "_row_id")).alias("_best"))
    return best.select(F.col("_event").alias(event_id), F.col("_best._row_id").alias(row_id))
