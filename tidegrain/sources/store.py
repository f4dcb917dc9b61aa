"""An append-only store of logs as parquet, partitioned by the day a row was observed.

Rows are only ever appended: corrections are rows that point to the row they replace. The only reader
is :meth:`LogStore.view`, which cannot see past its cutoff and turns it into a partition filter too.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrain.operators import pit, stats

DAY = "observed_day"


@dataclass
class LogStore:
    """``root`` holds a folder per table; ``rules`` holds per table the row rules of its append gate."""

    spark: SparkSession
    root: str
    rules: Mapping[str, Mapping[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in self.rules:
            self._path(name)

    def _path(self, table: str, part: str = "rows") -> str:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", table):
            raise ValueError(f"no name of a table: {table!r}")
        return f"{self.root}/{table}/{part}"

    def _raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._path(table))

    def append(self, table: str, rows: DataFrame) -> dict[str, int]:
        """Append what passes the table's rules, quarantine the rest with the names of the rules broken."""
        rules = {n: F.expr(c) for n, c in self.rules.get(table, {}).items()} | {"observed_before_as_of": F.col("observed_at") >= F.col("as_of")}
        gated = pit.gate(rows, rules).persist()
        try:
            good, bad = gated.where(F.size("broken") == 0).drop("broken"), gated.where(F.size("broken") > 0)
            counts = {"accepted": good.count(), "quarantined": bad.count()}
            if counts["accepted"]:
                good.withColumn(DAY, F.to_date("observed_at")).hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(self._path(table))
            if counts["quarantined"]:
                bad.write.mode("append").parquet(self._path(table, "quarantine"))
        finally:
            gated.unpersist()
        return counts

    def append_with_ids(self, table: str, rows: DataFrame, order: list[str]) -> dict[str, int]:
        """Append with ids that continue after the highest one, in the order of a digest of the columns ``order``."""
        last = self._raw(table).agg(F.max("row_id")).first()[0] or 0
        told = rows.withColumn("_all", F.lit(0)).withColumn("_told", stats.row_digest(order))
        ids = stats.ranked(told, "_all", "_told").withColumn("row_id", (F.col("place") + F.lit(last)).cast("bigint"))
        return self.append(table, ids.drop("_all", "_told", "place"))

    def supersede(self, table: str, corrections: DataFrame, order: list[str] | None = None) -> dict[str, int]:
        """Append corrections; each must point to a stored row and be observed strictly later than it.

        With ``order`` they get their ids here, see :meth:`append_with_ids`.
        """
        old = self._raw(table).select(F.col("row_id").alias("_old"), F.col("observed_at").alias("_old_at"))
        both = corrections.join(old, corrections["supersedes"] == old["_old"], "left")
        wrong = both.where(F.col("_old").isNull() | (F.col("observed_at") <= F.col("_old_at"))).limit(5).collect()
        if wrong:
            raise ValueError(f"corrections must follow the row they replace: {[r['supersedes'] for r in wrong]}")
        return self.append_with_ids(table, corrections, order) if order else self.append(table, corrections)

    def insert_first_seen(self, table: str, rows: DataFrame, key: str, order: list[str]) -> int:
        """Dimension insert: the first row of every key that the table does not hold yet."""
        first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
        try:
            first = first.join(self.spark.read.parquet(self._path(table)).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        first = first.persist()
        try:
            n = first.count()
            if n:
                first.write.mode("append").parquet(self._path(table))
        finally:
            first.unpersist()
        return n

    def view(self, table: str, at: dt.datetime) -> DataFrame:
        """The rows known and in force at ``at``; days after it are not even read."""
        rows = self._raw(table).where(F.col(DAY) <= F.lit(at.date())).drop(DAY)
        return pit.as_of_view(rows, F.lit(at).cast("timestamp_ntz"))


def preserve(today: DataFrame, before: DataFrame, group: str) -> DataFrame:
    """Today's rows, and yesterday's of those groups for which today brought none; null is a group of its own."""
    have = today.select(F.col(group).alias("_have")).distinct()
    back = before.join(have, before[group].eqNullSafe(have["_have"]), "left_anti")
    return today.withColumn("preserved", F.lit(False)).unionByName(back.withColumn("preserved", F.lit(True)))


def complete_pages(pages: DataFrame, key: str, page: str = "page", more: str = "has_more", total: str = "total", rows: str = "rows") -> DataFrame:
    """Per key whether enumeration reached the end: the last page says so, or the rows reach the total told."""
    return pages.groupBy(key).agg(
        (F.coalesce(~F.max_by(more, page), F.lit(False)) | F.coalesce(F.sum(rows) >= F.max(total), F.lit(False))).alias("complete"), F.max(page).alias("pages"), F.sum(rows).alias("rows")
    )


def flatten_payload(quotes: DataFrame, body: str, paths: Mapping[str, str]) -> DataFrame:
    """``quotes`` with one column per JSON path, null where absent."""
    return quotes.select("*", *[F.get_json_object(F.col(body), p).alias(n) for n, p in paths.items()])


def most_specific(rows: DataFrame, rules: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Each row with the rule that fits it best: null in a rule fits anything, more named keys win, then the lowest rule.

    Rules become one equi-join per subset of named keys that occurs, so no row meets a rule it does not fit.
    """
    shape = F.concat_ws("", *[F.when(F.col(k).isNull(), "0").otherwise("1") for k in keys])
    shaped = rules.withColumn("_shape", shape)
    shapes = sorted(r["_shape"] for r in shaped.select("_shape").distinct().collect())  # at most 2 ** keys
    hits = None
    for s in shapes:
        on = [k for k, c in zip(keys, s) if c == "1"]
        some = shaped.where(F.col("_shape") == s).drop(*[k for k in keys if k not in on])
        if on:
            got = rows.join(some, on)
        else:  # the rules without any condition: only the first of them can win
            got = rows.join(F.broadcast(some.orderBy("rule").limit(1)))
        got = got.select(row_id, F.lit(-s.count("1")).alias("_rank"), "rule")
        hits = got if hits is None else hits.unionByName(got)
    if hits is None:
        return rows.select(row_id, F.lit(None).cast("int").alias("rule")).limit(0)
    best: Column = F.min(F.struct("_rank", "rule")).alias("_best")
    return hits.groupBy(row_id).agg(best).select(row_id, F.col("_best.rule").alias("rule"))
