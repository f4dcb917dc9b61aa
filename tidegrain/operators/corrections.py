"""Supersession and redelivery in append-only logs, shared by the operators on logs.

Every function here takes column names, keeps columns it does not know, and treats a null key as
a value of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> Column:
    """Equality of the paired columns in which null equals null; Spark plans it as an equi-join."""
    cond = F.lit(True)
    for a, b in keys:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def replaced_at(log: DataFrame, supersedes: str = "supersedes", observed: str = "observed_at") -> DataFrame:
    """``(replaced_id, replaced_at)``: when each replaced row was first known to be replaced."""
    return (
        log.where(F.col(supersedes).isNotNull())
        .groupBy(F.col(supersedes).alias("replaced_id"))
        .agg(F.min(observed).alias("replaced_at"))
    )


def with_replaced_at(log: DataFrame, row_id: str = "row_id", supersedes: str = "supersedes", observed: str = "observed_at") -> DataFrame:
    """``log`` with ``replaced_at``, null where no row supersedes it."""
    by = replaced_at(log, supersedes, observed)
    return log.join(by, log[row_id] == by["replaced_id"], "left").drop("replaced_id")


def never_replaced(log: DataFrame, row_id: str = "row_id", supersedes: str = "supersedes") -> DataFrame:
    """Rows that no row of the log supersedes."""
    gone = log.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("replaced_id")).distinct()
    return log.join(gone, log[row_id] == gone["replaced_id"], "left_anti")


def first_deliveries(log: DataFrame, content: Sequence[str], keep: Sequence[str], row_id: str = "row_id", observed: str = "observed_at") -> DataFrame:
    """One row per content: of rows equal in ``content`` (null equals null) the first observed, then the lowest id.

    Returns ``content`` and ``keep``. A mergeable minimum, so repeated content is folded before the shuffle.
    """
    first = F.min(F.struct(F.col(observed).alias("_o"), F.col(row_id).alias("_r"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])).alias("_first")
    got = log.groupBy(*content).agg(first)
    return got.select(*content, *[F.col(f"_first._k{i}").alias(c) for i, c in enumerate(keep)])
