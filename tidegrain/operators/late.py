"""Per-period aggregates by event time, corrected as late records arrive, with a cut-off.

Every log row becomes signed contributions to its own period: plus its amount in the batch in which
it arrived, minus the same amount in the batch in which a row superseding it arrived. Summed per
(period, arrival batch) they are mergeable partials, small against the log; a period's value at any
knowledge time is the sum of the batches up to then. Batch 0 holds what arrived before the period's
end, batch k what arrived in the k-th day after it; an arrival exactly at the cut-off belongs to the
last open batch. Contributions after the cut-off are refused: they are kept apart in
:func:`refused`, never merged.

Defined cases: rows without key, event time or arrival time belong to no period and are left out;
backfilled rows (true) never count, null is not backfilled; a null amount contributes 0; of
redelivered rows the first observed counts; an empty log gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.operators.corrections import first_deliveries, with_replaced_at

CUTOFF_DAYS = 3


def contributions(log: DataFrame, *, keys: Sequence[str], as_of: str, amount: str, content: Sequence[str], backfilled: str = "backfilled", row_id: str = "row_id", supersedes: str = "supersedes", observed: str = "observed_at") -> DataFrame:
    """``(keys, day, at, amount)``: what changes a period's total and when it became known."""
    need = list(dict.fromkeys([*keys, as_of, amount, *content, backfilled, row_id, supersedes, observed]))
    rows = with_replaced_at(log.select(*need), row_id, supersedes, observed)
    rows = rows.where(~F.coalesce(F.col(backfilled), F.lit(False)))
    for c in (*keys, as_of, observed):
        rows = rows.where(F.col(c).isNotNull())
    group = list(dict.fromkeys([*content, *keys, as_of]))
    kept = [c for c in (amount, observed, "replaced_at") if c not in group]
    once = first_deliveries(rows, group, kept, row_id, observed)
    value = F.coalesce(F.col(amount), F.lit(0)).cast("bigint")
    gone = F.greatest(F.col("replaced_at"), F.col(observed))
    gone = F.when(F.col("replaced_at").isNotNull(), F.struct(gone.alias("at"), (-value).alias("amount")))
    both = F.array(F.struct(F.col(observed).alias("at"), value.alias("amount")), gone)
    steps = F.explode(F.filter(both, lambda s: s.isNotNull()))
    return once.select(*keys, F.to_date(as_of).alias("day"), steps.alias("_c")).select(*keys, "day", F.col("_c.at").alias("at"), F.col("_c.amount").alias("amount"))


def batch_of(day: Column, at: Column, cutoff_days: int = CUTOFF_DAYS) -> Column:
    """The arrival batch of a contribution; ``cutoff_days + 1`` is the first refused one."""
    end = F.date_add(day, 1).cast("timestamp_ntz")
    closes = F.date_add(day, 1 + cutoff_days).cast("timestamp_ntz")
    late = F.datediff(F.to_date(at), F.date_add(day, 1)) + 1
    return F.when(at < end, F.lit(0)).when(at <= closes, F.least(late, F.lit(cutoff_days))).otherwise(F.lit(cutoff_days + 1)).cast("int")


def partials(contribution: DataFrame, keys: Sequence[str], cutoff_days: int = CUTOFF_DAYS) -> DataFrame:
    """``(keys, day, batch, amount, n)``: mergeable partial aggregates per period and arrival batch."""
    return contribution.groupBy(*keys, "day", batch_of(F.col("day"), F.col("at"), cutoff_days).alias("batch")).agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))


def merge(stored: DataFrame, arrived: DataFrame, keys: Sequence[str], cutoff_days: int = CUTOFF_DAYS) -> DataFrame:
    """Stored partials with a new set of partials merged in; those of closed periods are refused."""
    both = stored.unionByName(arrived.where(F.col("batch") <= cutoff_days))
    return both.groupBy(*keys, "day", "batch").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))


def refused(partial: DataFrame, cutoff_days: int = CUTOFF_DAYS) -> DataFrame:
    """Partials that came after their period's cut-off."""
    return partial.where(F.col("batch") > cutoff_days)


def published(partial: DataFrame, keys: Sequence[str], cutoff_days: int = CUTOFF_DAYS) -> DataFrame:
    """``(keys, day, at_end, at_cutoff, refused)`` per period, combined on read."""
    amount = F.col("amount")
    on = lambda cond: F.coalesce(F.sum(F.when(cond, amount)), F.lit(0))
    return partial.groupBy(*keys, "day").agg(
        on(F.col("batch") == 0).alias("at_end"), on(F.col("batch") <= cutoff_days).alias("at_cutoff"), on(F.col("batch") > cutoff_days).alias("refused")
    )
