"""Point-in-time reads over append-only logs: as-of views, current rows, coverage, restatements, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days a rate is looked for at once before a wider reach is tried; 0 looks at all rates of the pair.
REACH_BACK = (8, 64, 0)


def as_of_view(log: DataFrame, at: Column, *, row_id: str = "row_id", supersedes: str = "supersedes", observed: str = "observed_at") -> DataFrame:
    """Rows known at ``at`` that no row known at ``at`` supersedes; each link of a chain drops by itself."""
    known = log.where(F.col(observed) <= at)
    gone = known.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("_gone")).distinct()
    return known.join(gone, known[row_id] == gone["_gone"], "left_anti")


def current(log: DataFrame, key: Sequence[str], *, as_of: str = "as_of", observed: str = "observed_at", row_id: str = "row_id") -> DataFrame:
    """One row per ``key``: the latest as_of, then observed, then id. A mergeable maximum, no sort."""
    rest = [c for c in log.columns if c not in key]
    best = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(as_of, observed, row_id)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def first_seen(log: DataFrame, key: str, columns: Sequence[str], *, observed: str = "observed_at", row_id: str = "row_id") -> DataFrame:
    """First-seen-wins dimension: per ``key`` the columns of its first observed row."""
    best = log.groupBy(key).agg(F.min(F.struct(observed, row_id, *[c for c in columns if c not in (observed, row_id)])).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in columns])


def signal_ready(xref: DataFrame, at: Column, least: float = 0.9, **named: str) -> DataFrame:
    """Links that may be used: manual and exact ones, fuzzy ones from ``least`` on."""
    ok = F.col("resolved_by").isin("manual", "exact") | ((F.col("resolved_by") == "fuzzy") & (F.col("confidence") >= least))
    return as_of_view(xref, at, **named).where(ok)


def review_queue(xref: DataFrame, at: Column, limit: int = 50, least: float = 0.9, **named: str) -> DataFrame:
    """Fuzzy links under ``least``, newest first; the limit is the report's size."""
    row_id, observed = named.get("row_id", "row_id"), named.get("observed", "observed_at")
    open_ = as_of_view(xref, at, **named).where((F.col("resolved_by") == "fuzzy") & (F.col("confidence") < least))
    return open_.orderBy(F.desc(observed), F.desc(row_id)).limit(limit)


def restatement(log: DataFrame, key: Sequence[str], value: str, first: Column, second: Column, **named: str) -> DataFrame:
    """Per key the current value at two knowledge times and whether it was added, dropped, changed or kept."""
    keys = list(key)
    one = lambda t, name: current(as_of_view(log, t, **named), keys).select(*keys, F.col(value).alias(name), F.lit(True).alias(f"_{name}"))
    a, b = one(first, "before"), one(second, "after").select(*[F.col(k).alias(f"b_{k}") for k in keys], "after", "_after")
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"b_{k}"])
    both = a.join(b, cond, "full")
    state = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "dropped").when(F.col("before").eqNullSafe(F.col("after")), "kept").otherwise("changed")
    return both.select(*[F.coalesce(k, f"b_{k}").alias(k) for k in keys], "before", "after", state.alias("state"))


def day_coverage(log: DataFrame, key: str, as_of: str = "as_of") -> DataFrame:
    """Per key: first and last day, days present and missing between them, longest run of consecutive days.

    Days minus their row number are constant within a run (gaps and islands); one row per key and day.
    """
    days = log.where(F.col(key).isNotNull() & F.col(as_of).isNotNull()).select(key, F.to_date(as_of).alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    runs = days.withColumn("island", island).groupBy(key, "island").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi"))
    out = runs.groupBy(key).agg(F.min("lo").alias("first_day"), F.max("hi").alias("last_day"), F.sum("n").alias("present"), F.max("n").alias("consecutive"))
    return out.withColumn("missing", F.datediff("last_day", "first_day") + 1 - F.col("present"))


def missing_days(log: DataFrame, key: str, as_of: str = "as_of") -> DataFrame:
    """``(key, from_day, to_day, days)``: the ranges of days without a row between a key's first and last day."""
    days = log.where(F.col(key).isNotNull() & F.col(as_of).isNotNull()).select(key, F.to_date(as_of).alias("_day")).distinct()
    gap = days.withColumn("_next", F.lead("_day").over(Window.partitionBy(key).orderBy("_day"))).where(F.datediff("_next", "_day") > 1)
    return gap.select(key, F.date_add("_day", 1).alias("from_day"), F.date_sub("_next", 1).alias("to_day"), (F.datediff("_next", "_day") - 1).alias("days"))


def decisions(links: DataFrame, at: Column, offset: int) -> DataFrame:
    """The rows that confirm ``links`` by hand: appended, sure, each superseding its link; ids are the links' plus ``offset``."""
    new = {"row_id": F.col("row_id") + F.lit(offset), "resolved_by": F.lit("manual"), "confidence": F.lit(1.0), "observed_at": at, "supersedes": F.col("row_id")}
    return links.select(*[(new[c] if c in new else F.col(c)).cast(links.schema[c].dataType).alias(c) for c in links.columns])


def run_states(log: DataFrame, run: str, status: str, at: str, keep: Sequence[str] = (), done: str = ":done") -> DataFrame:
    """One row per run of a log in which a run is a row at its start and, once done, a second one whose id ends in ``done``."""
    name = F.regexp_replace(run, f"{done}$", "")
    last = F.max(F.struct(F.col(run).endswith(done).alias("_d"), F.col(at).alias("_a"), F.col(status).alias("_s")))
    return log.groupBy(*keep, name.alias(run)).agg(last.alias("_l")).select(*keep, run, F.col("_l._s").alias(status), F.col("_l._a").alias(at))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``differing``: how many rows only one of two frames has, counted with repeats."""
    both = a.withColumn("_sign", F.lit(1)).unionByName(b.withColumn("_sign", F.lit(-1)))
    net = both.groupBy(*a.columns).agg(F.sum("_sign").alias("_net"))
    return net.agg(F.coalesce(F.sum(F.abs("_net")), F.lit(0)).cast("bigint").alias("differing"))


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``(rule, violations)``: a rule that is null passes, as a CHECK does. One pass over the rows."""
    counts = rows.agg(*[F.count_if(~F.coalesce(cond, F.lit(True))).alias(name) for name, cond in rules.items()])
    names = list(rules)
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in names])).alias("s")).select("s.rule", "s.violations")


def gate(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``broken``, the names of the rules they break; empty for accepted rows."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("broken", broken)


def matching(rows: DataFrame, wanted: Mapping[str, object], columns: Mapping[str, Column]) -> DataFrame:
    """Rows equal in every column for which something is wanted; None wants nothing."""
    for name, value in wanted.items():
        rows = rows if value is None else rows.where(columns[name] == F.lit(value))
    return rows


def orphans(rows: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent row."""
    return rows.join(parent.select(F.col(parent_key).alias("_p")).distinct(), rows[key] == F.col("_p"), "left_anti")


def last_rate(facts: DataFrame, rates: DataFrame, *, fact_id: str, fact_pair: str, at: str, known: str, pair: str = "pair", as_of: str = "as_of", observed: str = "observed_at", row_id: str = "row_id", supersedes: str = "supersedes") -> DataFrame:
    """``(fact_id, row_id)``: for every fact the rate of its pair at its time as known at its knowledge time.

    A rate counts if it holds at or before ``at``, was observed at or before ``known`` and was not superseded by a row
    observed by then; the latest time wins, then the latest observation, then the highest id. Facts without any are left out.

    Rates are few against facts. A fact meets the rates of its pair of the same and the cell of days before, an equality
    join; a rate found there is later than any outside. Only facts for which there was none are asked with wider cells.
    """
    gone = rates.where(F.col(supersedes).isNotNull()).groupBy(F.col(supersedes).alias("_gone")).agg(F.min(observed).alias("_until"))
    r = rates.join(gone, rates[row_id] == gone["_gone"], "left").select(F.col(pair).alias("_pair"), F.col(as_of).alias("_at"), F.col(observed).alias("_from"), "_until", F.col(row_id).alias("_rid"))
    r = r.where(F.col("_at").isNotNull() & F.col("_from").isNotNull())
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    asked = facts.where(F.col(at).isNotNull() & F.col(known).isNotNull()).select(F.col(fact_id).alias("_fid"), F.col(fact_pair).alias("_fp"), F.col(at).alias("_fa"), F.col(known).alias("_fk"))
    best = None
    open_ = asked
    for days in REACH_BACK:  # each wider reach is asked only for what the narrower ones did not answer
        wide = r.withColumn("_cell", F.explode(F.array(F.floor(day("_at") / days), F.floor(day("_at") / days) + 1))) if days else r.withColumn("_cell", F.lit(0))
        cell = F.floor(day("_fa") / days) if days else F.lit(0)
        met = open_.withColumn("_c", cell).join(wide, (F.col("_fp") == F.col("_pair")) & (F.col("_c") == F.col("_cell")))
        met = met.where((F.col("_at") <= F.col("_fa")) & (F.col("_from") <= F.col("_fk")) & (F.col("_until").isNull() | (F.col("_until") > F.col("_fk"))))
        found = met.groupBy("_fid").agg(F.max(F.struct("_at", "_from", "_rid")).alias("_b")).select("_fid", F.col("_b._rid").alias("_rid"))
        best = found if best is None else best.unionByName(found)
        open_ = open_.join(found.select("_fid"), "_fid", "left_anti")
    return best.select(F.col("_fid").alias(fact_id), F.col("_rid").alias(row_id))
