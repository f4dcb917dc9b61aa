"""Grouped statistics: paired ratios with a sufficiency gate, trailing z scores, hit rates, regression, digests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_quantile(values: Column, p: float) -> Column:
    """Quantile at rank (n + 1) p of an ascending array, extrapolating at the ends; null under two values."""
    n = F.size(values)
    h = (n + 1) * F.lit(p)
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(h))).cast("int")
    lo, hi = F.get(values, j - 1), F.get(values, j)
    return F.when(n >= 2, lo + (h - j) * (hi - lo))


def order_statistics(rows: DataFrame, bucket: Sequence[str], value: str, ranks: Column) -> DataFrame:
    """``(bucket, rank, value)``: exact order statistics of every bucket without sorting or collecting one.

    ``ranks`` is an array of 1-based ranks over the columns of ``bucket`` and ``n``, the bucket's count.
    Values are counted per bin of a monotone transform, prefix counts over the bins tell which bin holds
    a rank, and only the distinct values of those bins are ranked. Null values are left out.
    """
    keys = list(bucket)
    binned = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_bin", F.floor(F.asinh(F.col("_v") * 1000) * 100))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum("_c").over(run)).withColumn("n", F.sum("_c").over(whole))
    asked = counts.withColumn("rank", F.explode(ranks)).where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_c")))
    asked = asked.select(*keys, "_bin", "rank", (F.col("rank") - F.col("_upto") + F.col("_c")).alias("_local"))
    need = asked.select(*keys, "_bin").distinct()
    distinct = binned.join(need, [*keys, "_bin"], "left_semi").groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_m"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    distinct = distinct.withColumn("_to", F.sum("_m").over(inside))
    hit = asked.join(distinct, [*keys, "_bin"]).where((F.col("_local") <= F.col("_to")) & (F.col("_local") > F.col("_to") - F.col("_m")))
    return hit.select(*keys, "rank", F.col("_v").alias("value")).distinct()


def quartiles(rows: DataFrame, bucket: Sequence[str], value: str) -> DataFrame:
    """``(bucket, n, median, q1, q3)``, exact; quartiles at rank (n + 1) p, null under two values."""
    n = F.col("n")
    j = {p: F.greatest(F.lit(1), F.least(n - 1, F.floor((n + 1) * p))) for p in (0.25, 0.75)}
    mid = (F.floor((n + 1) / 2), F.ceil((n + 1) / 2))
    ranks = F.array_distinct(F.array(*mid, j[0.25], j[0.25] + 1, j[0.75], j[0.75] + 1))
    stat = order_statistics(rows, bucket, value, ranks)
    count = rows.where(F.col(value).isNotNull()).groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    at = stat.groupBy(*bucket).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))  # six ranks at most
    got = count.join(at, list(bucket))
    pick = lambda r: F.try_element_at("_at", r.cast("bigint"))
    exclusive = lambda p: F.when(n >= 2, pick(j[p]) + ((n + 1) * F.lit(p) - j[p]) * (pick(j[p] + 1) - pick(j[p])))
    return got.select(*bucket, "n", ((pick(mid[0]) + pick(mid[1])) / 2).alias("median"), exclusive(0.25).alias("q1"), exclusive(0.75).alias("q3"))


def medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, median)``, exact: the median of distinct values weighted by how often they occur.

    Values are counted before they meet, so a key costs its distinct values; null values are left out, null keys kept.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    return counted.groupBy(*keys).agg(F.percentile("_x", F.lit(0.5), F.col("_c")).alias("median"))


def ranked(rows: DataFrame, value: str, key: str) -> DataFrame:
    """``rows`` with ``place``, their rank by (value, md5 of key) over all rows, without a task that sees them all.

    Rows are counted per (value, first two digits of the digest); prefix sums over these counts offset ranks
    taken within each. A value shared by all rows still falls into 256 parts.
    """
    rows = rows.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_part", F.substring("_h", 1, 2))
    parts = rows.groupBy(value, "_part").agg(F.count(F.lit(1)).alias("_c"))
    per_value = parts.groupBy(value).agg(F.sum("_c").alias("_vc"))
    before = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct value, scores of four digits
    per_value = per_value.withColumn("_v0", F.coalesce(F.sum("_vc").over(before), F.lit(0)))
    inside = Window.partitionBy(value).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    parts = parts.withColumn("_p0", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(per_value, value)
    own = F.row_number().over(Window.partitionBy(value, "_part").orderBy("_h", key))
    return rows.withColumn("_i", own).join(parts.select(value, "_part", (F.col("_p0") + F.col("_v0")).alias("_o")), [value, "_part"]).withColumn("place", F.col("_i") + F.col("_o")).drop("_h", "_part", "_i", "_o")


def paired_ratios(rows: DataFrame, *, unit: Sequence[str], role: str, base: str, value: str, bucket: Sequence[str], member: str, least_pairs: int, least_members: int) -> DataFrame:
    """Per bucket and role the median ratio to the base role within a unit, published from a least sample on.

    ``unit`` columns identify what is compared (equal currency included); per unit and role the median
    value counts. Base values of 0 or less and missing partners are skipped. Quartiles are exact.
    """
    m = medians(rows, [*unit, *[b for b in bucket if b not in unit], role], value).withColumnRenamed("median", "_v")
    b = m.where((F.col(role) == base) & (F.col("_v") > 0)).select(*[F.col(c).alias(f"b_{c}") for c in unit], F.col("_v").alias("_base"))
    cond = F.lit(True)
    for c in unit:
        cond = cond & (m[c] == b[f"b_{c}"])
    pairs = m.where(F.col(role) != base).join(b, cond).withColumn("_ratio", F.col("_v") / F.col("_base"))
    keys = [*bucket, role]
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(member).alias("members"))
    q = quartiles(pairs, keys, "_ratio").drop("n")
    enough = (F.col("pairs") >= least_pairs) & (F.col("members") >= least_members)
    shown = lambda c: F.when(enough, F.round(c, 4))
    out = out.join(q, keys)
    return out.select(*keys, "pairs", "members", shown(F.col("median")).alias("ratio"), shown(F.col("q1")).alias("q1"), shown(F.col("q3")).alias("q3"), F.when(~enough, F.lit("sample_below_minimum")).alias("refused"))


def trailing_z(daily: DataFrame, key: Sequence[str], day: str, value: str, days: int, least: int = 2) -> DataFrame:
    """``daily`` with ``z``: distance from the mean of the trailing ``days`` before, in their deviations."""
    w = Window.partitionBy(*key).orderBy(F.datediff(day, F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    mean, dev, n = F.avg(value).over(w), F.stddev_samp(value).over(w), F.count(value).over(w)
    return daily.withColumn("z", F.when((n >= least) & (dev > 0), (F.col(value) - mean) / dev))


def hit_rates(rows: DataFrame, key: Sequence[str], columns: Sequence[str], least: int = 10) -> DataFrame:
    """Per key and column: matured rows, share above 0, median; nulls have not matured."""
    long = rows.unpivot(list(key), list(columns), "horizon", "excess")
    ok = F.col("excess").isNotNull()
    got = long.groupBy(*key, "horizon").agg(F.count_if(ok).alias("n"), F.avg(F.when(ok, (F.col("excess") > 0).cast("double"))).alias("_h"))
    mid = medians(long.withColumn("excess", F.col("excess").cast("double")), [*key, "horizon"], "excess")
    got = got.join(mid.select(*[F.col(k).alias(f"_{k}") for k in (*key, "horizon")], F.col("median").alias("_m")), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*key, "horizon")], "left")
    return got.select(*key, "horizon", "n", F.round("_h", 6).alias("hit_rate"), F.round("_m", 6).alias("median_excess"), F.when(F.col("n") < least, F.lit("low")).otherwise(F.lit("ok")).alias("confidence"))


def ordinary_least_squares(rows: DataFrame, y: str, xs: Sequence[str]) -> list[float]:
    """Intercept and slopes from one pass of moment sums; only (k + 1)(k + 2) / 2 numbers reach the driver."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    usable = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (*xs, y)))
    k = len(cols)
    sums = usable.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    a, b = m[:-1, :-1], m[:-1, -1]
    if np.linalg.matrix_rank(a) < k - 1:
        raise ValueError("singular design matrix")
    return [float(v) for v in np.linalg.solve(a, b)]


def residuals(rows: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """``rows`` with ``fitted`` and ``residual`` of the regression over all of them."""
    beta = ordinary_least_squares(rows, y, xs)
    fitted = F.lit(beta[0])
    for b, x in zip(beta[1:], xs):
        fitted = fitted + F.lit(b) * F.col(x).cast("double")
    return rows.withColumn("fitted", fitted).withColumn("residual", F.col(y).cast("double") - F.col("fitted"))


def row_digest(columns: Sequence[str]) -> Column:
    """The digest of a row: every value with its length before it, null as ``-``, so different rows have different texts."""
    told = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[told(c) for c in columns]), 256)


def day_digests(log: DataFrame, day: Column, columns: Sequence[str]) -> DataFrame:
    """``(day, n, digest)``: an order-free digest of all rows of a day.

    The digest is the hash of the count and of the sums of four parts of every row's hash, so it is a
    mergeable aggregate and covers the content of every row.
    """
    h = row_digest(columns)
    parts = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    got = log.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).cast("decimal(38,0)").cast("string").alias(f"p{i}") for i, p in enumerate(parts)])
    return got.select("day", "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "p0", "p1", "p2", "p3"), 256).alias("digest"))


def seal(digests: DataFrame) -> DataFrame:
    """``digests`` with ``chain``: each day's seal hashes the seal before it and the day's digest.

    The fold is sequential by nature; it runs over one row per day.
    """
    days = digests.agg(F.array_sort(F.collect_list(F.struct("day", "n", "digest"))).alias("d"))
    zero = F.expr("CAST(array() AS array<string>)")
    step = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), x["digest"]), 256)))
    chained = days.select("d", F.aggregate("d", zero, step).alias("c"))
    return chained.select(F.explode(F.arrays_zip("d", "c")).alias("z")).select("z.d.day", "z.d.n", "z.d.digest", F.col("z.c").alias("chain"))


def first_broken_day(stored: DataFrame, log: DataFrame, day: Column, columns: Sequence[str]) -> DataFrame:
    """One row: the first day whose stored seal does not follow from the log, null if all do."""
    now = seal(day_digests(log, day, columns)).select(F.col("day").alias("d2"), F.col("chain").alias("c2"))
    both = stored.join(now, stored["day"] == now["d2"], "full")
    return both.where(~F.col("chain").eqNullSafe(F.col("c2"))).agg(F.min(F.coalesce("day", "d2")).alias("first_broken"))
