"""Implausible readings in series of measurements: impossible values, stuck runs, spikes.

Each series goes through an undecimated lifting wavelet on the log scale. Level j works with the
neighbours 2**j positions before and after. Its predict step takes the reading's place between them: a
reading outside the hull of its two neighbours is predicted by the nearer end, one inside by itself, so a
lasting step, which one side explains, leaves no detail where a linear prediction would leave two. Its
update step takes the detail off the reading, which gives the approximation the next level works on;
reading = approximation + details of all levels. ``LEVELS`` levels hold one to three odd readings in a row.
Beyond its ends a series continues at the median of its first or last ``EDGE`` readings.

The detail of a reading is thresholded at ``LIMIT`` robust scales. A level's scale is 1.4826 times the
median distance of the approximation to the middle of its two neighbours; the largest of the levels counts.
Four or more neighbouring readings with a detail of the same size are a level of their own, no spike.
Runs of zero first differences, the details of the shortest (Haar) wavelet of the recorded values, are stuck
from ``STUCK`` equal readings on. Bounds decide on impossible readings, which take no part in the transform.

A position is a distinct event time of a series. Redelivered and correcting rows share the position of the
first delivered usable original, whose reading stands for it, and are judged by their own reading
against the same neighbours.

A series of up to ``block`` rows is one block. A longer one is never held or sorted in one task: its positions are
counted per day and offset by prefix sums, and the transform runs in blocks of ``block`` positions that also see the
``HALO`` positions around them. Scales are medians of bin counts, which merge. The block size changes no row.

Defined cases: rows without a reading, a reading in common units or an event time are left out; null
series columns form a series of their own; zero, negative and oversized readings are impossible whatever
the series and are not judged further; a series of one usable reading has no spikes; ties in event time
share a position; repeated rows are judged alike; empty input gives an empty result; only named columns
are read, so extra or clashing ones do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.session import small, written

LEVELS = 3
EDGE = 8
LIMIT = 5.0
STUCK = 6
#: Most readings in a row that are one spike.
LONGEST = 3
#: Smallest scale of a series, in natural logarithms, and bins per e-fold in which scales are counted.
LEAST_SCALE, SCALE_BINS = 0.005, 50
#: Rows of a series, or positions of a longer one, that one task transforms at a time; no result depends on it.
BLOCK = 50_000
#: Positions a core position's result can depend on: all levels' reach, the ends' medians, runs.
HALO = 2**LEVELS - 1 + EDGE + STUCK


def series_key(series: Sequence[str]) -> Column:
    """One string per series, different for different values: each part with its length, null apart from empty."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat(*[part(c) for c in series])


#: A block. The keys of series begin alike, which makes them slow to sort; the hash before the key decides nearly always.
PART = ("_h", "_s", "_block")
#: The rows of a block in order: those of a position together, the one that stands for it first.
ORDER = ("_as_of", "_bad", "_fix", "_observed", "_id")


def hashed(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` exchanged by ``by``, with ``_h``, a hash of the series' key that is made afterwards: it does not compress."""
    return rows.repartition(*by).withColumn("_h", F.xxhash64("_s"))


def numbered(rows: DataFrame, part: Sequence[str]) -> DataFrame:
    """``rows`` with ``_pos`` (distinct times so far), ``_u`` (those with a usable reading), their number ``_n`` and ``_stands`` within ``part``."""
    order = Window.partitionBy(*part).orderBy(*ORDER)
    rows = rows.withColumn("_at", ~F.coalesce(F.lag("_as_of").over(order) == F.col("_as_of"), F.lit(False)))
    rows = rows.withColumn("_stands", F.col("_at") & ~F.col("_bad"))
    count = lambda c, until: F.sum(F.col(c).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, until))
    return rows.select("*", count("_at", 0).alias("_pos"), count("_stands", 0).alias("_u"), count("_stands", Window.unboundedFollowing).alias("_n"))


def whole_series(rows: DataFrame) -> DataFrame:
    """Usable rows of series that are one block each."""
    got = numbered(hashed(rows, "_s").withColumn("_block", F.lit(0).cast("bigint")), PART).where("NOT _bad")
    yes = F.lit(True)
    return got.withColumn("_core", yes).withColumn("_starts", yes).withColumn("_ends", yes).drop("_at")


def cut_series(rows: DataFrame, block: int) -> DataFrame:
    """Usable rows of long series, each in its block and in those whose halo it is in."""
    part = ["_s", "_day"]
    rows = numbered(rows.withColumn("_day", F.to_date("_as_of")), part).drop("_n")
    days = rows.groupBy(*part).agg(F.count_if("_at").alias("_p"), F.count_if("_stands").alias("_q"))
    before = Window.partitionBy("_s").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per series and day
    days = days.select(*part, F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_q"), F.sum("_q").over(Window.partitionBy("_s")).alias("_n"))
    rows = rows.where("NOT _bad").join(days, part).withColumn("_pos", F.col("_pos") + F.col("_p")).withColumn("_u", F.col("_u") + F.col("_q"))
    place = lambda u: F.floor(u / block)
    lowest, highest = F.greatest(F.col("_u") - 1 - HALO, F.lit(0)), F.least(F.col("_u") - 1 + HALO, F.col("_n") - 1)
    rows = rows.withColumn("_block", F.explode(F.sequence(place(lowest), place(highest)))).withColumn("_core", F.col("_block") == place(F.col("_u") - 1))
    # A block that sees an end of the series needs what it continues at, not only the block that holds the end.
    rows = rows.withColumn("_starts", F.col("_block") * block <= HALO).withColumn("_ends", (F.col("_block") + 1) * block + HALO >= F.col("_n"))
    return hashed(rows.drop("_p", "_q", "_day", "_at"), "_s", "_block")


_OVER = f"OVER (PARTITION BY {', '.join(PART)} ORDER BY {', '.join(ORDER)})"


def _near(column: str, steps: int) -> Column:
    """``column`` of the position ``steps`` after (before, if negative) the row's; rows that only share a position hold null."""
    return F.expr(f"{'lead' if steps > 0 else 'lag'}({column}, {abs(steps)}) IGNORE NULLS {_OVER}")


def transform(rows: DataFrame) -> DataFrame:
    """The wavelet over blocks of usable rows.

    Gives ``_detail``, ``_stuck``, ``_long``, the bins ``_b0.._b2`` of the distances that make the scales, and ``_bin``,
    the largest of their medians over the block, for core rows.
    """
    stands, x, y = F.col("_stands"), F.col("_x"), F.col("_y")
    order = Window.partitionBy(*PART).orderBy(*ORDER)
    whole, so_far = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    median = lambda c: F.percentile(c, F.lit(0.5)).over(whole)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    base = [*PART, *ORDER, "_core", "_stands", "_keep", "_x", "_v"]
    rows = rows.select(*base, "_pos", "_u", "_n", "_starts", "_ends", F.when(stands, x).alias("_y"), F.when(stands, F.struct("_v", "_pos")).alias("_here"))
    head, tail = F.col("_starts") & (F.col("_u") <= EDGE), F.col("_ends") & (F.col("_u") > F.col("_n") - EDGE)
    rows = rows.select(
        *base, "_pos", "_u", "_n", "_y", median(F.when(head, y)).alias("_head"), median(F.when(tail, y)).alias("_tail"),
        _near("_here", -1).alias("_before"), _near("_y", -1).alias("_l"), _near("_y", 1).alias("_r"),
    )
    # A run is as long as it is from one difference to the next, of which the first reading is one.
    same = (F.col("_before._v") == F.col("_v")) & (F.col("_before._pos") == F.col("_pos") - 1)
    rows = rows.withColumn("_turn", F.when(stands & ~F.coalesce(same, F.lit(False)), F.col("_u"))).drop("_before", "_pos")
    for j in range(LEVELS):
        step = 2**j
        if j:
            rows = rows.select("*", _near("_y", -step).alias("_l"), _near("_y", step).alias("_r"), *([last("_turn").alias("_from"), _near("_turn", 1).alias("_next")] if j == 1 else []))
        left, right = F.coalesce("_l", "_head", y), F.coalesce("_r", "_tail", y)
        low, high = F.least(left, right), F.greatest(left, right)
        within = lambda c: F.when(stands, F.greatest(low, F.least(high, c)))  # noqa: E731, B023
        away = F.greatest(F.abs(y - (left + right) / 2), F.lit(LEAST_SCALE / 2))
        # Confined to one hull after another is confined to one: the ends of the first, confined to the later ones.
        hull = [F.when(stands, low), F.when(stands, high)] if j == 0 else [within(F.col("_lo")), within(F.col("_hi"))]
        rows = rows.select(*[c for c in rows.columns if c not in ("_l", "_r", "_lo", "_hi", "_y")], hull[0].alias("_lo"), hull[1].alias("_hi"), F.when(stands, F.round(F.log(away) * SCALE_BINS).cast("smallint")).alias(f"_b{j}"), within(y).alias("_y"))
    run = F.when(stands, F.coalesce(F.col("_next"), F.col("_n") + 1) - F.col("_from") >= STUCK)
    bins = [f"_b{j}" for j in range(LEVELS)]
    rows = rows.select(*base, *bins, "_lo", "_hi", run.alias("_run"), (x - y).alias("_d"))
    reach = [k for k in range(-LONGEST, LONGEST + 1) if k]
    rows = rows.select("*", *[_near("_d", k).alias(f"_d{k}") for k in reach])
    alike = {k: f"coalesce(`_d{k}` * _d >= 0.5 * _d * _d, false)" for k in reach}
    longer = F.expr(" OR ".join("(" + " AND ".join(alike[k] for k in range(a, a + LONGEST + 1) if k) + ")" for a in range(-LONGEST, 1)))
    rows = rows.select(*base, *bins, "_lo", "_hi", "_run", F.when(stands, F.col("_v")).alias("_v0"), F.when(stands, longer & (F.col("_d") != 0)).alias("_long"))
    # Rows that share a position are judged against its neighbours; the row that stands for it comes before them.
    own = [last(c).alias(c) for c in ("_lo", "_hi", "_run", "_v0", "_long")]
    rows = rows.select("_s", "_core", "_x", "_v", *bins, *own, "_keep", "_id", *[median(F.col(b)).alias(f"_m{b}") for b in bins]).where("_core")
    left = F.greatest(F.col("_lo"), F.least(F.col("_hi"), x))
    return rows.select("_s", "_keep", "_id", "_v", *bins, F.greatest(*[f"_m{b}" for b in bins]).alias("_bin"), (x - left).alias("_detail"), (F.col("_run") & (F.col("_v") == F.col("_v0"))).alias("_stuck"), "_long")


def scale(median_bin: Column) -> Column:
    return F.greatest(1.4826 * F.exp(median_bin / SCALE_BINS), F.lit(LEAST_SCALE)).alias("_scale")


def scales(transformed: DataFrame) -> DataFrame:
    """``(_s, _scale)``: the largest level's robust scale of a series.

    Medians of bin numbers: the buffer holds a count per bin in use, merges before the shuffle, and does
    not depend on how a series was cut.
    """
    got = transformed.groupBy("_s").agg(F.greatest(*[F.percentile(f"_b{j}", F.lit(0.5)) for j in range(LEVELS)]).alias("_bin"))
    return got.select("_s", scale(F.col("_bin")))


def flag_readings(rows: DataFrame, *, series: Sequence[str], as_of: str, observed: str, row_id: str, value: str, common: str, correction: str | None = None, keep: Sequence[str] = (), flagged_only: bool = False, upper: float = 500_000.0, block: int = BLOCK) -> DataFrame:
    """``keep, row_id, value, impossible, stuck, spike, detail`` for every row with a reading, or for the flagged ones.

    ``value`` is compared for equality (stuck runs), ``common`` is the same reading in common units (level
    and bounds); ``correction`` is null for originals; ``detail`` is in robust scales, null for impossible ones.
    """
    fix = F.col(correction).isNotNull() if correction else F.lit(False)
    c = F.col(common).cast("double")
    rows = rows.where(F.col(value).isNotNull() & F.col(as_of).isNotNull() & F.col(common).isNotNull())
    rows = rows.select(
        F.xxhash64(*[F.col(s).cast("string") for s in series]).alias("_hash"), series_key(series).alias("_s"), F.struct(*(keep or [F.lit(0).alias("_")])).alias("_keep"), F.col(row_id).alias("_id"), F.col(as_of).alias("_as_of"), F.col(observed).alias("_observed"),
        F.col(value).cast("double").alias("_v"), fix.alias("_fix"), ((c <= 0) | (c >= upper)).alias("_bad"), F.when((c > 0) & (c < upper), F.log(c)).alias("_x"),
    )
    # ln gives null for what is no number; such readings are impossible too.
    rows = rows.withColumn("_bad", F.col("_bad") | F.col("_x").isNull())
    yes, no = F.lit(True), F.lit(False)
    impossible = rows.where("_bad").select("_keep", "_id", "_v", yes.alias("impossible"), no.alias("stuck"), no.alias("spike"), F.lit(None).cast("double").alias("detail"))
    # Counted by hash, which is quicker to make than the key. Series that share one may be cut without need, which changes no row.
    hot = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > block).select("_hash")  # rows / block of them at most
    if hot.isEmpty():
        cut, done = None, rows
    else:
        hot = small(written(hot))
        cut, done = rows.join(hot, "_hash", "left_semi"), rows.join(hot, "_hash", "left_anti")
    judged = ["_keep", "_id", "_v", "_detail", "_stuck", "_long"]
    done = transform(whole_series(done)).select(*judged, scale(F.col("_bin")))
    if cut is not None:
        cut = transform(cut_series(cut, block)).drop("_bin")
        if flagged_only:  # no scale is smaller than the least: what is below it is sound and only counts for the scales
            maybe = F.col("_stuck") | (F.abs("_detail") > LIMIT * LEAST_SCALE)
            cut = cut.select("_s", *[f"_b{j}" for j in range(LEVELS)], *[F.when(maybe, F.col(c)).alias(c) for c in judged], maybe.alias("_maybe"))
        else:
            cut = cut.withColumn("_maybe", F.lit(True))
        cut = written(cut)
        done = done.unionByName(cut.where("_maybe").join(scales(cut), "_s").select(*judged, "_scale"))
    spike = (F.abs("_detail") > LIMIT * F.col("_scale")) & ~F.col("_long")
    done = done.select("_keep", "_id", "_v", no.alias("impossible"), F.col("_stuck").alias("stuck"), spike.alias("spike"), (F.col("_detail") / F.col("_scale")).alias("detail"))
    judged = written(done.where("stuck OR spike") if flagged_only else done)
    got = impossible.unionByName(judged)
    return got.select(*[F.col(f"_keep.{k}").alias(k) for k in keep], F.col("_id").alias(row_id), F.col("_v").alias("value"), "impossible", "stuck", "spike", "detail")
