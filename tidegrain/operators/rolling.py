"""Rolling totals over trailing periods as a versioned daily state.

A day's total over the last p days is yesterday's total plus today's arrivals minus the day that expires. The state
is a table on disk: per entity and day the amount and the totals, one folder per version, only ever appended to.
:meth:`RollingState.advance` makes a version from what arrived since the one before. It reads that version's arrivals
(a folder of their own), the first and last day of every entity from the arrivals before, and joins the stored rows
with the days it needs: the days a correction can touch, which are the changed day and the ones before its amount has
expired, and the last days before the state's end, whose amounts expire after it. Arrivals and stored rows stand once
in the plan of a version, so that planning five of them takes little of the driver's memory. Days after the end follow by the
recurrence from the last stored totals; touched days get the change's own recurrence added to their stored totals. All
other rows stay as they are.

All windows run over at most one row per entity and day and over arrivals folded to days, so an entity with any
share of the log costs no more than its days; the log itself only meets partial aggregates.

Defined cases: rows without entity or day have no place on the calendar and are left out; a null
amount counts as 0 but keeps its day; an empty log gives an empty state; repeated rows are folded
by content (:func:`arrivals`); extra columns are ignored, and columns
named like those of the state do not clash, as only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrain.operators.corrections import with_replaced_at
from tidegrain.session import new_folder

PERIODS = (7, 30)


def arrivals(log: DataFrame, *, entity: str, as_of: str, amount: str, content: Sequence[str], row_id: str = "row_id", supersedes: str = "supersedes", observed: str = "observed_at") -> DataFrame:
    """``(entity, day, at, amount, n_rows)``: signed changes of an entity's days and when they became known.

    A content counts once, from its first delivery on; it is withdrawn when the last of its
    deliveries has been superseded.
    """
    need = dict.fromkeys([*content, entity, as_of, amount, row_id, supersedes, observed])
    rows = with_replaced_at(log.select(*need), row_id, supersedes, observed)
    rows = rows.where(F.col(entity).isNotNull() & F.col(as_of).isNotNull())
    group = list(dict.fromkeys([*content, entity, as_of, amount]))
    life = rows.groupBy(*group).agg(F.min(observed).alias("_born"), F.max("replaced_at").alias("_died"), F.count(F.lit(1)).alias("_n"), F.count("replaced_at").alias("_gone"))
    value = F.coalesce(F.col(amount), F.lit(0)).cast("bigint")
    enter = F.struct(F.col("_born").alias("at"), value.alias("amount"), F.lit(1).cast("bigint").alias("n_rows"))
    leave = F.when(F.col("_gone") == F.col("_n"), F.struct(F.greatest("_died", "_born").alias("at"), (-value).alias("amount"), F.lit(-1).cast("bigint").alias("n_rows")))
    step = F.explode(F.filter(F.array(enter, leave), lambda s: s.isNotNull()))
    return life.select(F.col(entity).alias("entity"), F.to_date(as_of).alias("day"), step.alias("_s")).select("entity", "day", "_s.at", "_s.amount", "_s.n_rows")


def by_version(arrived: DataFrame, known_at: Sequence[str]) -> DataFrame:
    """``(entity, day, version, amount, n_rows)``: net change per day and version; version 1 closes at ``known_at[0]``."""
    version = F.lit(1)
    for t in known_at:
        version = version + F.coalesce(F.col("at") >= F.lit(t).cast("timestamp_ntz"), F.lit(False)).cast("int")
    return arrived.groupBy("entity", "day", version.alias("version")).agg(F.sum("amount").alias("amount"), F.sum("n_rows").alias("n_rows"))


class RollingState:
    """The versioned state under ``folder``: ``changes`` holds what arrived per version, ``state`` the rows each version wrote."""

    def __init__(self, spark: SparkSession, folder: str, periods: Sequence[int] = PERIODS) -> None:
        self.spark, self.folder, self.periods = spark, folder, tuple(periods)
        self.versions: list[int] = []
        self.kind = "string"

    def arrive(self, staged: DataFrame) -> None:
        """Store ``staged (entity, day, version, amount, n_rows)``, the net changes of all versions it holds."""
        rows = staged.where("amount != 0 OR n_rows != 0").select("entity", "day", "amount", "n_rows", "version")
        self.kind = rows.schema["entity"].dataType.simpleString()
        rows.write.mode("append").partitionBy("version").parquet(f"{self.folder}/changes")

    def _changes(self) -> DataFrame:
        return self.spark.read.schema(f"entity {self.kind}, day date, amount bigint, n_rows bigint, version int").parquet(f"{self.folder}/changes")

    def _stored(self) -> DataFrame | None:
        """The rows of all versions so far; None before the first."""
        if not self.versions:
            return None
        schema = ", ".join([f"entity {self.kind}, day date, amount bigint, n_rows bigint", *[f"total_{p} bigint" for p in self.periods], "version int"])
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/state/{v}" for v in self.versions])

    def _latest(self, rows: DataFrame, *more: str) -> DataFrame:
        names = ["amount", "n_rows", *[f"total_{p}" for p in self.periods]]
        best = rows.groupBy("entity", "day").agg(F.max(F.struct("version", *names)).alias("s"), *[F.max(c).alias(c) for c in more])
        return best.select("entity", "day", "s.version", *[F.col(f"s.{c}").alias(c) for c in names], *more)

    def advance(self, version: int) -> None:
        """Write the rows that the arrivals of ``version`` change or add.

        Each table is read once in the plan: arrivals become ranges of days, these meet the stored rows in one join.
        """
        longest, periods = max(self.periods), self.periods
        change = self._changes().where(F.col("version") == version).drop("version")
        if self.versions:  # the stored days of an entity reach from its first changed day to its last
            earlier = self._changes().where(F.col("version").isin(self.versions))
            change = change.join(earlier.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last")), "entity", "left")
        else:
            change = change.withColumns({"first": F.lit(None).cast("date"), "last": F.lit(None).cast("date")})
        w = Window.partitionBy("entity").orderBy("day")
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        change = change.select("*", F.lag("day").over(w).alias("prior"), F.lead("day").over(w).alias("follow"), F.min("day").over(so_far).alias("lo"))
        day, amount, last, zero = F.col("day"), F.col("amount"), F.col("last"), F.lit(0).cast("bigint")
        cols = ["c_amount", "c_rows", *[f"d{p}" for p in periods]]

        def days(lo: Column, hi: Column, on: bool = False, **values: Column) -> Column:
            return F.struct(lo.alias("lo"), hi.alias("hi"), *[values.get(c, zero).alias(c) for c in cols], F.lit(on).alias("on"))

        # The calendar: days whose totals a change reaches, new days after the end, days between a new begin and the old one.
        # A change reaches up to the day before the next one, if that comes before its amount has expired.
        reach = F.least(F.date_add("day", longest - 1), last, F.date_sub("follow", 1))
        ends = F.col("follow").isNull()
        ranges = [
            days(day, day, c_amount=amount, c_rows=F.col("n_rows"), **{f"d{p}": amount for p in periods}),
            *[days(F.date_add("day", p), F.date_add("day", p), **{f"d{p}": -amount}) for p in periods],
            F.when(day <= last, days(day, reach, on=True)),
            F.when(ends, days(F.coalesce(F.date_add("last", 1), F.col("lo")), day, on=True)),
            F.when(F.col("prior").isNull() & (day < F.col("first")), days(day, F.date_sub("first", 1), on=True)),
            F.when(ends & (day > last), days(F.date_sub("last", longest - 1), last)),  # their amounts expire after the end
        ]
        spans = change.select("entity", "last", F.explode(F.array(*ranges)).alias("s")).where("s.lo <= s.hi")
        asked = spans.select("entity", "last", F.explode(F.sequence("s.lo", "s.hi")).alias("day"), *[f"s.{c}" for c in cols], "s.on")
        asked = asked.groupBy("entity", "day").agg(*[F.sum(c).alias(c) for c in cols], F.max("on").alias("on"), F.max("last").alias("last"))
        stored = self._stored()
        if stored is None:
            rows = asked.withColumns({c: zero for c in ["amount", "n_rows", *[f"total_{p}" for p in periods]]})
        else:
            rows = self._latest(asked.join(stored, ["entity", "day"], "left"), *cols, "on", "last")
            rows = rows.fillna(0, ["amount", "n_rows", *[f"total_{p}" for p in periods]])
        # After the end the rows are dense from ``longest`` days before it on, so that the day that expires is p rows above.
        rows = rows.withColumns({f"e{p}": F.when(day == last, F.col(f"total_{p}")).when(day > last, -F.coalesce(F.lag("amount", p).over(w), zero)) for p in periods})
        total = lambda p: (F.when(day > last, F.sum(f"e{p}").over(so_far)).otherwise(F.col(f"total_{p}")) + F.sum(f"d{p}").over(so_far)).alias(f"total_{p}")
        out = rows.select("entity", "day", (amount + F.col("c_amount")).alias("amount"), (F.col("n_rows") + F.col("c_rows")).alias("n_rows"), *[total(p) for p in periods], "on").where("on").drop("on")
        out.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{self.folder}/state/{version}")
        self.versions.append(version)

    def read(self) -> DataFrame:
        """``(entity, day, amount, total_p, avg_p, version)``: the newest row of every day between its entity's first and last day with a current row."""
        best = self._latest(self._stored())
        whole = Window.partitionBy("entity")
        held = F.when(F.col("n_rows") > 0, F.col("day"))
        best = best.withColumn("_lo", F.min(held).over(whole)).withColumn("_hi", F.max(held).over(whole)).where(F.col("day").between(F.col("_lo"), F.col("_hi")))
        return best.select("entity", "day", "amount", *[f"total_{p}" for p in self.periods], *[(F.col(f"total_{p}") / F.lit(p)).alias(f"avg_{p}") for p in self.periods], "version")


def rolling_totals(log: DataFrame, *, entity: str, as_of: str, amount: str, content: Sequence[str], known_at: Sequence[str] = (), periods: Sequence[int] = PERIODS, row_id: str = "row_id", supersedes: str = "supersedes", observed: str = "observed_at", folder: str | None = None) -> DataFrame:
    """The state over the whole log, advanced version by version.

    ``known_at``: instants at which a version closes; version 1 holds what was observed before the first of them, the
    last version everything. The log is read once, folded to changes per entity, day and version.
    """
    spark = log.sparkSession
    state = RollingState(spark, folder or new_folder(spark, "rolling"), periods)
    state.arrive(by_version(arrivals(log, entity=entity, as_of=as_of, amount=amount, content=content, row_id=row_id, supersedes=supersedes, observed=observed), known_at))
    for v in range(1, len(known_at) + 2):
        state.advance(v)
    return state.read()
