"""Daily aggregates of an append-only log as a stream.

Each micro-batch is reduced to partial aggregates per (key, day) and appended under its batch id, so a
repeated batch overwrites itself; readers merge the partials. Rows are never dropped by a watermark:
corrections and late rows are part of the log, and cut-offs are applied to the partials
(:mod:`tidegrain.operators.late`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain.session import new_folder


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stream over the parquet files of a table, whether it is one file or a folder."""
    path = f"{root}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    fs, p = _file_system(spark, path)
    return spark.readStream.schema(schema).parquet(path if fs.getFileStatus(p).isDirectory() else f"{root}/{name}.parque[t]")


def partial_sink(folder: str, keys: list[str], at: str, amount: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(*keys, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("amount"))
        part.write.mode("overwrite").parquet(f"{folder}/partials/batch={batch_id}")

    return write


def merged(spark: SparkSession, folder: str, keys: list[str], like: DataFrame | None = None) -> DataFrame:
    """The partials of all batches combined; no batch yet gives no rows (``like`` tells the types of the keys)."""
    path = f"{folder}/partials"
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        types = {f.name: f.dataType.simpleString() for f in like.schema} if like is not None else {}
        return spark.createDataFrame([], ", ".join([*[f"{k} {types.get(k, 'string')}" for k in keys], "day date", "n bigint", "amount bigint"]))
    return spark.read.parquet(path).groupBy(*keys, "day").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))


def run_daily(spark: SparkSession, root: str, name: str, *, keys: list[str], at: str, amount: str, keep: str = "true", folder: str | None = None) -> DataFrame:
    """Run the stream over everything there is and return the merged aggregates.

    A second run with the same ``folder`` resumes after the first: it reads only files that came since.
    """
    folder = folder or new_folder(spark, "stream")
    log = read_log(spark, root, name)
    q = log.where(keep).writeStream.foreachBatch(partial_sink(folder, keys, at, amount)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return merged(spark, folder, keys, log)
