"""Session settings, durable lineage cuts and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidegrain")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEGRAIN_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session gets a temporary one; a cluster, whose executors could not see
    that, is refused.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None and known.isDefined():
        return known.get()
    if shared is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if known.isEmpty():
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidegrain-checkpoint-"))
    return shared or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; keeps the partitioning."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of intermediate tables per application.
_WRITTEN: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a fresh folder in the shared folder, removed by :func:`release`."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as parquet and read back: a lineage cut that several readers prune."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables of this session; frames that read them are of no use afterwards."""
    gone = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(gone)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is: the join then shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for costly passes over few large splits.

    Only inputs of fewer splits than cores are exchanged; others, as any large table, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
