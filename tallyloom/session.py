"""Spark session construction and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine relies on; none of them fixes a number of executors or rows.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with the engine's defaults.

    ``master`` None leaves the choice to spark-submit (``local[*]`` where nothing is set).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir`` if set.

    Only where the setting is absent (tests, a single machine) a temporary folder is chosen, and
    only on a local master; on a cluster the setting is required, since executors share no disk.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tallyloom-ckpt-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df``: survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name, starting with ``name``, below the shared folder of the lineage cuts."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """Lineage cuts of a loop: the state of each round is a table written to the shared folder.

    A checkpoint keeps the planner's estimate of its size, and an estimate that multiplies through
    the joins of every round grows without bound; a written table has its true size.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folders: list[str] = []

    def cut(self, df: DataFrame, keep: int = 4) -> DataFrame:
        """``df``, written and read again; tables older than ``keep`` cuts are dropped."""
        self.folders.append(shared_folder(self.spark, "round"))
        df.write.parquet(self.folders[-1])
        while len(self.folders) > keep:
            drop_folder(self.spark, self.folders.pop(0))
        return self.spark.read.schema(df.schema).parquet(self.folders[-1])

    def done(self, df: DataFrame | None = None) -> DataFrame | None:
        """The result as a checkpoint; all tables of the loop are dropped."""
        out = None if df is None else cut(df)
        while self.folders:
            drop_folder(self.spark, self.folders.pop())
        return out


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, from which the operators size their own."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
