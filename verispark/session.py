"""Session construction and lineage control."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "verispark", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every operator here assumes.

    UTC session time, adaptive execution with skew-join splitting, and Arrow
    transfer.  ``shuffle_partitions`` is only an upper bound: adaptive execution
    coalesces small partitions, so a cluster run leaves it large.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: without one it belongs to the cluster's default store, not to the disk of whoever opens it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def shared_folder(spark: SparkSession) -> str:
    """The folder that survives the loss of an executor.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session,
    as in tests, may fall back on a temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return qualified(spark, configured)
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="verispark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and go on from there.

    A lost executor then costs no recomputation of the past, every later branch
    sees the same rows, and the planner sees the table's true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a stage table below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
