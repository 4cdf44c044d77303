"""Session helpers: building a session for tests/bench, the shared folder and
tables written to it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "semestra") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own
    session; every operator only needs ``SparkSession.getActiveSession()``."""
    builder = (
        SparkSession.builder
        .master(master or os.environ.get("SPARK_MASTER", "local[8]"))
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for intermediate tables (``spark.checkpoint.dir``).

    A cluster names it. Only a local session, whose executors are threads of
    the driver, may fall back to a fresh temporary folder; anywhere else an
    unset folder is an error, since executors would write to their own disks.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    current = tempfile.mkdtemp(prefix="semestra-ckpt-")
    spark.conf.set("spark.checkpoint.dir", current)
    return current


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application: all lie in one folder, which
    ``drop_scratch`` deletes."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/semestra-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table this application has written to the shared folder,
    once no result that reads them is needed any more."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    drop_written(spark, [f"{base}/semestra-{spark.sparkContext.applicationId}"])


def materialize(df: DataFrame, name: str = "t", written: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the cluster's checkpoint
    folder and reading it back.

    One pass (``Dataset.checkpoint`` computes its input twice unless cached)
    and columnar files; the written table survives executor loss, so later
    stages never recompute the lineage behind it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)  # known: no job to find it out


def drop_written(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables written by ``materialize`` once nothing reads
    them (through the Hadoop file system of the path, so it works for any
    shared store the checkpoint folder lives on)."""
    for path in paths:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
