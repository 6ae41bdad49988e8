"""Session settings and the shared folder that stages write to."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TUNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Not needed where the package is installed on the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # Spark serves the archive to the executors from the driver
    target = os.path.join(tempfile.mkdtemp(prefix="seriesloom-code-"), "seriesloom")
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(context.applicationId)


def local_session(app: str = "seriesloom", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in TUNED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; a cluster
    without it is refused, since executors cannot see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="seriesloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/seriesloom-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a result once to the shared folder and read it back.

    Used where several later steps need the same costly table, and to cut the lineage of a
    loop's state. The table outlives lost executors, and unlike a checkpoint it is computed once.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(df: DataFrame) -> None:
    """Delete a table of ``stage`` that nothing reads any more, such as a loop's former state."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
