"""Session set-up and the shared folder used for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "intertie", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect (UTC, AQE with skew joins)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Checkpoint files go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def with_package(spark: SparkSession) -> SparkSession:
    """``spark``, whose workers on this machine find this package as the driver does.

    Batches to and from workers are kept small, so that long texts take
    little memory in either process.

    Workers start in a folder of their own. On a cluster, pass the package
    with ``--py-files`` or install it; this setting does no harm there.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, taken from ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder, which is
    where a single-JVM test run belongs; a cluster session must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if folder:
        if current is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="intertie-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: lineage ends there and rows keep their partition."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
