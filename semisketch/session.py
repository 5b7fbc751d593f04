"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


NO_FOLDER = "set spark.checkpoint.dir to a folder all executors share"


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster gets
    none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None and context.getCheckpointDir() is None and context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if folder is not None and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    if checkpoint_folder(df.sparkSession) is None:
        raise RuntimeError(NO_FOLDER)
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, for files that a job writes and reads back."""
    folder = checkpoint_folder(spark)
    if folder is None:
        raise RuntimeError(NO_FOLDER)
    return f"{folder.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def local_session(cores: str = "*", **more: str) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    PySpark notes the call site of every column operation unless told not to when
    the session starts; the expressions here have hundreds.
    """
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        **more,
    }
    builder = SparkSession.builder.master(f"local[{cores}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
