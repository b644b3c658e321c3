"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(
    app: str = "loglens", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **(conf or {})}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a context, for those that don't have it installed.

    For a session that was not made by ``get_session``.
    """
    context = spark.sparkContext
    if any(name.endswith("/loglens.zip") for name in context.listFiles):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    place = os.path.join(SparkFiles.getRootDirectory(), "packed")
    os.makedirs(place, exist_ok=True)
    context.addPyFile(shutil.make_archive(os.path.join(place, "loglens"), "zip", os.path.dirname(package), "loglens"))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="loglens-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loglens/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    The copy survives the loss of executors, is computed exactly once however often it is
    used, and gives the planner a real size to choose join strategies from.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_width(spark: SparkSession) -> int:
    """Partitions for CPU-bound Python work. Its input is small in bytes, so adaptive
    execution would merge it into few tasks if the number were left open."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
