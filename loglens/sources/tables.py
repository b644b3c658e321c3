"""Parquet tables, views over them, and reuse of finished stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loglens.sources import commits


def exists(spark: SparkSession, path: str) -> bool:
    """Existence on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def require(spark: SparkSession, path: str, made_by: str) -> str:
    if commits.current(spark, path) is None:
        raise FileNotFoundError(f"{path} is missing: run {made_by} first")
    return path


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The current version of a Parquet table; with a schema no file is opened for inference."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(commits.current(spark, path) or path)


def write_table(df: DataFrame, path: str, made_from: dict | None = None) -> None:
    """A new version of a table. The old one stays readable until the new one is whole."""
    commits.publish(df.sparkSession, path, lambda place: df.write.parquet(place), made_from)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], if_exists: str = "skip",
                inputs: list[str] | None = None, parameters: dict | None = None) -> DataFrame:
    """Build and write a stage, or reuse its output (``skip``) if it was made from the same: the files of the
    ``inputs`` paths, the parameters and the code. ``overwrite`` rebuilds in any case."""
    if if_exists not in ("skip", "overwrite"):
        raise ValueError("if_exists is 'skip' or 'overwrite'")
    wanted = commits.manifest(spark, inputs or [], parameters)
    if if_exists == "overwrite" or commits.current(spark, path) is None or commits.made_from(spark, path) != wanted:
        write_table(build(), path, wanted)
    return read_table(spark, path)


def register_views(parsed: DataFrame, scores: DataFrame, logs: str = "logs", wins: str = "wins") -> None:
    parsed.createOrReplaceTempView(logs)
    scores.createOrReplaceTempView(wins)


def query_file(spark: SparkSession, path: str, select: str) -> DataFrame:
    """Query a Parquet path in place: ``{table}`` in the statement stands for it."""
    return spark.sql(select, table=read_table(spark, path))
