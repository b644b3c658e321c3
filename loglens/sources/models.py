"""A fitted model as three Parquet tables: trees, scaler statistics, feature list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loglens.sources import commits
from loglens.sources.tables import read_table, require


@dataclass(frozen=True)
class Model:
    trees: DataFrame
    scaler: DataFrame
    features: DataFrame


def save_model(model: Model, path: str) -> None:
    """A new version of all three tables, which appear together."""
    def write(place: str) -> None:
        for name in ("trees", "scaler", "features"):
            getattr(model, name).write.parquet(f"{place}/{name}")

    commits.publish(model.trees.sparkSession, path, write)


def load_model(spark: SparkSession, path: str) -> Model:
    place = commits.current(spark, require(spark, path, "the model stage"))
    return Model(*[read_table(spark, f"{place}/{name}") for name in ("trees", "scaler", "features")])
