"""Which processed data sets exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglens.sources.tables import exists

# The files a finished data set consists of.
FILES = {"parsed": "parsed.parquet", "scores": "scores.parquet", "alerts": "alerts.parquet", "metrics": "metrics.json"}
_SCHEMA = "name string, description string, status string, files map<string,string>"


def list_datasets(spark: SparkSession, folders: dict[str, str], descriptions: dict[str, str] | None = None) -> DataFrame:
    """One row per named folder that holds a parsed table."""
    rows = []
    for name, folder in folders.items():
        root = folder.rstrip("/")
        if exists(spark, f"{root}/{FILES['parsed']}"):
            files = {k: f"{root}/{v}" for k, v in FILES.items()}
            rows.append((name, (descriptions or {}).get(name, ""), "ready", files))
    return spark.createDataFrame(rows, _SCHEMA)
