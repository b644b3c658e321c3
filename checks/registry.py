"""Registration of a check: a Spark query and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.context import Inputs
from checks.sql import statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(name: str, body: str | None = None, *needs: str):
    """Register a function of ``Inputs`` under ``name``; ``body`` with the tables it ``needs``
    is the SQL twin."""
    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if body is not None:
            ORACLE[name] = statement(body, *needs)
        return build

    return register
