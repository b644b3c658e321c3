"""Predicates on log lines, windows and alerts. Each returns a boolean Column or ``None``
for "no restriction"; ``all_of`` joins them, so user values never become SQL text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions import values


def all_of(predicates: Iterable[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def level_is(level: str | None) -> Column | None:
    return F.col("level") == F.lit(level) if level else None


def level_named(level: str | None) -> Column | None:
    """A level in any case."""
    return F.col("level") == values.upper_parameter(level) if level else None


def level_in(levels: list[str] | None) -> Column | None:
    return F.col("level").isin(list(levels)) if levels else None


def show(which: str) -> Column | None:
    """``all``, ``anomalies`` or ``normal``."""
    flags = {"all": None, "anomalies": 1, "normal": 0}
    flag = flags[which]
    return None if flag is None else F.col("is_anomaly") == flag


def search_substring(needle: str | None, column: str = "content") -> Column | None:
    """Case-insensitive containment; ``%`` and ``_`` in the needle act as wildcards, a
    backslash is an ordinary character."""
    if not needle:
        return None
    return F.col(column).ilike("%" + needle.replace("\\", "\\\\") + "%")


def search_regex(pattern: str | None, column: str = "content") -> Column | None:
    """Case-insensitive regular expression search; a null text never matches."""
    if not pattern:
        return None
    return F.coalesce(F.col(column).rlike("(?iu)" + pattern), F.lit(False))


def min_score(score: float | None) -> Column | None:
    return F.col("anomaly_score") >= F.lit(float(score)) if score is not None else None


def severity_is(severity: str | None) -> Column | None:
    return F.col("severity") == values.upper_parameter(severity) if severity else None


def between_times(start: int, end: int) -> Column:
    """Half-open: the end second is excluded."""
    return (F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end))


def label_mismatch() -> Column:
    """Windows whose truth flag contradicts their anomalous-line count."""
    counted, flag = F.col("anomaly_count"), F.col("is_anomaly")
    return ((counted > 0) & (flag == 0)) | ((counted == 0) & (flag == 1))


def options(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in ascending order, nulls left out: what a filter offers."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
