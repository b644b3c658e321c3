"""Windows from panes: lines are aggregated once into small cells of time that merge into windows.

A pane is as long as the greatest common divisor of a window's width and step, so every window is a run
of whole panes. Lines are grouped once, by pane and template and by pane and node; whatever the
step, only these groups are repeated for the windows that cover them. Counts merge by sums, the
distinct counts of a window by the sets that its panes' groups are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.schemas import RATIO_LEVELS

#: How the measures of two cells merge.
MERGED = {"n": F.sum, "first_ts": F.min, "last_ts": F.max, "anomalous": F.sum, "errors": F.sum, "fatal": F.sum, "severe": F.sum}


def whole(value: Column, unit: int) -> Column:
    """Floor division in integers."""
    return ((value - F.pmod(value, F.lit(unit))) / unit).cast("bigint")


def _measures() -> list[Column]:
    level = F.col("level")
    return [
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.sum("is_anomaly").alias("anomalous"),
        F.count_if(level.isin(RATIO_LEVELS)).alias("errors"),
        F.count_if(level == "FATAL").alias("fatal"),
        F.count_if(level == "SEVERE").alias("severe"),
    ]


def _two_ways(rows: DataFrame, time: str, event: str, measures: list[Column], by_event: Column) -> DataFrame:
    """Groups by (time, event) and by (time, node) in one pass; both are combined before the shuffle."""
    t, e, n = F.col(time), F.col(event), F.col("node")
    return rows.groupingSets([[t, e], [t, n]], t, e, n).agg(by_event, *measures)


def pane_cells(parsed: DataFrame, start: Column, length: int, event: str = "event_id", pane: str = "pane") -> DataFrame:
    """Cells of ``length`` seconds counted from ``start``: per (pane, event) and per (pane, node)."""
    timed = parsed.withColumn(pane, whole(F.col("timestamp") - start, length))
    return _two_ways(timed, pane, event, _measures(), (F.grouping(event) == 0).alias("by_event"))


def merge_cells(cells: DataFrame, time: str, event: str = "event_id") -> DataFrame:
    """Cells of equal time merged. Cells by event stay apart from those by node."""
    merged = [how(c).alias(c) for c, how in MERGED.items()]
    return cells.groupBy(time, event, "node", "by_event").agg(*merged)


def covering(cells: DataFrame, width: int, step: int, pane: str = "pane") -> DataFrame:
    """Every cell once for each window (``window_id``) that covers its pane of gcd(width, step) seconds."""
    length = math.gcd(width, step)
    begin = F.col(pane) * length
    last = whole(begin, step)
    first = F.greatest(whole(begin - width, step) + 1, F.lit(0))
    windows = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return cells.withColumn("window_id", F.explode(windows))


def window_cells(parsed: DataFrame, width: int, step: int | None = None, start: Column | None = None) -> DataFrame:
    """Counts per (window, event id) and per (window, node); ``start`` is the first line's time if not given."""
    start = parsed.agg(F.min("timestamp")).scalar() if start is None else start
    if step is None or step == width:
        return pane_cells(parsed, start, width, pane="window_id")
    panes = pane_cells(parsed, start, math.gcd(width, step))
    return merge_cells(covering(panes, width, step).drop("pane"), "window_id")


def regroup(cells: DataFrame, width: int, step: int | None = None, start: Column | None = None, event: str = "event_id") -> DataFrame:
    """``window_cells`` from cells of one second (``second``, since the epoch)."""
    step = step or width
    start = cells.agg(F.min("second")).scalar() if start is None else start
    paned = cells.withColumn("pane", whole(F.col("second") - start, math.gcd(width, step)))
    if step == width:
        return merge_cells(paned.withColumnRenamed("pane", "window_id"), "window_id", event)
    return merge_cells(covering(merge_cells(paned, "pane", event), width, step).drop("pane"), "window_id", event)
