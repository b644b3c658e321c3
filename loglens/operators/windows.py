"""Hourly windows anchored at the first line, and what is measured in each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.operators import panes
from loglens.operators.panes import whole as _whole
from loglens.schemas import DENSE_FEATURES, META_COLUMNS, WINDOW_SECONDS


def time_range(parsed: DataFrame) -> DataFrame:
    span = F.max("timestamp") - F.min("timestamp")
    return parsed.agg(
        F.min("timestamp").alias("t_min"),
        F.max("timestamp").alias("t_max"),
        span.alias("range_seconds"),
        F.round(span / 86400, 4).alias("range_days"),
    )


def offset_from_start(parsed: DataFrame) -> Column:
    """Seconds since the first line; the minimum is a scalar subquery, not a join."""
    return F.col("timestamp") - parsed.agg(F.min("timestamp")).scalar()


def assign_windows(parsed: DataFrame, width: int = WINDOW_SECONDS, step: int | None = None) -> DataFrame:
    """Add ``window_id``. Windows tumble; with ``step < width`` they overlap and a line is
    repeated once per window that covers it (at most ``ceil(width / step)`` times)."""
    offset = offset_from_start(parsed)
    if step is None or step == width:
        return parsed.withColumn("window_id", _whole(offset, width))
    last = _whole(offset, step)
    first = F.greatest(_whole(offset - width, step) + 1, F.lit(0))
    covering = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return parsed.withColumn("window_id", F.explode(covering))


def window_cells(parsed: DataFrame, width: int = WINDOW_SECONDS, step: int | None = None) -> DataFrame:
    """Counts per (window, event id) and per (window, node) in one pass over the lines.

    Both groupings are partially aggregated before the only line-level shuffle, so even an
    hour holding most of the log shuffles no more than its templates and nodes per task. Windows
    that overlap are merged from panes; lines are not repeated.
    """
    return panes.window_cells(parsed, width, step)


def event_counts(cells: DataFrame) -> DataFrame:
    """Long feature form: (window_id, event_id, n), absent = 0."""
    return cells.where("by_event").select("window_id", "event_id", "n")


def window_meta(cells: DataFrame) -> DataFrame:
    """One row per non-empty window."""
    by_event = F.col("by_event")

    def total(column: str) -> Column:
        return F.sum(F.when(by_event, F.col(column)).otherwise(0))

    rows = total("n")
    return cells.groupBy("window_id").agg(
        F.min("first_ts").alias("window_start"),
        F.max("last_ts").alias("window_end"),
        rows.alias("total_logs"),
        total("anomalous").alias("anomaly_count"),
        (total("errors") / rows).alias("error_ratio"),
        total("fatal").alias("fatal_count"),
        total("severe").alias("severe_count"),
        F.count_if(~by_event & F.col("node").isNotNull()).alias("unique_nodes"),
        F.count_if(by_event & F.col("event_id").isNotNull()).alias("unique_templates"),
        (total("anomalous") > 0).cast("int").alias("is_anomaly"),
    )


def window_features(parsed: DataFrame, width: int = WINDOW_SECONDS, step: int | None = None) -> DataFrame:
    return window_meta(window_cells(parsed, width, step))


def widen(counts: DataFrame, event_ids: list[int]) -> DataFrame:
    """Pivot to one ``e_<id>`` column per event id, ids ascending, missing = 0.

    The ids are given by the caller, so no extra pass collects them; the long form stays
    the stored one because the width here depends on the data.
    """
    ids = sorted(event_ids)
    wide = counts.groupBy("window_id").pivot("event_id", ids).agg(F.sum("n"))
    return wide.select("window_id", *[F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(f"e_{i}") for i in ids])


def join_meta(wide: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts with their window's measures; anything missing becomes 0."""
    return wide.join(meta, "window_id", "left").na.fill(0)


def model_columns(features: DataFrame) -> list[str]:
    """All columns the anomaly model may look at."""
    return [c for c in features.columns if c not in META_COLUMNS]


def long_features(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """Every model input as (window_id, feature, x); a missing row means 0."""
    sparse = counts.select(
        "window_id", F.concat(F.lit("e_"), F.col("event_id").cast("string")).alias("feature"),
        F.col("n").cast("double").alias("x"),
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in DENSE_FEATURES
    ])
    dense = meta.select("window_id", F.inline(pairs))
    return sparse.unionByName(dense)


def scaler_stats(features: DataFrame, n_windows: Column) -> DataFrame:
    """Mean and population deviation per feature over all windows, absent rows being 0.

    Moments are taken about the mean of the present values, then corrected for the zeros,
    which avoids the cancellation of a plain sum of squares.
    """
    per = features.groupBy("feature").agg(
        F.count(F.lit(1)).alias("present"), F.avg("x").alias("m"), F.var_pop("x").alias("v"),
    )
    share = F.col("present") / n_windows
    variance = share * F.col("v") + share * (1 - share) * F.col("m") * F.col("m")
    return per.select("feature", (share * F.col("m")).alias("mean"), F.sqrt(variance).alias("std"))


def standard_scale(features: DataFrame, stats: DataFrame) -> DataFrame:
    """(x - mean) / std, a zero deviation counting as 1. Stays sparse: a feature a window
    lacks has the scaled value ``-mean / divisor``, given by ``scaled_zero``."""
    divisor = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return features.join(stats, "feature").select(
        "window_id", "feature",
        ((F.col("x") - F.col("mean")) / divisor).alias("scaled"),
        (-F.col("mean") / divisor).alias("scaled_zero"),
    )


def feature_matrix_stats(meta: DataFrame, counts: DataFrame) -> DataFrame:
    """Shape and headline figures of the feature matrix."""
    width = counts.agg(F.count_distinct("event_id")).scalar()
    return meta.agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.sum(F.col("is_anomaly").cast("bigint")).alias("anomalous_windows"),
        F.count_if(F.col("is_anomaly") == 0).alias("normal_windows"),
        F.avg("is_anomaly").alias("anomaly_rate"),
        F.avg("total_logs").alias("avg_logs"),
        F.max("total_logs").alias("max_logs"),
        F.avg("error_ratio").alias("avg_error_ratio"),
    ).withColumn("n_columns", width + F.lit(len(DENSE_FEATURES) + len(META_COLUMNS) - 1))
