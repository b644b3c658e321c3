"""Data-quality checks. Each check is one row (check, ok, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.operators.evaluate import class_report, confusion
from loglens.operators.filters import label_mismatch

_ROW = ["check", "ok", "detail"]


def _check(name: str, rows: DataFrame, ok: Column, detail: Column) -> DataFrame:
    return rows.select(
        F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail")
    )


def missing_event_ids(parsed: DataFrame, counts: DataFrame) -> DataFrame:
    """Event ids of the lines without a feature."""
    return parsed.select("event_id").distinct().join(counts.select("event_id").distinct(), "event_id", "left_anti")


def window_count_check(meta: DataFrame, low: int = 1000, high: int = 50000) -> DataFrame:
    n = F.col("n")
    return _check("window_count", meta.agg(F.count(F.lit(1)).alias("n")), n.between(low, high), n)


def coverage_check(parsed: DataFrame, counts: DataFrame) -> DataFrame:
    missing = missing_event_ids(parsed, counts).agg(F.count(F.lit(1)).alias("n"))
    return _check("event_coverage", missing, F.col("n") == 0, F.col("n"))


def event_recount(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows and event ids whose stored count differs from a recount of the lines."""
    recount = lines.groupBy("window_id", "event_id").agg(F.count(F.lit(1)).alias("actual"))
    both = counts.join(recount, ["window_id", "event_id"], "full")
    stored, actual = F.coalesce("n", F.lit(0)), F.coalesce("actual", F.lit(0))
    return both.select("window_id", "event_id", stored.alias("stored"), actual.alias("actual")).where(
        F.col("stored") != F.col("actual"))


def event_recount_check(lines: DataFrame, counts: DataFrame) -> DataFrame:
    wrong = event_recount(lines, counts).agg(F.count(F.lit(1)).alias("n"))
    return _check("event_counts", wrong, F.col("n") == 0, F.col("n"))


def total_recount_check(lines: DataFrame, meta: DataFrame) -> DataFrame:
    recount = lines.groupBy("window_id").agg(F.count(F.lit(1)).alias("actual"))
    both = meta.select("window_id", "total_logs").join(recount, "window_id", "full")
    differ = F.coalesce("total_logs", F.lit(0)) != F.coalesce("actual", F.lit(0))
    return _check("total_logs", both.agg(F.count_if(differ).alias("n")), F.col("n") == 0, F.col("n"))


def label_check(meta: DataFrame) -> DataFrame:
    wrong = meta.agg(F.count_if(label_mismatch()).alias("n"))
    return _check("label_consistency", wrong, F.col("n") == 0, F.col("n"))


def null_cells(meta: DataFrame) -> DataFrame:
    """Null cells per column, as (column, nulls)."""
    per = meta.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in meta.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in meta.columns])
    return per.select(F.inline(pairs))


def cell_check(meta: DataFrame, counts: DataFrame) -> DataFrame:
    nulls = null_cells(meta).agg(F.sum("nulls")).scalar()
    bad = counts.agg(
        F.count_if(F.col("n").isNull()).alias("null_counts"), F.count_if(F.col("n") < 0).alias("negative")
    ).withColumn("nulls", nulls)
    total = F.col("nulls") + F.col("null_counts") + F.col("negative")
    return _check("null_or_negative", bad, total == 0, total)


def confusion_check(scores: DataFrame, metrics: DataFrame) -> DataFrame:
    cells = metrics.select("total_windows", F.col("confusion_matrix.*"))
    total = F.col("true_negative") + F.col("false_positive") + F.col("false_negative") + F.col("true_positive")
    windows = scores.agg(F.count(F.lit(1))).scalar()
    return _check("confusion_total", cells, (total == F.col("total_windows")) & (total == windows), total)


def precision_check(scores: DataFrame, metrics: DataFrame) -> DataFrame:
    again = class_report(confusion(scores)).select("precision_anomaly").scalar()
    gap = F.round(F.abs(F.col("precision_anomaly") - again), 4)
    return _check("precision", metrics, gap < 0.01, gap < 0.01)


def truth_check(scores: DataFrame, metrics: DataFrame) -> DataFrame:
    truth = scores.agg(F.sum(F.col("is_anomaly").cast("bigint"))).scalar()
    return _check("truth_count", metrics, F.col("anomalous_windows") == truth, F.col("anomalous_windows"))


def score_range_check(scores: DataFrame, low: float = 0.0, high: float = 2.0) -> DataFrame:
    outside = scores.agg(F.count_if(~F.col("anomaly_score").between(low, high)).alias("n"))
    return _check("score_range", outside, F.col("n") == 0, F.col("n"))


def flag_check(scores: DataFrame) -> DataFrame:
    other = scores.agg(F.count_if(~F.col("predicted").isin(0, 1)).alias("n"))
    return _check("predicted_flags", other, F.col("n") == 0, F.col("n"))


def model_check(probes: DataFrame, class_means: DataFrame, normal_below: float, extreme_above: float) -> DataFrame:
    """Behaviour of a fitted model; the bounds depend on the data and are parameters."""
    def probe(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("anomaly_score")))

    def mean(flag: int) -> Column:
        return F.max(F.when(F.col("is_anomaly") == flag, F.col("mean_score")))

    p = probes.agg(probe("median_normal").alias("normal"), probe("extreme").alias("extreme"))
    m = class_means.agg((mean(1) > mean(0)).alias("ordered"), F.round(mean(1) - mean(0), 6).alias("gap"))
    return reduce(DataFrame.unionByName, [
        _check("median_normal_low", p, F.col("normal") < normal_below, F.round("normal", 6)),
        _check("extreme_high", p, F.col("extreme") > extreme_above, F.round("extreme", 6)),
        _check("anomalies_above_normals", m, F.col("ordered"), F.col("gap")),
    ])


def quality_report(lines: DataFrame, counts: DataFrame, meta: DataFrame, scores: DataFrame, metrics: DataFrame,
                   low: int = 1000, high: int = 50000) -> DataFrame:
    """All table checks. ``lines`` carries ``window_id``."""
    return reduce(DataFrame.unionByName, [
        window_count_check(meta, low, high),
        coverage_check(lines, counts),
        event_recount_check(lines, counts),
        total_recount_check(lines, meta),
        label_check(meta),
        cell_check(meta, counts),
        confusion_check(scores, metrics),
        precision_check(scores, metrics),
        truth_check(scores, metrics),
        score_range_check(scores),
        flag_check(scores),
    ]).select(*_ROW)


def verdict(report: DataFrame) -> DataFrame:
    """One row: do all checks hold, and which do not."""
    failed = F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("check"))))
    return report.agg(F.bool_and("ok").alias("all_ok"), F.concat_ws(", ", failed).alias("failed"))
