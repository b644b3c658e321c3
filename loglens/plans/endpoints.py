"""The query surface: each endpoint is a function returning a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.functions.values import reduction_pct
from loglens.operators import filters
from loglens.operators.ranking import key_page, page, ranked_page
from loglens.operators.scoring import one
from loglens.schemas import NOISE


def _bounded(name: str, value: int, low: int, high: int | None) -> int:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high else ""))
    return value


def line_totals(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.sum(F.col("is_anomaly").cast("bigint")).alias("anomalous_lines"),
        F.round(F.avg("is_anomaly") * 100, 2).alias("anomaly_rate_pct"),
        F.count_distinct("event_id").alias("unique_templates"),
    )


def window_totals(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.sum(F.col("predicted").cast("bigint")).alias("anomalous_windows"),
        F.round(F.min("anomaly_score"), 4).alias("score_min"),
        F.round(F.max("anomaly_score"), 4).alias("score_max"),
        F.round(F.avg("anomaly_score"), 4).alias("score_mean"),
    )


def stats(parsed: DataFrame, scores: DataFrame) -> DataFrame:
    """Line and window totals in one row."""
    return line_totals(parsed).withColumn("w", one(window_totals(scores))).select("*", "w.*").drop("w")


_LOG_COLUMNS = ["line_id", "date", "node", "level", "is_anomaly", "template", "content"]


def _log_filter(level: str | None, anomaly_only: bool, search: str | None):
    return filters.all_of([
        filters.level_is(level),
        filters.show("anomalies") if anomaly_only else None,
        filters.search_substring(search),
    ])


def logs_page(parsed: DataFrame, level: str | None = None, anomaly_only: bool = False, search: str | None = None,
              limit: int = 100, offset: int = 0) -> DataFrame:
    _bounded("limit", limit, 1, 1000)
    _bounded("offset", offset, 0, None)
    rows = parsed.where(_log_filter(level, anomaly_only, search)).select(*_LOG_COLUMNS)
    return key_page(rows, "line_id", limit, offset)


def logs_total(parsed: DataFrame, level: str | None = None, anomaly_only: bool = False,
               search: str | None = None) -> DataFrame:
    return parsed.where(_log_filter(level, anomaly_only, search)).agg(F.count(F.lit(1)).alias("total"))


def anomalies_page(scores: DataFrame, min_score: float = 0.0, limit: int = 50, offset: int = 0) -> DataFrame:
    _bounded("limit", limit, 1, 500)
    _bounded("offset", offset, 0, None)
    rows = scores.where(filters.all_of([F.col("predicted") == 1, filters.min_score(min_score)]))
    best = ranked_page(rows, "anomaly_score", "window_start", limit, offset)
    return best.select(
        "window_start", "window_end", F.round("anomaly_score", 4).alias("anomaly_score"), "predicted",
        F.col("is_anomaly").alias("ground_truth"), "total_logs", "anomaly_count",
    )


def anomalies_total(scores: DataFrame, min_score: float = 0.0) -> DataFrame:
    rows = scores.where(filters.all_of([F.col("predicted") == 1, filters.min_score(min_score)]))
    return rows.agg(F.count(F.lit(1)).alias("total"))


def _alert_filter(severity: str | None, min_score: float):
    return filters.all_of([filters.min_score(min_score), filters.severity_is(severity)])


def alerts_page(alerts: DataFrame, severity: str | None = None, min_score: float = 0.0, limit: int = 50,
                offset: int = 0) -> DataFrame:
    _bounded("limit", limit, 1, 500)
    _bounded("offset", offset, 0, None)
    best = ranked_page(alerts.where(_alert_filter(severity, min_score)), "anomaly_score", "window_start", limit, offset)
    return best.select(
        "window_start", "window_end", F.round("anomaly_score", 4).alias("anomaly_score"), "severity",
        "top_template", "cluster_id", "cluster_label", "anomaly_count", "total_logs",
    )


def alerts_total(alerts: DataFrame, severity: str | None = None, min_score: float = 0.0) -> DataFrame:
    return alerts.where(_alert_filter(severity, min_score)).agg(F.count(F.lit(1)).alias("total"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Severity counts, clusters, noise, groups and percentage reduction in one row."""
    cluster = F.col("cluster_id")
    totals = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(F.col("severity") == name.upper()).alias(name) for name in ("critical", "high", "medium", "low")],
        F.count_distinct(F.when(cluster >= 0, cluster)).alias("clusters"),
        F.count_if(cluster == NOISE).alias("unique_alerts"),
    )
    groups = F.col("clusters") + F.col("unique_alerts")
    return totals.select(
        "*", groups.alias("distinct_groups"),
        reduction_pct(groups, F.col("total_alerts")).alias("noise_reduction_pct"),
    )


def cluster_summary(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    rows = (
        alerts.groupBy("cluster_id", "cluster_label")
        .agg(
            F.count(F.lit(1)).alias("alert_count"),
            F.round(F.max("anomaly_score"), 4).alias("max_score"),
            F.round(F.avg("anomaly_score"), 4).alias("avg_score"),
            F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        )
        .orderBy(F.desc("alert_count"), "cluster_id", "cluster_label")
    )
    return rows if limit is None else rows.limit(limit)


def window_logs(parsed: DataFrame, window_start: int, window_end: int, limit: int = 50) -> DataFrame:
    _bounded("limit", limit, 1, 200)
    rows = parsed.where(filters.between_times(window_start, window_end))
    return page(rows, [F.col("timestamp"), F.col("line_id")], limit).select(
        "node", "level", "is_anomaly", "template", "content", "timestamp")


def clustering_comparison(doc: DataFrame, total: DataFrame, eps: tuple[float, float] = (0.5, 0.4)) -> DataFrame:
    """The stored comparison document as one row per method; ``total`` is the real alert count."""
    methods = [("tfidf", "TF-IDF + DBSCAN", eps[0]), ("minilm", "MiniLM + DBSCAN", eps[1])]
    return doc.withColumn("total", total.scalar()).select(F.inline(F.array(*[
        F.struct(
            F.lit(key).alias("key"),
            F.lit(method).alias("method"),
            F.lit(value).alias("eps"),
            F.col(f"{key}_clusters").alias("clusters"),
            F.col(f"{key}_unique").alias("unique"),
            F.col(f"{key}_silhouette").alias("silhouette"),
            reduction_pct(F.col(f"{key}_clusters") + F.col(f"{key}_unique"), F.col("total")).alias("noise_reduction"),
        )
        for key, method, value in methods
    ])))
