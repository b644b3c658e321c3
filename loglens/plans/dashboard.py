"""The data behind the dashboard's panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.functions import text, values
from loglens.operators import filters, quantiles
from loglens.operators.alerts import dominant_lines, with_severity
from loglens.operators.joins import spread_join
from loglens.operators.ranking import mode_of


def top_templates(parsed: DataFrame, n: int = 15) -> DataFrame:
    counts = parsed.groupBy("event_id", "template").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "event_id", "template").limit(n).withColumn(
        "short", text.truncate(F.col("template"), 55))


def top_event_means(counts: DataFrame, meta: DataFrame, parsed: DataFrame, n: int = 10) -> DataFrame:
    """Event types with the highest mean count over all windows, zeros included."""
    windows = meta.agg(F.count(F.lit(1))).scalar()
    best = (
        counts.groupBy("event_id").agg((F.sum("n") / windows).alias("mean_count"))
        .orderBy(F.desc("mean_count"), "event_id").limit(n)
    )
    names = parsed.groupBy("event_id").agg(F.min_by("template", "line_id").alias("template"))
    return best.join(names, "event_id", "left").select(
        "event_id", "mean_count",
        text.truncate(F.coalesce("template", F.lit("unknown")), 55).alias("template"),
    )


def log_view(parsed: DataFrame, which: str = "all", levels: list[str] | None = None,
             search: str | None = None) -> DataFrame:
    """The log explorer's filters; the search is a regular expression."""
    return parsed.where(filters.all_of([
        filters.show(which), filters.level_in(levels), filters.search_regex(search)]))


def view_stats(view: DataFrame) -> DataFrame:
    """Counts of a filtered view; the rate of an empty view is null, shown as N/A."""
    rate = F.avg("is_anomaly")
    return view.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("is_anomaly") == 1).alias("anomalous"),
        F.count_if(F.col("is_anomaly") == 0).alias("normal"),
        rate.alias("rate"),
        F.coalesce(values.percent_text(rate, 2), F.lit("N/A")).alias("rate_text"),
    )


def timeline(scores: DataFrame, threshold: float | None = None) -> DataFrame:
    """Score over time; ``flagged`` at or above the threshold (default: the 0.90 quantile)."""
    limit = F.lit(threshold if threshold is not None else quantiles.exact(scores, "anomaly_score", [0.90])[0])
    return scores.select(
        values.epoch_text(F.col("window_start")).alias("window_dt"), "window_start", "anomaly_score",
        (F.col("anomaly_score") >= limit).alias("flagged"),
    )


def volume_series(scores: DataFrame) -> DataFrame:
    return scores.select("window_id", "total_logs", "anomaly_score",
                         values.truth_text(F.col("is_anomaly")).alias("ground_truth"))


def top_windows(scores: DataFrame, n: int = 20) -> DataFrame:
    """Highest scores with their band and caption. Every window is graded with the cuts of the
    predicted ones."""
    best = with_severity(scores, scores).orderBy(F.desc("anomaly_score"), "window_id").limit(n)
    return best.select(
        "window_id", "severity", F.round("anomaly_score", 3).alias("score"), "anomaly_count", "total_logs",
        values.epoch_text(F.col("window_start")).alias("time_utc"),
        F.format_string(
            "%s | Score: %.3f | Anomalous lines: %d | %s", "severity", "anomaly_score", "anomaly_count",
            values.epoch_text(F.col("window_start")),
        ).alias("label"),
    )


def cluster_headers(lines: DataFrame, alerts: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """One header per cluster (noise too): size, worst score, band, caption and a clean line."""
    severity = F.col("severity")
    per = alerts.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("alerts"),
        F.max("anomaly_score").alias("worst"),
        *[F.count_if(severity == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")],
    )
    counts = [F.col(s) for s in ("critical", "high", "medium", "low")]
    return per.join(dominant_lines(lines, alerts, cluster), cluster).select(
        F.col(cluster).alias("cluster"),
        F.when(F.col(cluster) >= 0, F.concat(F.lit("Cluster "), F.col(cluster).cast("string")))
        .otherwise("Unique").alias("name"),
        "alerts",
        F.round("worst", 3).alias("worst"),
        "critical",
        values.worst_severity(*counts[:3]).alias("marker"),
        values.severity_caption(*counts).alias("caption"),
        "dominant_template",
        text.clean_caption(F.col("rep_content")).alias("line"),
    )


def relabelled(alerts: DataFrame, cluster: str) -> DataFrame:
    """Alerts with ``cluster_label_view``: the commonest template of the chosen clustering."""
    counts = alerts.groupBy(cluster, "top_template").agg(F.count(F.lit(1)).alias("n"))
    labels = mode_of(counts, [cluster], "top_template").select(
        cluster, F.col("top_template").alias("cluster_label_view"))
    return spread_join(alerts, labels, [cluster], by="window_id", how="left")


def method_table(summary: DataFrame) -> DataFrame:
    """Two-row comparison table with a mark at the winner."""
    return summary.select(
        "method", "clusters", "unique_rows", "distinct_groups",
        values.percent_text(F.col("noise_reduction_pct") / 100, 1).alias("noise_reduction"),
        F.round("silhouette", 4).alias("silhouette"),
        F.when(F.col("winner"), "x").otherwise("").alias("winner"),
    )


def finding(summary: DataFrame) -> DataFrame:
    """Which method reduces more, and which one is better separated, as computed."""
    reduce_best = F.max_by("method", F.struct("noise_reduction_pct", "method"))
    return summary.agg(
        reduce_best.alias("better_reduction"),
        F.max("noise_reduction_pct").alias("noise_reduction_pct"),
        F.max_by("method", F.col("winner").cast("int")).alias("better_silhouette"),
        F.round(F.max("silhouette"), 4).alias("silhouette"),
    )
