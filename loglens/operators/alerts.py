"""Anomalous windows to alerts, and the lines that represent them.

``lines`` below is the parsed table with its ``window_id`` (``windows.assign_windows``).
A window spans [first line, last line] of one ``window_id``, so every interval lookup
"start <= ts < end" is an equality on ``window_id`` plus ``ts < end``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.functions import text, values
from loglens.operators import quantiles
from loglens.operators.joins import spread_join
from loglens.operators.ranking import mode_of
from loglens.operators.scoring import one
from loglens.schemas import FALLBACK_LEVELS, NOISE


def interval_join(lines: DataFrame, spans: DataFrame, start: str, end: str, width: int = 3600) -> DataFrame:
    """Lines with ``start <= timestamp < end`` for arbitrary spans, without a nested loop:
    both sides meet on fixed time cells, a span visiting each cell it touches. The second
    key spreads a crowded cell over several tasks."""
    def cell(at: Column) -> Column:
        return F.floor(at / width)

    reach = spans.where(F.col(end) > F.col(start)).withColumn(
        "cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end) - 1)))
    )
    placed = lines.withColumn("cell", cell(F.col("timestamp")))
    inside = (F.col("timestamp") >= F.col(start)) & (F.col("timestamp") < F.col(end))
    return spread_join(placed, reach, ["cell"], by="line_id").where(inside).drop("cell")


def _before_end(inclusive_end: bool) -> Column:
    stamp, end = F.col("timestamp"), F.col("window_end")
    return stamp <= end if inclusive_end else stamp < end


def lines_in_windows(lines: DataFrame, windows: DataFrame, inclusive_end: bool = False) -> DataFrame:
    """Each line of each given window. Windows are small and repeated per salt; the planner
    broadcasts them when their measured size allows, and no task gets a whole busy window
    when it does not. The end second is excluded unless asked for."""
    return spread_join(lines, windows, ["window_id"], by="line_id").where(_before_end(inclusive_end))


def preferred_lines(lines: DataFrame, windows: DataFrame, inclusive_end: bool = False) -> DataFrame:
    """Anomalous lines of each window where it has any, else all its lines."""
    inside = lines_in_windows(lines, windows.select("window_id", "window_end"), inclusive_end)
    flagged = inside.where("is_anomaly = 1").select("window_id").distinct().withColumn("has", F.lit(True))
    kept = lines_in_windows(lines, windows.select("window_id", "window_end").join(flagged, "window_id", "left"),
                            inclusive_end)
    return kept.where((F.col("is_anomaly") == 1) | F.col("has").isNull()).drop("has", "window_end")


def second_cells(lines: DataFrame, *columns: str) -> DataFrame:
    """Line counts per window and second. A window holds at most 3,600 seconds, so even the
    busiest one shrinks to seconds x distinct values before it is joined or grouped."""
    return lines.groupBy("window_id", "timestamp", *columns).agg(F.count(F.lit(1)).alias("n"))


def window_tops(lines: DataFrame, windows: DataFrame, inclusive_end: bool = False) -> DataFrame:
    """Most frequent template and level per window, anomalous lines going first."""
    cells = second_cells(lines, "template", "level", "is_anomaly")
    ends = windows.select("window_id", "window_end")
    inside = spread_join(cells, ends, ["window_id"], by="timestamp").where(_before_end(inclusive_end))
    counts = inside.groupBy("window_id", "template", "level", "is_anomaly").agg(F.sum("n").alias("n"))
    return _mode(counts, "template").join(_mode(counts, "level"), "window_id")


def _mode(counts: DataFrame, value: str) -> DataFrame:
    per_value = counts.groupBy("window_id", "is_anomaly", value).agg(F.sum("n").alias("n"))
    best = mode_of(per_value, ["window_id"], value, prefer="is_anomaly")
    return best.select("window_id", F.col(value).alias(f"top_{value}"))


def severity_cuts(scores: DataFrame) -> DataFrame:
    """The 0.95, 0.85 and 0.70 quantiles of the scores of predicted windows."""
    picked = scores.where("predicted = 1")
    return quantiles.row(picked, "anomaly_score", {"p95": 0.95, "p85": 0.85, "p70": 0.70})


def with_severity(windows: DataFrame, scores: DataFrame) -> DataFrame:
    """Add the severity band; the cuts always come from the predicted windows of ``scores``."""
    cuts = one(severity_cuts(scores))
    return (
        windows.withColumn("cuts", cuts)
        .withColumn("severity", values.severity_band(
            F.col("anomaly_score"), F.col("cuts.p95"), F.col("cuts.p85"), F.col("cuts.p70")))
        .drop("cuts")
    )


def make_alerts(
    lines: DataFrame, scores: DataFrame, drop_empty: bool = False, inclusive_end: bool = False
) -> DataFrame:
    """One alert per predicted window. Windows without lines before their last second become
    ``unknown`` / ``INFO`` alerts, or are left out with ``drop_empty``."""
    picked = scores.where("predicted = 1").select(
        "window_id", "window_start", "window_end", "anomaly_score", "anomaly_count", "total_logs"
    )
    tops = window_tops(lines, picked, inclusive_end)
    graded = with_severity(picked, scores)
    return graded.join(tops, "window_id", "inner" if drop_empty else "left").select(
        "window_id", "window_start", "window_end", "anomaly_score", "anomaly_count", "total_logs", "severity",
        F.coalesce("top_template", F.lit("unknown")).alias("top_template"),
        F.coalesce("top_level", F.lit("INFO")).alias("top_level"),
    )


def cluster_labels(alerts: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Per cluster: its most frequent template, cut to 60; all noise shares one label, taken
    from the first noise alert."""
    clustered = alerts.where(F.col(cluster) != NOISE)
    counts = clustered.groupBy(cluster, "top_template").agg(F.count(F.lit(1)).alias("n"))
    modes = mode_of(counts, [cluster], "top_template").select(
        cluster, text.truncate(F.col("top_template"), 60).alias("cluster_label")
    )
    noise = alerts.where(F.col(cluster) == NOISE).groupBy(cluster).agg(
        F.concat(F.lit("Unique: "), text.truncate(F.min_by("top_template", "window_id"), 40)).alias("cluster_label")
    )
    return modes.unionByName(noise)


def attach_labels(alerts: DataFrame, per_row_noise: bool = False, cluster: str = "cluster_id") -> DataFrame:
    """Add ``cluster_label``; optionally each noise alert gets a label of its own. There is
    one label row per cluster and no size bound on it, so the planner picks the join; a cluster
    holding most alerts is spread over several tasks."""
    labelled = spread_join(alerts, cluster_labels(alerts, cluster), [cluster], by="window_id", how="left")
    if per_row_noise:
        own = F.concat(F.lit("Unique: "), text.truncate(F.col("top_template"), 40))
        labelled = labelled.withColumn(
            "cluster_label", F.when(F.col(cluster) == NOISE, own).otherwise(F.col("cluster_label"))
        )
    return labelled


def alert_lines(lines: DataFrame, alerts: DataFrame) -> DataFrame:
    """A representative line per alert, in three tiers: lines with the alert's template, else
    lines at an error level, else the template itself with level UNKNOWN."""
    keyed = alerts.select("window_id", "window_end", "top_template")
    tier = F.when(F.col("template") == F.col("top_template"), 1).when(F.col("level").isin(FALLBACK_LEVELS), 2)
    hits = (
        lines_in_windows(lines, keyed).withColumn("tier", tier).where(F.col("tier").isNotNull())
        .groupBy("window_id", "tier", "content")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_id", "level")).alias("first"))
    )
    best = hits.groupBy("window_id").agg(
        F.min(F.struct("tier", (-F.col("n")).alias("rank"), "content")).alias("by_count"),
        F.min(F.struct("tier", "first")).alias("by_line"),
    )
    return alerts.join(best, "window_id", "left").select(
        *alerts.columns,
        F.coalesce("by_count.tier", F.lit(3)).alias("tier"),
        F.coalesce("by_count.content", "top_template").alias("rep_content"),
        F.coalesce("by_line.first.level", F.lit("UNKNOWN")).alias("rep_level"),
    )


def alert_table(lines: DataFrame, alerts: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """What a cluster's detail table shows, best score first inside each cluster."""
    return alert_lines(lines, alerts).select(
        cluster,
        "window_id",
        values.epoch_text(F.col("window_start")).alias("time_utc"),
        "severity",
        F.round("anomaly_score", 3).alias("score"),
        F.col("anomaly_count").alias("anomaly_lines"),
        "total_logs",
        F.col("rep_level").alias("level"),
        text.ellipsize(F.col("rep_content"), 100).alias("error_content"),
    ).orderBy(cluster, F.desc("score"), "window_id")


def dominant_lines(lines: DataFrame, alerts: DataFrame, cluster: str = "cluster_id", tries: int = 5) -> DataFrame:
    """Per cluster: its most frequent template, and the commonest line with that template in
    the first of its first five alerts that has one (else the template text)."""
    counts = alerts.groupBy(cluster, "top_template").agg(F.count(F.lit(1)).alias("n"))
    dominant = mode_of(counts, [cluster], "top_template").select(
        cluster, F.col("top_template").alias("dominant_template")
    )
    order = Window.partitionBy(cluster).orderBy("window_id")
    early = (
        alerts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= tries)
        .select(cluster, "place", "window_id", "window_end").join(dominant, cluster)
    )
    hits = (
        lines_in_windows(lines, early).where(F.col("template") == F.col("dominant_template"))
        .groupBy(cluster, "place", "content").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(cluster).agg(F.min(F.struct("place", (-F.col("n")).alias("rank"), "content")).alias("best"))
    )
    return dominant.join(hits, cluster, "left").select(
        cluster, "dominant_template",
        F.coalesce("best.content", "dominant_template").alias("rep_content"),
    )


def top_window_lines(lines: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per real cluster: size, worst score, critical count and the commonest line of its
    top-scoring window (anomalous lines first), cut to 55; a window without lines falls back
    to the cluster's label."""
    real = alerts.where(F.col("cluster_id") != NOISE)
    per = real.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.max("anomaly_score").alias("max_score"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.min(F.struct((-F.col("anomaly_score")).alias("rank"), "window_id", "window_end")).alias("top"),
        F.min_by("cluster_label", "window_id").alias("cluster_label"),
    )
    tops = per.select("cluster_id", "top.window_id", "top.window_end")
    counts = lines_in_windows(lines, tops).groupBy("cluster_id", "is_anomaly", "content").agg(
        F.count(F.lit(1)).alias("n"))
    best = mode_of(counts, ["cluster_id"], "content", prefer="is_anomaly").select("cluster_id", "content")
    return per.join(best, "cluster_id", "left").select(
        "cluster_id", "count",
        F.coalesce(text.ellipsize(F.col("content"), 55), text.truncate(F.col("cluster_label"), 55)).alias("label"),
        "max_score", "critical",
    )


def top_windows_first_lines(lines: DataFrame, scores: DataFrame, windows: int = 5, per_window: int = 5) -> DataFrame:
    """The first anomalous lines of the highest-scoring windows."""
    top = scores.orderBy(F.desc("anomaly_score"), "window_id").limit(windows).select(
        "window_id", "window_start", "window_end", "anomaly_score", "anomaly_count"
    )
    hits = lines_in_windows(lines.where("is_anomaly = 1"), top)
    order = Window.partitionBy("window_id").orderBy("line_id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_window).select(
        "window_id", "window_start", F.round("anomaly_score", 3).alias("anomaly_score"),
        "anomaly_count", "line_id", "level", "node", "template",
    )


def cluster_severities(alerts: DataFrame) -> DataFrame:
    """(cluster_id, severity, n): how many alerts of each severity a cluster has."""
    return alerts.groupBy("cluster_id", "severity").agg(F.count(F.lit(1)).alias("n"))
