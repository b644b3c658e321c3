"""Checks on joins, alerts, clustering and the cluster views."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.context import Inputs
from checks.registry import check
from checks.sql import dominant_sql, mode_sql, silhouette_sql, statistics_sql
from loglens.functions import text, values
from loglens.operators import alerts as A
from loglens.operators import cluster, filters, neighbours, ranking, vectors
from loglens.plans import dashboard, endpoints
from loglens.session import scratch_path, stage
from loglens.sources import documents

# --- C: joins -------------------------------------------------------------------------------


@check("C1_lines_in_windows", "SELECT window_id, line_id, template, level FROM inside", "inside")
def _(x: Inputs):
    windows = x.scores.where("predicted = 1").select("window_id", "window_end")
    return A.lines_in_windows(x.lines, windows).select("window_id", "line_id", "template", "level")


@check("C1b_interval_join", """SELECT s.window_id, l.line_id FROM (SELECT window_id, window_start - 1800 AS a, window_end + 600 AS b FROM picked) s
JOIN logs l ON l.timestamp >= s.a AND l.timestamp < s.b""", "picked", "logs")
def _(x: Inputs):
    """Overlapping spans that are no feature windows."""
    spans = x.scores.where("predicted = 1").select(
        "window_id", (F.col("window_start") - 1800).alias("a"), (F.col("window_end") + 600).alias("b"))
    return A.interval_join(x.logs, spans, "a", "b").select("window_id", "line_id")


@check("C1c_inclusive_end", """SELECT p.window_id, count(*) AS lines FROM picked p JOIN logs l
ON l.timestamp >= p.window_start AND l.timestamp <= p.window_end GROUP BY 1""", "picked", "logs")
def _(x: Inputs):
    windows = x.scores.where("predicted = 1").select("window_id", "window_end")
    return A.lines_in_windows(x.lines, windows, inclusive_end=True).groupBy("window_id").agg(
        F.count(F.lit(1)).alias("lines"))


@check("C2_preferred_lines", "SELECT window_id, line_id, is_anomaly FROM preferred", "preferred")
def _(x: Inputs):
    windows = x.scores.where("predicted = 1")
    return A.preferred_lines(x.lines, windows).select("window_id", "line_id", "is_anomaly")


@check("C4_cluster_labels", "SELECT window_id, cluster_id, cluster_label FROM alerts", "alerts")
def _(x: Inputs):
    return A.attach_labels(x.placed).select("window_id", "cluster_id", "cluster_label")


@check("C5_top_window_lines", """SELECT window_id, window_start, round(anomaly_score, 3) AS anomaly_score, anomaly_count, line_id, level, node, template
FROM (SELECT s.window_id, s.window_start, s.anomaly_score, s.anomaly_count, l.line_id, l.level, l.node, l.template,
row_number() OVER (PARTITION BY s.window_id ORDER BY l.line_id) AS r
FROM (SELECT * FROM scores ORDER BY anomaly_score DESC, window_id LIMIT 5) s JOIN logs l
ON l.timestamp >= s.window_start AND l.timestamp < s.window_end AND l.is_anomaly = 1) WHERE r <= 5""", "scores", "logs")
def _(x: Inputs):
    return A.top_windows_first_lines(x.lines, x.scores)


@check("C6_representative_lines", "SELECT window_id, tier, rep_content, rep_level FROM represented", "represented")
def _(x: Inputs):
    return A.alert_lines(x.lines, x.bare_alerts).select("window_id", "tier", "rep_content", "rep_level")


@check("C7_dominant_lines", dominant_sql("alerts", "cluster_id"), "alerts", "logs")
def _(x: Inputs):
    return A.dominant_lines(x.lines, x.alerts)


@check("C11_neighbour_counts", """SELECT d.doc_id AS point, coalesce(n, 0) AS near FROM documents d LEFT JOIN
(SELECT a, count(*) AS n FROM doc_pairs GROUP BY 1) ON a = d.doc_id WHERE d.doc_id IN (SELECT id FROM doc_w)""", "doc_pairs", "doc_w")
def _(x: Inputs):
    """Neighbours within 0.5 of every document with a vocabulary word, equal vectors included."""
    model = vectors.tfidf(x.table("documents"), "doc_id", "text")
    groups = neighbours.model_groups(model, 0.5)
    counts = neighbours.neighbour_counts(groups, 0.5)
    alive = groups.points.join(counts, "point", "left").select(
        "point", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("near"))
    return model.members.join(alive, "point").select(F.col("doc").alias("point"), "near")


# --- I: alerts and clusters -------------------------------------------------------------------


@check("I11_make_alerts", "SELECT * FROM bare_alerts", "bare_alerts")
def _(x: Inputs):
    return x.make_alerts()


@check("I12_make_alerts_drop_empty", "SELECT * FROM bare2", "bare2")
def _(x: Inputs):
    return x.make_alerts(drop_empty=True)


@check("H5_severity_band", """SELECT window_id, CASE WHEN anomaly_score >= p95 THEN 'CRITICAL' WHEN anomaly_score >= p85 THEN 'HIGH'
WHEN anomaly_score >= p70 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM scores, cuts""", "scores", "cuts")
def _(x: Inputs):
    return A.with_severity(x.scores, x.scores).select("window_id", "severity")


@check("I13_tfidf", "SELECT id AS point, word, round(w, 9) AS w FROM doc_w WHERE id IN (SELECT min(doc_id) FROM documents GROUP BY text)", "doc_w")
def _(x: Inputs):
    """Unit TF-IDF weights of every different text."""
    docs = x.table("documents")
    model = vectors.tfidf(docs, "doc_id", "text")
    firsts = model.signed.join(vectors.distinct_texts(docs, "doc_id", "text").select("doc"), "doc")
    words = F.broadcast(model.vocabulary.select("idx", "word"))
    return model.unit(firsts).select("doc", F.inline("unit")).join(words, "idx").select(
        F.col("doc").alias("point"), "word", F.round("w", 9).alias("w"))


@check("I13b_vocabulary", "SELECT word, n, df FROM doc_vocab", "doc_vocab")
def _(x: Inputs):
    return vectors.tfidf(x.table("documents"), "doc_id", "text").vocabulary.select("word", "n", "df")


@check("I14_unit_vectors", "SELECT id AS point, CAST(word - 1 AS INTEGER) AS idx, round(w, 9) AS w FROM vec_w", "vec_w")
def _(x: Inputs):
    points = vectors.unit_vectors(x.table("embeddings"), "vec_id", "embedding")
    return vectors.dense_weights(points).select("point", "idx", F.round("w", 9).alias("w"))


@check("I15_dbscan_documents", "SELECT id AS doc_id, cluster_id FROM doc_cl", "doc_cl")
def _(x: Inputs):
    return cluster.cluster_texts(x.table("documents"), "doc_id", "text")[0].select("doc_id", "cluster_id")


@check("I15b_dbscan_alerts", "SELECT window_id, cluster_id FROM placed", "placed")
def _(x: Inputs):
    return x.cluster_alerts().select("window_id", "cluster_id")


@check("I15c_dbscan_min_samples", "SELECT id AS doc_id, cluster_id FROM dm_cl", "dm_cl")
def _(x: Inputs):
    """Core, border and noise points at a density threshold of 25."""
    rows, _, _ = cluster.cluster_texts(x.table("documents"), "doc_id", "text", eps=0.4, min_samples=25)
    return rows.select("doc_id", "cluster_id")


@check("I16_dbscan_vectors", "SELECT id AS vec_id, cluster_id FROM vec_cl", "vec_cl")
def _(x: Inputs):
    return cluster.cluster_vectors(x.table("embeddings"), "vec_id", "embedding", eps=0.6)[0]


@check("I16b_vector_neighbours", """SELECT e.vec_id AS point, coalesce(n, 0) AS near FROM embeddings e LEFT JOIN
(SELECT a, count(*) AS n FROM vec_pairs GROUP BY 1) ON a = e.vec_id""", "vec_pairs")
def _(x: Inputs):
    points = stage(vectors.unit_vectors(x.table("embeddings"), "vec_id", "embedding"), "vectors")
    return neighbours.neighbour_counts(neighbours.dense_groups(points, 0.6), 0.6)


@check("I17_cluster_statistics", statistics_sql("placed", "cluster_id"), "placed")
def _(x: Inputs):
    return cluster.cluster_statistics(x.placed)


@check("I17b_document_statistics", statistics_sql("doc_cl", "cluster_id"), "doc_cl")
def _(x: Inputs):
    return cluster.cluster_statistics(cluster.cluster_texts(x.table("documents"), "doc_id", "text")[0])


@check("I18_silhouette_documents", silhouette_sql("doc_w", "doc_cl"), "doc_w", "doc_cl")
def _(x: Inputs):
    _, found, model = cluster.cluster_texts(x.table("documents"), "doc_id", "text")
    return cluster.silhouette(found, model.weights, model)


@check("I18b_silhouette_vectors", silhouette_sql("vec_w", "(SELECT vec_id AS id, label AS cluster_id FROM embeddings)"), "vec_w")
def _(x: Inputs):
    points = stage(vectors.unit_vectors(x.table("embeddings"), "vec_id", "embedding"), "vectors")
    labels = x.table("embeddings").select(F.col("vec_id").alias("point"), F.col("label").alias("cluster_id"))
    return cluster.silhouette(points.select("point", "copies").join(labels, "point"), vectors.dense_weights(points))


@check("I19_cluster_label", "SELECT cluster_id, cluster_label FROM labels", "labels")
def _(x: Inputs):
    return A.cluster_labels(x.placed)


@check("I19b_own_noise_labels", """SELECT d.doc_id AS window_id, c.cluster_id, CASE WHEN c.cluster_id = -1 THEN 'Unique: ' || left(d.text, 40)
ELSE left(m.t, 60) END AS cluster_label FROM documents d JOIN doc_cl c ON c.id = d.doc_id
LEFT JOIN (""" + mode_sql("(SELECT c.cluster_id, d.text AS top_template FROM documents d JOIN doc_cl c ON c.id = d.doc_id)",
                          "cluster_id", "top_template", "t") + ") m USING (cluster_id)", "doc_cl")
def _(x: Inputs):
    """Document clusters stand in for alerts: they have real noise."""
    rows, _, _ = cluster.cluster_texts(x.table("documents"), "doc_id", "text")
    like_alerts = rows.select(F.col("doc_id").alias("window_id"), "cluster_id", F.col("text").alias("top_template"))
    return A.attach_labels(like_alerts, per_row_noise=True).select("window_id", "cluster_id", "cluster_label")


_METHODS = " UNION ALL ".join(
    f"SELECT '{name}' AS method, *, (SELECT silhouette FROM ({silhouette_sql(w, c)})) AS silhouette FROM ({statistics_sql('two_ways', col)})"
    for name, col, w, c in [
        ("TF-IDF + DBSCAN", "cluster_id_tfidf", "a2_w", "a2_cl"),
        ("MiniLM + DBSCAN", "cluster_id_minilm", "v2_w", "v2_cl"),
    ])
_SUMMARY = f"""SELECT *, CASE WHEN method LIKE 'TF%' THEN silhouette >= (SELECT min(silhouette) FROM m WHERE method NOT LIKE 'TF%')
ELSE silhouette > (SELECT min(silhouette) FROM m WHERE method LIKE 'TF%') END AS winner FROM m"""
_NEEDS = ("two_ways", "a2_w", "v2_w", "a2_cl", "v2_cl")


@check("I20_method_comparison", f"SELECT * FROM (WITH m AS ({_METHODS}) {_SUMMARY})", *_NEEDS)
def _(x: Inputs):
    return x.compare_methods()


@check("G3_comparison_table", f"""SELECT method, clusters, unique_rows, distinct_groups, printf('%.1f%%', noise_reduction_pct) AS noise_reduction,
round(silhouette, 4) AS silhouette, CASE WHEN winner THEN 'x' ELSE '' END AS winner FROM (WITH m AS ({_METHODS}) {_SUMMARY})""", *_NEEDS)
def _(x: Inputs):
    return dashboard.method_table(x.method_summary)


@check("I20b_finding", f"""SELECT arg_max(method, struct_pack(a := noise_reduction_pct, b := method)) AS better_reduction,
max(noise_reduction_pct) AS noise_reduction_pct, max(method) FILTER (winner) AS better_silhouette,
round(max(silhouette), 4) AS silhouette FROM (WITH m AS ({_METHODS}) {_SUMMARY})""", *_NEEDS)
def _(x: Inputs):
    return dashboard.finding(x.method_summary)


@check("I20c_comparison_endpoint", f"""SELECT CASE WHEN method LIKE 'TF%' THEN 'tfidf' ELSE 'minilm' END AS key, method,
CASE WHEN method LIKE 'TF%' THEN 0.5 ELSE 0.6 END::DOUBLE AS eps, clusters, unique_rows AS "unique", round(silhouette, 4) AS silhouette,
noise_reduction_pct AS noise_reduction FROM ({_METHODS})""", *_NEEDS)
def _(x: Inputs):
    """Written as the comparison document, read back and served."""
    def pick(column: str, method: str):
        return F.max(F.when(F.col("method").startswith(method), F.col(column)))

    doc = x.method_summary.agg(
        pick("silhouette", "TF").alias("tfidf_silhouette"), pick("silhouette", "Mini").alias("minilm_silhouette"),
        pick("clusters", "TF").alias("tfidf_clusters"), pick("unique_rows", "TF").alias("tfidf_unique"),
        pick("clusters", "Mini").alias("minilm_clusters"), pick("unique_rows", "Mini").alias("minilm_unique"))
    path = scratch_path(x.spark, "comparison")
    documents.write_json_doc(doc, path)
    total = x.two_methods.agg(F.count(F.lit(1)))
    return endpoints.clustering_comparison(documents.read_json_doc(x.spark, path), total, (0.5, 0.6))


# --- D, F, B, H on alerts ---------------------------------------------------------------------

_SUMMARY_SQL = """SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical,
count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,
count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS clusters, count(*) FILTER (cluster_id = -1) AS unique_alerts FROM placed"""


@check("D14_alert_summary", f"""SELECT *, clusters + unique_alerts AS distinct_groups,
CASE WHEN total_alerts > 0 THEN round((1 - (clusters + unique_alerts) / total_alerts) * 100, 1) ELSE 0 END AS noise_reduction_pct
FROM ({_SUMMARY_SQL})""", "placed")
def _(x: Inputs):
    return endpoints.alert_summary(x.placed)


@check("D15_noise_reduction", """SELECT level, CASE WHEN count(*) > 0 THEN round((1 - count(DISTINCT template) / count(*)) * 100, 1) ELSE 0 END AS pct
FROM logs GROUP BY 1""", "logs")
def _(x: Inputs):
    return x.logs.groupBy("level").agg(
        values.reduction_pct(F.count_distinct("template"), F.count(F.lit(1))).alias("pct"))


@check("D16_cluster_summary", """SELECT cluster_id, cluster_label, count(*) AS alert_count, round(max(anomaly_score), 4) AS max_score,
round(avg(anomaly_score), 4) AS avg_score, count(*) FILTER (severity = 'CRITICAL') AS critical_count FROM alerts GROUP BY 1, 2""", "alerts")
def _(x: Inputs):
    return endpoints.cluster_summary(x.alerts)


@check("D17_cluster_lines", f"""SELECT t.cluster_id, t.count, coalesce(CASE WHEN length(m.content) > 55 THEN left(m.content, 55) || '...' ELSE m.content END,
left(t.label, 55)) AS label, t.max_score, t.critical FROM (SELECT cluster_id, count(*) AS count, max(anomaly_score) AS max_score,
  count(*) FILTER (severity = 'CRITICAL') AS critical, arg_min(cluster_label, window_id) AS label FROM alerts WHERE cluster_id >= 0 GROUP BY 1) t
LEFT JOIN (SELECT cluster_id, content FROM (SELECT cluster_id, content, row_number() OVER (PARTITION BY cluster_id ORDER BY is_anomaly DESC, count(*) DESC, content) AS r
  FROM (SELECT a.cluster_id, l.content, l.is_anomaly FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY anomaly_score DESC, window_id) AS q
     FROM alerts WHERE cluster_id >= 0) WHERE q = 1) a JOIN logs l ON l.timestamp >= a.window_start AND l.timestamp < a.window_end)
  GROUP BY cluster_id, content, is_anomaly) WHERE r = 1) m USING (cluster_id)
ORDER BY t.count DESC, t.cluster_id LIMIT 10""", "alerts", "logs")
def _(x: Inputs):
    return A.top_window_lines(x.lines, x.alerts).orderBy(F.desc("count"), "cluster_id").limit(10)


@check("D10b_severity_counts", "SELECT severity, count(*) AS count FROM bare_alerts GROUP BY 1", "bare_alerts")
def _(x: Inputs):
    from loglens.operators.ranking import value_counts

    return value_counts(x.bare_alerts, "severity")


@check("D33_cluster_severities", "SELECT cluster_id, severity, count(*) AS n FROM placed GROUP BY 1, 2", "placed")
def _(x: Inputs):
    return A.cluster_severities(x.placed)


@check("F4_alerts_page", """SELECT window_start, window_end, round(a.anomaly_score, 4) AS anomaly_score, severity, top_template, cluster_id,
cluster_label, anomaly_count, total_logs FROM alerts a WHERE a.anomaly_score >= 0.2 AND severity = 'LOW'
ORDER BY a.anomaly_score DESC, window_start LIMIT 50 OFFSET 3""", "alerts")
def _(x: Inputs):
    return endpoints.alerts_page(x.alerts, severity="low", min_score=0.2, offset=3)


@check("F4b_alerts_total", "SELECT count(*) AS total FROM bare_alerts WHERE anomaly_score >= 0.2 AND severity = 'LOW'", "bare_alerts")
def _(x: Inputs):
    return endpoints.alerts_total(x.bare_alerts, "low", 0.2)


@check("B15_severity_filter", "SELECT window_id FROM bare_alerts WHERE severity = 'MEDIUM'", "bare_alerts")
def _(x: Inputs):
    return x.bare_alerts.where(filters.severity_is("medium")).select("window_id")


@check("F9_sort_inside_cluster", """SELECT cluster_id, window_id, row_number() OVER (PARTITION BY cluster_id ORDER BY anomaly_score DESC, window_id) AS place
FROM placed""", "placed")
def _(x: Inputs):
    return ranking.places_in_groups(x.placed.select("cluster_id", "window_id", "anomaly_score"), "cluster_id", "anomaly_score", "window_id").drop("anomaly_score")


@check("F6b_top_windows_captioned", """SELECT window_id, severity, round(anomaly_score, 3) AS score, anomaly_count, total_logs,
strftime(make_timestamp(window_start * 1000000), '%Y-%m-%d %H:%M') AS time_utc,
printf('%s | Score: %.3f | Anomalous lines: %d | %s', severity, anomaly_score, anomaly_count,
  strftime(make_timestamp(window_start * 1000000), '%Y-%m-%d %H:%M')) AS label FROM (SELECT *,
CASE WHEN anomaly_score >= p95 THEN 'CRITICAL' WHEN anomaly_score >= p85 THEN 'HIGH' WHEN anomaly_score >= p70 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM scores, cuts) ORDER BY anomaly_score DESC, window_id LIMIT 20""", "scores", "cuts")
def _(x: Inputs):
    return dashboard.top_windows(x.scores)


_BANDS = ("count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, "
          "count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l")
_DAYS = f"SELECT window_id // 24 AS day, {_BANDS} FROM bare_alerts GROUP BY 1"


def _days(x: Inputs):
    s = F.col("severity")
    return x.bare_alerts.groupBy(F.floor(F.col("window_id") / 24).alias("day")).agg(
        *[F.count_if(s == name).alias(short) for name, short in [("CRITICAL", "c"), ("HIGH", "h"), ("MEDIUM", "m"), ("LOW", "l")]])


@check("H6_worst_severity", f"""SELECT day, CASE WHEN c > 0 THEN 'CRITICAL' WHEN h > 0 THEN 'HIGH' WHEN m > 0 THEN 'MEDIUM' ELSE 'LOW' END AS marker
FROM ({_DAYS})""", "bare_alerts")
def _(x: Inputs):
    return _days(x).select("day", values.worst_severity(F.col("c"), F.col("h"), F.col("m")).alias("marker"))


@check("H7_severity_caption", f"""SELECT day, CASE WHEN c > 0 THEN c || ' CRITICAL' WHEN h > 0 THEN h || ' HIGH' WHEN l >= m THEN l || ' LOW'
ELSE m || ' MEDIUM' END AS caption FROM ({_DAYS})""", "bare_alerts")
def _(x: Inputs):
    return _days(x).select("day", values.severity_caption(*[F.col(c) for c in "chml"]).alias("caption"))


@check("I21_cluster_table", """SELECT p.cluster_id, r.window_id, strftime(make_timestamp(r.window_start * 1000000), '%Y-%m-%d %H:%M') AS time_utc,
r.severity, round(r.anomaly_score, 3) AS score, r.anomaly_count AS anomaly_lines, r.total_logs, r.rep_level AS level,
CASE WHEN length(r.rep_content) > 100 THEN left(r.rep_content, 100) || '...' ELSE r.rep_content END AS error_content
FROM represented r JOIN placed p USING (window_id)""", "represented", "placed")
def _(x: Inputs):
    return A.alert_table(x.lines, x.placed)


def _headers_sql(alerts: str, cid: str) -> str:
    return f"""SELECT g.{cid} AS cluster, CASE WHEN g.{cid} >= 0 THEN 'Cluster ' || g.{cid} ELSE 'Unique' END AS name, g.alerts, round(g.worst, 3) AS worst,
g.c AS critical, CASE WHEN c > 0 THEN 'CRITICAL' WHEN h > 0 THEN 'HIGH' WHEN m > 0 THEN 'MEDIUM' ELSE 'LOW' END AS marker,
CASE WHEN c > 0 THEN c || ' CRITICAL' WHEN h > 0 THEN h || ' HIGH' WHEN l >= m THEN l || ' LOW' ELSE m || ' MEDIUM' END AS caption,
d.dominant_template, left(trim(regexp_replace(regexp_replace(d.rep_content, '0x[0-9a-fA-F]+', '', 'g'), '\\s+', ' ', 'g')), 65) AS line
FROM (SELECT {cid}, count(*) AS alerts, max(anomaly_score) AS worst, {_BANDS} FROM {alerts} GROUP BY 1) g
JOIN ({dominant_sql(alerts, cid)}) d USING ({cid})"""


@check("I21b_cluster_headers", _headers_sql("alerts", "cluster_id"), "alerts", "logs")
def _(x: Inputs):
    return dashboard.cluster_headers(x.lines, x.alerts)


@check("I21c_headers_by_vectors", _headers_sql("two_ways", "cluster_id_minilm"), "two_ways", "logs")
def _(x: Inputs):
    return dashboard.cluster_headers(x.lines, x.two_methods, "cluster_id_minilm")


@check("I21d_relabelled", f"""SELECT b.window_id, b.cluster_id_minilm, m.t AS cluster_label_view FROM two_ways b
JOIN ({mode_sql('two_ways', 'cluster_id_minilm', 'top_template', 't')}) m USING (cluster_id_minilm)""", "two_ways")
def _(x: Inputs):
    return dashboard.relabelled(x.two_methods, "cluster_id_minilm").select(
        "window_id", "cluster_id_minilm", "cluster_label_view")


@check("H2b_label_cut", "SELECT window_id, left(top_template, 50) AS short FROM bare_alerts", "bare_alerts")
def _(x: Inputs):
    return x.bare_alerts.select("window_id", text.truncate(F.col("top_template"), 50).alias("short"))
