"""The stages from a raw log to alerts. Each writes its tables and can be reused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.operators import alerts as A
from loglens.operators import cluster, evaluate, forest, quality, scoring, templates, vectors, windows
from loglens.operators.parse import parse_lines
from loglens.session import stage
from loglens.sources import documents, models, tables
from loglens.sources.raw import read_raw_log


@dataclass(frozen=True)
class Paths:
    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        suffix = {"metrics": ".json", "clustering_comparison": ".json", "verdict": ".json", "model": ""}.get(name, ".parquet")
        return f"{self.root.rstrip('/')}/{name}{suffix}"


def ingest(spark: SparkSession, log: str, out: Paths, mine: bool = True, if_exists: str = "skip") -> DataFrame:
    """Raw log to the ``parsed`` table."""
    def build() -> DataFrame:
        parsed = tables.materialize(spark, out.lines, lambda: parse_lines(read_raw_log(spark, log)), if_exists, [log])
        return templates.with_mined_templates(parsed) if mine else templates.mask_templates(parsed)

    tables.require(spark, log, "the log collector")
    return tables.materialize(spark, out.parsed, build, if_exists, [log], {"mine": mine})


def measure(spark: SparkSession, out: Paths, if_exists: str = "skip") -> tuple[DataFrame, DataFrame]:
    """``features`` (one row per window) and ``features_long`` (event counts)."""
    parsed = tables.read_table(spark, tables.require(spark, out.parsed, "ingest"))
    cells = stage(windows.window_cells(parsed), "cells")  # used twice; the log is scanned once
    meta = tables.materialize(spark, out.features, lambda: windows.window_meta(cells), if_exists, [out.parsed])
    counts = tables.materialize(spark, out.features_long, lambda: windows.event_counts(cells), if_exists, [out.parsed])
    return meta, counts


def score(spark: SparkSession, out: Paths, dataset: str, if_exists: str = "skip",
          share: float | None = None) -> DataFrame:
    """Fit, score, predict, confirm; writes ``scores``, the model tables and the metrics."""
    meta = tables.read_table(spark, tables.require(spark, out.features, "measure"))
    counts = tables.read_table(spark, tables.require(spark, out.features_long, "measure"))
    features = windows.long_features(counts, meta)

    def build() -> DataFrame:
        n = meta.count()
        stats = windows.scaler_stats(features, F.lit(n))
        trees = forest.fit_isolation_forest(features, meta.select("window_id"))
        models.save_model(models.Model(trees, stats, stats.select("feature")), out.model)
        model = models.load_model(spark, out.model)
        scored = meta.join(forest.score_windows(features, model.trees), "window_id")
        scored = tables.materialize(spark, out.scored, lambda: scored, "overwrite")
        return scoring.apply_gate(scoring.confirm(scoring.predict(scored, share)))

    scores = tables.materialize(spark, out.scores, build, if_exists, [out.features, out.features_long], {"share": share})
    documents.write_json_doc(evaluate.metrics_document(scores, dataset), out.metrics)
    return scores


def alert(spark: SparkSession, out: Paths, if_exists: str = "skip") -> DataFrame:
    """``alerts`` with text clusters and labels."""
    parsed = tables.read_table(spark, tables.require(spark, out.parsed, "ingest"))
    scores = tables.read_table(spark, tables.require(spark, out.scores, "score"))

    def build() -> DataFrame:
        made = tables.materialize(
            spark, out.alerts_unclustered,
            lambda: A.make_alerts(windows.assign_windows(parsed), scores), "overwrite")
        clustered, _, _ = cluster.cluster_texts(made, "window_id", "top_template")
        return A.attach_labels(clustered)

    return tables.materialize(spark, out.alerts, build, if_exists, [out.parsed, out.scores])


def compare(spark: SparkSession, out: Paths, embeddings: DataFrame, eps: float = 0.4, text_eps: float = 0.5,
            if_exists: str = "skip") -> DataFrame:
    """Cluster the alerts by text and by ``embeddings`` (window_id, embedding); windows without one
    are left out. Writes ``alerts_two_methods`` and the ``clustering_comparison`` document, and
    returns the two-row comparison."""
    parsed = tables.read_table(spark, tables.require(spark, out.parsed, "ingest"))
    scores = tables.read_table(spark, tables.require(spark, out.scores, "score"))
    made = tables.materialize(
        spark, out.alerts_compared,
        lambda: A.make_alerts(windows.assign_windows(parsed), scores, drop_empty=True).drop("top_level"), if_exists,
        [out.parsed, out.scores])
    text, text_points, model = cluster.cluster_texts(made, "window_id", "top_template", text_eps)
    placed = made.select("window_id").join(embeddings.select("window_id", "embedding"), "window_id")
    dense, dense_points, unit = cluster.cluster_vectors(placed, "window_id", "embedding", eps)
    both = tables.materialize(
        spark, out.alerts_two_methods,
        lambda: text.withColumnRenamed("cluster_id", "cluster_id_tfidf").join(
            dense.withColumnRenamed("cluster_id", "cluster_id_minilm"), "window_id"), if_exists,
        [out.alerts_compared], {"eps": eps, "text_eps": text_eps, "embeddings": embeddings.agg(
            F.bit_xor(F.xxhash64("window_id", "embedding"))).first()[0]})
    rows = {}
    for name, label, points, weights in [("tfidf", "TF-IDF + DBSCAN", text_points, model.weights),
                                         ("minilm", "MiniLM + DBSCAN", dense_points, vectors.dense_weights(unit))]:
        rows[name] = stage(
            cluster.cluster_statistics(both, f"cluster_id_{name}")
            .withColumn("silhouette", cluster.silhouette(points, weights).scalar()).withColumn("method", F.lit(label)), "summary")
    halves = [
        rows[name].select(F.col("silhouette").alias(f"{name}_silhouette"), F.col("clusters").alias(f"{name}_clusters"),
                          F.col("unique_rows").alias(f"{name}_unique")) for name in rows]
    documents.write_json_doc(halves[0].join(halves[1]), out.clustering_comparison)  # one row each
    return cluster.compare_methods(rows["tfidf"], rows["minilm"])


def verify(spark: SparkSession, out: Paths, low: int = 1000, high: int = 50000, normal_below: float = 0.35,
           extreme_above: float = 0.40) -> DataFrame:
    """Check the written tables and the saved model. Writes ``report`` (one row for each check) and
    the ``verdict`` document, and returns the report."""
    parsed = tables.read_table(spark, tables.require(spark, out.parsed, "ingest"))
    counts = tables.read_table(spark, tables.require(spark, out.features_long, "measure"))
    scores = tables.read_table(spark, tables.require(spark, out.scores, "score"))
    meta = tables.read_table(spark, out.features)
    metrics = documents.read_json_doc(spark, tables.require(spark, out.metrics, "score"))
    model = models.load_model(spark, out.model)
    checked = quality.quality_report(windows.assign_windows(parsed), counts, meta, scores, metrics, low, high)
    probes = forest.score_external(
        forest.probe_vectors(windows.long_features(counts, meta), meta, model.scaler), model.trees)
    behaviour = quality.model_check(probes, evaluate.mean_score_by_class(scores), normal_below, extreme_above)
    report = tables.materialize(spark, out.report, lambda: checked.unionByName(behaviour), "overwrite")
    documents.write_json_doc(quality.verdict(report), out.verdict)
    return report
