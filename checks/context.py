"""Lazily derived inputs of one check run, mirrored by the SQL tables in ``checks.sql``."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from loglens.operators import alerts as A
from loglens.operators import cluster, scoring, vectors, windows
from loglens.session import stage


_STAGED: dict[tuple[str, str, str], DataFrame] = {}
_CLUSTERED: dict[tuple[str, str, str], tuple] = {}


class Inputs:
    """Every member is derived from the given tables. The stage outputs (scores, alerts) are
    written once per session and data set and then reused, as ``plans.stages`` does."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STAGED:
            _STAGED[key] = stage(build(), name)
        return _STAGED[key]

    def table(self, name: str) -> DataFrame:
        return inputs.table(self.spark, self.sf_dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return inputs.raw_lines(self.spark, self.sf_dir)

    @cached_property
    def logs(self) -> DataFrame:
        return inputs.logs(self.spark, self.sf_dir)

    @cached_property
    def lines(self) -> DataFrame:
        return windows.assign_windows(self.logs)

    @cached_property
    def cells(self) -> DataFrame:
        return windows.window_cells(self.logs)

    @cached_property
    def counts(self) -> DataFrame:
        return windows.event_counts(self.cells)

    @cached_property
    def meta(self) -> DataFrame:
        return windows.window_meta(self.cells)

    @cached_property
    def features(self) -> DataFrame:
        return windows.long_features(self.counts, self.meta)

    @cached_property
    def scored(self) -> DataFrame:
        """Windows with the surrogate score."""
        return scoring.surrogate_scores(self.meta)

    @cached_property
    def confirmed(self) -> DataFrame:
        """Raw predictions with the evidence filter's opinion."""
        return scoring.confirm(scoring.predict(self.stage("scored", lambda: self.scored)))

    @cached_property
    def scores(self) -> DataFrame:
        return self.stage("scores", lambda: scoring.apply_gate(self.confirmed))

    def make_alerts(self, drop_empty: bool = False) -> DataFrame:
        return A.make_alerts(self.lines, self.scores, drop_empty)

    @cached_property
    def bare_alerts(self) -> DataFrame:
        """Alerts before clustering."""
        return self.stage("bare_alerts", self.make_alerts)

    def cluster_alerts(self) -> DataFrame:
        return cluster.cluster_texts(self.bare_alerts, "window_id", "top_template")[0]

    @cached_property
    def placed(self) -> DataFrame:
        """Alerts with cluster ids."""
        return self.stage("placed", self.cluster_alerts)

    @cached_property
    def alerts(self) -> DataFrame:
        """Alerts with text clusters and labels."""
        return self.stage("alerts", lambda: A.attach_labels(self.placed))

    @cached_property
    def both_ways(self) -> tuple[DataFrame, tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
        """Alerts clustered by text and by a vector column, with the points of both (whose
        copies sit in written tables); clustered once per session and data set."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "both_ways")
        if key not in _CLUSTERED:
            made = self.stage("full_alerts", lambda: self.make_alerts(drop_empty=True).drop("top_level"))
            vectors_ = self.table("embeddings")
            slots = vectors_.select(F.col("vec_id").alias("slot"), "embedding")
            with_vector = made.withColumn("slot", F.col("window_id") % vectors_.count()).join(slots, "slot")
            text, text_points, model = cluster.cluster_texts(made, "window_id", "top_template")
            dense, dense_points, unit = cluster.cluster_vectors(with_vector, "window_id", "embedding", eps=0.6)
            both = text.withColumnRenamed("cluster_id", "cluster_id_tfidf").join(
                dense.withColumnRenamed("cluster_id", "cluster_id_minilm"), "window_id")
            _CLUSTERED[key] = (stage(both, "both"), (text_points, model.weights),
                               (dense_points, vectors.dense_weights(unit)))
        return _CLUSTERED[key]

    @property
    def two_methods(self) -> DataFrame:
        return self.both_ways[0]

    def compare_methods(self) -> DataFrame:
        both, text, dense = self.both_ways
        rows = []
        for name, column, (points, weights) in [("TF-IDF + DBSCAN", "cluster_id_tfidf", text),
                                                ("MiniLM + DBSCAN", "cluster_id_minilm", dense)]:
            rows.append(
                cluster.cluster_statistics(both, column)
                .withColumn("silhouette", cluster.silhouette(points, weights).scalar())
                .withColumn("method", F.lit(name))
            )
        return cluster.compare_methods(*rows)

    @cached_property
    def method_summary(self) -> DataFrame:
        return self.stage("method_summary", self.compare_methods)
