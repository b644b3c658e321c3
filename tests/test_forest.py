import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.operators import forest


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(7)
    rows = []
    for w in range(400):
        values = rng.normal(10, 1, 4) if w != 123 else np.array([60.0, -40.0, 55.0, 80.0])
        rows += [(w, f"f{i}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "window_id bigint, feature string, x double").cache()


def _scores(features, parts):
    moved = features.repartition(parts)
    model = forest.fit_isolation_forest(moved, moved.select("window_id").distinct(), trees=40)
    return {r.window_id: r.anomaly_score for r in forest.score_windows(moved, model).collect()}


def test_scores_are_in_range_and_find_the_outlier(features):
    scores = _scores(features, 3)
    assert len(scores) == 400
    assert all(0 < s <= 1 for s in scores.values())
    assert max(scores, key=scores.get) == 123


def test_scores_do_not_depend_on_partitions(features):
    assert _scores(features, 2) == _scores(features, 13)


def test_samples_are_exact(features):
    ids = features.select("window_id").distinct()
    per_tree = forest.tree_samples(ids, 400, trees=20, sample=64).groupBy("tree").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("window_id").alias("d")).collect()
    assert [(r.n, r.d) for r in per_tree] == [(64, 64)] * 20
    few = forest.tree_samples(ids.where("window_id < 10"), 10, trees=3, sample=64)
    assert few.count() == 30


def test_medians_count_absent_rows(spark):
    x = spark.createDataFrame([(1, "a", 5.0), (2, "b", 3.0), (3, "a", 7.0)], "window_id bigint, feature string, x double")
    meta = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "window_id bigint, is_anomaly int")
    assert {r.feature: r.median for r in forest.class_medians(x, meta).collect()} == {"a": 5.0, "b": 0.0}
