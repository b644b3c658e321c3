"""Quality figures on odd inputs."""

import math

import pytest
from pyspark.sql import functions as F

from loglens.operators import evaluate

_COLUMNS = "anomaly_score double, is_anomaly int, predicted int"


@pytest.mark.parametrize("truth", [1, 0])
def test_area_of_one_class_is_undefined(spark, truth):
    """Without a pair of both classes there is no share of pairs ranked right, also not 0."""
    scores = spark.createDataFrame([(0.2, truth, 0), (0.7, truth, 1)], _COLUMNS)
    area = evaluate.roc_auc(scores).first()["roc_auc"]
    assert math.isnan(area) if truth else area is None


def test_document_of_one_class(spark):
    scores = spark.createDataFrame([(0.2, 1, 0), (0.7, 1, 1)], _COLUMNS)
    row = evaluate.metrics_document(scores, "logs").first()
    assert math.isnan(row.roc_auc) and row.normal_windows == 0 and row.recall_anomaly == 0.5


def test_document_rounds_like_its_sql(spark):
    """57 of 800 is a little less than 0.07125 as a double; its decimal digits would be rounded up."""
    duckdb = pytest.importorskip("duckdb")
    scores = spark.range(800).select(
        (F.col("id") / 800).alias("anomaly_score"), (F.col("id") % 2).cast("int").alias("is_anomaly"),
        F.when(F.col("id") < 57, F.col("id") % 2).otherwise(1 - F.col("id") % 2).cast("int").alias("predicted"))
    want = duckdb.connect().execute("SELECT round(57 / 800, 4)").fetchone()[0]
    assert evaluate.metrics_document(scores, "logs").first()["accuracy"] == want == 0.0712


def test_profile_makes_its_scores_once(spark):
    """Whatever stands behind the scores, often all lines, is computed once and not for every pass over the ranks."""
    made = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    scores = spark.range(200).select((F.col("id") / 200).alias("anomaly_score")).mapInArrow(noted, "anomaly_score double")
    row = evaluate.score_profile(scores).first()
    assert (row.score_min, row.score_max, round(row.score_p90, 9)) == (0.0, 0.995, 0.8955) and made.value == 200
