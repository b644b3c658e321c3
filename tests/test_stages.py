"""From a raw log file to labelled alerts, and reuse of finished stages."""

import pytest
from pyspark.sql import functions as F

from checks import inputs
from loglens.operators import quality, windows
from loglens.plans import endpoints, stages
from loglens.sources import documents, tables


@pytest.fixture(scope="module")
def out(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    log = str(root / "raw")
    inputs.raw_lines(spark, sf_dir).orderBy("line_id").select("value").write.text(log)
    paths = stages.Paths(str(root / "out"))
    stages.ingest(spark, log, paths)
    stages.measure(spark, paths)
    stages.score(spark, paths, "logs")
    stages.alert(spark, paths)
    return paths


def test_tables_are_sound(spark, out):
    parsed, scores = tables.read_table(spark, out.parsed), tables.read_table(spark, out.scores)
    counts = tables.read_table(spark, out.features_long)
    metrics = documents.read_json_doc(spark, out.metrics)
    report = quality.quality_report(windows.assign_windows(parsed), counts, scores, scores, metrics, 1, 50000)
    assert report.where("not ok").count() == 0
    assert report.count() == 11


def test_alerts_cover_predicted_windows(spark, out):
    alerts = tables.read_table(spark, out.alerts)
    predicted = tables.read_table(spark, out.scores).where("predicted = 1")
    assert alerts.count() == predicted.count() > 0
    assert alerts.where(F.col("cluster_label").isNull()).count() == 0
    assert endpoints.alert_summary(alerts).first().total_alerts == alerts.count()


def test_finished_stage_is_reused(spark, sf_dir, tmp_path):
    """As long as its input, its parameters and the code are the same."""
    log, paths = str(tmp_path / "raw"), stages.Paths(str(tmp_path / "out"))
    lines = inputs.raw_lines(spark, sf_dir)
    lines.where("line_id < 100").select("value").write.text(log)

    def files():
        return tables.read_table(spark, paths.parsed).inputFiles()

    stages.ingest(spark, log, paths, mine=False)
    stages.measure(spark, paths)
    first, features = files(), tables.read_table(spark, paths.features).inputFiles()
    stages.ingest(spark, log, paths, mine=False)
    stages.measure(spark, paths)
    assert files() == first and tables.read_table(spark, paths.features).inputFiles() == features
    stages.ingest(spark, log, paths)
    assert files() != first
    lines.where("line_id BETWEEN 100 AND 150").select("value").write.mode("append").text(log)
    second = files()
    count = tables.read_table(spark, paths.parsed).count()
    stages.ingest(spark, log, paths)
    assert files() != second and tables.read_table(spark, paths.parsed).count() > count
    stages.measure(spark, paths)
    assert tables.read_table(spark, paths.features).inputFiles() != features


def test_a_killed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.write_table(spark.range(3).toDF("x"), path)
    broken = spark.range(5).select(F.raise_error(F.lit("killed")).alias("x"))
    with pytest.raises(Exception, match="killed"):
        tables.write_table(broken, path)
    assert tables.read_table(spark, path).count() == 3
    tables.write_table(spark.range(7).toDF("x"), path)
    tables.write_table(spark.range(8).toDF("x"), path)
    assert tables.read_table(spark, path).count() == 8
    with pytest.raises(Exception, match="killed"):
        tables.materialize(spark, str(tmp_path / "new"), lambda: broken)
    with pytest.raises(FileNotFoundError):
        tables.require(spark, str(tmp_path / "new"), "the stage")
    assert tables.materialize(spark, str(tmp_path / "new"), lambda: spark.range(2)).count() == 2


def test_old_versions_go(spark, tmp_path):
    import os

    path = str(tmp_path / "table")
    for k in range(5):
        tables.write_table(spark.range(k).toDF("x"), path)
    assert len([n for n in os.listdir(path) if n.startswith("v-")]) == 2 and tables.read_table(spark, path).count() == 4


def test_plain_tables_are_read_as_they_are(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.range(4).write.parquet(path)
    assert tables.read_table(spark, tables.require(spark, path, "x")).count() == 4


def test_verify_writes_report_and_verdict(spark, out):
    report = stages.verify(spark, out, low=1, normal_below=0.45)
    assert report.count() == 14 and report.where("not ok").count() == 0
    assert documents.read_json_doc(spark, out.verdict).first().all_ok is True


def test_compare_writes_both_clusterings(spark, sf_dir, out):
    """The windows take the given vectors in turn."""
    given = inputs.table(spark, sf_dir, "embeddings")
    windows_ = tables.read_table(spark, out.scores).select("window_id")
    vectors = windows_.withColumn("vec_id", F.col("window_id") % given.count()).join(given, "vec_id")
    summary = stages.compare(spark, out, vectors, eps=0.6)
    assert summary.count() == 2 and summary.where("winner").count() == 1
    both = tables.read_table(spark, out.alerts_two_methods)
    assert {"cluster_id_tfidf", "cluster_id_minilm"} <= set(both.columns) and both.count() > 0
    row = documents.read_json_doc(spark, out.clustering_comparison).first()
    by = {r.method[:6]: r for r in summary.collect()}
    assert (row.tfidf_clusters, row.minilm_unique) == (by["TF-IDF"].clusters, by["MiniLM"].unique_rows)


def test_missing_input_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="ingest"):
        stages.measure(spark, stages.Paths(str(tmp_path)))


def test_missing_document_gives_defaults(spark, tmp_path):
    row = documents.read_json_doc(spark, str(tmp_path / "none.json"), defaults={"tfidf_silhouette": 0.0}).first()
    assert row.tfidf_silhouette == 0.0
    with pytest.raises(FileNotFoundError):
        documents.read_json_doc(spark, str(tmp_path / "none.json"))
