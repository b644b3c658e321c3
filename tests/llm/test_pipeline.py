"""The pipeline, stage by stage."""

import corpus_pipeline
from loglens.session import stage
from tests.llm.test_jaccard import brute
from tests.llm.test_chat_secrets import base


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf_dir), "step")
        rows = docs.collect()
        if name == "best-fit packing":
            assert {r.doc_id for r in rows} == before.keys()
            assert all(r.offset + r.length <= 4096 for r in rows)
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and after.keys() <= before.keys()
        if name == "language ID":
            assert len(after) > 0.99 * len(before)
        if name == "quality classifier":
            gone = [labels[k] for k in before.keys() - after.keys() if k in labels]
            assert gone.count(0) > 0.8 * sum(labels.get(k) == 0 for k in before) and gone.count(1) < 0.05 * len(labels)
        if name == "n-gram Jaccard join":
            assert after.keys() == {c for _, _, c in brute(list(before.items()))}
        if name == "secret scans":
            assert not any(base(t) for t in after.values())
            assert all(r.n_chars == len(r.text) for r in rows)
            assert all(after[k] == before[k] for k in after if "[SECRET]" not in after[k])
        before = after


def test_empty(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_awkward_documents(spark, sf_dir):
    """Nulls, ties, repeated rows, long texts and columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clash = ["stays", "row", "met", "doc", "label", "key", "_key", "score", "piece", "spans", "votes", "good", "x", "tie", "length"]
    extra = [F.lit(k).alias(name) for k, name in enumerate(clash)]
    texts = [r.text for r in given.where("lang = 'en'").orderBy(F.desc("n_chars")).limit(4).collect()]
    rows = [(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "12 34 !!", None, None, 8),
            (None, texts[0] + " and more", "en", "s", None), (9004, texts[1] + " twice here", "en", "s", 1),
            (9004, texts[1] + " twice here", "en", "s", 1), (9005, texts[2], "en", "s", 1), (9005, texts[3] + " token = abcdefgh12345", "en", None, 1),
            (9006, (texts[0] + " ") * 40, "en", "s", 1)]
    docs = given.unionByName(spark.createDataFrame(rows, given.schema)).select("*", *extra)
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf_dir), "awkward")
        held = docs.collect()
        if name == "best-fit packing":
            assert any(r.doc_id is None for r in held) and all(r.offset + r.length <= 4096 for r in held)
            break
        assert docs.columns == columns
        assert all(r[c] == k for r in held for k, c in enumerate(clash))
        if name == "language ID":
            assert not {9001, 9002, 9003} & {r.doc_id for r in held} and all(r.text for r in held)
        if name == "n-gram Jaccard join":
            assert sum(r.doc_id == 9004 for r in held) <= 1
            want = {c for _, _, c in brute([(k, r.text) for k, r in enumerate(held)])}
            assert len(want) == len(held)  # no two of what stays are near copies
