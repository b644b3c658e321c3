"""A training corpus from the documents: five stages, each calling one operator of ``loglens.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Between stages the documents are written as Parquet and read again, so a lost executor
repeats work of one stage only.

Defined cases: language ID drops null and empty texts and those without a letter, so no later stage has one;
a row with a null id is a document like any other, is learned from by none of the classifiers' language machines
and is left out of no stage; of documents with equal ids and different texts all stay that are not near copies;
of repeated rows, as of all near copies, one stays; of a group it is the row of the least id, nulls last, and by a
hash of the text among equal ids; columns beside those of ``documents`` are kept up to the last stage,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import jaccard, language, packing, secret_scan, weak_quality
from loglens.session import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is as good as undecided."""
    return language.kept(docs, language.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the scorer learned from weak labels rejects."""
    return weak_quality.kept(docs, weak_quality.fit(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of least id, of every group of near copies."""
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the texts; ``n_chars`` follows."""
    masked = secret_scan.redacted(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents, placed in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", distinct_documents),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: The classifiers and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
