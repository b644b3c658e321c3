"""The queries of this package and, where SQL can say them, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loglens.llm import bpe, chat, fingerprint, hard_negatives, jaccard, language, packing, prefix_trie, rules, secret_scan, simhash, surrogates, weak_quality

#: The key of the registered query, which is no secret.
PII_KEY = "registered query"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, source: str = "documents", sql: str | None = None):
    """Register a function of one whole table."""
    def register(build: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(table(spark, sf_dir, source))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


@query("op1_pii_surrogates")
def op1(docs: DataFrame) -> DataFrame:
    return surrogates.with_surrogates(docs.select("doc_id", "text"), PII_KEY)


@query("op2_lempel_ziv_fingerprint")
def op2(docs: DataFrame) -> DataFrame:
    return fingerprint.with_edits(docs)


@query("op3_hierarchical_language")
def op3(docs: DataFrame) -> DataFrame:
    return language.identified(docs, language.fit(docs))


@query("op4_weak_label_quality")
def op4(docs: DataFrame) -> DataFrame:
    return weak_quality.scored(docs, weak_quality.fit(docs))


@query("op5_quality_rules", sql=rules.sql())
def op5(docs: DataFrame) -> DataFrame:
    return rules.judged(docs)


@query("op6_ngram_jaccard_join")
def op6(docs: DataFrame) -> DataFrame:
    return jaccard.components(docs)


@query("op7_chat_prefix_targets", "conversations", sql=chat.SQL)
def op7(turns: DataFrame) -> DataFrame:
    return chat.digest(chat.examples(chat.with_marker_turns(turns)))


@query("op8_byte_bpe")
def op8(docs: DataFrame) -> DataFrame:
    return bpe.round_trip(docs)


@query("op9_secret_scan")
def op9(docs: DataFrame) -> DataFrame:
    return secret_scan.scanned(docs)


@query("op10_best_fit_packing")
def op10(docs: DataFrame) -> DataFrame:
    return packing.packed_documents(docs)


@query("op11_hard_negatives", "embeddings", sql=hard_negatives.SQL)
def op11(vectors: DataFrame) -> DataFrame:
    return hard_negatives.mined(vectors)


@query("op12_prefix_trie", "conversations")
def op12(turns: DataFrame) -> DataFrame:
    return prefix_trie.nodes(turns)


@query("op13_simhash_dedup")
def op13(docs: DataFrame) -> DataFrame:
    return simhash.components(docs)
