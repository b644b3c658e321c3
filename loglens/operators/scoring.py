"""From anomaly scores to confirmed anomalous windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions.values import clamp
from loglens.operators import quantiles
from loglens.operators.evaluate import class_report, confusion
from loglens.operators.ranking import quantile_at
from loglens.schemas import DENSE_FEATURES


def one(row: DataFrame, *columns: str) -> Column:
    """A one-row frame as a struct-valued scalar subquery: used instead of a join."""
    return row.select(F.struct(*(columns or row.columns))).scalar()


def surrogate_scores(meta: DataFrame) -> DataFrame:
    """Deterministic stand-in for the forest: mean |z| of the dense features, mapped into
    [0, 1) and rounded to nine digits, so that everything behind scoring can be checked in SQL."""
    stats = one(meta.agg(
        *[F.avg(c).alias(f"m_{c}") for c in DENSE_FEATURES],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in DENSE_FEATURES],
    ))
    with_stats = meta.withColumn("stats", stats)

    def z(c: str) -> Column:
        deviation = F.col(f"stats.s_{c}")
        return F.abs(F.col(c) - F.col(f"stats.m_{c}")) / F.when(deviation == 0, 1.0).otherwise(deviation)

    x = sum((z(c) for c in DENSE_FEATURES[1:]), z(DENSE_FEATURES[0])) / len(DENSE_FEATURES)
    return (
        with_stats.withColumn("x", x)
        .withColumn("anomaly_score", F.round(F.col("x") / (1 + F.col("x")), 9))
        .drop("x", "stats")
    )


def contamination(meta: DataFrame) -> DataFrame:
    """Expected share of anomalous windows, from the labels, kept within [0.01, 0.45]."""
    return meta.agg(clamp(F.avg("is_anomaly"), 0.01, 0.45).alias("contamination"))


def predict(scored: DataFrame, share: float | None = None) -> DataFrame:
    """Flag scores strictly above the ``1 - contamination`` quantile."""
    level = F.lit(1.0 - share) if share is not None else F.lit(1.0) - contamination(scored).scalar()
    cut = quantile_at(scored, "anomaly_score", level).scalar()
    return scored.withColumn("predicted", (F.col("anomaly_score") > cut).cast("int"))


def confirm(predicted: DataFrame) -> DataFrame:
    """Keep a prediction only with evidence: an error level in the window, or a very high score."""
    p95 = F.lit(quantiles.exact(predicted, "anomaly_score", [0.95])[0])
    evidence = (
        (F.col("fatal_count") > 0)
        | (F.col("severe_count") > 0)
        | (F.col("error_ratio") > 0)
        | (F.col("anomaly_score") >= p95)
    )
    return predicted.withColumn("confirmed", ((F.col("predicted") == 1) & evidence).cast("int"))


def gate_report(confirmed: DataFrame) -> DataFrame:
    """One row: F1 and error cells before and after the evidence filter, and the verdict."""
    before = one(class_report(confusion(confirmed, predicted="predicted")))
    after = one(class_report(confusion(confirmed, predicted="confirmed")))
    spark = confirmed.sparkSession
    return (
        spark.range(1).select(before.alias("b"), after.alias("a"))
        .select(
            F.col("b.f1_anomaly").alias("f1_before"),
            F.col("a.f1_anomaly").alias("f1_after"),
            F.col("b.false_positive").alias("fp_before"),
            F.col("b.false_negative").alias("fn_before"),
            F.col("a.false_positive").alias("fp_after"),
            F.col("a.false_negative").alias("fn_after"),
            (F.col("a.f1_anomaly") >= F.col("b.f1_anomaly") - 0.01).alias("adopted"),
        )
    )


def apply_gate(confirmed: DataFrame, adopt: bool | None = None) -> DataFrame:
    """Use the filtered predictions if they cost at most 0.01 of F1 (or as told)."""
    verdict = F.lit(adopt) if adopt is not None else gate_report(confirmed).select("adopted").scalar()
    return confirmed.withColumn(
        "predicted", F.when(verdict, F.col("confirmed")).otherwise(F.col("predicted"))
    ).drop("confirmed")
