"""Model quality against the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions.values import ratio, round_half, truth_text
from loglens.operators import quantiles as exact_quantiles
from loglens.operators.ranking import running_sums
from loglens.session import stage


def confusion(scores: DataFrame, truth: str = "is_anomaly", predicted: str = "predicted") -> DataFrame:
    t, p = F.col(truth), F.col(predicted)
    return scores.agg(
        F.count_if((t == 0) & (p == 0)).alias("true_negative"),
        F.count_if((t == 0) & (p == 1)).alias("false_positive"),
        F.count_if((t == 1) & (p == 0)).alias("false_negative"),
        F.count_if((t == 1) & (p == 1)).alias("true_positive"),
    )


def cross_table(scores: DataFrame) -> DataFrame:
    """Actual by predicted, as text labels, one row per actual class."""
    table = scores.groupBy(truth_text(F.col("is_anomaly")).alias("actual")).pivot(
        "predicted", [0, 1]
    ).agg(F.count(F.lit(1)))
    return table.select(
        "actual",
        F.coalesce(F.col("0"), F.lit(0)).alias("predicted_normal"),
        F.coalesce(F.col("1"), F.lit(0)).alias("predicted_anomaly"),
    )


def class_report(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, accuracy and macro F1; an empty denominator gives 0."""
    tn, fp = F.col("true_negative"), F.col("false_positive")
    fn, tp = F.col("false_negative"), F.col("true_positive")
    total = tn + fp + fn + tp
    f1_a, f1_n = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fn + fp)
    return cells.select(
        "*",
        total.alias("total_windows"),
        ratio(tp, tp + fp).alias("precision_anomaly"),
        ratio(tp, tp + fn).alias("recall_anomaly"),
        f1_a.alias("f1_anomaly"),
        ratio(tn, tn + fn).alias("precision_normal"),
        ratio(tn, tn + fp).alias("recall_normal"),
        f1_n.alias("f1_normal"),
        ratio(tn + tp, total).alias("accuracy"),
        ((f1_a + f1_n) / 2).alias("macro_avg_f1"),
    )


def _class_sums(scores: DataFrame) -> DataFrame:
    positive = (F.col("is_anomaly") == 1).cast("bigint")
    return running_sums(scores, "anomaly_score", {"pos": F.sum(positive), "neg": F.sum(1 - positive)})


def roc_auc(scores: DataFrame) -> DataFrame:
    """Share of (anomalous, normal) pairs ranked right, ties counting one half. It has no value where a class has no
    rows: not a number without normal rows, null without anomalous ones."""
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    wins, pos, neg = F.sum(F.col("pos") * below), F.sum("pos"), F.sum("neg")
    share = F.when(neg == 0, F.lit(float("nan"))).otherwise(wins / F.nullif(pos.cast("double") * neg, F.lit(0.0)))
    return _class_sums(scores).agg(F.when(pos > 0, share).alias("roc_auc"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """The score whose use as an inclusive threshold maximises F1; the lowest one on ties."""
    steps = _class_sums(scores)
    positives, negatives = steps.agg(F.sum("pos")).scalar(), steps.agg(F.sum("neg")).scalar()
    tp = positives - F.col("cum_pos") + F.col("pos")
    fp = negatives - F.col("cum_neg") + F.col("neg")
    f1 = ratio(2 * tp, tp + fp + positives)
    return steps.select("anomaly_score", f1.alias("f1")).agg(
        F.min(F.struct((-F.col("f1")).alias("loss"), F.col("anomaly_score").alias("score"))).alias("best")
    ).select(F.col("best.score").alias("best_threshold"), (-F.col("best.loss")).alias("best_f1"))


def score_profile(scores: DataFrame) -> DataFrame:
    s = "anomaly_score"
    # Ranks take several passes: over a written column, not over what made it.
    scores = stage(scores.select(s), "profile")
    cuts = exact_quantiles.exact(scores, s, [0.85, 0.90, 0.95])
    return scores.agg(
        F.min(s).alias("score_min"),
        F.max(s).alias("score_max"),
        F.avg(s).alias("score_mean"),
        *[F.lit(cut).cast("double").alias(name) for name, cut in zip(("score_p85", "score_p90", "score_p95"), cuts)],
    )


def quantiles(df: DataFrame, column: str, levels: dict[str, float], where: Column | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles as one row."""
    return exact_quantiles.row(df if where is None else df.where(where), column, levels)


def histogram(df: DataFrame, column: str, bins: int = 80) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are absent."""
    low, high = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    place = F.coalesce(F.floor((F.col(column) - low) / F.nullif(high - low, F.lit(0.0)) * bins), F.lit(0))
    return df.select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count")
    )


def metrics_document(scores: DataFrame, dataset: str) -> DataFrame:
    """All quality figures as one row, the confusion cells nested."""
    def only(row: DataFrame) -> Column:
        return row.select(F.struct("*")).scalar()

    cells = ["true_negative", "false_positive", "false_negative", "true_positive"]
    base = class_report(confusion(scores)).select(
        "*",
        only(roc_auc(scores)).alias("a"),
        only(best_threshold(scores)).alias("t"),
        only(score_profile(scores)).alias("p"),
    )
    rounded = ["precision_anomaly", "recall_anomaly", "f1_anomaly", "precision_normal", "recall_normal",
               "f1_normal", "accuracy"]
    profile = ["score_min", "score_max", "score_mean", "score_p85", "score_p90", "score_p95"]
    return base.select(
        F.lit(dataset).alias("dataset"),
        "total_windows",
        (F.col("false_negative") + F.col("true_positive")).alias("anomalous_windows"),
        (F.col("true_negative") + F.col("false_positive")).alias("normal_windows"),
        *[round_half(F.col(c), 4).alias(c) for c in rounded],
        round_half(F.col("a.roc_auc"), 4).alias("roc_auc"),
        round_half(F.col("macro_avg_f1"), 4).alias("macro_avg_f1"),
        round_half(F.col("t.best_threshold"), 4).alias("best_threshold"),
        F.struct(*cells).alias("confusion_matrix"),
        *[round_half(F.col(f"p.{c}"), 4).alias(c) for c in profile],
    )


def mean_score_by_class(scores: DataFrame) -> DataFrame:
    return scores.groupBy("is_anomaly").agg(F.avg("anomaly_score").alias("mean_score"))
