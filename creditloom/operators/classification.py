"""Ranking, probability and class metrics, grouped, from counts per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions.scores import number_or_null
from creditloom.operators.ordering import with_running_totals


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion_counts(actual: Column, predicted: Column, rows: Column | None = None) -> list[Column]:
    """tn, fp, fn and tp; ``rows`` weighs pre-aggregated input."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    result = []
    for name, (a, p) in cells.items():
        hit = (actual == a) & (predicted == p)
        if rows is None:
            result.append(F.count_if(hit).alias(name))
        else:
            result.append(F.coalesce(F.sum(F.when(hit, rows)), F.lit(0)).alias(name))
    return result


def with_class_metrics(counts: DataFrame) -> DataFrame:
    """Rates from tn, fp, fn, tp; a rate without any case is 0."""
    tn, fp, fn, tp = (F.col(name).cast("double") for name in ("tn", "fp", "fn", "tp"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    specificity, false_positive = _ratio(tn, tn + fp), _ratio(fp, fp + tn)
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
            "precision": precision,
            "recall": recall,
            "specificity": specificity,
            "false_positive_rate": false_positive,
        }
    ).withColumns(
        {
            "f1": _ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
            "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2,
            "youden_j": F.col("recall") - F.col("false_positive_rate"),
        }
    )


def score_counts(
    df: DataFrame, groups: Sequence[str], score: Column, actual: Column, rows: Column | None = None
) -> DataFrame:
    """Positives and negatives per group and distinct score; rows without a score are left out."""
    weight = F.lit(1) if rows is None else rows
    return (
        df.select(
            *groups,
            number_or_null(score).alias("score"),
            F.when(actual == 1, weight).otherwise(0).alias("pos"),
            F.when(actual == 0, weight).otherwise(0).alias("neg"),
        )
        .where(F.col("score").isNotNull())
        .groupBy(*groups, "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def ranking_metrics(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """AUC, Gini, Brier score and log-loss per group from ``score_counts``.

    AUC is the share of positive/negative pairs in the right order, ties counting half. With
    one class only, AUC, Gini and log-loss are null. A group may be of any size: its scores
    stay spread over tasks.
    """
    keys = list(groups) or ["__all"]
    scored = counts if groups else counts.withColumn("__all", F.lit(1))
    placed = with_running_totals(scored, keys, "score", ["pos", "neg"])
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = pos * (F.col("neg_before").cast("double") + neg / 2)
    clip = F.least(
        F.greatest(F.col("score"), F.lit(K.LOG_LOSS_CLIP)), F.lit(1 - K.LOG_LOSS_CLIP)
    )
    sums = placed.groupBy(*keys).agg(
        F.sum(wins).alias("wins"),
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
        F.sum(pos * F.pow(F.col("score") - 1, 2) + neg * F.pow(F.col("score"), 2)).alias("sq"),
        F.sum(-pos * F.ln(clip) - neg * F.ln(F.lit(1.0) - clip)).alias("ll"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    auc = F.when(both, F.col("wins") / (F.col("p") * F.col("n")))
    return (
        sums.withColumns(
            {
                "auc": auc,
                "brier": F.col("sq") / (F.col("p") + F.col("n")),
                "log_loss": F.when(both, F.col("ll") / (F.col("p") + F.col("n"))),
            }
        )
        .withColumn("gini", F.round(2 * F.col("auc") - 1, 3))
        .select(*groups, "auc", "gini", "brier", "log_loss")
    )


def threshold_sweep(
    df: DataFrame, groups: Sequence[str], score: Column, actual: Column
) -> DataFrame:
    """Class metrics at the cutoffs 0.01 … 0.99 in one pass.

    Every row is counted once under the number of cutoffs at or below its score; the at most
    100 counts of a group then give the confusion table of each cutoff.
    """
    near = F.floor(F.col("__score") * 100)
    # floor(score * 100) can be off by one where score * 100 is rounded; compare to be exact.
    reached = (
        F.when((near + 1) / F.lit(100.0) <= F.col("__score"), near + 1)
        .when(near / F.lit(100.0) > F.col("__score"), near - 1)
        .otherwise(near)
    )
    level = F.greatest(F.least(reached, F.lit(99)), F.lit(0)).cast("int")
    counts = (
        df.select(*groups, score.cast("double").alias("__score"), actual.alias("__actual"))
        .groupBy(*groups, level.alias("level"))
        .agg(
            F.count_if(F.col("__actual") == 1).alias("pos"),
            F.count_if(F.col("__actual") == 0).alias("neg"),
        )
    )
    cutoffs = F.explode(F.sequence(F.lit(1), F.lit(99))).alias("cutoff")
    above = F.col("level") >= F.col("cutoff")
    cells = (
        counts.select(*groups, "level", "pos", "neg", cutoffs)
        .groupBy(*groups, "cutoff")
        .agg(
            F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"),
            F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
        )
        .withColumn("threshold", F.col("cutoff") / F.lit(100.0))
        .drop("cutoff")
    )
    return with_class_metrics(cells)


def best_threshold(sweep: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The cutoff with the largest Youden J, then F1, then balanced accuracy, then the lowest."""
    rank = F.struct(
        K.THRESHOLD_METRIC, "f1", "balanced_accuracy", (-F.col("threshold")).alias("low_first")
    )
    fields = [name for name in sweep.columns if name not in groups]
    best = F.max_by(F.struct(*fields), rank).alias("best")
    return sweep.groupBy(*groups).agg(best).select(*groups, "best.*")
