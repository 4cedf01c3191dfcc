"""How stored predictions did once their labels matured."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions.scores import right_closed_index
from creditloom.operators.classification import (
    confusion_counts,
    ranking_metrics,
    score_counts,
    with_class_metrics,
)
from creditloom.operators.quantiles import column_quantiles, even_fractions, group_quantiles
from creditloom.session import materialize


def performance_state(scored: DataFrame) -> DataFrame:
    """``rows`` per model, months, threshold, score, predicted and actual class.

    States of several prediction months add up: what ``state_summary`` and ``state_bands`` make of
    their union is what the predictions themselves would give.
    """
    return scored.groupBy(
        "model_version",
        "prediction_snapshot_date",
        "label_snapshot_date",
        F.col("prediction_threshold").cast("double").alias("prediction_threshold"),
        F.col("model_predictions").cast("double").alias("score"),
        F.col("predicted_label").cast("int").alias("predicted"),
        F.col("actual_label").cast("int").alias("actual"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def performance_summary(scored: DataFrame, evaluation_date: str) -> DataFrame:
    """One row per model over all matured predictions and one per prediction month."""
    # Equal rows are counted once and fixed; rates and ranks both start from the counts.
    return state_summary(materialize(performance_state(scored)), evaluation_date)


def state_summary(state: DataFrame, evaluation_date: str) -> DataFrame:
    """``performance_summary`` from a state, which is read twice."""
    keys = ["model_version", "performance_group"]
    month_group = F.date_format(
        "prediction_snapshot_date", f"'{K.MONTH_GROUP_PREFIX}'yyyy_MM_dd"
    )
    counted = state.withColumn(
        "performance_group", F.explode(F.array(F.lit(K.ALL_MATURED), month_group))
    )
    rows = F.col("rows")
    total = F.sum("rows")

    def text(day: Column) -> Column:
        return F.date_format(day, "yyyy-MM-dd")

    summary = with_class_metrics(
        counted.groupBy(*keys).agg(
            text(F.min("prediction_snapshot_date")).alias("prediction_start_date"),
            text(F.max("prediction_snapshot_date")).alias("prediction_end_date"),
            text(F.min("label_snapshot_date")).alias("label_start_date"),
            text(F.max("label_snapshot_date")).alias("label_end_date"),
            total.alias("row_count"),
            (F.sum(F.col("actual") * rows) / total).alias("actual_default_rate"),
            (F.sum(F.col("score") * rows) / total).alias("avg_model_prediction"),
            # Holds the distinct thresholds of a model: one per training or scoring run.
            F.percentile("prediction_threshold", 0.5, rows).alias("prediction_threshold"),
            (F.sum(F.col("predicted") * rows) / total).alias("predicted_default_rate"),
            *confusion_counts(F.col("actual"), F.col("predicted"), rows),
        )
    )
    ranked = ranking_metrics(
        score_counts(counted, keys, F.col("score"), F.col("actual"), rows), keys
    )
    # A group whose scores are all missing has no ranks, but its row stays.
    ranked = ranked.withColumnsRenamed({key: f"__{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same &= summary[key].eqNullSafe(ranked[f"__{key}"])
    return summary.join(ranked, same, "left").select(
        "model_version",
        F.lit(evaluation_date).alias("evaluation_date"),
        "performance_group",
        "prediction_start_date",
        "prediction_end_date",
        "label_start_date",
        "label_end_date",
        "row_count",
        "actual_default_rate",
        "avg_model_prediction",
        "prediction_threshold",
        "predicted_default_rate",
        "auc",
        "gini",
        "brier",
        "log_loss",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        "accuracy",
        "precision",
        "recall",
        "specificity",
        "f1",
        "tn",
        "fp",
        "fn",
        "tp",
    )


def _shown(value: float, digits: int) -> float:
    """A number to ``digits`` decimals, or to that many significant ones below 1."""
    if value == 0 or not math.isfinite(value):
        return value
    if abs(value) < 1:
        digits += -int(math.floor(math.log10(abs(value)))) - 1
    return round(value, digits)


def band_names(edges: Sequence[float], digits: int = 3) -> list[str]:
    """'(low, high]' for neighbouring edges, with just enough digits to tell edges apart."""
    while digits < 20 and len({_shown(e, digits) for e in edges}) < len(edges):
        digits += 1
    shown = [_shown(e, digits) for e in edges]
    shown[0] -= 10.0**-digits  # the lowest band includes its lower edge
    return [f"({low}, {high}]" for low, high in zip(shown, shown[1:])]


def _bands(score: Column, quantiles: Sequence[float] | None) -> tuple[Column, Column]:
    """The number of a score's band between the quantiles, and the name of column ``band``."""
    edges = sorted(set(quantiles or []))
    if len(edges) < 2:
        band, names = F.lit(0), [K.ALL_SCORES_BAND]
    else:
        band, names = right_closed_index(score, edges[1:-1]), band_names(edges)
    return band, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("band") + 1)


def score_bands(
    scored: DataFrame, bins: int = K.DEFAULT_BINS
) -> DataFrame:
    """Calibration by quantile band of the score; tied scores give fewer bands or a single one."""
    quantiles = column_quantiles(
        scored, {"score": F.col("model_predictions")}, even_fractions(bins)
    )["score"]
    band, name = _bands(F.col("model_predictions"), quantiles)
    return (
        scored.withColumn("band", band)
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("model_predictions").alias("min_score"),
            F.max("model_predictions").alias("max_score"),
            F.avg("model_predictions").alias("avg_score"),
            F.avg("actual_label").alias("actual_default_rate"),
            F.avg("predicted_label").alias("predicted_default_rate"),
        )
        .withColumn("score_band", name)
    )


def _mean(name: str) -> Column:
    """The mean of a state's column over the rows that have a value."""
    weight = F.when(F.col(name).isNotNull(), F.col("rows"))
    return F.sum(F.col(name) * F.col("rows")) / F.sum(weight)


def state_bands(state: DataFrame, bins: int = K.DEFAULT_BINS) -> DataFrame:
    """``score_bands`` from a state."""
    fractions = {f"edge_{i}": fraction for i, fraction in enumerate(even_fractions(bins))}
    edges = group_quantiles(state, [], F.col("score"), fractions, F.col("rows")).first()
    known = None if edges is None or edges[0] is None else list(edges)
    band, name = _bands(F.col("score"), known)
    return (
        state.withColumn("band", band)
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.sum("rows").alias("row_count"),
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
            _mean("score").alias("avg_score"),
            _mean("actual").alias("actual_default_rate"),
            _mean("predicted").alias("predicted_default_rate"),
        )
        .withColumn("score_band", name)
    )
