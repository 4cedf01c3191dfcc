"""Joins across months: label to feature, prediction to label, scored to unscored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions.scores import score_class


def label_feature_join(
    labels: DataFrame, features: DataFrame, lag: int = K.LABEL_LAG_MONTHS
) -> DataFrame:
    """Each label with its customer's features ``lag`` months earlier; unmatched labels stay."""
    shifted = labels.withColumn("feature_snapshot_date", F.add_months(K.SNAPSHOT, -lag))
    renamed = features.withColumnRenamed(K.SNAPSHOT, "feature_snapshot_date")
    return shifted.join(renamed, [K.CUSTOMER, "feature_snapshot_date"], "left")


def maturing_predictions(
    predictions: DataFrame, model_version: Column | str, lag: int = K.LABEL_LAG_MONTHS
) -> DataFrame:
    """Predictions with the month their label is due, and defaults for older tables.

    Without a stored threshold 0.5 is used, and without a stored class the score decides.
    """
    version = F.lit(model_version) if isinstance(model_version, str) else model_version
    day = F.col(K.SNAPSHOT).try_cast("date")
    df = predictions.withColumns(
        {
            "prediction_snapshot_date": day,
            "label_snapshot_date": F.add_months(day, lag),
            "model_version": version,
        }
    )
    if "prediction_threshold" not in df.columns:
        df = df.withColumn("prediction_threshold", F.lit(K.DEFAULT_THRESHOLD))
    if "label" in df.columns:
        return df.withColumnRenamed("label", "predicted_label")
    predicted = score_class(F.col("model_predictions"), F.col("prediction_threshold"))
    return df.withColumn("predicted_label", predicted)


def matured(predictions: DataFrame, evaluation_date: str) -> DataFrame:
    return predictions.where(F.col("label_snapshot_date") <= F.lit(evaluation_date).cast("date"))


def customer_month_labels(labels: DataFrame) -> DataFrame:
    """One label per customer and month: any default wins. Rows without a key are left out."""
    present = labels.where(F.col(K.CUSTOMER).isNotNull() & F.col(K.SNAPSHOT).isNotNull())
    picks = [F.max("label").alias("actual_label")]
    if "label_def" in labels.columns:
        picks.append(F.min("label_def").alias("label_def"))
    return present.groupBy(
        K.CUSTOMER, F.col(K.SNAPSHOT).try_cast("date").alias("label_snapshot_date")
    ).agg(*picks)


def prediction_label_join(predictions: DataFrame, collapsed_labels: DataFrame) -> DataFrame:
    return predictions.join(collapsed_labels, [K.CUSTOMER, "label_snapshot_date"], "inner")


def snapshot_dates(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Distinct snapshot dates in order, optionally between two dates."""
    day = F.col(K.SNAPSHOT).try_cast("date")
    dates = df.select(day.alias(K.SNAPSHOT))
    if first:
        dates = dates.where(F.col(K.SNAPSHOT) >= F.lit(first).cast("date"))
    if last:
        dates = dates.where(F.col(K.SNAPSHOT) <= F.lit(last).cast("date"))
    return dates.distinct().orderBy(K.SNAPSHOT)


def unscored_snapshots(
    features: DataFrame,
    predictions: DataFrame,
    first: str | None = None,
    last: str | None = None,
) -> DataFrame:
    """Feature months in range that have no prediction yet."""
    scored = predictions.select(F.col(K.SNAPSHOT).try_cast("date").alias(K.SNAPSHOT)).distinct()
    return (
        snapshot_dates(features, first, last)
        .join(scored, K.SNAPSHOT, "left_anti")
        .orderBy(K.SNAPSHOT)
    )
