"""Month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import constants as K


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def previous_month(day: Column) -> Column:
    return F.add_months(month_start(day), -1)


def months_apart(earlier: Column, later: Column) -> Column:
    """Calendar months from ``earlier`` to ``later``, days ignored."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def month_sequence(first: Column, last: Column) -> Column:
    """Every month start from ``first`` to ``last``, both included; empty if they are reversed."""
    first, last = month_start(first), month_start(last)
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return F.when(first <= last, months).otherwise(F.array().cast("array<date>"))


def month_frame(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per month start."""
    bounds = [F.to_date(F.lit(value)) for value in (first, last)]
    return spark.range(1).select(F.explode(month_sequence(*bounds)).alias(K.SNAPSHOT))


def training_windows(train_date: Column) -> dict[str, Column]:
    """Date windows of a model trained on ``train_date``.

    The two months before it are out-of-time, the twelve before those are train/test, and
    features lie six months before their labels. Days are clamped to the month's length.
    """
    oot_start = F.add_months(train_date, -K.OOT_MONTHS)
    oot_end = F.date_sub(train_date, 1)
    train_start = F.add_months(oot_start, -K.TRAIN_TEST_MONTHS)
    return {
        "train_test_start_date": train_start,
        "train_test_end_date": F.date_sub(oot_start, 1),
        "oot_start_date": oot_start,
        "oot_end_date": oot_end,
        "feature_start_date": F.add_months(train_start, -K.LABEL_LAG_MONTHS),
        "feature_end_date": F.add_months(oot_end, -K.LABEL_LAG_MONTHS),
    }
