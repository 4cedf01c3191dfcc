"""Data-quality gates as queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions.months import month_frame
from creditloom.operators.gold import snapshot_coverage


def snapshot_row_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(K.SNAPSHOT).agg(F.count(F.lit(1)).alias("row_count"))


def missing_months(df: DataFrame, first: str, last: str) -> DataFrame:
    """Months of the range that the table has no row for."""
    present = df.select(F.trunc(F.col(K.SNAPSHOT).try_cast("date"), "month").alias(K.SNAPSHOT)).distinct()
    return (
        month_frame(df.sparkSession, first, last)
        .join(present, K.SNAPSHOT, "left_anti")
        .orderBy(K.SNAPSHOT)
    )


def partition_status(
    tables: Mapping[str, DataFrame],
    first: str,
    last: str,
    may_be_empty_before: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows and status of every table in every month of the range.

    A month without rows is ``missing``, or ``allowed_empty`` before the month named for its
    table in ``may_be_empty_before``.
    """
    spark = next(iter(tables.values())).sparkSession
    allowed = may_be_empty_before or {}
    reports = []
    for name, table in tables.items():
        low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
        counts = snapshot_row_counts(table.where(F.col(K.SNAPSHOT).between(low, high)))
        until = allowed.get(name)
        empty = F.lit("missing")
        if until:
            excused = F.col(K.SNAPSHOT) < F.lit(until).cast("date")
            empty = F.when(excused, "allowed_empty").otherwise(empty)
        rows = F.coalesce(F.col("row_count"), F.lit(0))
        reports.append(
            month_frame(spark, first, last)
            .join(counts, K.SNAPSHOT, "left")
            .select(
                F.lit(name).alias("table_name"),
                K.SNAPSHOT,
                rows.alias("row_count"),
                F.when(rows > 0, "ok").otherwise(empty).alias("status"),
            )
        )
    report = reports[0]
    for other in reports[1:]:
        report = report.unionByName(other)
    return report


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)
    )


def join_coverage(attributes: DataFrame, others: Mapping[str, DataFrame]) -> DataFrame:
    """Per snapshot: attribute rows, join rows with each other table, and whether there are none."""
    report = None
    for name, table in others.items():
        one = snapshot_coverage(attributes, table, f"{name}_matched").withColumn(
            f"{name}_no_overlap",
            (F.col("total_rows") > 0) & (F.col(f"{name}_matched") == 0),
        )
        report = one if report is None else report.join(one.drop("total_rows"), K.SNAPSHOT)
    return report


def all_null_columns(df: DataFrame) -> DataFrame:
    """Names of columns without any value, found in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{name}`")).alias(name) for name in df.columns])
    return (
        counts.unpivot([], list(df.columns), "column_name", "non_null")
        .where(F.col("non_null") == 0)
        .select("column_name")
    )


def split_sanity(training: DataFrame, split: Column, features: Sequence[str]) -> DataFrame:
    """Per split: rows, label classes and rows with any feature set."""
    any_feature = reduce(or_, [F.col(name).isNotNull() for name in features])
    return (
        training.withColumn("split", split)
        .where(F.col("split").isNotNull())
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct("label").alias("label_classes"),
            F.count_if(any_feature).alias("rows_with_features"),
        )
    )


def maturity_check(predictions: DataFrame, evaluation_date: str) -> DataFrame:
    """How many predictions have matured, and the earliest label month any of them needs."""
    due = F.col("label_snapshot_date") <= F.lit(evaluation_date).cast("date")
    return predictions.agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.count_if(due).alias("matured_count"),
        F.min("label_snapshot_date").alias("earliest_label_date"),
    )
