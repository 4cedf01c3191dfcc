"""Profiles of any table: columns, distributions, snapshots, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions.scores import number_or_null
from creditloom.operators.quantiles import column_quantiles, group_quantiles
from creditloom.session import materialize


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column and text value, null included: one shuffle for all columns."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return (
        texts.unpivot([], list(columns), "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, nulls and distinct values of every column.

    Values are counted before they are counted as distinct, so frequent ones cost nothing.
    ``approximate`` estimates the distinct values in one pass without a shuffle of values.
    """
    names = df.columns
    types = F.element_at(
        F.create_map(*[F.lit(x) for n in names for x in (n, df.schema[n].dataType.simpleString())]),
        F.col("column_name"),
    )
    if approximate:
        facts = [
            F.struct(
                F.lit(n).alias("column_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(F.col(f"`{n}`").isNull()).alias("null_count"),
                F.approx_count_distinct(F.col(f"`{n}`")).alias("n_unique"),
            )
            for n in names
        ]
        profile = df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))
    else:
        null_rows = F.sum(F.when(F.col("value").isNull(), F.col("row_count")).otherwise(0))
        profile = (
            _value_counts(df, names)
            .groupBy("column_name")
            .agg(
                F.sum("row_count").alias("total"),
                null_rows.alias("null_count"),
                F.count("value").alias("n_unique"),
            )
            .withColumnRenamed("total", "row_count")
        )
    percent = F.round(F.col("null_count") / F.col("row_count") * 100, 2)
    return profile.select(
        "column_name",
        types.alias("dtype"),
        "null_count",
        F.coalesce(percent, F.lit(0.0)).alias("null_pct"),
        "n_unique",
    )


def numeric_summary(
    df: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns, rounded to 4 digits."""
    numbers = df.select(*columns).persist()
    quartiles = column_quantiles(
        numbers, {c: F.col(c) for c in columns}, [Fraction(i, 4) for i in (1, 2, 3)]
    )
    rows = []
    for name in columns:
        value = number_or_null(F.col(name))
        q1, q2, q3 = quartiles[name] or [None] * 3
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(value).alias("count"),
                F.round(F.avg(value), 4).alias("mean"),
                F.round(F.stddev_samp(value), 4).alias("std"),
                F.round(F.min(value), 4).alias("min"),
                F.round(F.lit(q1).cast("double"), 4).alias("p25"),
                F.round(F.lit(q2).cast("double"), 4).alias("p50"),
                F.round(F.lit(q3).cast("double"), 4).alias("p75"),
                F.round(F.max(value), 4).alias("max"),
            )
        )
    summary = materialize(numbers.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    numbers.unpersist()
    return summary


def histograms(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Counts in exactly ``bins`` equal steps from each column's smallest to largest value."""
    values = df.select(*[number_or_null(F.col(c)).alias(c) for c in columns])
    limits = values.agg(
        *[F.min(c).alias(f"low_{c}") for c in columns],
        *[F.max(c).alias(f"high_{c}") for c in columns],
    ).first()
    entries = []
    for name in columns:
        low, high = limits[f"low_{name}"], limits[f"high_{name}"]
        step = (high - low) / bins if low is not None else 0.0
        place = F.lit(0)
        if step > 0:
            place = F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
        place = F.when(F.col(name).isNotNull(), place.cast("int"))
        entries.append(F.struct(F.lit(name).alias("column_name"), place.alias("bin")))
    return (
        values.select(F.inline(F.array(*entries)))
        .where(F.col("bin").isNotNull())
        .groupBy("column_name", "bin")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def top_values(df: DataFrame, column: str, n: int = K.PROFILE_TOP_VALUES) -> DataFrame:
    """The ``n`` most frequent values as text, nulls left out; ties go to the smaller text."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), "value")
        .limit(n)
    )


def most_common(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The most common value of each column as text; ties go to the smaller text."""
    counts = _value_counts(df, columns).where(F.col("value").isNotNull())
    ties = counts.groupBy("column_name", "row_count").agg(F.min("value").alias("value"))
    return ties.groupBy("column_name").agg(
        F.max_by("value", "row_count").alias("most_common"),
        F.max("row_count").alias("row_count"),
    )


def table_facts(df: DataFrame, numeric: Sequence[str], label: str | None = None) -> DataFrame:
    """Missing rate and sample deviation of each numeric column, and the table's class rate."""
    rate = F.avg(F.col(label).cast("double")) if label else F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.avg(F.col(name).isNull().cast("double")).alias("missing_rate"),
            F.stddev_samp(number_or_null(F.col(name))).alias("sample_std"),
            rate.alias("class_rate"),
        )
        for name in numeric
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Scores and predicted default rate of each snapshot, rounded to 4 digits."""

    def r(column: Column) -> Column:
        return F.round(column, 4)

    score = F.col("model_predictions")
    return predictions.groupBy(K.SNAPSHOT).agg(
        F.count(F.lit(1)).alias("row_count"),
        r(F.avg(score)).alias("avg_score"),
        r(F.min(score)).alias("min_score"),
        r(F.max(score)).alias("max_score"),
        r(F.avg("label")).alias("predicted_default_rate"),
        r(F.min("prediction_threshold")).alias("prediction_threshold"),
    )


def snapshot_score_stats(predictions: DataFrame) -> DataFrame:
    """Rows, mean, median and predicted default rate of each snapshot."""
    stats = predictions.groupBy(K.SNAPSHOT).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg("model_predictions").alias("avg_score"),
        F.avg("label").alias("predicted_default_rate"),
    )
    medians = group_quantiles(
        predictions, [K.SNAPSHOT], F.col("model_predictions"), {"median_score": Fraction(1, 2)}
    )
    return stats.join(medians, K.SNAPSHOT, "left")


def ratio_bounds(
    df: DataFrame
) -> dict[str, list[float] | None]:
    """The 1 % and 99 % quantiles of the ratio columns a table has."""
    columns = {c: F.col(c) for c in K.CAPPED_RATIOS if c in df.columns}
    return column_quantiles(df, columns, [Fraction(q) for q in K.RATIO_QUANTILES])


def bounds_frame(spark, bounds: Mapping[str, list[float] | None]) -> DataFrame:
    rows = [(name, *pair) for name, pair in bounds.items() if pair]
    return spark.createDataFrame(rows, "column_name string, low double, high double")


def lookback_snapshots(df: DataFrame, months: int, last: str | None = None) -> DataFrame:
    """The latest ``months`` snapshots of the table, optionally up to the month of ``last``."""
    dates = df.select(F.col(K.SNAPSHOT).try_cast("date").alias(K.SNAPSHOT))
    if last:
        cutoff = F.trunc(F.lit(last).cast("date"), "month")
        dates = dates.where(F.trunc(K.SNAPSHOT, "month") <= cutoff)
    return dates.distinct().orderBy(F.desc(K.SNAPSHOT)).limit(months)


def sample_head(df: DataFrame, order: Sequence[str], rows: int = K.SAMPLE_ROWS) -> DataFrame:
    return df.orderBy(*order).limit(rows)
