"""Choosing columns by rule, and row filters over chosen columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from creditloom import constants as K


def prefixed(columns: Iterable[str], prefix: str = K.FEATURE_PREFIX) -> list[str]:
    return [name for name in columns if name.startswith(prefix)]


def model_features(columns: Iterable[str]) -> list[str]:
    """Everything that is not an id, a label, personal data or an earlier prediction."""
    hidden = set(K.NON_FEATURES)
    return [name for name in columns if name not in hidden]


def split_by_type(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and other columns, by schema."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    return numeric, [c for c in columns if c not in set(numeric)]


def with_any_value(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which at least one of the columns is set."""
    return df.dropna(how="all", subset=list(columns))


def member_or_other(value: Column, members: Sequence[str], other: str = K.OTHER) -> Column:
    return F.when(value.isin(list(members)), value).otherwise(F.lit(other))


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Schema check without a job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def overall_performance(history: DataFrame) -> DataFrame:
    return history.where(F.col("performance_group") == K.ALL_MATURED)


def monthly_performance(history: DataFrame) -> DataFrame:
    return history.where(F.col("performance_group").startswith(K.MONTH_GROUP_PREFIX)).withColumn(
        "prediction_snapshot_date", F.col("prediction_start_date").try_cast("date")
    )


def score_rows(detail: DataFrame) -> DataFrame:
    return detail.where(F.col("feature_name") == K.SCORE_FEATURE)


def feature_rows(detail: DataFrame) -> DataFrame:
    return detail.where(F.col("feature_name") != K.SCORE_FEATURE)
