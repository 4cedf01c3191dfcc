"""Keyed histories: replace by key, latest row, known versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key by ``order``.

    An aggregate, not a window: rows of one key meet on the map side, so no key is too large.
    """
    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(last).select("__row.*")


def upserted(
    old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; inside ``new`` the last by ``order`` wins."""
    batches = old.withColumn("__batch", F.lit(0)).unionByName(
        new.withColumn("__batch", F.lit(1)), allowMissingColumns=True
    )
    return latest_by_key(batches, keys, ["__batch", *order]).drop("__batch")


def known_versions(*tables: DataFrame) -> DataFrame:
    """All model versions named in any of the tables."""
    versions = None
    for table in tables:
        named = table.select("model_version").where(F.col("model_version").isNotNull())
        versions = named if versions is None else versions.union(named)
    return versions.distinct().orderBy("model_version")


def latest_per_model(history: DataFrame, order: str) -> DataFrame:
    return latest_by_key(history, ["model_version"], [order])


def in_order(history: DataFrame, *order: str, newest: str) -> DataFrame:
    """A history with the newest of ``newest`` first, then by the other columns upwards."""
    return history.orderBy(F.desc(newest), *order)
