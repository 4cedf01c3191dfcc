"""What changed between two states of a table, by month, without comparing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("n_rows", "checksum")


def row_checksum(columns: Sequence[str]) -> Column:
    """A 64-bit hash of a row; where nulls stand counts too."""
    names = sorted(columns)
    cells = [F.col(f"`{name}`") for name in names]
    return F.xxhash64(*cells, *[cell.isNull() for cell in cells])


def content_state(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and a checksum per group, the same in any order and any cut into files.

    A sum of row hashes: equal rows count as often as they occur, and states of parts add up.
    """
    own = row_checksum([name for name in rows.columns if name not in by])
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(own.cast("decimal(38,0)")).alias("checksum")
    )


def summed_state(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The state of larger groups from the states of their parts."""
    return states.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("checksum").cast("decimal(38,0)").alias("checksum")
    )


def changed_groups(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose rows are not the same in both states, with the ``reason``: new, changed or gone."""
    old = before.select(*by, F.struct(*STATE).alias("old"))
    new = after.select(*by, F.struct(*STATE).alias("new"))
    reason = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("new").isNull(), "gone")
        .when(F.col("old") != F.col("new"), "changed")
    )
    return (
        old.join(new, list(by), "full")
        .select(*by, reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )
