"""Global order without a single-task window.

A window partitioned by a month, a label or a feature would put that whole group into one task,
and one group may hold a third of all rows. These operators range-partition on the group *and*
the order column, so a large group spreads over many tasks, and then add what lies in the
earlier partitions from a table with one row per group and partition.

Partition numbers must not change between the two uses, so the partitioned rows are fixed with
``materialize``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from creditloom.session import materialize

_PART = "__part"
_POSITION = "__position"
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in these.


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null, keeping the left copy of them."""
    renamed = right.withColumnsRenamed({key: f"__right_{key}" for key in keys})
    condition = None
    for key in keys:
        same = left[key].eqNullSafe(renamed[f"__right_{key}"])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition).drop(*[f"__right_{key}" for key in keys])


def with_row_number(
    df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """Number the rows 1, 2, … in ``order`` inside each of ``groups``.

    ``groups`` are few (months, labels, features); rows per group are unlimited.
    """
    keys = [*groups, *order]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_POSITION, F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright(_POSITION, _LOCAL_BITS))
    )
    placed = materialize(placed)
    runs = placed.groupBy(*groups, _PART).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(_POSITION).alias("__first")
    )
    earlier = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *groups,
        _PART,
        "__first",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
    )
    number = F.col("__before") + F.col(_POSITION) - F.col("__first") + 1
    return (
        _join_on(placed, runs, [*groups, _PART])
        .withColumn(name, number)
        .drop(_PART, _POSITION, "__first", "__before")
    )


def numbered(df: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
    """Number the rows 1, 2, … inside each of ``groups`` in any order, without moving them."""
    placed = materialize(
        df.withColumn(_POSITION, F.monotonically_increasing_id()).withColumn(
            _PART, F.shiftright(_POSITION, _LOCAL_BITS)
        )
    )
    inside = Window.partitionBy(*groups, _PART).orderBy(_POSITION)
    runs = placed.groupBy(*groups, _PART).agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *groups, _PART, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before")
    )
    return (
        _join_on(placed, runs, [*groups, _PART])
        .withColumn(name, F.col("__before") + F.row_number().over(inside))
        .drop(_PART, _POSITION, "__before")
    )


def with_running_totals(
    df: DataFrame, groups: Sequence[str], order: str, amounts: Sequence[str]
) -> DataFrame:
    """Add, for each amount, its sum over the rows before this one and over the whole group.

    Rows are ordered by ``order`` inside each of ``groups``; give one row per group and order
    value (collapse equal values first). Adds ``<amount>_before`` and ``<amount>_total``.
    """
    placed = df.repartitionByRange(*groups, order).withColumn(_PART, F.spark_partition_id())
    placed = materialize(placed)
    runs = placed.groupBy(*groups, _PART).agg(
        *[F.sum(amount).alias(f"__run_{amount}") for amount in amounts]
    )
    group = Window.partitionBy(*groups)
    earlier = group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *groups,
        _PART,
        *[
            F.coalesce(F.sum(f"__run_{a}").over(earlier), F.lit(0)).alias(f"__earlier_{a}")
            for a in amounts
        ],
        *[F.sum(f"__run_{a}").over(group).alias(f"{a}_total") for a in amounts],
    )
    inside = (
        Window.partitionBy(*groups, _PART)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = _join_on(placed, runs, [*groups, _PART])
    return joined.withColumns(
        {
            f"{a}_before": F.col(f"__earlier_{a}")
            + F.coalesce(F.sum(a).over(inside), F.lit(0))
            for a in amounts
        }
    ).drop(_PART, *[f"__earlier_{a}" for a in amounts])


def seeded_order(keys: Sequence[str], seed: int) -> Column:
    """A repeatable shuffle key: the md5 text of the keys and the seed."""
    parts = [F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
