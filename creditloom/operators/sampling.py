"""Temporal and stratified splits, and resampling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from creditloom import constants as K
from creditloom.operators.ordering import numbered, seeded_order, with_row_number
from creditloom.session import materialize

_PREFIX_LENGTH = 4  # hexadecimal digits: 65,536 even slices of the hash order
_DRAW_DIGITS = 13  # hexadecimal digits of a draw: as many bits as a double holds exactly


def temporal_split(windows: Mapping[str, Column]) -> Column:
    """'train_test', 'oot' or null for a label's snapshot date."""
    day = F.col(K.SNAPSHOT)
    return F.when(
        day.between(windows["train_test_start_date"], windows["train_test_end_date"]),
        "train_test",
    ).when(day.between(windows["oot_start_date"], windows["oot_end_date"]), "oot")


def with_stratified_holdout(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    fraction: str = K.HOLDOUT_FRACTION,
    seed: int = K.SPLIT_SEED,
) -> DataFrame:
    """Add ``holdout``: true for the first ceil(fraction × rows) of each class in hash order.

    ``keys`` identify a row. The rows themselves are not sorted or shuffled: counts per class
    and hash prefix tell in which of 65,536 slices the limit lies, and only that slice is
    ordered to find the exact limit.
    """
    share = Fraction(fraction)
    place = F.struct(
        seeded_order(keys, seed).alias("hash"), F.xxhash64(*df.columns).alias("tie")
    ).alias("__place")
    hashed = df.select(label, place)
    prefix = F.substring("__place.hash", 1, _PREFIX_LENGTH).alias("slice")
    slices = hashed.groupBy(label, prefix).agg(F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy(label)
    earlier = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.expr(
        f"(total * {share.numerator}L + {share.denominator - 1}L) div {share.denominator}L"
    )
    limit_slice = (
        slices.withColumns(
            {
                "before": F.coalesce(F.sum("rows").over(earlier), F.lit(0)),
                "total": F.sum("rows").over(group),
            }
        )
        .withColumn("wanted", wanted)
        .where((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("rows")))
        .select(label, "slice", (F.col("wanted") - F.col("before")).alias("inside"))
    )
    # One row per class from here on.
    in_slice = hashed.withColumn("slice", prefix).join(F.broadcast(limit_slice), [label, "slice"])
    # Ordering samples its rows before it deals them out; the slice is small, df is not.
    in_slice = materialize(in_slice.select(label, "inside", "__place", "__place.hash", "__place.tie"))
    limit = (
        with_row_number(in_slice, [label], ["hash", "tie"], "n")
        .groupBy(label, "__place", "inside")
        .agg(F.min("n").alias("first"), F.max("n").alias("last"))
        .where(F.col("inside").between(F.col("first"), F.col("last")))
        .select(
            F.col(label).alias("__class"),
            F.col("__place").alias("__limit"),
            (F.col("inside") - F.col("first") + 1).alias("__take"),
            (F.col("inside") < F.col("last")).alias("__some_left"),
        )
    )
    limit = materialize(limit)
    marked = df.withColumn("__place", place).join(
        F.broadcast(limit), F.col(label).eqNullSafe(F.col("__class")), "left"
    )
    helpers = ("__place", "__limit", "__take", "__class", "__some_left")
    if limit.where("__some_left").isEmpty():  # no limit lies within a set of equal rows
        up_to = F.coalesce(F.col("__place") <= F.col("__limit"), F.lit(False))
        return marked.withColumn("holdout", up_to).drop(*helpers)
    at_limit = F.coalesce(F.col("__place") == F.col("__limit"), F.lit(False))
    rest = marked.where(~at_limit).withColumn(
        "holdout", F.coalesce(F.col("__place") < F.col("__limit"), F.lit(False))
    )
    # Rows equal in every column share the limit: as many of them are taken as are still wanted.
    equal = numbered(marked.where(at_limit), [label], "__n").withColumn(
        "holdout", F.col("__n") <= F.col("__take")
    )
    return rest.unionByName(equal.drop("__n")).drop(*helpers)


def draws(spark: SparkSession, count: int, rows: int, seed: int) -> DataFrame:
    """``at, copies``: how often each of the places 1 to ``rows`` comes up in ``count`` draws.

    Draw k hits a place by a hash of the seed and k, so the draws repeat and are made in parallel.
    """
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id"))), 1, _DRAW_DIGITS)
    share = F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_DRAW_DIGITS))
    place = F.floor(share * F.lit(float(rows))) + 1
    return spark.range(count).groupBy(place.alias("at")).agg(F.count(F.lit(1)).alias("copies"))


def bootstrap_sample(
    df: DataFrame,
    fraction: float,
    seed: int,
    keys: Sequence[str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``rows`` draws with replacement, by default ``fraction`` of the table's rows, rounded.

    Rows are numbered by a hash of their ``keys`` (all columns, if not given) and every draw picks
    one number, so a row may be drawn any number of times and equal rows are drawn each on its own.
    The sample repeats on any partitioning. An empty table gives an empty sample.
    """
    order = {
        "__hash": seeded_order(keys or df.columns, seed),
        "__tie": F.xxhash64(*df.columns),
    }
    placed = with_row_number(df.withColumns(order), [], list(order), "__at")
    total = placed.agg(F.coalesce(F.max("__at"), F.lit(0))).first()[0]
    count = rows if rows is not None else math.floor(fraction * total + 0.5)
    drawn = draws(df.sparkSession, count if total else 0, total, seed)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))
    return (
        placed.join(drawn.toDF("__at", "__copies"), "__at")
        .withColumn("__copy", copies)
        .select(*df.columns)
    )
