"""Small tables kept as numbered revisions that several writers can commit to at once.

A revision's rows are written to a folder of their own first. What commits them is a file named
after the number, which holds the folder's name and can be created only once. A writer that finds
its number taken reads the newer revision, applies its change to that and tries the next number, so
no committed change is lost. Readers see whole revisions only; folders without a number are not read.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from creditloom.sources import files

ATTEMPTS = 50
LONGEST_PAUSE = 2.0  # seconds


def _log(path: str) -> str:
    return f"{path}/log"


def revisions(spark: SparkSession, path: str) -> list[int]:
    """The committed numbers, 1, 2, …"""
    return sorted(int(name) for name in files.names_in(spark, _log(path)))


def read_revision(
    spark: SparkSession, path: str, schema: StructType | str, number: int | None = None
) -> DataFrame:
    """A revision, by default the latest, or an empty table if there is none yet."""
    if number is None:
        number = max(revisions(spark, path), default=0)
    if number == 0:
        return spark.createDataFrame([], schema)
    folder = files.read_text(spark, f"{_log(path)}/{number:09d}")
    return spark.read.schema(schema).parquet(f"{path}/{folder}")


def commit(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    change: Callable[[DataFrame], DataFrame],
) -> int:
    """Commit ``change`` applied to the latest revision as the next one; returns its number."""
    for attempt in range(ATTEMPTS):
        last = max(revisions(spark, path), default=0)
        folder = f"rows-{uuid.uuid4().hex}"
        change(read_revision(spark, path, schema, last)).write.parquet(f"{path}/{folder}")
        if files.put_if_absent(spark, f"{_log(path)}/{last + 1:09d}", folder):
            return last + 1
        files.delete(spark, f"{path}/{folder}")
        time.sleep(random.uniform(0, min(LONGEST_PAUSE, 0.05 * 2**attempt)))
    raise RuntimeError(f"{path}: other writers took {ATTEMPTS} numbers in a row")


def save_revision(df: DataFrame, path: str) -> int:
    """Commit a table as the next revision whatever the latest one is; earlier ones stay."""
    return commit(df.sparkSession, path, df.schema, lambda _: df)
