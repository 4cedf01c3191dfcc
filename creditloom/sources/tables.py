"""Snapshot tables: partitioned Parquet with the snapshot date as a column, not in file names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditloom import constants as K
from creditloom.operators.history import upserted
from creditloom.operators.quality import missing_months
from creditloom.session import materialize
from creditloom.sources import files


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema every column is text: nothing is inferred."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_raw_snapshots(
    spark: SparkSession, path: str, snapshots: Sequence[str], schema: StructType | str | None = None
) -> DataFrame:
    """Raw rows of the given snapshots."""
    day = F.col(K.SNAPSHOT).try_cast("date")
    wanted = [F.lit(s).cast("date") for s in snapshots]
    return read_csv(spark, path, schema).where(day.isin(wanted))


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a table? One that is there but cannot be read is an error, not a missing one."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A table, or an empty one with ``schema`` if there is none yet."""
    reader = spark.read.schema(schema) if schema else spark.read
    if schema and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return reader.parquet(path)


def read_table_or_csv(
    spark: SparkSession, path: str, csv_path: str, schema: StructType | str
) -> DataFrame:
    """The table, else its CSV export, else an empty table; always with ``schema``."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    try:
        return read_csv(spark, csv_path, schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def require_snapshots(table: DataFrame, snapshots: Sequence[str], what: str) -> DataFrame:
    """The rows of the snapshots; raises, naming them, if any has none."""
    days = [F.lit(s).cast("date") for s in snapshots]
    rows = table.where(F.col(K.SNAPSHOT).isin(days))
    present = {str(row[0]) for row in rows.select(K.SNAPSHOT).distinct().collect()}
    absent = sorted(set(snapshots) - present)
    if absent:
        raise FileNotFoundError(f"no snapshot {', '.join(absent)} in {what}")
    return rows


def read_snapshot(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """Rows of one snapshot; raises if it is not there."""
    return require_snapshots(spark.read.parquet(path), [snapshot], path)


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Rows from the month of ``first`` to the month of ``last``; every month must be there."""
    table = spark.read.parquet(path)
    absent = [str(row[0]) for row in missing_months(table, first, last).collect()]
    if absent:
        raise FileNotFoundError(f"months missing in {path}: {', '.join(absent)}")
    start = F.trunc(F.lit(first).cast("date"), "month")
    end = F.last_day(F.lit(last).cast("date"))
    return table.where(F.col(K.SNAPSHOT).between(start, end))


def of_snapshots(table: DataFrame, snapshots: Iterable[str | date]) -> DataFrame:
    """The rows of the snapshots; other partitions are not read."""
    return table.where(F.col(K.SNAPSHOT).isin([F.lit(str(day)).cast("date") for day in snapshots]))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``snapshot_date, path, size, modified`` of a snapshot table's files, without reading them."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listing.select(
        F.col(K.SNAPSHOT).cast("date").alias(K.SNAPSHOT),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def read_with_file_name(spark: SparkSession, path: str) -> DataFrame:
    """A table with the file each row came from."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("source_file"))


def read_labels_between(spark: SparkSession, path: str, first, last) -> DataFrame:
    """Labels of the closed date range; an empty range keeps the schema."""
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    return spark.read.parquet(path).where(F.col(K.SNAPSHOT).between(low, high))


def write_snapshots(
    df: DataFrame, path: str, partition_by: Sequence[str] = (K.SNAPSHOT,), csv_path: str | None = None
) -> None:
    """Replace exactly the partitions ``df`` has rows for; others stay.

    Rebalancing gives each snapshot a few even files, however large the snapshot is.
    """
    balanced = df.hint("rebalance", *partition_by)

    def replace(kind: str, target: str) -> None:
        writer = balanced.write.mode("overwrite").partitionBy(*partition_by)
        writer = writer.option("partitionOverwriteMode", "dynamic")
        if kind == "csv":
            writer = writer.option("header", True)
        writer.format(kind).save(target)

    if csv_path is None:
        replace("parquet", path)
        return
    balanced = balanced.persist()  # two outputs of one plan
    try:
        replace("parquet", path)
        replace("csv", csv_path)
    finally:
        balanced.unpersist()


def drop_partitions(
    spark: SparkSession, path: str, partitions: Sequence[Mapping[str, str]]
) -> None:
    """Remove whole partitions, each given by its columns in the order of the folders."""
    for partition in partitions:
        folders = [f"{name}={value}" for name, value in partition.items()]
        files.delete(spark, "/".join([path, *folders]))


def replace_snapshots(df: DataFrame, path: str, snapshots: Sequence[str]) -> None:
    """Make the table's given snapshots those of ``df``; one without rows there goes."""
    spark = df.sparkSession

    def listed() -> DataFrame:
        return of_snapshots(listed_files(spark, path), snapshots)

    before = materialize(listed()) if exists(spark, path) else None
    write_snapshots(of_snapshots(df, snapshots), path)
    if before is not None:
        # Written snapshots have new files, so an old one is left where no row came.
        left = before.join(listed(), "path", "left_semi").select(K.SNAPSHOT).distinct().collect()
        drop_partitions(spark, path, [{K.SNAPSHOT: str(row[0])} for row in left])


def write_missing_snapshots(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write only snapshots the table does not have yet, or all with ``overwrite``."""
    spark = df.sparkSession
    if not overwrite and exists(spark, path):
        present = spark.read.parquet(path).select(K.SNAPSHOT).distinct()
        df = df.join(present, K.SNAPSHOT, "left_anti")
    write_snapshots(df, path)


def upsert(
    new: DataFrame,
    path: str,
    keys: Sequence[str],
    partition_by: Sequence[str],
    order: Sequence[str] = (),
    csv_path: str | None = None,
) -> None:
    """Put rows into a history by key, the last write winning.

    Only the partitions of the new rows are read and replaced; ``partition_by`` is part of
    ``keys``.
    """
    spark = new.sparkSession
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        touched = new.select(*partition_by).distinct()
        old = old.join(touched, list(partition_by), "left_semi")
    else:
        old = new.limit(0)
    # The result is fixed before the partitions it was read from are replaced.
    merged = materialize(upserted(old, new, keys, order))
    write_snapshots(merged.select(*new.columns), path, partition_by, csv_path)
