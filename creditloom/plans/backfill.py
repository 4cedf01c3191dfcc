"""Landing, silver and gold for a set of months in one go."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions.months import month_frame
from creditloom.operators import gold, silver
from creditloom.operators.quality import partition_status
from creditloom.sources import tables

LOANS = "loan_daily"
RAW_FEATURES = tuple(silver.SILVER_FEATURES)


def months_between(spark: SparkSession, first: str, last: str) -> list[str]:
    """Month starts as ISO text; as many as the range has months."""
    return [str(row[0]) for row in month_frame(spark, first, last).collect()]


def land(
    spark: SparkSession, sources: Mapping[str, str], lake: str, first: str, last: str
) -> dict[str, DataFrame]:
    """Copy the months of every source CSV to bronze, as text; returns the bronze tables."""
    months = months_between(spark, first, last)
    landed = {}
    for name, path in sources.items():
        target = f"{lake}/bronze/{name}"
        tables.write_snapshots(tables.read_raw_snapshots(spark, path, months), target)
        landed[name] = spark.read.parquet(target)
    return landed


def _replace(df: DataFrame, path: str, months: Sequence[str] | None) -> None:
    if months is None:
        tables.write_snapshots(df, path)
    else:
        tables.replace_snapshots(df, path, months)


def _months_of(table: DataFrame, months: Sequence[str] | None) -> DataFrame:
    return table if months is None else tables.of_snapshots(table, months)


def build_silver(
    spark: SparkSession, lake: str, months: Mapping[str, Sequence[str]] | None = None
) -> None:
    """Build the silver tables, or only the given months of the tables named."""
    rules = {LOANS: silver.silver_loans, **silver.SILVER_FEATURES}
    for name in rules if months is None else months:
        own = None if months is None else months[name]
        landed = _months_of(spark.read.parquet(f"{lake}/bronze/{name}"), own)
        _replace(rules[name](landed), f"{lake}/silver/{name}", own)


def build_gold(
    spark: SparkSession,
    lake: str,
    dpd: int = K.DEFAULT_DPD,
    mob: int = K.DEFAULT_MOB,
    months: Mapping[str, Sequence[str]] | None = None,
) -> None:
    """Build labels and features, or only what the given months of the silver tables touch."""

    def read(name: str, wanted: Sequence[str] | None) -> DataFrame:
        return _months_of(spark.read.parquet(f"{lake}/silver/{name}"), wanted)

    def wanted(names: Sequence[str]) -> list[str] | None:
        return None if months is None else sorted({m for name in names for m in months.get(name, [])})

    if (own := wanted([LOANS])) != []:
        _replace(gold.gold_labels(read(LOANS, own), dpd, mob), f"{lake}/gold/label_store", own)
    if (own := wanted(RAW_FEATURES)) != []:
        joined = (read(name, own) for name in ("attributes", "financials", "clickstream"))
        _replace(gold.gold_features(*joined), f"{lake}/gold/feature_store", own)


def backfill(
    spark: SparkSession,
    sources: Mapping[str, str],
    lake: str,
    first: str = K.BACKFILL_START,
    last: str = K.BACKFILL_END,
) -> DataFrame:
    """Run all layers for the months and return the status of every table and month."""
    land(spark, sources, lake, first, last)
    build_silver(spark, lake)
    build_gold(spark, lake)
    return lake_status(spark, lake, first, last)


def lake_status(spark: SparkSession, lake: str, first: str, last: str) -> DataFrame:
    """Row count and status of each layer's tables; labels may be missing before they mature."""
    layers = {
        "bronze": [LOANS, *RAW_FEATURES],
        "silver": [LOANS, *RAW_FEATURES],
        "gold": ["label_store", "feature_store"],
    }
    found = {
        f"{layer}/{name}": spark.read.parquet(f"{lake}/{layer}/{name}")
        for layer, names in layers.items()
        for name in names
    }
    return partition_status(found, first, last, {"gold/label_store": K.FIRST_MATURED_LABEL})


def require_complete(status: DataFrame) -> None:
    """Raise, naming the gaps, unless every month is ok or allowed to be empty."""
    months = F.concat_ws(" ", F.sort_array(F.collect_list(F.col(K.SNAPSHOT).cast("string"))))
    # One row per table, and a month of the calendar per entry.
    gaps = (
        status.where("status = 'missing'")
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("n"), months.alias("months"))
        .orderBy("table_name")
        .collect()
    )
    if gaps:
        named = ", ".join(f"{row['table_name']} {row['months']} ({row['n']})" for row in gaps)
        raise ValueError(f"months without rows: {named}")
