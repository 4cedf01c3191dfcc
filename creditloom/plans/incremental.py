"""Building only the months whose landed rows changed since the last build.

``manifest`` under the lake lists the landed files a build went by: path, size, time, rows and a
checksum of the rows. A run lists the files anew, which reads no data. Only files that the manifest
does not know are read, to take their checksum; months whose rows are as before, though in other
files, are not built again. Every layer is built month by month from the same month below, so the
changed months of a source name the partitions to read and to replace above it.

The manifest is written after the layers: a run that fails is simply done again by the next one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.operators.incremental import changed_groups, content_state, summed_state
from creditloom.plans import backfill
from creditloom.session import materialize
from creditloom.sources import tables

SOURCE = "source"
MANIFEST = (
    f"{SOURCE} string, {K.SNAPSHOT} date, path string, size long, modified timestamp,"
    " n_rows long, checksum decimal(38,0)"
)
_FILE = ["path", "size", "modified"]
_MONTH = [SOURCE, K.SNAPSHOT]


def _manifest(lake: str) -> str:
    return f"{lake}/manifest"


def _source_files(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """The manifest rows of one landed table as it is now; ``known`` are its last ones."""
    files = materialize(tables.listed_files(spark, path))
    unread = files.join(known, _FILE, "left_anti")
    months = [row[0] for row in unread.select(K.SNAPSHOT).distinct().collect()]  # of the calendar
    kept = known.join(files, _FILE, "left_semi").select(*files.columns, "n_rows", "checksum")
    if not months:
        return kept
    rows = tables.of_snapshots(spark.read.parquet(path), months)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"))
    rows = rows.join(unread.select("path"), "path", "left_semi")
    states = content_state(rows, [K.SNAPSHOT, "path"]).drop(K.SNAPSHOT)
    # A file without rows has no state of its own.
    read = unread.join(states, "path", "left").fillna(0, ["n_rows"])
    checksum = F.coalesce("checksum", F.lit(0)).cast("decimal(38,0)").alias("checksum")
    return kept.unionByName(read.select(*files.columns, "n_rows", checksum))


def landed_files(spark: SparkSession, lake: str) -> DataFrame:
    """All landed files as they are now, in the form of the manifest."""
    known = tables.read_table(spark, _manifest(lake), MANIFEST)
    found = spark.createDataFrame([], MANIFEST)
    for source in (backfill.LOANS, *backfill.RAW_FEATURES):
        own = known.where(F.col(SOURCE) == source).drop(SOURCE)
        files = _source_files(spark, f"{lake}/bronze/{source}", own)
        found = found.unionByName(files.withColumn(SOURCE, F.lit(source)))
    return found


def pending_months(known: DataFrame, now: DataFrame) -> DataFrame:
    """``source, snapshot_date, reason`` of the months to build, from two manifests."""
    return changed_groups(summed_state(known, _MONTH), summed_state(now, _MONTH), _MONTH)


def refresh(
    spark: SparkSession, lake: str, dpd: int = K.DEFAULT_DPD, mob: int = K.DEFAULT_MOB
) -> DataFrame:
    """Build silver and gold for the months that changed; returns them with the reason."""
    known = tables.read_table(spark, _manifest(lake), MANIFEST)
    now = materialize(landed_files(spark, lake))
    pending = materialize(pending_months(known, now))
    months: dict[str, list[str]] = {}
    for row in pending.select(*_MONTH).collect():  # sources x months of the calendar
        months.setdefault(row[SOURCE], []).append(str(row[K.SNAPSHOT]))
    if months:
        backfill.build_silver(spark, lake, months)
        backfill.build_gold(spark, lake, dpd, mob, months)
    _commit(spark, lake, known, now)
    return pending


def _commit(spark: SparkSession, lake: str, known: DataFrame, now: DataFrame) -> None:
    """Replace the manifest's rows of the months whose files are not the same any more."""
    renewed = now.join(known, _FILE, "left_anti").select(*_MONTH)
    removed = known.join(now, _FILE, "left_anti").select(*_MONTH)
    touched = materialize(renewed.union(removed).distinct())
    rows = materialize(now.join(touched, _MONTH, "left_semi"))
    gone = touched.join(rows, _MONTH, "left_anti").collect()  # sources x months of the calendar
    tables.write_snapshots(rows, _manifest(lake), _MONTH)
    tables.drop_partitions(
        spark, _manifest(lake), [{name: str(row[name]) for name in _MONTH} for row in gone]
    )


def run_month(
    spark: SparkSession, sources: Mapping[str, str], lake: str, month: str
) -> DataFrame:
    """One month of a schedule: land it, build what changed, return the months built."""
    backfill.land(spark, sources, lake, month, month)
    return refresh(spark, lake)
