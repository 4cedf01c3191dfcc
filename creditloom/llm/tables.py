"""What the operators of this subpackage share: reading a table and one definition of a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import shared_folder

# A word is a run of characters other than space, tab, newline, \v, \f and \r.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, or in the ``folder`` given, read again.

    Cuts lineage like a checkpoint. A checkpoint keeps the plan's estimated size, which grows as a
    power when a loop joins its own results again and again; a table has its true one.
    """
    folder = folder or shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda word: word != "")


def text_hash(*columns: str) -> Column:
    """A 64-bit hash that breaks ties between rows with the same key."""
    return F.xxhash64(*[F.col(name) for name in columns])
