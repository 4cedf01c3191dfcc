"""Whether models are to be trained again: by calendar and by drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators import registry
from creditloom.plans.training import REGISTRY_SCHEMA
from creditloom.sources import revisions


def training_due(spark: SparkSession, model_root: str, run_date: str) -> DataFrame:
    """Three months after the latest training, or with none yet, training is due."""
    log = revisions.read_revision(spark, f"{model_root}/registry", REGISTRY_SCHEMA)
    return registry.training_cadence(log, F.lit(run_date).cast("date"))


def retrain_requests(
    spark: SparkSession, lake: str, model_root: str, snapshot: str
) -> DataFrame:
    """Per model type, whether drift at this snapshot asks for retraining.

    A monitored model asks also where the registry no longer holds it.
    """
    history = spark.read.parquet(f"{lake}/gold/model_monitoring/history")
    log = revisions.read_revision(spark, f"{model_root}/registry", REGISTRY_SCHEMA)
    typed = registry.typed_history(history, log)
    return registry.retrain_decisions(typed, F.lit(snapshot).cast("date"))
