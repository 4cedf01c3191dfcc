"""Scoring of feature months that have no predictions yet."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions.scores import score_class
from creditloom.operators import modeling, registry, selection
from creditloom.operators.temporal import unscored_snapshots
from creditloom.plans.training import (
    FACTS_SCHEMA,
    REGISTRY_SCHEMA,
    reconcile_registry,
    train_model,
)
from creditloom.sources import revisions, tables

PREDICTION_COLUMNS = [
    K.CUSTOMER,
    K.SNAPSHOT,
    "model_name",
    "model_predictions",
    "prediction_threshold",
    "label",
]


def load_model(spark: SparkSession, model_root: str, version: str) -> tuple[PipelineModel, dict]:
    """A saved pipeline and its facts: frozen features, windows, stored cutoff."""
    facts = tables.read_table(spark, f"{model_root}/facts", FACTS_SCHEMA)
    row = facts.where(F.col("file_stem") == version).first()
    if row is None:
        raise LookupError(f"no saved model {version}")
    return PipelineModel.load(f"{model_root}/artifacts/{version}"), row.asDict()


def choose_model(
    spark: SparkSession,
    model_root: str,
    model_version: str | None = None,
    model_type: str | None = None,
    lake: str | None = None,
    bootstrap_date: str = K.FIRST_TRAINING_DATE,
) -> str:
    """The named model, else the champion, else the challenger, after reconciling the registry.

    With ``lake`` given and nothing usable registered, one model is trained first.
    """
    reconcile_registry(spark, model_root)
    log = revisions.read_revision(spark, f"{model_root}/registry", REGISTRY_SCHEMA)
    try:
        return registry.selected_model(log, model_version, model_type)
    except LookupError:
        if model_version or lake is None:
            raise
    train_model(
        spark,
        spark.read.parquet(f"{lake}/gold/label_store"),
        spark.read.parquet(f"{lake}/gold/feature_store"),
        bootstrap_date,
        model_type or K.BOOSTED_TREES,
        model_root,
    )
    log = revisions.read_revision(spark, f"{model_root}/registry", REGISTRY_SCHEMA)
    return registry.selected_model(log, model_version, model_type)


def predictions(
    features: DataFrame,
    model: PipelineModel,
    facts: dict,
    version: str,
    threshold: float | None = None,
) -> DataFrame:
    """Score, cutoff and class of every feature row; ``threshold`` overrides the stored one."""
    selection.require_columns(features, facts["features"], "feature store")
    cutoff = facts["prediction_threshold"] if threshold is None else threshold
    scored = modeling.with_score(
        features.select(K.CUSTOMER, K.SNAPSHOT, *facts["features"]), model
    )
    return scored.withColumns(
        {
            "model_name": F.lit(version),
            "prediction_threshold": F.lit(cutoff),
            "label": score_class(F.col("model_predictions"), F.lit(cutoff)),
        }
    ).select(*PREDICTION_COLUMNS)


def score_new_months(
    spark: SparkSession,
    lake: str,
    model_root: str,
    model_version: str | None = None,
    model_type: str | None = None,
    threshold: float | None = None,
    first: str = K.FIRST_TRAINING_DATE,
    last: str | None = None,
    csv_export: bool = False,
) -> tuple[str, list[str]]:
    """Score all feature months without predictions of the chosen model in one job.

    Returns the model and the months scored; a second run finds none.
    """
    version = choose_model(spark, model_root, model_version, model_type, lake)
    features = spark.read.parquet(f"{lake}/gold/feature_store")
    target = f"{lake}/gold/model_predictions/{version}"
    known = tables.read_table(spark, target, f"{K.CUSTOMER} string, {K.SNAPSHOT} date")
    months = [row[0] for row in unscored_snapshots(features, known, first, last).collect()]
    if not months:
        return version, []
    model, facts = load_model(spark, model_root, version)
    fresh = features.where(F.col(K.SNAPSHOT).isin(months))
    csv_path = f"{lake}/gold/model_predictions_csv/{version}" if csv_export else None
    scored = predictions(fresh, model, facts, version, threshold)
    tables.write_snapshots(scored, target, csv_path=csv_path)
    return version, [str(month) for month in months]
