"""Evaluation of stored predictions whose labels have matured.

A model's predictions and labels are counted once a month: ``performance_state`` keeps, per
prediction month, how many rows have which score and classes, and next to it what files of
predictions and labels they were counted from. An evaluation lists the files, which reads no data,
counts the months whose files are others than before, and makes its rows from the counts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.operators import evaluation, quality, selection, temporal
from creditloom.operators.incremental import changed_groups, content_state
from creditloom.session import materialize
from creditloom.sources import tables

STATE = (
    f"model_version string, {K.SNAPSHOT} date, label_snapshot_date date,"
    " prediction_threshold double, score double, predicted int, actual int, rows long"
)
INPUTS = f"{K.SNAPSHOT} date, n_rows long, checksum decimal(38,0)"


def _due(day: str) -> Column:
    """The month whose labels tell about predictions of ``day``."""
    return F.add_months(day, K.LABEL_LAG_MONTHS)


def _predictions(lake: str, model_version: str) -> str:
    return f"{lake}/gold/model_predictions/{model_version}"


def _state(lake: str, model_version: str) -> str:
    return f"{lake}/gold/performance_state/{model_version}"


def matured_rows(
    predictions: DataFrame, labels: DataFrame, model_version: str, evaluation_date: str
) -> DataFrame:
    """Matured predictions with the label of their customer six months later."""
    selection.require_columns(
        predictions, [K.CUSTOMER, K.SNAPSHOT, "model_predictions"], "predictions"
    )
    selection.require_columns(labels, [K.CUSTOMER, "label", K.SNAPSHOT], "labels")
    due = temporal.maturing_predictions(predictions, model_version)
    return temporal.prediction_label_join(
        temporal.matured(due, evaluation_date), temporal.customer_month_labels(labels)
    )


def check_maturity(months: DataFrame, model_version: str, evaluation_date: str) -> None:
    """Raises unless one of the prediction ``months`` has matured."""
    due = months.select(_due(K.SNAPSHOT).alias("label_snapshot_date"))
    row = quality.maturity_check(due, evaluation_date).first()
    if not row["prediction_count"]:
        raise FileNotFoundError(f"no predictions of {model_version}")
    if not row["matured_count"]:
        raise ValueError(
            f"no prediction has matured by {evaluation_date};"
            f" the earliest label date needed is {row['earliest_label_date']}"
        )


def _matured_months(months: DataFrame, evaluation_date: str) -> DataFrame:
    return months.where(_due(K.SNAPSHOT) <= F.lit(evaluation_date).cast("date"))


def month_inputs(
    spark: SparkSession, lake: str, model_version: str, evaluation_date: str
) -> DataFrame:
    """What each matured month is counted from: the state of its prediction and label files."""
    predictions = _matured_months(
        tables.listed_files(spark, _predictions(lake, model_version)), evaluation_date
    )
    months = predictions.select(K.SNAPSHOT, _due(K.SNAPSHOT).alias("due")).distinct()
    labels = tables.listed_files(spark, f"{lake}/gold/label_store").withColumnRenamed(K.SNAPSHOT, "due")
    labels = labels.join(months, "due").select(*predictions.columns)
    return content_state(predictions.unionByName(labels), [K.SNAPSHOT])


def refresh_state(
    spark: SparkSession, lake: str, model_version: str, evaluation_date: str
) -> list[str]:
    """Count the matured months whose predictions or labels changed; returns them in order.

    What a month was counted from is written after its counts: a run that fails is done again.
    """
    path = _state(lake, model_version)
    known = _matured_months(tables.read_table(spark, f"{path}/inputs", INPUTS), evaluation_date)
    now = materialize(month_inputs(spark, lake, model_version, evaluation_date))
    changed = changed_groups(known, now, [K.SNAPSHOT]).select(K.SNAPSHOT, _due(K.SNAPSHOT))
    pending = {str(day): str(due) for day, due in changed.collect()}  # months of the calendar
    if pending:
        predictions = spark.read.parquet(_predictions(lake, model_version))
        labels = spark.read.parquet(f"{lake}/gold/label_store")
        scored = matured_rows(
            tables.of_snapshots(predictions, pending),
            tables.of_snapshots(labels, set(pending.values())),
            model_version,
            evaluation_date,
        )
        counted = evaluation.performance_state(scored)
        counted = counted.withColumnRenamed("prediction_snapshot_date", K.SNAPSHOT)
        tables.replace_snapshots(counted, f"{path}/counts", list(pending))
        tables.replace_snapshots(now, f"{path}/inputs", list(pending))
    return sorted(pending)


def stored_state(
    spark: SparkSession, lake: str, model_version: str, evaluation_date: str
) -> DataFrame:
    """The counts of the months matured by the date, as ``performance_state`` has them."""
    counts = tables.read_table(spark, f"{_state(lake, model_version)}/counts", STATE)
    return _matured_months(counts, evaluation_date).withColumnRenamed(
        K.SNAPSHOT, "prediction_snapshot_date"
    )


def evaluate(
    spark: SparkSession,
    lake: str,
    model_version: str,
    evaluation_date: str,
    bins: int = K.DEFAULT_BINS,
    csv_export: bool = False,
) -> DataFrame:
    """Judge a model by its matured predictions, keep the result and return its summary rows."""
    files = tables.listed_files(spark, _predictions(lake, model_version))
    check_maturity(files, model_version, evaluation_date)
    refresh_state(spark, lake, model_version, evaluation_date)
    state = stored_state(spark, lake, model_version, evaluation_date).persist()
    try:
        if state.isEmpty():
            raise ValueError("no matured label matches a prediction by customer and month")
        summary = evaluation.state_summary(state, evaluation_date)
        detail = evaluation.state_bands(state, bins).select(
            F.lit(model_version).alias("model_version"),
            F.lit(evaluation_date).alias("evaluation_date"),
            "score_band",
            "row_count",
            "min_score",
            "max_score",
            "avg_score",
            "actual_default_rate",
            "predicted_default_rate",
        )
        root = f"{lake}/gold/model_performance"
        part = ["model_version", "evaluation_date"]
        for name, rows, keys in (
            ("history", summary, K.PERFORMANCE_KEY),
            ("detail", detail, [*part, "score_band"]),
        ):
            csv_path = f"{root}_csv/{name}" if csv_export else None
            tables.upsert(rows, f"{root}/{name}", keys, part, csv_path=csv_path)
    finally:
        state.unpersist()
    return (
        spark.read.schema(summary.schema)
        .parquet(f"{root}/history")
        .where(
            (F.col("model_version") == model_version)
            & (F.col("evaluation_date") == evaluation_date)
        )
    )
