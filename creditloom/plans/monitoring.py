"""Drift monitoring of one model over one or many snapshots."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.operators import drift, modeling, selection
from creditloom.operators.incremental import content_state
from creditloom.operators.quality import missing_months
from creditloom.plans.scoring import load_model
from creditloom.sources import revisions, tables

STORED_PROFILE = f"{drift.PROFILE}, reference_state string"

SUMMARY_COLUMNS = [
    "model_version",
    "snapshot_date",
    "snapshot_date_clean",
    "reference_feature_start_date",
    "reference_feature_end_date",
    "reference_count",
    "current_count",
    "psi_score",
    "psi_status",
    "max_csi",
    "max_csi_feature",
    "csi_status",
    "status",
    "retrain_required",
    "psi_warning_threshold",
    "psi_retrain_threshold",
    "csi_warning_threshold",
    "csi_retrain_threshold",
    "categorical_top_n",
    "created_at",
]
DETAIL_COLUMNS = [
    "model_version",
    "snapshot_date",
    "feature_name",
    "feature_type",
    "csi",
    "reference_count",
    "current_count",
    "bucket_count",
    "categorical_top_n",
]


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    bins: int = K.DEFAULT_BINS,
    top_n: int = K.CATEGORICAL_TOP_N,
) -> DataFrame:
    """Score and feature drift of every current snapshot against the reference.

    Both tables hold ``model_score`` and the features. The reference is read for the buckets
    and for its counts: persist it when scoring it is expensive.
    """
    return report_from_profile(fitted_profile(reference, features, bins, top_n), current, features)


def fitted_profile(
    reference: DataFrame, features: Sequence[str], bins: int, top_n: int
) -> DataFrame:
    """The profile of the score and the features in the reference."""
    numeric, categorical = selection.split_by_type(reference, features)
    return drift.drift_profile(reference, [K.SCORE_FEATURE, *numeric], categorical, bins, top_n)


def report_from_profile(
    profile: DataFrame, current: DataFrame, features: Sequence[str]
) -> DataFrame:
    """``drift_report`` from the reference's profile."""
    table = drift.drift_from_profile(
        profile, current, [K.SCORE_FEATURE, *features], [K.SNAPSHOT]
    )
    is_score = F.col("feature_name") == K.SCORE_FEATURE
    return table.withColumn(
        "feature_type", F.when(is_score, "score").otherwise(F.col("feature_type"))
    )


def reference_state(spark: SparkSession, store: str, windows: Mapping[str, str]) -> str:
    """What the reference months consist of now, from the list of their files alone.

    Raises if a month of the window has no files.
    """
    first, last = windows["feature_start_date"], windows["feature_end_date"]
    files = tables.listed_files(spark, store).where(
        F.col(K.SNAPSHOT).between(F.trunc(F.lit(first).cast("date"), "month"), F.last_day(F.lit(last).cast("date")))
    )
    absent = [str(row[0]) for row in missing_months(files, first, last).collect()]
    if absent:
        raise FileNotFoundError(f"months missing in {store}: {', '.join(absent)}")
    state = content_state(files, []).first()
    return f"{state['n_rows']}:{state['checksum']}"


def model_profile(
    spark: SparkSession,
    lake: str,
    model_version: str,
    features: Sequence[str],
    windows: Mapping[str, str],
    score: Callable[[DataFrame], DataFrame],
    bins: int = K.DEFAULT_BINS,
    top_n: int = K.CATEGORICAL_TOP_N,
) -> DataFrame:
    """The stored profile of a model's reference months; fitted if there is none of these months.

    Profiles are kept per model, bins and top levels. Where the months' files are others than
    those a profile was fitted on, a new revision is fitted; earlier ones stay.
    """
    store = f"{lake}/gold/feature_store"
    path = f"{lake}/gold/drift_profiles/{model_version}/bins-{bins}-top-{top_n}"
    state = reference_state(spark, store, windows)
    stored = revisions.read_revision(spark, path, STORED_PROFILE)
    if stored.where(F.col("reference_state") == state).isEmpty():
        reference = tables.read_months(
            spark, store, windows["feature_start_date"], windows["feature_end_date"]
        )
        population = score(reference).persist()
        try:
            fitted = fitted_profile(population, features, bins, top_n)
            rows = fitted.withColumn("reference_state", F.lit(state))
            number = revisions.commit(spark, path, STORED_PROFILE, lambda _: rows)
        finally:
            population.unpersist()
        stored = revisions.read_revision(spark, path, STORED_PROFILE, number)
    return stored.drop("reference_state")


def monitoring_summary(
    detail: DataFrame,
    model_version: str,
    windows: dict[str, str],
    psi_warning: float = K.PSI_WARNING,
    psi_retrain: float = K.PSI_RETRAIN,
    csi_warning: float = K.CSI_WARNING,
    csi_retrain: float = K.CSI_RETRAIN,
    top_n: int = K.CATEGORICAL_TOP_N,
) -> DataFrame:
    """One row per snapshot from the drift report."""
    score = selection.score_rows(detail).select(
        K.SNAPSHOT, F.col("csi").alias("psi_score"), "reference_count", "current_count"
    )
    worst = drift.worst_feature(selection.feature_rows(detail), [K.SNAPSHOT])
    rows = score.join(worst, K.SNAPSHOT, "left").withColumns(
        {
            "max_csi": F.coalesce("max_csi", F.lit(0.0)),
            "max_csi_feature": F.coalesce("max_csi_feature", F.lit("")),
        }
    )
    judged = drift.with_statuses(rows, psi_warning, psi_retrain, csi_warning, csi_retrain)
    day = F.date_format(K.SNAPSHOT, "yyyy-MM-dd")
    return judged.withColumns(
        {
            "model_version": F.lit(model_version),
            "snapshot_date": day,
            "snapshot_date_clean": F.replace(day, F.lit("-"), F.lit("_")),
            "reference_feature_start_date": F.lit(windows["feature_start_date"]),
            "reference_feature_end_date": F.lit(windows["feature_end_date"]),
            "psi_warning_threshold": F.lit(psi_warning),
            "psi_retrain_threshold": F.lit(psi_retrain),
            "csi_warning_threshold": F.lit(csi_warning),
            "csi_retrain_threshold": F.lit(csi_retrain),
            "categorical_top_n": F.lit(top_n),
            "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        }
    ).select(*SUMMARY_COLUMNS)


def monitor(
    spark: SparkSession,
    lake: str,
    model_root: str,
    model_version: str,
    snapshots: Sequence[str],
    bins: int = K.DEFAULT_BINS,
    top_n: int = K.CATEGORICAL_TOP_N,
    csv_export: bool = False,
    **limits: float,
) -> DataFrame:
    """Measure drift of the snapshots, put the rows into the histories and return the summary.

    The reference is the feature window the model was trained on; every month of it must be
    there. Its rows are read and scored once per model: what later runs need of it is stored.
    """
    model, facts = load_model(spark, model_root, model_version)
    features, windows = facts["features"], facts["windows"]
    store = f"{lake}/gold/feature_store"
    current = tables.require_snapshots(spark.read.parquet(store), snapshots, store)
    selection.require_columns(current, features, "feature store")

    def scored(df: DataFrame) -> DataFrame:
        kept = df.select(K.SNAPSHOT, *features)
        return modeling.with_score(kept, model, K.SCORE_FEATURE)

    profile = model_profile(
        spark, lake, model_version, features, windows, scored, bins, top_n
    )
    detail = report_from_profile(profile, scored(current), features).persist()
    try:
        summary = monitoring_summary(detail, model_version, windows, top_n=top_n, **limits)
        shown = detail.withColumns(
            {
                "model_version": F.lit(model_version),
                "snapshot_date": F.date_format(K.SNAPSHOT, "yyyy-MM-dd"),
            }
        ).select(*DETAIL_COLUMNS)
        root = f"{lake}/gold/model_monitoring"
        for name, rows, keys in (
            ("history", summary, K.MONITORING_KEY),
            ("csi_detail", shown, [*K.MONITORING_KEY, "feature_name"]),
        ):
            csv_path = f"{root}_csv/{name}" if csv_export else None
            tables.upsert(rows, f"{root}/{name}", keys, K.MONITORING_KEY, csv_path=csv_path)
    finally:
        detail.unpersist()
    texts = [F.lit(s) for s in snapshots]
    return (
        spark.read.schema(summary.schema)
        .parquet(f"{root}/history")
        .where((F.col("model_version") == model_version) & F.col("snapshot_date").isin(texts))
    )


def ordered_detail(detail: DataFrame) -> DataFrame:
    """The score row first, then features by falling CSI."""
    return detail.orderBy(
        "snapshot_date", F.desc(F.col("feature_name") == K.SCORE_FEATURE), F.desc("csi")
    )
