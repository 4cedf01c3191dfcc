"""Training job: join, split, search, calibrate, choose a cutoff, save and register."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions.months import training_windows
from creditloom.operators import classification, modeling, quality, registry, sampling, selection
from creditloom.operators.temporal import label_feature_join
from creditloom.session import materialize
from creditloom.sources import files
from creditloom.sources.revisions import commit, read_revision
from creditloom.sources.tables import read_table

SPLITS = ("train", "test", "oot")
REGISTRY_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in K.REGISTRY_COLUMNS.items())
# What is saved beside a pipeline. ``file_stem`` is its folder, so a misplaced model shows.
FACTS_SCHEMA = (
    f"{REGISTRY_SCHEMA}, features array<string>, windows map<string,string>,"
    " params map<string,string>,"
    " data_stats array<struct<split:string,row_count:long,default_rate:double>>, file_stem string"
)
WINDOW_COLUMNS = [
    "train_test_start_date",
    "train_test_end_date",
    "oot_start_date",
    "oot_end_date",
    "feature_start_date",
    "feature_end_date",
]


@dataclass
class FittedModel:
    """A fitted pipeline with what a registry row and later scoring need."""

    model: PipelineModel
    model_type: str
    train_date: str
    features: list[str]
    windows: dict[str, str]
    params: dict[str, Any]
    metrics: dict[str, dict[str, float]]
    threshold: dict[str, float]
    oot_at_threshold: dict[str, float]
    split_sizes: dict[str, tuple[int, float]]


def window_dates(spark: SparkSession, train_date: str) -> dict[str, str]:
    """The training windows of one date as ISO text."""
    windows = training_windows(F.lit(train_date).cast("date"))
    texts = [F.date_format(day, "yyyy-MM-dd").alias(name) for name, day in windows.items()]
    return spark.range(1).select(*texts).first().asDict()


def training_rows(
    labels: DataFrame, features: DataFrame, windows: Mapping[str, str]
) -> tuple[DataFrame, list[str]]:
    """Labels of the windows with the features of six months earlier, and the feature names.

    Both tables are cut to their windows first, so only those partitions are read.
    """

    def day(name: str):
        return F.lit(windows[name]).cast("date")

    in_window = labels.where(
        F.col(K.SNAPSHOT).between(day("train_test_start_date"), day("oot_end_date"))
    )
    early = features.where(
        F.col(K.SNAPSHOT).between(day("feature_start_date"), day("feature_end_date"))
    )
    joined = label_feature_join(in_window, early)
    names = selection.model_features(joined.columns)
    if not names:
        raise ValueError("no feature columns left after exclusions")
    part = sampling.temporal_split({name: day(name) for name in WINDOW_COLUMNS})
    return joined.withColumn("part", part), names


def check_training_rows(rows: DataFrame, features: Sequence[str]) -> None:
    """Both parts must be there with both classes, and some row must have a feature."""
    report = {
        row["split"]: row
        for row in quality.split_sanity(rows, F.col("part"), features).collect()
    }
    for part in ("train_test", "oot"):
        if part not in report:
            raise ValueError(f"no {part} rows in the training windows")
        if report[part]["label_classes"] < 2:
            raise ValueError(f"{part} rows must hold both label classes")
    if not any(row["rows_with_features"] for row in report.values()):
        raise ValueError("no label has features six months earlier")


def fit_model(
    labels: DataFrame,
    features: DataFrame,
    train_date: str,
    model_type: str,
    candidates: Sequence[Mapping[str, Any]] | None = None,
) -> FittedModel:
    """Fit, calibrate and assess one model; ``candidates`` defaults to the seeded random draw."""
    spark = labels.sparkSession
    windows = window_dates(spark, train_date)
    rows, names = training_rows(labels, features, windows)
    kept = rows.where(F.col("part").isNotNull()).select(
        K.CUSTOMER, "loan_id", K.SNAPSHOT, "part", F.col("label").cast("double"), *names
    )
    # One join and one split feed every fit below.
    kept = kept.persist()
    split = sampling.with_stratified_holdout(
        kept.where(F.col("part") == "train_test"), "label", [K.CUSTOMER, "loan_id", K.SNAPSHOT]
    ).persist()
    try:
        check_training_rows(kept, names)
        train = split.where(~F.col("holdout")).drop("holdout")
        test = split.where(F.col("holdout")).drop("holdout")
        oot = kept.where(F.col("part") == "oot")
        numeric, categorical = selection.split_by_type(kept, names)
        prepared = modeling.fit_preprocessing(train, numeric, categorical)
        ready = {
            name: prepared.transform(df).select("label", modeling.FEATURES).persist()
            for name, df in zip(SPLITS, (train, test, oot))
        }
        grid = K.LOG_REG_GRID if model_type == K.LOG_REG else K.BOOSTED_TREES_GRID
        points = list(candidates or modeling.drawn_candidates(grid))
        best, params, _ = modeling.search(model_type, ready["train"], ready["test"], points)
        slicer = modeling.calibration_slicer(model_type)
        calibrator = modeling.fit_sigmoid(slicer.transform(best.transform(ready["test"])))
        tail = PipelineModel([best, slicer, calibrator])

        scored = None
        for name, df in ready.items():
            part = modeling.with_score(df, tail).select(
                F.lit(name).alias("split"), "label", "model_predictions"
            )
            scored = part if scored is None else scored.unionByName(part)
        scored = scored.persist()
        score, label = F.col("model_predictions"), F.col("label")
        metrics = {
            row["split"]: row.asDict()
            for row in classification.ranking_metrics(
                classification.score_counts(scored, ["split"], score, label), ["split"]
            ).collect()
        }
        sweep = classification.threshold_sweep(scored, ["split"], score, label)
        cutoffs = {(row["split"], row["threshold"]): row.asDict() for row in sweep.collect()}
        chosen = classification.best_threshold(
            sweep.where(F.col("split") == "test"), ["split"]
        ).first()["threshold"]
        sizes = {
            row["split"]: (row["n"], row["rate"])
            for row in scored.groupBy("split")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 2).alias("rate"))
            .collect()
        }
        scored.unpersist()
        for df in ready.values():
            df.unpersist()
    finally:
        split.unpersist()
        kept.unpersist()
    return FittedModel(
        model=PipelineModel([*prepared.stages, *tail.stages]),
        model_type=model_type,
        train_date=train_date,
        features=names,
        windows=windows,
        params=params,
        metrics=metrics,
        threshold=cutoffs[("test", chosen)],
        oot_at_threshold=cutoffs[("oot", chosen)],
        split_sizes=sizes,
    )


def registry_row(fit: FittedModel, model_version: str) -> dict[str, Any]:
    row: dict[str, Any] = {
        "model_version": model_version,
        "model_type": fit.model_type,
        "train_date": fit.train_date,
        "calibration_method": K.CALIBRATION_METHOD,
        "calibration_selection_metric": K.CALIBRATION_SELECTION,
        "prediction_threshold": fit.threshold["threshold"],
        "threshold_selection_metric": K.THRESHOLD_METRIC,
        "threshold_selection_score": fit.threshold[K.THRESHOLD_METRIC],
        "oot_threshold_selection_score": fit.oot_at_threshold[K.THRESHOLD_METRIC],
        "champion": 0,
        "challenger": 0,
    }
    for metric in ("auc", "gini", "brier", "log_loss"):
        for split in SPLITS:
            row[f"{metric}_{split}"] = fit.metrics[split][metric]
    return row


def train_model(
    spark: SparkSession,
    labels: DataFrame,
    features: DataFrame,
    train_date: str,
    model_type: str,
    model_root: str,
    candidates: Sequence[Mapping[str, Any]] | None = None,
) -> str:
    """Fit a model, save its pipeline and facts under ``model_root`` and register it."""
    fit = fit_model(labels, features, train_date, model_type, candidates)
    base = f"{K.MODEL_PREFIX}{model_type}_{train_date.replace('-', '_')}"
    version = claim_version(spark, model_root, base)
    fit.model.write().save(f"{model_root}/artifacts/{version}")

    row = registry_row(fit, version)
    new = spark.createDataFrame([[row[name] for name in K.REGISTRY_COLUMNS]], REGISTRY_SCHEMA)
    stats = [(split, *fit.split_sizes[split]) for split in SPLITS]
    params = {name: str(value) for name, value in fit.params.items()}
    facts = [
        *[row[name] for name in K.REGISTRY_COLUMNS], fit.features, fit.windows, params, stats, version
    ]
    spark.createDataFrame([facts], FACTS_SCHEMA).write.mode("append").partitionBy(
        "file_stem"
    ).parquet(f"{model_root}/facts")
    commit(spark, f"{model_root}/registry", REGISTRY_SCHEMA, lambda log: registry.registered(log, new))
    return version


def claim_version(spark: SparkSession, model_root: str, base: str) -> str:
    """A version name that no other training has or gets: the next number no one holds.

    Counting starts after the registered versions of ``base``. Names of saved models and of
    trainings under way are held too, also where the registry has lost one of them.
    """
    log = read_revision(spark, f"{model_root}/registry", REGISTRY_SCHEMA)
    names = spark.createDataFrame([(base,)], "base_name string")
    number = registry.next_version_numbers(log, names).first()["next_number"]
    held = set(files.names_in(spark, f"{model_root}/artifacts"))
    held |= {row[0] for row in log.where(F.col("model_version").startswith(base)).select("model_version").collect()}
    while True:
        version = f"{base}_v{number}"
        if version not in held and files.put_if_absent(spark, f"{model_root}/claims/{version}", ""):
            return version
        number += 1


def rejected_models(spark: SparkSession, model_root: str) -> DataFrame:
    """Saved models that reconciling leaves out of the registry, with the reason."""
    facts = read_table(spark, f"{model_root}/facts", FACTS_SCHEMA)
    return registry.rejected_artifacts(facts)


def reconcile_registry(spark: SparkSession, model_root: str) -> DataFrame:
    """Bring the registry in line with the saved models; returns the versions that came or went."""
    facts = read_table(spark, f"{model_root}/facts", FACTS_SCHEMA)
    path = f"{model_root}/registry"

    def reconciled(log: DataFrame) -> DataFrame:
        return registry.reconciled(facts, log).select(*K.REGISTRY_COLUMNS)

    number = commit(spark, path, REGISTRY_SCHEMA, reconciled)
    before, now = (read_revision(spark, path, REGISTRY_SCHEMA, n) for n in (number - 1, number))
    return materialize(registry.version_changes(now, before))
