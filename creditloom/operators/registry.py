"""The model registry: validity, champions and challengers, promotion, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions.months import months_apart

RANK_BY = ["auc_oot", "auc_test", "auc_train"]


def valid_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts with a version that equals their file stem and with all three AUCs."""
    version = F.trim("model_version")
    return (
        artifacts.where((version != "") & (version == F.col("file_stem")))
        .dropna(subset=RANK_BY)
        .withColumn("model_version", version)
        .withColumn("model_type", F.trim(F.coalesce("model_type", F.lit(""))))
    )


def rejected_artifacts(artifacts: DataFrame) -> DataFrame:
    """The artifacts that are no valid models, with the rules each one fails, in a fixed order."""
    version = F.trim(F.coalesce("model_version", F.lit("")))
    named = F.when(version == "", "no version").when(
        ~version.eqNullSafe(F.col("file_stem")), "version is not the file's name"
    )
    missing = [F.when(F.col(name).isNull() | F.isnan(name), f"no {name}") for name in RANK_BY]
    reasons = F.array_compact(F.array(named, *missing))
    return artifacts.select(
        "file_stem", "model_version", "model_type", F.array_join(reasons, "; ").alias("reason")
    ).where(F.col("reason") != "")


def typed_history(history: DataFrame, log: DataFrame) -> DataFrame:
    """Monitoring rows with their model's type, from the registry or, where it is gone, its name."""
    known = log.select("model_version", F.col("model_type").alias("__type")).distinct()
    named = F.coalesce(
        *[F.when(F.col("model_version").startswith(f"{K.MODEL_PREFIX}{t}_"), t) for t in K.MODEL_TYPES]
    )
    return (
        history.drop("model_type")
        .join(known, "model_version", "left")
        .withColumn("model_type", F.coalesce("__type", named))
        .drop("__type")
    )


def best_by_type(models: DataFrame) -> DataFrame:
    """Best model of each type: AUC out-of-time, then test, then train, then the smaller name."""
    ties = models.groupBy("model_type", *RANK_BY).agg(F.min("model_version").alias("model_version"))
    return ties.groupBy("model_type").agg(
        F.max_by("model_version", F.struct(*RANK_BY)).alias("model_version")
    )


def reconciled(artifacts: DataFrame, old_log: DataFrame) -> DataFrame:
    """Valid artifacts with champion and challenger of each type.

    A type's only still valid old champion stays; otherwise the best model is champion. The
    challenger is the best of the others.
    """
    models = valid_artifacts(artifacts).drop("champion", "challenger")
    old = (
        old_log.where(F.col("champion").try_cast("int") == 1)
        .select(F.trim("model_type").alias("model_type"), F.trim("model_version").alias("model_version"))
        .distinct()
        .join(models.select("model_type", "model_version"), ["model_type", "model_version"], "left_semi")
        .groupBy("model_type")
        .agg(F.count(F.lit(1)).alias("champions"), F.min("model_version").alias("kept"))
        .where(F.col("champions") == 1)
    )
    champions = (
        best_by_type(models)
        .join(old, "model_type", "left")
        .select("model_type", F.coalesce("kept", "model_version").alias("champion_version"))
    )
    crowned = models.join(champions, "model_type")
    others = crowned.where(F.col("model_version") != F.col("champion_version"))
    challengers = best_by_type(others).withColumnRenamed("model_version", "challenger_version")

    def is_version(column: str) -> Column:
        same = F.col("model_version") == F.col(column)
        return F.coalesce(same.cast("int"), F.lit(0))

    return (
        crowned.join(challengers, "model_type", "left")
        .withColumns(
            {
                "champion": is_version("champion_version"),
                "challenger": is_version("challenger_version"),
            }
        )
        .drop("champion_version", "challenger_version", "file_stem")
    )


def version_changes(registry: DataFrame, old_log: DataFrame) -> DataFrame:
    """Versions that came or went against the old log."""
    now = registry.select("model_version").distinct()
    before = (
        old_log.select(F.trim("model_version").alias("model_version"))
        .where(F.col("model_version").isNotNull())
        .distinct()
    )
    added = now.join(before, "model_version", "left_anti").withColumn("change", F.lit("added"))
    removed = before.join(now, "model_version", "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def promotion(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Champion and challenger flags of new models against the champion of their type.

    The first of a type is champion; a model better on both test and out-of-time AUC is
    challenger.
    """
    champions = (
        registry.where(F.col("champion") == 1)
        .groupBy("model_type")
        .agg(
            F.min_by("auc_test", "model_version").alias("__test"),
            F.min_by("auc_oot", "model_version").alias("__oot"),
            F.lit(True).alias("__found"),
        )
    )
    better = (F.col("auc_test") > F.col("__test")) & (F.col("auc_oot") > F.col("__oot"))
    return (
        candidates.drop("champion", "challenger")
        .join(champions, "model_type", "left")
        .withColumns(
            {
                "champion": F.col("__found").isNull().cast("int"),
                "challenger": F.coalesce(better.cast("int"), F.lit(0)),
            }
        )
        .drop("__test", "__oot", "__found")
    )


def registered(registry: DataFrame, new_model: DataFrame) -> DataFrame:
    """The registry with one more model; a new challenger takes the place of its type's old one."""
    new = promotion(registry, new_model)
    taken = new.where(F.col("challenger") == 1).select("model_type").distinct()
    kept = registry.join(taken.withColumn("__taken", F.lit(True)), "model_type", "left").withColumn(
        "challenger", F.when(F.col("__taken"), F.lit(0)).otherwise(F.col("challenger"))
    )
    return kept.unionByName(new, allowMissingColumns=True).select(*K.REGISTRY_COLUMNS)


def next_version_numbers(registry: DataFrame, base_names: DataFrame) -> DataFrame:
    """For each ``base_name`` the next ``<base>_v<n>``, n counting its versions so far."""
    used = (
        registry.withColumn("base_name", F.regexp_extract("model_version", r"^(.*)_v[^_]*$", 1))
        .groupBy("base_name")
        .agg(F.count(F.lit(1)).alias("versions"))
    )
    number = F.coalesce(F.col("versions"), F.lit(0)) + 1
    return base_names.join(used, "base_name", "left").select(
        "base_name",
        number.alias("next_number"),
        F.concat("base_name", F.lit("_v"), number.cast("string")).alias("model_version"),
    )


def selection_by_type(registry: DataFrame) -> DataFrame:
    """The model each type would score with: its champion, else its challenger, and why not."""
    flags = registry.groupBy("model_type").agg(
        F.count_if(F.col("champion") == 1).alias("champions"),
        F.count_if(F.col("challenger") == 1).alias("challengers"),
        F.min(F.when(F.col("champion") == 1, F.col("model_version"))).alias("champion"),
        F.min(F.when(F.col("challenger") == 1, F.col("model_version"))).alias("challenger"),
    )
    source = (
        F.when(F.col("champions") > 1, "more than one champion")
        .when(F.col("champions") == 1, "champion")
        .when(F.col("challengers") > 1, "more than one challenger")
        .when(F.col("challengers") == 1, "challenger")
        .otherwise("none")
    )
    version = F.when(source == "champion", F.col("champion")).when(
        source == "challenger", F.col("challenger")
    )
    return flags.select(
        "model_type", source.alias("selection_source"), version.alias("model_version")
    )


def selected_model(
    registry: DataFrame, model_version: str | None = None, model_type: str | None = None
) -> str:
    """The one version to score with; raises if it is unknown or not unique.

    Registry rows are models, and at most two of them are fetched.
    """
    if model_version:
        rows = registry.where(F.col("model_version") == model_version).limit(1).collect()
        if not rows:
            raise LookupError(f"model not registered: {model_version}")
        if model_type and rows[0]["model_type"] != model_type:
            raise ValueError(f"model {model_version} is not of type {model_type}")
        return model_version
    pool = registry.where(F.col("model_type") == model_type) if model_type else registry
    for role in ("champion", "challenger"):
        rows = pool.where(F.col(role) == 1).select("model_version").limit(2).collect()
        if len(rows) > 1:
            raise ValueError(f"more than one {role} registered")
        if rows:
            return rows[0]["model_version"]
    raise LookupError(f"no champion or challenger registered for type {model_type or 'any'}")


def training_cadence(registry: DataFrame, run_date: Column) -> DataFrame:
    """Latest training date, months since, and whether the next training is due."""
    latest = F.max(F.col("train_date").try_cast("date")).alias("last_train_date")
    since = months_apart(F.col("last_train_date"), run_date)
    return registry.agg(latest).select(
        "last_train_date",
        since.alias("months_since"),
        F.coalesce(since >= K.TRAINING_INTERVAL_MONTHS, F.lit(True)).alias("training_due"),
    )


def retrain_decisions(monitoring: DataFrame, snapshot: str | Column) -> DataFrame:
    """Per known model type: whether any monitored model asked for retraining at this snapshot.

    A type that was not monitored has a row too, and asks for nothing.
    """
    day = F.lit(snapshot) if isinstance(snapshot, str) else snapshot
    asked = (
        monitoring.where(F.col(K.SNAPSHOT) == day)
        .groupBy("model_type")
        .agg(F.bool_or("retrain_required").alias("asked"))
    )
    types = monitoring.sparkSession.createDataFrame([(t,) for t in K.MODEL_TYPES], "model_type string")
    return types.join(asked, "model_type", "left").select(
        "model_type", F.coalesce("asked", F.lit(False)).alias("retrain_required")
    )
