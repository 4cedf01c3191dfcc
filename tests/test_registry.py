from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.operators import registry as R
from creditloom.plans.training import REGISTRY_SCHEMA
from creditloom.sources import revisions

ARTIFACT = "model_version string, model_type string, file_stem string, auc_oot double, auc_test double, auc_train double"


def artifacts(spark, rows):
    return spark.createDataFrame([(v, t, v, o, te, tr) for v, t, o, te, tr in rows], ARTIFACT)


def log(spark, rows):
    return spark.createDataFrame(rows, "model_version string, model_type string, champion int")


def flags(df):
    return {r["model_version"]: (r["champion"], r["challenger"]) for r in df.collect()}


MODELS = [("a", "t", 0.7, 0.7, 0.7), ("b", "t", 0.8, 0.6, 0.7), ("c", "t", 0.8, 0.6, 0.7)]


def test_best_becomes_champion(spark):
    got = flags(R.reconciled(artifacts(spark, MODELS), log(spark, []).limit(0)))
    assert got == {"a": (0, 0), "b": (1, 0), "c": (0, 1)}


def test_single_valid_old_champion_stays(spark):
    got = flags(R.reconciled(artifacts(spark, MODELS), log(spark, [("a", "t", 1), ("gone", "t", 1)])))
    assert got == {"a": (1, 0), "b": (0, 1), "c": (0, 0)}


def test_two_old_champions_are_dropped(spark):
    got = flags(R.reconciled(artifacts(spark, MODELS), log(spark, [("a", "t", 1), ("c", "t", 1)])))
    assert got == {"a": (0, 0), "b": (1, 0), "c": (0, 1)}


def test_invalid_artifacts(spark):
    rows = [("x", "t", "y", 0.7, 0.7, 0.7), ("", "t", "", 0.7, 0.7, 0.7), ("z", "t", "z", None, 0.7, 0.7), ("ok", "t", "ok", 0.1, 0.1, 0.1)]
    got = R.valid_artifacts(spark.createDataFrame(rows, ARTIFACT))
    assert [r["model_version"] for r in got.collect()] == ["ok"]


def registry_of(spark, rows):
    df = spark.createDataFrame(
        rows, "model_version string, model_type string, auc_test double, auc_oot double, champion int, challenger int"
    )
    missing = {n: F.lit(None).cast(k) for n, k in K.REGISTRY_COLUMNS.items() if n not in df.columns}
    return df.withColumns(missing).select(*K.REGISTRY_COLUMNS)


def test_registration(spark):
    now = registry_of(spark, [("a", "t", 0.7, 0.7, 1, 0), ("b", "t", 0.6, 0.6, 0, 1), ("o", "u", 0.9, 0.9, 1, 0)])
    better = R.registered(now, registry_of(spark, [("n", "t", 0.8, 0.8, 0, 0)]))
    assert flags(better) == {"a": (1, 0), "b": (0, 0), "o": (1, 0), "n": (0, 1)}
    half = R.registered(now, registry_of(spark, [("n", "t", 0.8, 0.7, 0, 0)]))
    assert flags(half) == {"a": (1, 0), "b": (0, 1), "o": (1, 0), "n": (0, 0)}
    first = R.registered(now, registry_of(spark, [("n", "new", 0.1, 0.1, 0, 0)]))
    assert flags(first)["n"] == (1, 0)


def test_selection(spark):
    now = registry_of(spark, [("a", "t", 0.7, 0.7, 1, 0), ("b", "t", 0.6, 0.6, 0, 1), ("c", "u", 0.6, 0.6, 0, 1)])
    assert R.selected_model(now, model_type="t") == "a"
    assert R.selected_model(now, model_type="u") == "c"
    assert R.selected_model(now, "b") == "b"
    with pytest.raises(ValueError):
        R.selected_model(now, "b", "u")
    with pytest.raises(LookupError):
        R.selected_model(now, "nobody")
    two = now.withColumn("champion", F.lit(1))
    with pytest.raises(ValueError, match="more than one champion"):
        R.selected_model(two, model_type="t")


def test_cadence_with_empty_registry(spark):
    empty = revisions.read_revision(spark, "/tmp/creditloom-no-such-table", REGISTRY_SCHEMA)
    row = R.training_cadence(empty, F.lit("2024-09-01").cast("date")).first()
    assert row["training_due"] and row["last_train_date"] is None


def test_revisions(spark, tmp_path):
    path = str(tmp_path / "registry")
    one = registry_of(spark, [("a", "t", 0.7, 0.7, 1, 0)])
    revisions.save_revision(one, path)
    revisions.save_revision(one.withColumn("model_version", F.lit("b")), path)
    got = revisions.read_revision(spark, path, REGISTRY_SCHEMA)
    assert [r["model_version"] for r in got.collect()] == ["b"]
    assert got.columns == list(K.REGISTRY_COLUMNS)


def test_rejected_artifacts_name_every_failed_rule(spark):
    rows = [
        ("a", "t", "a", 0.7, 0.7, 0.7), ("", "t", "b", 0.7, 0.7, 0.7), (None, "t", "c", None, 0.7, 0.7),
        ("d", None, "e", 0.7, float("nan"), None), ("f", "t", None, 0.7, 0.7, 0.7), (" g ", "t", "g", 0.7, 0.7, 0.7),
    ]
    df = spark.createDataFrame(rows, ARTIFACT)
    got = {(r.model_version, r.file_stem): r.reason for r in R.rejected_artifacts(df).collect()}
    assert got == {
        ("", "b"): "no version",
        (None, "c"): "no version; no auc_oot",
        ("d", "e"): "version is not the file's name; no auc_test; no auc_train",
        ("f", None): "version is not the file's name",
    }
    # Every artifact is either a model or rejected.
    assert R.valid_artifacts(df).count() + len(got) == len(rows)


def test_a_monitored_model_that_is_gone_from_the_registry_still_asks(spark):
    version = f"{K.MODEL_PREFIX}{K.LOG_REG}_2024_09_01_v1"
    day = F.lit("2024-10-01").cast("date")
    history = spark.createDataFrame([(version, True), ("unknown", True)], "model_version string, retrain_required boolean")
    history = history.withColumn(K.SNAPSHOT, day)
    typed = R.typed_history(history, spark.createDataFrame([], REGISTRY_SCHEMA))
    asked = {r["model_type"]: r["retrain_required"] for r in R.retrain_decisions(typed, day).collect()}
    assert asked == {K.LOG_REG: True, K.BOOSTED_TREES: False}
    log = spark.createDataFrame([("unknown", K.BOOSTED_TREES)], "model_version string, model_type string")
    typed = R.typed_history(history, log)
    assert {r["model_version"]: r["model_type"] for r in typed.collect()} == {version: K.LOG_REG, "unknown": K.BOOSTED_TREES}
