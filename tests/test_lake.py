"""The whole chain on a small lake: land, silver, gold, train, score, monitor, evaluate."""

from __future__ import annotations

import pytest
from pandas.testing import assert_frame_equal
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions.months import month_sequence
from creditloom.operators import evaluation as judged
from creditloom.operators import registry
from creditloom.plans import backfill, evaluation, monitoring, retraining, scoring, training
from creditloom.sources import revisions, tables

ONE_POINT = [{"C": 1.0, "class_weight": None, "max_iter": 500}]
TRAIN_DATE = "2024-09-01"


@pytest.fixture(scope="module")
def sources(spark, sf_dir, tmp_path_factory):
    """Four source CSVs: every customer of the smallest table in each of 24 months."""
    root = tmp_path_factory.mktemp("sources")
    months = month_sequence(F.lit(K.BACKFILL_START).cast("date"), F.lit(K.BACKFILL_END).cast("date"))
    grid = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("Customer_ID"),
        "c_custkey",
        "c_acctbal",
        "c_mktsegment",
        F.explode(months).alias("snapshot_date"),
    )
    chance = F.pmod(F.crc32(F.concat("Customer_ID", F.col("snapshot_date").cast("string"))), F.lit(100))
    risky = chance < F.when(F.col("c_acctbal") < 4500, 60).otherwise(15)
    files = {
        "loan_daily": grid.select(
            F.concat("Customer_ID", F.lit("-"), F.col("snapshot_date").cast("string")).alias("loan_id"),
            "Customer_ID",
            F.add_months("snapshot_date", -6).alias("loan_start_date"),
            F.lit(10).alias("tenure"),
            F.lit(6).alias("installment_num"),
            F.lit(1000).alias("loan_amt"),
            F.lit(100).alias("due_amt"),
            F.lit(100).alias("paid_amt"),
            F.when(risky, 150).otherwise(0).alias("overdue_amt"),
            F.lit(400).alias("balance"),
            "snapshot_date",
        ),
        "attributes": grid.select(
            "Customer_ID",
            F.lit("somebody").alias("Name"),
            F.lit("000").alias("SSN"),
            F.col("c_mktsegment").alias("Occupation"),
            F.concat((F.col("c_custkey") % 80 + 18).cast("string"), F.lit("_")).alias("Age"),
            "snapshot_date",
        ),
        "financials": grid.select(
            "Customer_ID",
            F.concat(F.col("c_acctbal").cast("string"), F.lit("_")).alias("Outstanding_Debt"),
            F.lit("50000_").alias("Annual_Income"),
            F.lit("4000").alias("Monthly_Inhand_Salary"),
            F.lit("400").alias("Total_EMI_per_month"),
            (F.col("c_custkey") % 90).cast("string").alias("Credit_Utilization_Ratio"),
            F.lit("1 Years and 2 Months").alias("Credit_History_Age"),
            "snapshot_date",
        ),
        "clickstream": grid.where("c_custkey % 3 <> 0").select(
            "Customer_ID",
            (F.col("c_custkey") % 7).alias("fe_1"),
            (F.col("c_custkey") % 11).alias("fe_2"),
            "snapshot_date",
        ),
    }
    paths = {}
    for name, df in files.items():
        paths[name] = str(root / name)
        df.coalesce(2).write.option("header", True).csv(paths[name])
    return paths


@pytest.fixture(scope="module")
def lake(spark, sources, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    backfill.require_complete(backfill.backfill(spark, sources, root))
    return root


@pytest.fixture(scope="module")
def models(spark, lake, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    labels = spark.read.parquet(f"{lake}/gold/label_store")
    features = spark.read.parquet(f"{lake}/gold/feature_store")
    version = training.train_model(
        spark, labels, features, TRAIN_DATE, K.LOG_REG, root, ONE_POINT
    )
    return root, version


def test_layers(spark, lake, sources):
    customers = spark.read.option("header", True).csv(sources["attributes"]).count()
    features = spark.read.parquet(f"{lake}/gold/feature_store")
    assert features.count() == customers
    # The fallback gives unmatched customers values while donors last: two of three have one.
    by_month = features.groupBy("snapshot_date").agg(F.count("fe_1").alias("set"), F.count("*").alias("n"))
    assert all(row["n"] > row["set"] > 0 for row in by_month.collect())
    labels = spark.read.parquet(f"{lake}/gold/label_store")
    assert labels.columns[:4] == ["loan_id", "Customer_ID", "label", "label_def"]
    bronze = spark.read.parquet(f"{lake}/bronze/loan_daily")
    assert dict(bronze.dtypes)["due_amt"] == "string"


def test_rerun_replaces_only_its_months(spark, lake, sources):
    before = spark.read.parquet(f"{lake}/bronze/loan_daily").count()
    backfill.land(spark, {"loan_daily": sources["loan_daily"]}, lake, "2023-03-01", "2023-04-01")
    assert spark.read.parquet(f"{lake}/bronze/loan_daily").count() == before


def test_missing_month_is_named(spark, lake):
    status = backfill.lake_status(spark, lake, "2024-11-01", "2025-01-01")
    with pytest.raises(ValueError, match="gold/feature_store 2025-01-01"):
        backfill.require_complete(status)
    with pytest.raises(FileNotFoundError, match="2025-01-01"):
        tables.read_months(spark, f"{lake}/gold/feature_store", "2024-11-15", "2025-01-10")
    with pytest.raises(FileNotFoundError):
        tables.read_snapshot(spark, f"{lake}/gold/feature_store", "2025-02-01")


def test_training_registers_a_champion(spark, models):
    root, version = models
    assert version == "credit_model_log_reg_2024_09_01_v1"
    log = revisions.read_revision(spark, f"{root}/registry", training.REGISTRY_SCHEMA)
    row = log.first()
    assert (row["champion"], row["challenger"]) == (1, 0)
    assert row["auc_test"] > 0.55
    assert 0.01 <= row["prediction_threshold"] <= 0.99
    _, facts = scoring.load_model(spark, root, version)
    assert not set(facts["features"]) & set(K.NON_FEATURES)
    assert facts["windows"]["feature_end_date"] == "2024-02-29"


def test_score_monitor_evaluate(spark, lake, models):
    root, version = models
    named, months = scoring.score_new_months(
        spark, lake, root, model_type=K.LOG_REG, first="2024-03-01", csv_export=True
    )
    assert named == version and len(months) == 10
    assert scoring.score_new_months(spark, lake, root, model_type=K.LOG_REG, first="2024-03-01")[1] == []
    stored = spark.read.parquet(f"{lake}/gold/model_predictions/{version}")
    assert stored.where("model_predictions between 0 and 1").count() == stored.count()

    kept = monitoring.monitor(spark, lake, root, version, ["2024-09-01", "2024-10-01"]).collect()
    again = monitoring.monitor(spark, lake, root, version, ["2024-10-01"]).collect()
    assert len(kept) == 2 and len(again) == 1
    history = spark.read.parquet(f"{lake}/gold/model_monitoring/history")
    assert history.count() == 2
    assert set(monitoring.SUMMARY_COLUMNS) == set(history.columns)
    # The same customers every month: no drift beyond the changing fallback donors.
    assert {row["status"] for row in kept} == {"healthy"}
    detail = spark.read.parquet(f"{lake}/gold/model_monitoring/csi_detail")
    assert monitoring.ordered_detail(detail).first()["feature_name"] == K.SCORE_FEATURE
    assert detail.where("feature_type = 'categorical'").where("categorical_top_n is null").isEmpty()

    summary = evaluation.evaluate(spark, lake, version, "2024-12-01").collect()
    groups = {row["performance_group"]: row for row in summary}
    assert set(groups) == {K.ALL_MATURED, *[f"prediction_2024_{m:02d}_01" for m in (3, 4, 5, 6)]}
    assert groups[K.ALL_MATURED]["row_count"] == sum(
        row["row_count"] for name, row in groups.items() if name != K.ALL_MATURED
    )
    evaluation.evaluate(spark, lake, version, "2024-12-01")
    assert spark.read.parquet(f"{lake}/gold/model_performance/history").count() == len(groups)
    with pytest.raises(ValueError, match="2024-09-01"):
        evaluation.evaluate(spark, lake, version, "2024-08-31")


def test_a_stored_profile_stands_in_for_the_reference(spark, lake, models, monkeypatch):
    root, version = models
    first = monitoring.monitor(spark, lake, root, version, ["2024-11-01"]).drop("created_at").collect()
    detail = spark.read.parquet(f"{lake}/gold/model_monitoring/csi_detail").where("snapshot_date = '2024-11-01'")
    rows = sorted(detail.collect())

    def refuses(*_):
        raise AssertionError("read the reference again")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "read_months", refuses)
        again = monitoring.monitor(spark, lake, root, version, ["2024-11-01"]).drop("created_at").collect()
        assert again == first
        detail = spark.read.parquet(f"{lake}/gold/model_monitoring/csi_detail").where("snapshot_date = '2024-11-01'")
        assert sorted(detail.collect()) == rows
        # Other buckets are another profile, and so are changed reference months.
        with pytest.raises(AssertionError, match="again"):
            monitoring.monitor(spark, lake, root, version, ["2024-11-01"], bins=5)
    model, facts = scoring.load_model(spark, root, version)
    month = facts["windows"]["feature_start_date"]
    path = f"{lake}/gold/drift_profiles/{version}/bins-{K.DEFAULT_BINS}-top-{K.CATEGORICAL_TOP_N}"
    assert revisions.revisions(spark, path) == [1]
    rows = tables.of_snapshots(spark.read.parquet(f"{lake}/gold/feature_store"), [month]).checkpoint()
    tables.write_snapshots(rows, f"{lake}/gold/feature_store")
    assert monitoring.monitor(spark, lake, root, version, ["2024-11-01"]).drop("created_at").collect() == first
    assert revisions.revisions(spark, path) == [1, 2]


def test_a_missing_reference_month_is_named(spark, lake):
    windows = {"feature_start_date": "2022-11-01", "feature_end_date": "2023-02-01"}
    with pytest.raises(FileNotFoundError, match="2022-11-01, 2022-12-01"):
        monitoring.reference_state(spark, f"{lake}/gold/feature_store", windows)


def test_second_model_is_versioned_and_compared(spark, lake, models):
    root, _ = models
    labels = spark.read.parquet(f"{lake}/gold/label_store")
    features = spark.read.parquet(f"{lake}/gold/feature_store")
    second = training.train_model(
        spark, labels, features, TRAIN_DATE, K.LOG_REG, root, ONE_POINT
    )
    assert second.endswith("_v2")
    log = revisions.read_revision(spark, f"{root}/registry", training.REGISTRY_SCHEMA)
    flags = {row["model_version"]: (row["champion"], row["challenger"]) for row in log.collect()}
    assert flags[second] == (0, 0)  # the same model is not better than the champion
    assert registry.selected_model(log, model_type=K.LOG_REG).endswith("_v1")
    with pytest.raises(LookupError):
        registry.selected_model(log, model_type=K.BOOSTED_TREES)
    assert training.reconcile_registry(spark, root).isEmpty()
    log = revisions.read_revision(spark, f"{root}/registry", training.REGISTRY_SCHEMA)
    flags = {row["model_version"]: (row["champion"], row["challenger"]) for row in log.collect()}
    assert flags[second] == (0, 1)  # reconciling makes the best other model challenger
    due = retraining.training_due(spark, root, "2024-11-01").first()
    assert not due["training_due"]
    assert retraining.training_due(spark, root, "2024-12-01").first()["training_due"]
    asked = retraining.retrain_requests(spark, lake, root, "2024-10-01")
    assert {r["model_type"]: r["retrain_required"] for r in asked.collect()} == dict.fromkeys(K.MODEL_TYPES, False)


def test_evaluation_reads_only_changed_months(spark, lake, models, monkeypatch):
    root, version = models
    date, store = "2024-12-01", f"{lake}/gold/label_store"
    scoring.score_new_months(spark, lake, root, model_type=K.LOG_REG, first="2024-03-01")

    def whole():
        """Summary and bands from all rows, without a state."""
        predictions = spark.read.parquet(f"{lake}/gold/model_predictions/{version}")
        scored = evaluation.matured_rows(predictions, spark.read.parquet(store), version, date)
        return judged.performance_summary(scored, date), judged.score_bands(scored)

    def same(got, want, key):
        got, want = (df.toPandas().sort_values(key).reset_index(drop=True) for df in (got, want))
        assert_frame_equal(got[sorted(want.columns)], want[sorted(want.columns)])

    def check():
        summary, bands = whole()
        got = evaluation.evaluate(spark, lake, version, date).drop("created_at")
        same(got, summary.drop("created_at"), "performance_group")
        detail = spark.read.parquet(f"{lake}/gold/model_performance/detail").where(F.col("evaluation_date") == date)
        same(detail.select(*bands.drop("band").columns), bands.drop("band"), "min_score")

    check()
    counts = f"{lake}/gold/performance_state/{version}/counts"
    before = {row["path"]: row["snapshot_date"] for row in tables.listed_files(spark, counts).collect()}
    with monkeypatch.context() as patch:
        patch.setattr(evaluation, "matured_rows", None)  # nothing is counted again
        assert evaluation.refresh_state(spark, lake, version, date) == []
        assert evaluation.evaluate(spark, lake, version, "2024-10-01").count() == 3

    labels = tables.of_snapshots(spark.read.parquet(store), ["2024-10-01"]).checkpoint()
    tables.write_snapshots(labels.withColumn("label", 1 - F.col("label")), store)
    assert evaluation.refresh_state(spark, lake, version, date) == ["2024-04-01"]
    after = {row["path"]: row["snapshot_date"] for row in tables.listed_files(spark, counts).collect()}
    assert {str(day) for path, day in after.items() if path not in before} == {"2024-04-01"}
    check()
    tables.write_snapshots(labels, store)


def test_one_class_cannot_train(spark, lake):
    labels = spark.read.parquet(f"{lake}/gold/label_store").withColumn("label", F.lit(0))
    features = spark.read.parquet(f"{lake}/gold/feature_store")
    with pytest.raises(ValueError, match="both label classes"):
        training.fit_model(labels, features, TRAIN_DATE, K.LOG_REG, ONE_POINT)
