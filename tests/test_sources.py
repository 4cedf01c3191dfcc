from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from creditloom.operators import quality, selection, temporal
from creditloom.operators.gold import with_distribution_fallback
from creditloom.sources import tables


def months(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, d string").select(
        "k", "v", F.col("d").cast("date").alias("snapshot_date")
    )


def content(spark, path):
    return {(r["k"], r["v"], str(r["snapshot_date"])) for r in spark.read.parquet(path).collect()}


JAN, FEB = "2024-01-01", "2024-02-01"


def test_overwrite_is_per_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_snapshots(months(spark, [("a", 1, JAN), ("b", 2, FEB)]), path)
    tables.write_snapshots(months(spark, [("c", 3, FEB)]), path, csv_path=str(tmp_path / "csv"))
    assert content(spark, path) == {("a", 1, JAN), ("c", 3, FEB)}
    exported = tables.read_csv(spark, str(tmp_path / "csv")).collect()
    assert [(r["k"], r["v"]) for r in exported] == [("c", "3")]


def test_write_if_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_snapshots(months(spark, [("a", 1, JAN)]), path)
    both = months(spark, [("x", 9, JAN), ("b", 2, FEB)])
    tables.write_missing_snapshots(both, path)
    assert content(spark, path) == {("a", 1, JAN), ("b", 2, FEB)}
    tables.write_missing_snapshots(both, path, overwrite=True)
    assert content(spark, path) == {("x", 9, JAN), ("b", 2, FEB)}


def test_upsert_table(spark, tmp_path):
    path = str(tmp_path / "h")
    keys = ["k", "snapshot_date"]
    tables.upsert(months(spark, [("a", 1, JAN), ("b", 1, JAN), ("a", 1, FEB)]), path, keys, ["snapshot_date"])
    change = months(spark, [("a", 5, JAN), ("c", 7, JAN)])
    for _ in range(2):
        tables.upsert(change, path, keys, ["snapshot_date"])
    assert content(spark, path) == {("a", 5, JAN), ("b", 1, JAN), ("c", 7, JAN), ("a", 1, FEB)}


def test_snapshot_readers(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_snapshots(months(spark, [("a", 1, JAN), ("b", 2, "2024-03-01")]), path)
    assert tables.read_snapshot(spark, path, JAN).count() == 1
    with pytest.raises(FileNotFoundError, match="2024-02-01"):
        tables.read_months(spark, path, JAN, "2024-03-31")
    assert tables.read_months(spark, path, JAN, "2024-01-31").count() == 1
    empty = tables.read_labels_between(spark, path, "2025-01-01", "2025-02-01")
    assert empty.isEmpty() and "v" in empty.columns
    named = tables.read_with_file_name(spark, path).first()["source_file"]
    assert named.endswith(".parquet")
    plan = tables.read_snapshot(spark, path, JAN)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_raw_snapshots_are_text(spark, tmp_path):
    path = str(tmp_path / "raw")
    months(spark, [("a", 1, JAN), ("b", 2, FEB)]).write.option("header", True).csv(path)
    raw = tables.read_raw_snapshots(spark, path, [FEB])
    assert [(r["k"], r["v"]) for r in raw.collect()] == [("b", "2")]


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="missing columns"):
        selection.require_columns(df, ["a", "b"], "t")


def test_maturity_boundary(spark):
    df = spark.createDataFrame([("c", "2024-09-01", 0.7)], "Customer_ID string, snapshot_date string, model_predictions double")
    due = temporal.maturing_predictions(df, "m")
    assert due.first()["predicted_label"] == 1 and due.first()["prediction_threshold"] == 0.5
    assert temporal.matured(due, "2025-03-01").count() == 1
    assert temporal.matured(due, "2025-02-28").count() == 0


def test_labels_collapse_to_any_default(spark):
    rows = [("c", JAN, 0), ("c", JAN, 1), (None, JAN, 1)]
    labels = spark.createDataFrame(rows, "Customer_ID string, snapshot_date string, label int")
    got = temporal.customer_month_labels(labels).collect()
    assert [(r["Customer_ID"], r["actual_label"]) for r in got] == [("c", 1)]


def test_fallback_pairs_each_donor_once(spark):
    keys = "Customer_ID string, snapshot_date string"
    attributes = spark.createDataFrame([(f"c{i}", JAN) for i in range(1, 6)], keys)
    donors = [("c2", JAN, 2.0), ("c4", JAN, 4.0), ("z", JAN, 9.0)]
    clicks = spark.createDataFrame(donors, f"{keys}, fe_1 double")
    gold = attributes.join(clicks, ["Customer_ID", "snapshot_date"], "left")
    got = {r["Customer_ID"]: r["fe_1"] for r in with_distribution_fallback(gold, attributes, clicks).collect()}
    assert (got["c2"], got["c4"], got["c5"]) == (2.0, 4.0, None)
    assert {got["c1"], got["c3"]} <= {2.0, 4.0, 9.0} and got["c1"] != got["c3"]
    full = spark.createDataFrame([(f"c{i}", JAN, None if i == 1 else 1.0) for i in range(1, 6)], f"{keys}, fe_1 double")
    gold = attributes.join(full, ["Customer_ID", "snapshot_date"], "left")
    kept = {r["Customer_ID"]: r["fe_1"] for r in with_distribution_fallback(gold, attributes, full).collect()}
    assert kept["c1"] is None and kept["c5"] == 1.0  # every customer matches: nothing is filled


def test_coverage_counts_join_rows(spark):
    left = months(spark, [("a", 1, JAN), ("b", 1, JAN)]).withColumnRenamed("k", "Customer_ID")
    right = months(spark, [("a", 1, JAN), ("a", 2, JAN)]).withColumnRenamed("k", "Customer_ID")
    row = quality.join_coverage(left, {"x": right, "none": right.limit(0)}).first()
    assert (row["total_rows"], row["x_matched"], row["x_no_overlap"]) == (2, 2, False)
    assert (row["none_matched"], row["none_no_overlap"]) == (0, True)


def test_table_else_export_else_empty(spark, tmp_path):
    path, csv_path = str(tmp_path / "t"), str(tmp_path / "csv")
    schema = "k string, v int, snapshot_date date"
    assert tables.read_table_or_csv(spark, path, csv_path, schema).isEmpty()
    months(spark, [("a", 1, JAN)]).write.option("header", True).csv(csv_path)
    assert tables.read_table_or_csv(spark, path, csv_path, schema).first()["v"] == 1
    tables.write_snapshots(months(spark, [("b", 2, FEB)]), path)
    assert tables.read_table_or_csv(spark, path, csv_path, schema).first()["k"] == "b"
