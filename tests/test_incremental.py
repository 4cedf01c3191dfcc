from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.operators.incremental import changed_groups, content_state, summed_state
from creditloom.plans import backfill, incremental
from creditloom.sources import tables
from tests.test_lake import sources  # noqa: F401

MONTHS = ["2023-07-01", "2023-08-01", "2023-09-01"]


def times(lake):
    """Path and time of every file of the built layers."""
    files = [p for layer in ("silver", "gold") for p in Path(lake, layer).rglob("*.parquet")]
    return {str(p): p.stat().st_mtime_ns for p in files}


def touched(before, after):
    """``layer/table/month`` of files that came, went or changed."""
    paths = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    return {"/".join(Path(p).parts[-4:-1]) for p in paths}


def partitions(names, month):
    return {f"{name}/{K.SNAPSHOT}={month}" for name in names}


def built(pending):
    return {(row[0], str(row[1]), row[2]) for row in pending.collect()}


@pytest.fixture(scope="module")
def lake(spark, sources, tmp_path_factory):  # noqa: F811
    root = str(tmp_path_factory.mktemp("monthly"))
    for month in MONTHS:
        incremental.run_month(spark, sources, root, month)
    return root


def test_month_by_month_equals_one_backfill(spark, lake, sources, tmp_path):  # noqa: F811
    backfill.backfill(spark, sources, str(tmp_path), MONTHS[0], MONTHS[-1])
    for name in ("silver/loan_daily", "silver/financials", "gold/label_store", "gold/feature_store"):
        one, other = (spark.read.parquet(f"{root}/{name}") for root in (str(tmp_path), lake))
        assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0


def test_a_run_without_changes_writes_nothing(spark, lake):
    before = times(lake)
    assert incremental.refresh(spark, lake).count() == 0
    assert times(lake) == before


def test_landing_the_same_rows_again_builds_nothing(spark, lake, sources):  # noqa: F811
    before = times(lake)
    assert incremental.run_month(spark, sources, lake, MONTHS[1]).count() == 0
    assert times(lake) == before
    known = spark.read.parquet(f"{lake}/manifest")
    listed = tables.listed_files(spark, f"{lake}/bronze/loan_daily")
    own = known.where("source = 'loan_daily'")
    assert own.join(listed, ["path", "size", "modified"], "left_semi").count() == listed.count() == own.count()


def test_a_changed_month_of_loans_touches_its_partitions_only(spark, lake):
    before = times(lake)
    rows = tables.of_snapshots(spark.read.parquet(f"{lake}/bronze/loan_daily"), [MONTHS[1]])
    changed = rows.withColumn("overdue_amt", F.lit("150")).checkpoint()
    tables.write_snapshots(changed, f"{lake}/bronze/loan_daily")
    assert built(incremental.refresh(spark, lake)) == {("loan_daily", MONTHS[1], "changed")}
    assert touched(before, times(lake)) == partitions(["silver/loan_daily", "gold/label_store"], MONTHS[1])
    labels = tables.of_snapshots(spark.read.parquet(f"{lake}/gold/label_store"), [MONTHS[1]])
    assert {row[0] for row in labels.select("label").distinct().collect()} == {1}


def test_a_changed_month_of_a_feature_source(spark, lake):
    before = times(lake)
    rows = tables.of_snapshots(spark.read.parquet(f"{lake}/bronze/attributes"), [MONTHS[2]])
    tables.write_snapshots(rows.withColumn("Age", F.lit("33_")).checkpoint(), f"{lake}/bronze/attributes")
    assert built(incremental.refresh(spark, lake)) == {("attributes", MONTHS[2], "changed")}
    assert touched(before, times(lake)) == partitions(["silver/attributes", "gold/feature_store"], MONTHS[2])


def test_labels_that_no_row_reaches_any_more_go(spark, lake):
    rows = tables.of_snapshots(spark.read.parquet(f"{lake}/bronze/loan_daily"), [MONTHS[2]])
    early = rows.withColumn("installment_num", F.lit("1")).checkpoint()
    tables.write_snapshots(early, f"{lake}/bronze/loan_daily")
    incremental.refresh(spark, lake)
    labels = spark.read.parquet(f"{lake}/gold/label_store")
    assert {str(row[0]) for row in labels.select(K.SNAPSHOT).distinct().collect()} == set(MONTHS[:2])
    assert tables.of_snapshots(spark.read.parquet(f"{lake}/silver/loan_daily"), [MONTHS[2]]).count() > 0


def test_a_month_that_is_gone_goes_from_all_layers(spark, lake):
    tables.drop_partitions(spark, f"{lake}/bronze/loan_daily", [{K.SNAPSHOT: MONTHS[0]}])
    assert built(incremental.refresh(spark, lake)) == {("loan_daily", MONTHS[0], "gone")}
    for name in ("silver/loan_daily", "gold/label_store"):
        assert tables.of_snapshots(spark.read.parquet(f"{lake}/{name}"), [MONTHS[0]]).count() == 0
    assert incremental.refresh(spark, lake).count() == 0


def test_months_are_read_by_partition(spark, lake):
    read = tables.of_snapshots(spark.read.parquet(f"{lake}/bronze/loan_daily"), [MONTHS[1]])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan or "PartitionFilters: [(snapshot_date" in plan
    assert {Path(f).parts[-2] for f in read.inputFiles()} >= {f"{K.SNAPSHOT}={MONTHS[1]}"}


def test_a_failed_build_is_done_again(spark, lake, monkeypatch):
    rows = tables.of_snapshots(spark.read.parquet(f"{lake}/bronze/financials"), [MONTHS[1]])
    tables.write_snapshots(rows.withColumn("Annual_Income", F.lit("1")).checkpoint(), f"{lake}/bronze/financials")

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(backfill, "build_gold", fails)
        with pytest.raises(RuntimeError):
            incremental.refresh(spark, lake)
    assert built(incremental.refresh(spark, lake)) == {("financials", MONTHS[1], "changed")}


def test_states_see_nulls_repeats_and_add_up(spark):
    schema = "m int, a string, b string"
    one = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, "y", "z"), (3, None, None)], schema)
    same = spark.createDataFrame([(3, None, None), (2, "y", "z"), (1, "x", None), (1, "x", None)], schema)
    other = spark.createDataFrame([(1, None, "x"), (1, "x", None), (2, "y", "z"), (4, None, None)], schema)
    state = content_state(one, ["m"])
    assert changed_groups(state, content_state(same, ["m"]), ["m"]).count() == 0
    found = changed_groups(state, content_state(other, ["m"]), ["m"]).collect()
    assert {tuple(row) for row in found} == {(1, "changed"), (3, "gone"), (4, "new")}
    parts = content_state(one.withColumn("part", F.monotonically_increasing_id()), ["m", "part"])
    assert changed_groups(state, summed_state(parts, ["m"]), ["m"]).count() == 0
    assert content_state(one.where("false"), ["m"]).count() == 0
