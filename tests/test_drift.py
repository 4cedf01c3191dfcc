from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.operators import drift, history, selection
from creditloom.plans import monitoring


def index(spark, expected, actual):
    def counts(side):
        rows = [("f", b, n) for b, n in side.items()]
        return spark.createDataFrame(rows, "feature_name string, bucket string, row_count long")

    row = drift.stability_index(counts(expected), counts(actual)).first()
    return row["csi"], row["bucket_count"]


def by_hand(expected, actual):
    total = 0.0
    for bucket in set(expected) | set(actual):
        e = max(expected.get(bucket, 0) / max(sum(expected.values()), 1e-6), 1e-6)
        a = max(actual.get(bucket, 0) / max(sum(actual.values()), 1e-6), 1e-6)
        total += (a - e) * math.log(a / e)
    return total


@pytest.mark.parametrize(
    "expected, actual",
    [
        ({"a": 5, "b": 5}, {"a": 5, "b": 5}),
        ({"a": 50, "b": 50}, {"a": 50, "b": 50, "c": 0}),
        ({"a": 50, "b": 50}, {"a": 10, "c": 90}),
        ({"a": 50, "b": 50}, {}),
    ],
)
def test_stability_index(spark, expected, actual):
    value, buckets = index(spark, expected, actual)
    assert value == pytest.approx(by_hand(expected, actual), abs=1e-12)
    assert value >= 0 and math.isfinite(value)
    assert buckets == len(set(expected) | set(actual))


def test_same_population_has_no_drift(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    buckets = drift.fit_buckets(orders, ["o_totalprice"], ["o_orderpriority"])
    table = drift.drift_table(orders, orders, buckets, ["o_totalprice", "o_orderpriority"])
    assert [row["csi"] for row in table.collect()] == [0.0, 0.0]
    counted = drift.bucket_counts(orders, buckets, ["o_totalprice", "o_orderpriority"])
    assert counted.agg(F.sum("row_count")).first()[0] == 2 * orders.count()


def test_constant_reference_is_all_missing(spark):
    reference = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    current = spark.createDataFrame([(9.0,), (None,)], "v double")
    buckets = drift.fit_buckets(reference, ["v"])
    row = drift.drift_table(reference, current, buckets, ["v"]).first()
    assert (row["csi"], row["bucket_count"]) == (0.0, 1)
    assert {r["bucket"] for r in drift.bucket_counts(current, buckets, ["v"]).collect()} == {K.MISSING}


def test_inner_edge_belongs_to_the_lower_bucket(spark):
    reference = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    buckets = drift.fit_buckets(reference, ["v"], bins=2)
    assert buckets.edges["v"] == [3.0]
    got = {r["bucket"]: r["row_count"] for r in drift.bucket_counts(reference, buckets, ["v"]).collect()}
    assert got == {"0": 3, "1": 2}


def test_categories(spark):
    reference = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)], "v string")
    current = spark.createDataFrame([("a",), (None,), ("zzz",), ("c",)], "v string")
    buckets = drift.fit_buckets(reference, [], ["v"], top_n=2)
    got = {r["bucket"]: r["row_count"] for r in drift.bucket_counts(current, buckets, ["v"]).collect()}
    assert got == {"a": 1, K.OTHER: 3}
    with_null = drift.fit_buckets(reference.union(current), [], ["v"], top_n=1)
    assert with_null.levels["v"] == ["a", K.MISSING]


def test_worst_feature(spark):
    rows = [("x", 0.2), ("b", 0.5), ("a", 0.5)]
    table = spark.createDataFrame(rows, "feature_name string, csi double")
    assert tuple(drift.worst_feature(table).first()) == (0.5, "a")
    assert tuple(drift.worst_feature(table.limit(0)).first()) == (0.0, "")


def test_trend(spark):
    rows = [("m", "2024-01-01", 0.0), ("m", "2024-02-01", 0.1), ("m", "2024-03-01", 0.1), ("m", "2024-04-01", 0.05)]
    got = drift.drift_trend(
        spark.createDataFrame(rows, "model_version string, snapshot_date string, psi_score double")
    ).orderBy("snapshot_date").collect()
    assert [r["psi_trend"] for r in got] == ["first snapshot", "increased", "flat", "decreased"]
    assert got[1]["psi_change_pct"] is None and got[3]["psi_change_pct"] == pytest.approx(-0.5)


def test_report_over_several_snapshots_equals_one_by_one(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.trunc("o_orderdate", "year").alias("snapshot_date"),
        (F.col("o_totalprice") / 600000).alias(K.SCORE_FEATURE),
        "o_totalprice",
        "o_orderstatus",
    )
    reference = orders.where("year(snapshot_date) < 1998")
    features = ["o_totalprice", "o_orderstatus"]
    both = monitoring.drift_report(reference, orders.where("year(snapshot_date) >= 2000"), features)
    detail = {(r["snapshot_date"], r["feature_name"]): r["csi"] for r in both.collect()}
    for year in (2000, 2001):
        one = monitoring.drift_report(reference, orders.where(f"year(snapshot_date) = {year}"), features)
        for r in one.collect():
            assert detail.pop((r["snapshot_date"], r["feature_name"])) == pytest.approx(r["csi"])
    assert not detail
    summary = monitoring.monitoring_summary(
        both, "m", {"feature_start_date": "1995-01-01", "feature_end_date": "1997-12-31"}
    )
    assert summary.count() == 2 and summary.columns == monitoring.SUMMARY_COLUMNS
    without = monitoring.monitoring_summary(
        selection.score_rows(both), "m", {"feature_start_date": "x", "feature_end_date": "y"}
    ).first()
    assert (without["max_csi"], without["max_csi_feature"]) == (0.0, "")


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("m", "d1", 1), ("m", "d2", 2)], "k string, d string, v int")
    new = spark.createDataFrame([("m", "d2", 9), ("n", "d1", 3)], "k string, d string, v int")
    once = history.upserted(old, new, ["k", "d"])
    twice = history.upserted(once, new, ["k", "d"])
    want = {("m", "d1", 1), ("m", "d2", 9), ("n", "d1", 3)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}
