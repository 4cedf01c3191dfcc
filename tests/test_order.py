"""Exact order statistics against numpy and pandas."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.operators import ordering, quantiles, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold more than a third of the rows."""
    rng = np.random.default_rng(7)
    n = 5000
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.6, "big", rng.choice(["a", "b"], n)),
            "v": np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(0, 50, n), 1)),
            "w": rng.lognormal(0, 3, n),
            "key": [f"k{i}" for i in range(n)],
        }
    )
    df = spark.createDataFrame(pdf).repartition(7)
    return df, pdf


def test_column_quantiles(skewed):
    df, pdf = skewed
    got = quantiles.column_quantiles(
        df,
        {"v": F.col("v"), "w": F.col("w"), "none": F.lit(None).cast("double")},
        quantiles.even_fractions(10),
    )
    for name in ("v", "w"):
        np.testing.assert_allclose(got[name], np.quantile(pdf[name], np.linspace(0, 1, 11)), rtol=1e-12)
    assert got["none"] is None


def test_column_quantiles_do_not_need_a_good_sketch(skewed, monkeypatch):
    df, pdf = skewed
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 4)
    got = quantiles.column_quantiles(df, {"w": F.col("w")}, [Fraction(1, 100), Fraction(99, 100)])
    np.testing.assert_allclose(got["w"], np.quantile(pdf["w"], [0.01, 0.99]), rtol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.just(float("nan"))), min_size=1, max_size=30))
def test_column_quantiles_property(spark, numbers):
    df = spark.createDataFrame([(x,) for x in numbers], "v double")
    got = quantiles.column_quantiles(df, {"v": F.col("v")}, quantiles.even_fractions(4))["v"]
    kept = [x for x in numbers if x is not None and x == x]
    if not kept:
        assert got is None
    else:
        np.testing.assert_allclose(got, np.quantile(kept, np.linspace(0, 1, 5)), rtol=1e-9, atol=1e-9)


def test_group_quantiles(skewed):
    df, pdf = skewed
    got = quantiles.group_quantiles(
        df, ["g"], F.col("v"), {"q1": Fraction(1, 4), "q2": Fraction(1, 2)}
    ).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile([0.25, 0.5]).unstack()
    np.testing.assert_allclose(got[["q1", "q2"]].to_numpy(), want.to_numpy())


def test_row_number(skewed):
    df, pdf = skewed
    got = ordering.with_row_number(df, ["g"], ["v", "key"], "n").toPandas()
    got = got.sort_values(["g", "v", "key"])
    assert len(got) == len(pdf)
    assert (got.groupby("g").cumcount() + 1 == got["n"]).all()


def test_row_number_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, v int")
    got = {tuple(r) for r in ordering.with_row_number(df, ["g"], ["v"], "n").collect()}
    assert got == {(None, 1, 1), (None, 2, 2), ("a", 1, 1)}


def test_running_totals(skewed):
    df, pdf = skewed
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("rows"))
    got = ordering.with_running_totals(counts, ["g"], "v", ["rows"]).toPandas()
    got = got.sort_values(["g", "v"])
    assert (got.groupby("g")["rows"].cumsum() - got["rows"] == got["rows_before"]).all()
    assert (got.groupby("g")["rows"].transform("sum") == got["rows_total"]).all()


def test_stratified_holdout(skewed):
    df, pdf = skewed
    split = sampling.with_stratified_holdout(df.select("g", "key"), "g", ["key"])
    got = split.toPandas()
    assert len(got) == len(pdf)
    sizes = got.groupby("g")["holdout"].agg(["sum", "size"])
    assert (sizes["sum"] == np.ceil(sizes["size"] * 0.2)).all()
    again = split.repartition(3).toPandas()
    assert set(got[got.holdout].key) == set(again[again.holdout].key)


def test_bootstrap(skewed):
    df, pdf = skewed
    drawn = sampling.bootstrap_sample(df, 1.0, 5)
    assert drawn.count() == len(pdf) and drawn.columns == df.columns
    seen = drawn.select("key").distinct().count() / len(pdf)
    assert abs(seen - (1 - np.exp(-1))) < 0.05
    assert sampling.bootstrap_sample(df, 0.25, 5).count() == int(0.25 * len(pdf) + 0.5)


def test_bootstrap_of_equal_and_of_few_rows(spark):
    equal = spark.createDataFrame([("x",)] * 200 + [(None,)] * 100, "key string")
    drawn = sampling.bootstrap_sample(equal, 1.0, 5).groupBy("key").count().collect()
    counts = {row["key"]: row["count"] for row in drawn}
    assert sum(counts.values()) == 300 and 160 < counts["x"] < 240
    few = sampling.bootstrap_sample(spark.createDataFrame([("a",), ("b",)], "key string"), 1.0, 5, rows=1000)
    counts = {row["key"]: row["count"] for row in few.groupBy("key").count().collect()}
    assert sum(counts.values()) == 1000 and min(counts.values()) > 400
    assert sampling.bootstrap_sample(equal.limit(0), 1.0, 5, rows=10).isEmpty()


def test_bootstrap_repeats_on_any_partitioning(skewed):
    df, _ = skewed
    draws = [
        sorted(r.key for r in sampling.bootstrap_sample(df.repartition(n), 0.7, 5, ["key"]).collect())
        for n in (3, 7)
    ]
    assert draws[0] == draws[1]


def test_numbers_without_order(skewed):
    df, pdf = skewed
    got = ordering.numbered(df, ["g"], "n").toPandas()
    for group, rows in got.groupby("g"):
        assert sorted(rows["n"]) == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("copies", [1, 10])
def test_holdout_of_equal_rows_is_exact(spark, copies):
    rows = [("a", "x")] * 10 * copies + [("b", f"k{i}") for i in range(25)]
    df = spark.createDataFrame(rows, "label string, key string")
    got = sampling.with_stratified_holdout(df, "label", ["key"], "0.2")
    assert got.count() == len(rows) and got.columns == ["label", "key", "holdout"]
    held = {r.label: r["count"] for r in got.where("holdout").groupBy("label").count().collect()}
    assert held == {"a": 2 * copies, "b": 5}


def test_quantile_plan_gathers_no_values(skewed, monkeypatch):
    df, _ = skewed
    plans = []
    for name in ("materialize", "with_running_totals"):
        real = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda d, *a, real=real: plans.append(d) or real(d, *a))
    quantiles.column_quantiles(df, {"v": F.col("v"), "w": F.col("w")}, [Fraction(1, 2)])
    assert len(plans) == 2  # the second reading, and the ordering of the near values
    assert not any("collect_list" in d._jdf.queryExecution().toString() for d in plans)


def test_quantiles_read_the_data_twice(spark, skewed, tmp_path):
    df, pdf = skewed
    df.write.parquet(str(tmp_path / "t"))
    read = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = spark.read.parquet(str(tmp_path / "t")).select("v", "w")
    counted = table.mapInArrow(rows, table.schema)
    quantiles.column_quantiles(counted, {n: F.col(n) for n in ("v", "w")}, quantiles.even_fractions(10))
    assert read.value == 2 * len(pdf)


def test_a_rank_outside_the_near_intervals_is_found_all_the_same(skewed, monkeypatch):
    df, pdf = skewed
    real = quantiles._sketched

    def blind(*args):
        found = real(*args)
        return {name: quantiles.replace(column, near=set()) for name, column in found.items()}

    monkeypatch.setattr(quantiles, "_sketched", blind)
    got = quantiles.column_quantiles(df, {n: F.col(n) for n in ("v", "w")}, quantiles.even_fractions(4))
    for name in ("v", "w"):
        np.testing.assert_allclose(got[name], np.quantile(pdf[name], np.linspace(0, 1, 5)), rtol=1e-12)
