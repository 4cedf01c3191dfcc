"""Edge rows for the column expressions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from creditloom.functions import cleaning, months, ratios, scores
from creditloom.operators import gold, silver


def values(spark, rows, schema, column):
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def one(spark, texts, column):
    return values(spark, list(enumerate(texts)), "v string", column(F.col("v")))


LOAN = "loan_id string, Customer_ID string, loan_start_date string, tenure string, installment_num string, loan_amt string, due_amt string, paid_amt string, overdue_amt string, balance string, snapshot_date string"


def loan(due, overdue, snapshot, number="6", balance="1"):
    return ("l", "c", "2022-01-01", "10", number, "1000", due, "0", overdue, balance, snapshot)


@pytest.mark.parametrize(
    "due, overdue, snapshot, missed, first, dpd, label",
    [
        ("100", "0", "2023-05-01", 0, None, 0, 0),
        ("100", "150", "2023-05-01", 2, dt.date(2023, 3, 1), 61, 1),
        ("100", "100", "2023-03-01", 1, dt.date(2023, 2, 1), 28, 0),
        ("100", "100", "2023-05-01", 1, dt.date(2023, 4, 1), 30, 1),
        ("0", "50", "2023-05-01", 0, None, None, 0),
        ("100", None, "2023-05-01", 0, None, 0, 0),
        ("n/a", "50", "2023-05-01", 0, None, None, 0),
    ],
)
def test_days_past_due(spark, due, overdue, snapshot, missed, first, dpd, label):
    loans = silver.silver_loans(spark.createDataFrame([loan(due, overdue, snapshot)], LOAN))
    row = loans.first()
    assert (row["installments_missed"], row["first_missed_date"], row["dpd"]) == (missed, first, dpd)
    assert gold.gold_labels(loans).first()["label"] == label
    assert gold.gold_labels(loans).first()["label_def"] == "30dpd_6mob"


def test_numeric_nulls_become_zero_and_dates_stay(spark):
    row = silver.silver_loans(
        spark.createDataFrame([loan("10", "0", "2023-05-01", None, "?")], LOAN)
    ).first()
    assert (row["mob"], row["installment_num"], row["balance"]) == (0, 0, 0.0)


def test_dirty_numbers(spark):
    texts = ["50000_", "_42_", "abc", "28.5", "", None, "NaN", "1e400", "99999999999"]
    ints = one(spark, texts, cleaning.repaired_int)
    assert ints == [50000, 42, None, 28, None, None, None, None, None]
    floats = one(spark, texts, cleaning.repaired_float)
    assert floats[:5] == [50000.0, 42.0, None, 28.5, None] and floats[6] is None


def test_ranges(spark):
    ages = spark.createDataFrame(
        [("c", a, "2024-01-01") for a in ("-1", "0", "100", "101", "x_")],
        "Customer_ID string, Age string, snapshot_date string",
    )
    cleaned = {r["Age"] for r in silver.silver_attributes(ages).collect()}
    assert cleaned == {None, 0, 100}
    rows = [("15", "16", "100", "__-333333__"), ("16", "15", "101", "5")]
    money = spark.createDataFrame(
        rows, "Num_Bank_Accounts string, Num_Credit_Card string, Interest_Rate string, Monthly_Balance string"
    )
    got = {tuple(r) for r in silver.silver_financials(money).collect()}
    assert got == {(15, None, 100, None), (None, 15, None, 5.0)}


def test_history_text(spark):
    texts = ["17 Years and 6 Months", "1 Year and 1 Month", "5 Years", "x", None, "7 Months"]
    assert one(spark, texts, ratios.history_months) == [210, 13, 60, 0, None, 7]


def test_ratios_and_flag(spark):
    rows = [(0, 5.0, 0.0), (1, None, 10.0), (2, 5.0, 10.0), (3, -1.0, 10.0), (4, 0.0, 10.0)]
    assert values(
        spark, rows, "a double, b double", ratios.guarded_ratio(F.col("a"), F.col("b"))
    ) == [None, None, 0.5, None, 0.0]
    assert values(
        spark, [(0, 50.0), (1, 50.01), (2, None)], "v double", ratios.high_utilization(F.col("v"))
    ) == [0, 1, 0]


def test_right_closed(spark):
    rows = [(i, v) for i, v in enumerate([0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 9.0, None])]
    index = scores.right_closed_index(F.col("v"), [1.0, 2.0, 3.0])
    assert values(spark, rows, "v double", index) == [0, 0, 1, 1, 2, 2, 3, None]


def test_statuses(spark):
    rows = [(0, 0.05, 0.30), (1, 0.15, 0.0), (2, 0.25, 0.0), (3, 0.05, 0.15)]
    psi, csi = F.col("psi"), F.col("csi")
    status = scores.overall_status(
        psi, scores.drift_status(psi, 0.1, 0.25), scores.drift_status(csi, 0.1, 0.25), 0.25
    )
    assert values(spark, rows, "psi double, csi double", status) == [
        "healthy", "warning", "retrain_required", "warning",
    ]


def test_training_windows(spark):
    windows = months.training_windows(F.lit("2024-09-01").cast("date"))
    row = spark.range(1).select(*[c.cast("string").alias(n) for n, c in windows.items()]).first()
    assert row.asDict() == {
        "train_test_start_date": "2023-07-01",
        "train_test_end_date": "2024-06-30",
        "oot_start_date": "2024-07-01",
        "oot_end_date": "2024-08-31",
        "feature_start_date": "2023-01-01",
        "feature_end_date": "2024-02-29",
    }


def test_months(spark):
    assert [str(r[0]) for r in months.month_frame(spark, "2023-11-15", "2024-02-03").collect()] == [
        "2023-11-01", "2023-12-01", "2024-01-01", "2024-02-01",
    ]
    assert months.month_frame(spark, "2024-02-01", "2024-01-01").isEmpty()
    row = spark.range(1).select(
        months.previous_month(F.lit("2024-01-31").cast("date")).cast("string"),
        months.months_apart(F.lit("2023-11-30").cast("date"), F.lit("2024-02-01").cast("date")),
    ).first()
    assert tuple(row) == ("2023-12-01", 3)
