from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from creditloom.operators import classification as C
from creditloom.operators import evaluation


def ranked(spark, rows):
    df = spark.createDataFrame(rows, "s double, y int")
    return C.ranking_metrics(C.score_counts(df, [], F.col("s"), F.col("y"))).first()


def pairs(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(200)]
    got = ranked(spark, rows)
    assert got["auc"] == pytest.approx(pairs(rows))
    assert got["gini"] == pytest.approx(round(2 * pairs(rows) - 1, 3))
    assert got["brier"] == pytest.approx(sum((s - y) ** 2 for s, y in rows) / len(rows))
    clip = [(min(max(s, 1e-15), 1 - 1e-15), y) for s, y in rows]
    loss = -sum(y * math.log(s) + (1 - y) * math.log(1 - s) for s, y in clip) / len(rows)
    assert got["log_loss"] == pytest.approx(loss)
    mirrored = ranked(spark, [(1 - s, y) for s, y in rows])
    assert mirrored["auc"] == pytest.approx(1 - got["auc"])


def test_one_class(spark):
    got = ranked(spark, [(0.2, 1), (0.6, 1)])
    assert (got["auc"], got["gini"], got["log_loss"]) == (None, None, None)
    assert got["brier"] == pytest.approx((0.64 + 0.16) / 2)


def test_class_metrics_without_cases(spark):
    df = spark.createDataFrame([(0, 0, 0, 0)], "tn int, fp int, fn int, tp int")
    row = C.with_class_metrics(df).first()
    assert row["precision"] == row["recall"] == row["f1"] == row["youden_j"] == 0.0


def test_sweep_against_every_cutoff(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0.01, 0.07, 0.29, 0.57, 0.58, 0.99, 1.0, 0.0, rng.random()]), rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    sweep = C.threshold_sweep(df, [], F.col("s"), F.col("y"))
    got = {r["threshold"]: r for r in sweep.collect()}
    assert len(got) == 99
    best = None
    for k in range(1, 100):
        t = k / 100
        tp = sum(y == 1 and s >= t for s, y in rows)
        fp = sum(y == 0 and s >= t for s, y in rows)
        assert (got[t]["tp"], got[t]["fp"]) == (tp, fp)
        key = (got[t]["youden_j"], got[t]["f1"], got[t]["balanced_accuracy"])
        if best is None or key > best[0]:
            best = (key, t)
    assert C.best_threshold(sweep).first()["threshold"] == best[1]


def test_tied_scores_are_one_band(spark):
    df = spark.createDataFrame(
        [(0.5, 1, 0), (0.5, 0, 1)], "model_predictions double, actual_label int, predicted_label int"
    )
    row = evaluation.score_bands(df).first()
    assert (row["score_band"], row["row_count"], row["actual_default_rate"]) == ("all_scores", 2, 0.5)


def test_bands(spark):
    rows = [(i / 100, i % 2, int(i > 50)) for i in range(1, 101)]
    df = spark.createDataFrame(
        rows, "model_predictions double, actual_label int, predicted_label int"
    )
    got = evaluation.score_bands(df, 4).orderBy("band").collect()
    assert [r["row_count"] for r in got] == [25, 25, 25, 25]
    assert got[0]["score_band"] == "(0.009000000000000001, 0.258]"
    assert got[-1]["score_band"] == "(0.752, 1.0]"


def test_a_model_without_scores_keeps_its_row(spark):
    rows = [("a", 0.2, 0, 0), ("a", 0.8, 1, 1), ("b", None, 0, 0)]
    df = spark.createDataFrame(
        rows, "model_version string, model_predictions double, predicted_label int, actual_label int"
    ).selectExpr(
        "*", "date'2024-01-01' AS prediction_snapshot_date", "date'2024-07-01' AS label_snapshot_date",
        "0.5D AS prediction_threshold",
    )
    got = evaluation.performance_summary(df, "2024-08-01").collect()
    assert sorted((r.model_version, r.auc) for r in got) == [("a", 1.0)] * 2 + [("b", None)] * 2
