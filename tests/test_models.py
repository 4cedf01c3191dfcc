from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler

from creditloom import constants as K
from creditloom.operators import modeling


def test_unseen_category_is_all_zeros_and_nulls_are_filled(spark):
    train = spark.createDataFrame(
        [(1.0, "a"), (3.0, "b"), (None, None), (float("nan"), "a")], "n double, c string"
    )
    prepared = modeling.fit_preprocessing(train, ["n"], ["c"])
    rows = spark.createDataFrame([(2.0, "never"), (None, None)], "n double, c string")
    got = [r[modeling.FEATURES].toArray().tolist() for r in prepared.transform(rows).collect()]
    assert got[0] == [0.0, 0.0, 0.0, 0.0]  # the median 2 is also the mean
    assert got[1][0] == 0.0 and sum(got[1][1:]) == 1.0


def test_search_grid():
    assert len(list(modeling.drawn_candidates(K.LOG_REG_GRID))) == 16
    drawn = list(modeling.drawn_candidates(K.BOOSTED_TREES_GRID))
    assert len(drawn) == K.SEARCH_DRAWS and drawn == list(modeling.drawn_candidates(K.BOOSTED_TREES_GRID))
    assert len({tuple(sorted(p.items())) for p in drawn}) == K.SEARCH_DRAWS


def test_sigmoid_minimises_the_smoothed_loss(spark):
    rng = random.Random(2)
    rows = [(s := rng.random(), float(rng.random() < 1 / (1 + math.exp(-6 * s + 3)))) for _ in range(400)]
    df = VectorAssembler(inputCols=["s"], outputCol=modeling.CALIBRATION_INPUT).transform(
        spark.createDataFrame(rows, "s double, label double")
    )
    fitted = modeling.fit_sigmoid(df)
    pos = sum(y for _, y in rows)
    high, low = (pos + 1) / (pos + 2), 1 / (len(rows) - pos + 2)
    a, b = fitted.coefficients[0], fitted.intercept
    # At the optimum both gradients of the log-loss against smoothed targets vanish.
    errors = [(1 / (1 + math.exp(-(a * s + b))) - (high if y else low), s) for s, y in rows]
    assert sum(e for e, _ in errors) == pytest.approx(0, abs=1e-3)
    assert sum(e * s for e, s in errors) == pytest.approx(0, abs=1e-3)


def test_boosted_trees_and_unknown_family(spark):
    rng = random.Random(4)
    rows = [(x := rng.random(), float(x > 0.5)) for _ in range(200)]
    df = VectorAssembler(inputCols=["x"], outputCol=modeling.FEATURES).transform(
        spark.createDataFrame(rows, "x double, label double")
    )
    point = {name: options[0] for name, options in K.BOOSTED_TREES_GRID.items()} | {"n_estimators": 2}
    model, params, auc = modeling.search(K.BOOSTED_TREES, df, df, [point])
    assert params == point and auc > 0.9
    two = [point | {"max_depth": 2}, point | {"max_depth": 4}]
    assert modeling.search(K.BOOSTED_TREES, df, df, two)[1] == two[0]  # equal AUC: the first wins
    with pytest.raises(ValueError):
        modeling.fit_candidate("none", {}, df, 1)
