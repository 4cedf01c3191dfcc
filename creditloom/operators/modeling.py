"""Fitting, calibrating and applying default models with Spark ML."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from fractions import Fraction
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.operators.quantiles import column_quantiles

LABEL = "label"
FEATURES = "features"
CALIBRATION_INPUT = "calibration_input"
CALIBRATED = "calibrated"
SEARCH_PARALLELISM = 4


def fit_preprocessing(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> PipelineModel:
    """Median fill and standard scale for numbers; '__missing__' and one-hot for categories.

    A category not seen in training becomes all zeros.
    """
    medians = column_quantiles(train, {c: F.col(c) for c in numeric}, [Fraction(1, 2)])
    filled = [
        f"coalesce(nullif(cast(`{c}` as double), double('NaN')), {(medians[c] or [0.0])[0]!r}D)"
        f" AS `{c}__filled`"
        for c in numeric
    ] + [f"coalesce(cast(`{c}` as string), '{K.MISSING}') AS `{c}__text`" for c in categorical]
    stages: list[Transformer] = []
    current = train

    def add(stage) -> None:
        nonlocal current
        model = stage.fit(current) if hasattr(stage, "fit") else stage
        stages.append(model)
        current = model.transform(current)

    add(SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__"))
    parts = []
    if numeric:
        add(VectorAssembler(inputCols=[f"{c}__filled" for c in numeric], outputCol="numbers"))
        add(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True))
        parts.append("scaled")
    if categorical:
        texts = [f"{c}__text" for c in categorical]
        indexes = [f"{c}__index" for c in categorical]
        onehots = [f"{c}__onehot" for c in categorical]
        add(StringIndexer(inputCols=texts, outputCols=indexes, handleInvalid="keep"))
        add(OneHotEncoder(inputCols=indexes, outputCols=onehots, dropLast=True))
        parts += onehots
    add(VectorAssembler(inputCols=parts, outputCol=FEATURES))
    return PipelineModel(stages)


def drawn_candidates(
    grid: Mapping[str, Sequence[Any]], draws: int = K.SEARCH_DRAWS, seed: int = K.SPLIT_SEED
) -> Iterator[dict[str, Any]]:
    """Up to ``draws`` different points of the grid in a seeded random order."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    yield from random.Random(seed).sample(points, min(draws, len(points)))


def fit_candidate(model_type: str, params: Mapping[str, Any], train: DataFrame, rows: int):
    """Fit one parameter point on preprocessed rows."""
    if model_type == K.LOG_REG:
        weighted = train
        if params["class_weight"] == "balanced":
            positives = train.where(F.col(LABEL) == 1).count()
            weight = F.when(F.col(LABEL) == 1, rows / (2 * positives)).otherwise(
                rows / (2 * (rows - positives))
            )
            weighted = train.withColumn("weight", weight)
        model = LogisticRegression(
            labelCol=LABEL,
            featuresCol=FEATURES,
            maxIter=params["max_iter"],
            regParam=1.0 / (params["C"] * rows),
            elasticNetParam=0.0,
            standardization=False,
        )
        if weighted is not train:
            model.setWeightCol("weight")
        return model.fit(weighted)
    if model_type == K.BOOSTED_TREES:
        return GBTClassifier(
            labelCol=LABEL,
            featuresCol=FEATURES,
            maxIter=params["n_estimators"],
            maxDepth=params["max_depth"],
            stepSize=params["learning_rate"],
            subsamplingRate=params["subsample"],
            featureSubsetStrategy=str(params["colsample_bytree"]),
            minInfoGain=float(params["gamma"]),
            minInstancesPerNode=params["min_child_weight"],
            seed=K.SPLIT_SEED,
        ).fit(train)
    raise ValueError(f"unknown model type {model_type}")


def search(
    model_type: str,
    train: DataFrame,
    holdout: DataFrame,
    candidates: Sequence[Mapping[str, Any]],
    parallelism: int = SEARCH_PARALLELISM,
) -> tuple[Any, dict[str, Any], float]:
    """The candidate with the best holdout AUC; the first of equals wins.

    ``parallelism`` fits are under way at a time, each a distributed job of its own.
    """
    evaluator = BinaryClassificationEvaluator(
        labelCol=LABEL, rawPredictionCol="rawPrediction", metricName="areaUnderROC", numBins=0
    )
    rows = train.count()

    def fitted(params: Mapping[str, Any]) -> tuple[Any, dict[str, Any], float]:
        model = fit_candidate(model_type, params, train, rows)
        return model, dict(params), evaluator.evaluate(model.transform(holdout))

    with ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(inheritable_thread_target(train.sparkSession)(fitted), candidates))
    if not results:
        raise ValueError("no parameter points to try")
    return max(results, key=lambda result: result[2])


def calibration_slicer(model_type: str) -> VectorSlicer:
    """Calibration reads the margin of a linear model and the probability of trees."""
    source = "rawPrediction" if model_type == K.LOG_REG else "probability"
    return VectorSlicer(inputCol=source, outputCol=CALIBRATION_INPUT, indices=[1])


def fit_sigmoid(scored: DataFrame):
    """Platt scaling of ``calibration_input`` with smoothed targets.

    The target of a positive is (P+1)/(P+2), of a negative 1/(N+2). Each row enters twice, as a
    1 and as a 0, weighted with its target and the rest.
    """
    sizes = scored.agg(F.count_if(F.col(LABEL) == 1), F.count_if(F.col(LABEL) == 0)).first()
    high, low = (sizes[0] + 1) / (sizes[0] + 2), 1 / (sizes[1] + 2)
    target = F.when(F.col(LABEL) == 1, high).otherwise(low)
    copies = scored.select(
        CALIBRATION_INPUT,
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("outcome"), target.alias("weight")),
                F.struct(F.lit(0.0).alias("outcome"), (1 - target).alias("weight")),
            )
        ),
    )
    return LogisticRegression(
        featuresCol=CALIBRATION_INPUT,
        labelCol="outcome",
        weightCol="weight",
        probabilityCol=CALIBRATED,
        rawPredictionCol="calibrated_margin",
        predictionCol="calibrated_class",
        regParam=0.0,
        tol=1e-10,
        maxIter=500,
    ).fit(copies)


def with_score(df: DataFrame, model: PipelineModel, name: str = "model_predictions") -> DataFrame:
    """Add the calibrated default probability, keeping the table's own columns only."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array(CALIBRATED)[1].alias(name))
