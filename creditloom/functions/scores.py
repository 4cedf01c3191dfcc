"""Score classes, drift statuses and bucket expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom import constants as K


def score_class(score: Column, threshold: Column | float) -> Column:
    return (score >= threshold).cast("int")


def drift_status(value: Column, warning: float, retrain: float) -> Column:
    return (
        F.when(value >= retrain, K.RETRAIN_STATUS)
        .when(value >= warning, K.WARNING_STATUS)
        .otherwise(K.HEALTHY_STATUS)
    )


def overall_status(psi: Column, psi_status: Column, csi_status: Column, psi_retrain: float) -> Column:
    """Only score drift asks for retraining; a feature at retrain level alone stays healthy."""
    any_warning = (psi_status == K.WARNING_STATUS) | (csi_status == K.WARNING_STATUS)
    return (
        F.when(psi >= psi_retrain, K.RETRAIN_STATUS)
        .when(any_warning, K.WARNING_STATUS)
        .otherwise(K.HEALTHY_STATUS)
    )


def right_closed_index(value: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending ``edges`` lie below ``value``: bucket i is (edge i-1, edge i].

    Written as comparisons with constants, in halves, so that it stays in generated code and
    costs log2(edges) steps a row.
    """

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(edges[middle]), search(low, middle)).otherwise(
            search(middle + 1, high)
        )

    return F.when(value.isNotNull(), search(0, len(edges)))


def number_or_null(value: Column) -> Column:
    """As double, with NaN as null."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)
