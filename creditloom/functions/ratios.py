"""Derived customer features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom import constants as K


def guarded_ratio(part: Column, whole: Column) -> Column:
    """part / whole for a positive whole and a part of at least zero, else null."""
    ok = (whole > 0) & (part >= 0)
    return F.when(ok, part.cast("double") / whole.cast("double"))


def high_utilization(ratio: Column) -> Column:
    return F.coalesce((ratio > K.HIGH_UTILIZATION).cast("int"), F.lit(0))


def history_months(text: Column) -> Column:
    """'17 Years and 6 Months' to 210; a missing part is 0, a missing text is null."""

    def part(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("int"), F.lit(0))

    return F.when(text.isNotNull(), part(K.YEARS_PATTERN) * 12 + part(K.MONTHS_PATTERN))


def clipped(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value to the given bounds; null stays null."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)
