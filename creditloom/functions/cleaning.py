"""Typing and repair of raw text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float(value: Column) -> Column:
    """Text or number to float; what cannot be read, and NaN, is null."""
    number = value.try_cast("float")
    return F.when(~F.isnan(number), number)


def to_int(value: Column) -> Column:
    """Text or number to int, cutting off decimals ('28.5' is 28); what cannot be read is null."""
    return value.try_cast("double").try_cast("int")


def typed(value: Column, type_name: str) -> Column:
    """Cast for one entry of a column-to-type map."""
    if type_name == "int":
        return to_int(value)
    if type_name == "float":
        return to_float(value)
    return value.try_cast(type_name)


def without_underscores(value: Column) -> Column:
    return F.replace(value.cast("string"), F.lit("_"), F.lit(""))


def repaired_float(value: Column) -> Column:
    return to_float(without_underscores(value))


def repaired_int(value: Column) -> Column:
    return to_int(without_underscores(value))


def in_range(value: Column, low: float, high: float) -> Column:
    """The value if inside the closed range, else null."""
    return F.when(value.between(low, high), value)


def non_negative(value: Column) -> Column:
    return F.when(value >= 0, value)
