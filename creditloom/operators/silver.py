"""Typed and repaired tables from landed text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions import cleaning, delinquency


def typed_loans(raw: DataFrame) -> DataFrame:
    """Every loan column in its fixed type; unreadable values are null."""
    return raw.select(
        *[cleaning.typed(F.col(name), kind).alias(name) for name, kind in K.LOAN_TYPES.items()]
    )


def with_days_past_due(loans: DataFrame) -> DataFrame:
    """Add month on book, missed instalments, first missed date and days past due.

    Every numeric null of the table becomes 0 once the missed instalments are known, and days
    past due are taken after that.
    """
    missed = delinquency.installments_missed(F.col("overdue_amt"), F.col("due_amt"))
    filled = loans.withColumns(
        {"mob": F.col("installment_num").cast("int"), "installments_missed": missed}
    ).fillna(0)
    snapshot = F.col(K.SNAPSHOT)
    dated = filled.withColumn(
        "first_missed_date",
        delinquency.first_missed_date(snapshot, F.col("installments_missed")),
    )
    days = delinquency.days_past_due(snapshot, F.col("overdue_amt"), F.col("first_missed_date"))
    return dated.withColumn("dpd", days)


def silver_loans(raw: DataFrame) -> DataFrame:
    return with_days_past_due(typed_loans(raw))


def distinct_rows(raw: DataFrame) -> DataFrame:
    """One of each set of identical rows; copies meet on the map side first."""
    return raw.dropDuplicates()


def _repaired(raw: DataFrame, repairs: dict) -> DataFrame:
    """Apply the repairs for columns that exist, in one projection, order kept."""
    return raw.select(
        *[repairs.get(name, F.col)(name).alias(name) for name in raw.columns]
    )


def _rule(fix, check=None):
    def repair(name):
        value = fix(F.col(name))
        return check(value) if check else value

    return repair


def _text(value):
    return value.cast("string")


def _date(value):
    return value.try_cast("date")


def silver_financials(raw: DataFrame) -> DataFrame:
    repairs = {name: _rule(cleaning.repaired_float) for name in K.FINANCIAL_FLOATS}
    repairs |= {name: _rule(cleaning.repaired_int) for name in K.FINANCIAL_INTS}
    repairs |= {name: _rule(_text) for name in K.FINANCIAL_TEXTS}
    for name in K.FINANCIAL_NON_NEGATIVE:
        fix = cleaning.repaired_int if name in K.FINANCIAL_INTS else cleaning.repaired_float
        repairs[name] = _rule(fix, cleaning.non_negative)
    for name, (low, high) in K.FINANCIAL_RANGES.items():
        repairs[name] = _rule(
            cleaning.repaired_int, lambda v, low=low, high=high: cleaning.in_range(v, low, high)
        )
    repairs[K.SNAPSHOT] = _rule(_date)
    return _repaired(distinct_rows(raw), repairs)


def silver_attributes(raw: DataFrame) -> DataFrame:
    low, high = K.ATTRIBUTE_RANGES["Age"]
    repairs = {name: _rule(_text) for name in K.ATTRIBUTE_TEXTS}
    repairs["Age"] = _rule(cleaning.repaired_int, lambda v: cleaning.in_range(v, low, high))
    repairs[K.SNAPSHOT] = _rule(_date)
    return _repaired(distinct_rows(raw), repairs)


def silver_clickstream(raw: DataFrame) -> DataFrame:
    return _repaired(distinct_rows(raw), {K.SNAPSHOT: _rule(_date)})


SILVER_FEATURES = {
    "clickstream": silver_clickstream,
    "attributes": silver_attributes,
    "financials": silver_financials,
}
