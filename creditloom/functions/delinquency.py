"""Days past due and the default label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def installments_missed(overdue: Column, due: Column) -> Column:
    """Whole instalments behind, rounded up; null when nothing is due."""
    behind = F.try_divide(overdue.cast("double"), due.cast("double"))
    return F.ceil(behind).try_cast("int")


def first_missed_date(snapshot: Column, missed: Column) -> Column:
    return F.when(missed > 0, F.add_months(snapshot, -missed))


def days_past_due(snapshot: Column, overdue: Column, first_missed: Column) -> Column:
    """Calendar days since the first missed instalment; null if overdue with no such date."""
    return F.when(overdue > 0, F.datediff(snapshot, first_missed)).otherwise(F.lit(0))


def default_label(days: Column, dpd: int) -> Column:
    """1 from ``dpd`` days on; an unknown number of days counts as 0."""
    return F.coalesce((days >= dpd).cast("int"), F.lit(0))


def label_definition(dpd: int, mob: int) -> Column:
    return F.lit(f"{dpd}dpd_{mob}mob")
