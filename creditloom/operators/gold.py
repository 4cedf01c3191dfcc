"""Default labels and the customer feature store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions import delinquency, ratios
from creditloom.operators.ordering import seeded_order, with_row_number
from creditloom.operators.selection import prefixed

LABEL_COLUMNS = ["loan_id", K.CUSTOMER, "label", "label_def", K.SNAPSHOT]


def gold_labels(silver: DataFrame, dpd: int = K.DEFAULT_DPD, mob: int = K.DEFAULT_MOB) -> DataFrame:
    """Loans at month on book ``mob`` with their default label."""
    return (
        silver.where(F.col("mob") == mob)
        .withColumns(
            {
                "label": delinquency.default_label(F.col("dpd"), dpd),
                "label_def": delinquency.label_definition(dpd, mob),
            }
        )
        .select(*LABEL_COLUMNS)
    )


def joined_features(
    attributes: DataFrame, financials: DataFrame, clickstream: DataFrame
) -> DataFrame:
    """Attributes with financials and clickstream of the same customer and snapshot."""
    return attributes.join(financials, K.FEATURE_KEY, "left").join(
        clickstream, K.FEATURE_KEY, "left"
    )


def snapshot_coverage(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Per snapshot: rows of ``left`` and rows its inner join with ``right`` would have.

    Both sides are counted by key first, so repeated keys are multiplied, not joined.
    """
    sizes = left.groupBy(*K.FEATURE_KEY).agg(F.count(F.lit(1)).alias("__left"))
    others = right.groupBy(*K.FEATURE_KEY).agg(F.count(F.lit(1)).alias("__right"))
    matched = F.col("__left") * F.coalesce(F.col("__right"), F.lit(0))
    return (
        sizes.join(others, K.FEATURE_KEY, "left")
        .groupBy(K.SNAPSHOT)
        .agg(F.sum("__left").alias("total_rows"), F.sum(matched).alias(name))
    )


def with_distribution_fallback(
    gold: DataFrame,
    attributes: DataFrame,
    clickstream: DataFrame,
    seed: int = K.FALLBACK_SEED,
    donor_key: Sequence[str] = (K.CUSTOMER,),
) -> DataFrame:
    """Fill missing ``fe_*`` values from other customers of the same snapshot.

    Only in snapshots where fewer clickstream rows match than there are attribute rows: the
    n-th gold row by customer takes the missing values of the n-th clickstream row in a seeded
    shuffle order. Each donor serves once; gold rows beyond the donors keep their nulls.
    """
    names = prefixed(clickstream.columns)
    if not names:
        return gold
    coverage = snapshot_coverage(attributes, clickstream, "matched")
    incomplete = coverage.where(F.col("matched") < F.col("total_rows")).select(K.SNAPSHOT)

    key = "__pair"
    donors = (
        clickstream.join(incomplete, K.SNAPSHOT, "left_semi")
        .select(
            K.SNAPSHOT,
            seeded_order(donor_key, seed).alias("__shuffled"),
            F.xxhash64(*names).alias("__tie"),
            *[F.col(name).alias(f"__donor_{name}") for name in names],
        )
    )
    # The rest of the row breaks ties, so rows of one customer do not gather in one partition.
    donors = with_row_number(donors, [K.SNAPSHOT], ["__shuffled", "__tie"], key)
    donors = donors.drop("__shuffled", "__tie")
    tie_break = F.xxhash64(*gold.columns).alias("__tie")
    numbered = with_row_number(
        gold.select("*", tie_break), [K.SNAPSHOT], [K.CUSTOMER, "__tie"], key
    )
    filled = {name: F.coalesce(F.col(name), F.col(f"__donor_{name}")) for name in names}
    return (
        numbered.join(donors, [K.SNAPSHOT, key], "left")
        .withColumns(filled)
        .select(*gold.columns)
    )


def with_derived_features(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {
            "debt_to_income_ratio": ratios.guarded_ratio(
                F.col("Outstanding_Debt"), F.col("Annual_Income")
            ),
            "emi_to_salary_ratio": ratios.guarded_ratio(
                F.col("Total_EMI_per_month"), F.col("Monthly_Inhand_Salary")
            ),
            "high_credit_utilization_flag": ratios.high_utilization(
                F.col("Credit_Utilization_Ratio")
            ),
            "Credit_History_Age_Months": ratios.history_months(F.col("Credit_History_Age")),
        }
    )


def gold_features(
    attributes: DataFrame,
    financials: DataFrame,
    clickstream: DataFrame,
    fallback: bool = True,
    seed: int = K.FALLBACK_SEED,
) -> DataFrame:
    """The feature store for every snapshot of the three tables."""
    gold = joined_features(attributes, financials, clickstream)
    if fallback:
        gold = with_distribution_fallback(gold, attributes, clickstream, seed)
    return with_derived_features(gold)


def repaired_features(features: DataFrame, bounds: dict[str, list[float] | None]) -> DataFrame:
    """Clip money columns at zero, derive the features again and cap the ratios.

    ``bounds`` holds low and high of each ratio, usually quantiles of a reference table.
    """
    clip = {c: ratios.clipped(F.col(c), 0.0) for c in K.CLIPPED_AT_ZERO if c in features.columns}
    derived = with_derived_features(features.withColumns(clip))
    caps = {
        c: ratios.clipped(F.col(c), *bounds[c]) for c in K.CAPPED_RATIOS if bounds.get(c)
    }
    return derived.withColumns(caps) if caps else derived
