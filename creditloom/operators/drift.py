"""Population stability of scores (PSI) and features (CSI).

Buckets are fitted once on a reference population and then written into the plan as constants:
columns × bins edges and columns × top-n levels, however many rows there are. Every snapshot
and feature is then counted in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from creditloom import constants as K
from creditloom.functions.scores import (
    drift_status,
    number_or_null,
    overall_status,
    right_closed_index,
)
from creditloom.operators.quantiles import column_quantiles, even_fractions
from creditloom.operators.selection import member_or_other


@dataclass(frozen=True)
class DriftBuckets:
    """Fitted buckets. ``edges`` are the inner ones; None means there are too few values."""

    edges: Mapping[str, list[float] | None]
    levels: Mapping[str, list[str]] = field(default_factory=dict)
    top_n: int = K.CATEGORICAL_TOP_N

    def bucket(self, name: str) -> Column:
        """The bucket of a column's value, as text."""
        if name in self.levels:
            return member_or_other(_level(name), self.levels[name])
        edges = self.edges[name]
        if edges is None:
            return F.lit(K.MISSING)
        index = right_closed_index(number_or_null(F.col(name)), edges)
        return F.coalesce(index.cast("string"), F.lit(K.MISSING))

    def kind(self) -> Column:
        """Feature type, for a column named ``feature_name``."""
        return F.when(F.col("feature_name").isin(list(self.levels)), "categorical").otherwise(
            "numeric"
        )


def _level(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(K.MISSING))


def inner_edges(quantiles: list[float] | None) -> list[float] | None:
    """Distinct edges without the outer two; None if fewer than two are distinct."""
    distinct = sorted(set(quantiles or []))
    return distinct[1:-1] if len(distinct) >= 2 else None


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per feature and level, null being a level of its own."""
    texts = df.select(*[_level(name).alias(name) for name in columns])
    return (
        texts.unpivot([], list(columns), "feature_name", "level")
        .groupBy("feature_name", "level")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def top_levels(df: DataFrame, columns: Sequence[str], top_n: int) -> DataFrame:
    """The ``top_n`` most frequent levels of each feature; ties go to the smaller name."""
    order = Window.partitionBy("feature_name").orderBy(F.desc("row_count"), "level")
    return (
        level_counts(df, columns)
        .withColumn("level_rank", F.row_number().over(order))
        .where(F.col("level_rank") <= top_n)
    )


def fit_buckets(
    reference: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    bins: int = K.DEFAULT_BINS,
    top_n: int = K.CATEGORICAL_TOP_N,
) -> DriftBuckets:
    quantiles = column_quantiles(
        reference, {name: F.col(name) for name in numeric}, even_fractions(bins)
    )
    levels: dict[str, list[str]] = {name: [] for name in categorical}
    if categorical:
        for row in top_levels(reference, categorical, top_n).collect():
            levels[row["feature_name"]].append(row["level"])
        has_missing = reference.agg(
            *[F.bool_or(_level(name) == K.MISSING).alias(name) for name in categorical]
        ).first()
        for name in categorical:
            if has_missing[name] and K.MISSING not in levels[name]:
                levels[name].append(K.MISSING)
    return DriftBuckets({n: inner_edges(q) for n, q in quantiles.items()}, levels, top_n)


def bucket_counts(
    df: DataFrame, buckets: DriftBuckets, columns: Sequence[str], groups: Sequence[str] = ()
) -> DataFrame:
    """Rows per group, feature and bucket: all features in one pass over ``df``."""
    entries = [
        F.struct(F.lit(name).alias("feature_name"), buckets.bucket(name).alias("bucket"))
        for name in columns
    ]
    return (
        df.select(*groups, F.inline(F.array(*entries)))
        .groupBy(*groups, "feature_name", "bucket")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def stability_index(
    expected: DataFrame, actual: DataFrame, groups: Sequence[str] = ()
) -> DataFrame:
    """PSI of every group and feature from bucket counts.

    A bucket seen on one side only counts 0 on the other. Shares are at least 1e-6, so empty
    buckets stay finite. Sizes here are features × buckets, never rows.
    """

    def as_map(counts: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
        pairs = F.collect_list(F.struct("bucket", F.col("row_count").cast("double")))
        return counts.groupBy(*keys, "feature_name").agg(
            F.map_from_entries(pairs).alias(f"{side}_counts"),
            F.sum("row_count").alias(f"{side}_count"),
        )

    expected_maps = as_map(expected, [], "reference")
    actual_maps = as_map(actual, groups, "current")
    if groups:
        both = actual_maps.join(F.broadcast(expected_maps), "feature_name")
    else:
        both = expected_maps.join(F.broadcast(actual_maps), "feature_name", "left")
        empty = F.create_map().cast("map<string,double>")
        both = both.withColumns(
            {
                "current_counts": F.coalesce("current_counts", empty),
                "current_count": F.coalesce("current_count", F.lit(0)),
            }
        )
    domain = F.array_union(F.map_keys("reference_counts"), F.map_keys("current_counts"))

    def share(side: str) -> Column:
        count = F.coalesce(F.try_element_at(f"{side}_counts", F.col("bucket")), F.lit(0.0))
        total = F.greatest(F.col(f"{side}_count").cast("double"), F.lit(K.STABILITY_FLOOR))
        return F.greatest(count / total, F.lit(K.STABILITY_FLOOR))

    shares = both.select(
        *groups,
        "feature_name",
        "reference_count",
        "current_count",
        "reference_counts",
        "current_counts",
        F.explode(domain).alias("bucket"),
    ).select(
        *groups,
        "feature_name",
        "reference_count",
        "current_count",
        share("reference").alias("__expected"),
        share("current").alias("__actual"),
    )
    term = (F.col("__actual") - F.col("__expected")) * F.ln(F.col("__actual") / F.col("__expected"))
    return shares.groupBy(*groups, "feature_name", "reference_count", "current_count").agg(
        F.sum(term).alias("csi"), F.count(F.lit(1)).cast("int").alias("bucket_count")
    )


PROFILE = (
    "feature_name string, feature_type string, edges array<double>, levels array<string>,"
    " counts map<string,bigint>, top_n int"
)


def drift_table(
    reference: DataFrame,
    current: DataFrame,
    buckets: DriftBuckets,
    columns: Sequence[str],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Stability index of every column, and group of the current rows, with its feature type."""
    counts = bucket_counts(reference, buckets, columns)
    return drift_from_counts(counts, current, buckets, columns, groups)


def drift_from_counts(
    expected: DataFrame,
    current: DataFrame,
    buckets: DriftBuckets,
    columns: Sequence[str],
    groups: Sequence[str] = (),
) -> DataFrame:
    """``drift_table`` where the reference's bucket counts are known."""
    index = stability_index(expected, bucket_counts(current, buckets, columns, groups), groups)
    kind = buckets.kind()
    return index.withColumn("feature_type", kind).withColumn(
        "categorical_top_n", F.when(kind == "categorical", F.lit(float(buckets.top_n)))
    ).select(
        *groups,
        "feature_name",
        "feature_type",
        "csi",
        "reference_count",
        "current_count",
        "bucket_count",
        "categorical_top_n",
    )


def drift_profile(
    reference: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    bins: int = K.DEFAULT_BINS,
    top_n: int = K.CATEGORICAL_TOP_N,
) -> DataFrame:
    """All that drift measures need of a reference: one row per column, with buckets and counts.

    The table has as many rows as there are columns, whatever the reference's size, and can be
    stored and read again in its place. The reference is read several times: persist it.
    """
    spark = reference.sparkSession
    buckets = fit_buckets(reference, numeric, categorical, bins, top_n)
    fitted = spark.createDataFrame(
        [
            (name, kind, buckets.edges.get(name), buckets.levels.get(name))
            for names, kind in ((numeric, "numeric"), (categorical, "categorical"))
            for name in names
        ],
        "feature_name string, feature_type string, edges array<double>, levels array<string>",
    )
    pairs = F.collect_list(F.struct("bucket", "row_count"))
    counts = bucket_counts(reference, buckets, [*numeric, *categorical])
    maps = counts.groupBy("feature_name").agg(F.map_from_entries(pairs).alias("counts"))
    none = F.create_map().cast("map<string,bigint>")
    return fitted.join(F.broadcast(maps), "feature_name", "left").withColumns(
        {"counts": F.coalesce("counts", none), "top_n": F.lit(top_n)}
    )


def profile_buckets(profile: DataFrame) -> DriftBuckets:
    """The buckets of a profile; a row per column is read."""
    edges, levels, top_n = {}, {}, K.CATEGORICAL_TOP_N
    for row in profile.select("feature_name", "feature_type", "edges", "levels", "top_n").collect():
        if row["feature_type"] == "categorical":
            levels[row["feature_name"]] = row["levels"]
        else:
            edges[row["feature_name"]] = row["edges"]
        top_n = row["top_n"]
    return DriftBuckets(edges, levels, top_n)


def profile_counts(profile: DataFrame) -> DataFrame:
    """The reference's rows per feature and bucket."""
    return profile.select("feature_name", F.explode("counts").alias("bucket", "row_count"))


def drift_from_profile(
    profile: DataFrame, current: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()
) -> DataFrame:
    """``drift_table`` from a profile in place of the reference."""
    return drift_from_counts(
        profile_counts(profile), current, profile_buckets(profile), columns, groups
    )


def worst_feature(csi: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Largest CSI and its feature; ties go to the smaller name, no features give 0 and ''."""
    peak = csi.groupBy(*groups, "csi").agg(F.min("feature_name").alias("feature_name"))
    return peak.groupBy(*groups).agg(
        F.coalesce(F.max("csi"), F.lit(0.0)).alias("max_csi"),
        F.coalesce(F.max_by("feature_name", "csi"), F.lit("")).alias("max_csi_feature"),
    )


def with_statuses(
    summary: DataFrame,
    psi_warning: float = K.PSI_WARNING,
    psi_retrain: float = K.PSI_RETRAIN,
    csi_warning: float = K.CSI_WARNING,
    csi_retrain: float = K.CSI_RETRAIN,
) -> DataFrame:
    """Add the statuses to rows that hold ``psi_score`` and ``max_csi``."""
    psi = F.col("psi_score")
    return (
        summary.withColumns(
            {
                "psi_status": drift_status(psi, psi_warning, psi_retrain),
                "csi_status": drift_status(F.col("max_csi"), csi_warning, csi_retrain),
                "retrain_required": psi >= psi_retrain,
            }
        ).withColumn(
            "status",
            overall_status(psi, F.col("psi_status"), F.col("csi_status"), psi_retrain),
        )
    )


def drift_trend(history: DataFrame) -> DataFrame:
    """Change of PSI against the model's previous snapshot.

    The history holds one row per model and month, so a model's window is as long as its life
    in months.
    """
    order = Window.partitionBy("model_version").orderBy(K.SNAPSHOT)
    change = F.col("psi_score") - F.col("psi_previous")
    return (
        history.withColumn("psi_previous", F.lag("psi_score").over(order))
        .withColumn("psi_change", change)
        .withColumns(
            {
                "psi_change_pct": F.try_divide(F.col("psi_change"), F.col("psi_previous")),
                "psi_trend": F.when(F.col("psi_change") > 0, "increased")
                .when(F.col("psi_change") < 0, "decreased")
                .when(F.col("psi_change") == 0, "flat")
                .otherwise("first snapshot"),
            }
        )
    )
