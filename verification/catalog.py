"""Every registered query: an operator over the views, whole tables in, one table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType

from creditloom import constants as K
from creditloom.functions import cleaning, months, ratios, scores as score_functions
from creditloom.operators import (
    classification,
    drift,
    evaluation,
    gold,
    history,
    incremental,
    modeling,
    profiling,
    quality,
    registry,
    sampling,
    selection,
    silver,
    temporal,
)
from creditloom.plans import monitoring, training
from creditloom.session import shared_folder
from creditloom.sources import revisions, tables
from verification import views as V

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
DIGITS = 9
LARGE_NUMBERS = {"table_facts"}  # deviations of amounts, shown to 4 digits
EVALUATION_DATE = "2001-01-01"
TRAIN_DATE = "2000-06-01"


def query(function: Query) -> Query:
    """Register a query; its dates leave as text and its numbers rounded, as in the SQL."""

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        digits = 4 if function.__name__ in LARGE_NUMBERS else DIGITS
        return present(function(spark, sf_dir), digits)

    QUERIES[function.__name__] = shown
    return function


def present(df: DataFrame, digits: int) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, FloatType):
            column = column.cast("double")
        elif isinstance(field.dataType, DoubleType):
            column = F.round(column, digits) + F.lit(0.0)
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- Loans: landing, silver, labels -------------------------------------------------------


def loans(spark, sf):
    return silver.silver_loans(V.loan_raw(spark, sf))


def labels(spark, sf):
    return gold.gold_labels(loans(spark, sf))


@query
def bronze_snapshot_filter(spark, sf):
    raw = V.loan_raw(spark, sf)
    return raw.where(F.col("snapshot_date").try_cast("date") == F.lit("1999-03-01").cast("date")).select(
        "loan_id", "Customer_ID", "loan_start_date", "tenure", "installment_num", "snapshot_date"
    )


@query
def source_files(spark, sf):
    """Rows by the file they were read from."""
    rows = tables.read_with_file_name(spark, f"{sf}/orders.parquet")
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"))


@query
def snapshot_row_counts(spark, sf):
    return quality.snapshot_row_counts(loans(spark, sf))


@query
def snapshot_dates(spark, sf):
    return temporal.snapshot_dates(loans(spark, sf), "1997-01-01", "1999-12-31")


@query
def range_scan_missing_months(spark, sf):
    return quality.missing_months(loans(spark, sf), "1994-06-15", "2002-03-20")


@query
def silver_loan_typed(spark, sf):
    return silver.typed_loans(V.loan_raw(spark, sf))


@query
def silver_loan_dpd(spark, sf):
    return loans(spark, sf)


@query
def silver_dedupe(spark, sf):
    return silver.distinct_rows(
        V.loan_raw(spark, sf).select("loan_id", "installment_num", "loan_start_date")
    )


@query
def changed_months(spark, sf):
    """Months to build again where loans of each March changed, Julys are gone and Novembers came."""
    raw = V.loan_raw(spark, sf)
    month = F.month(F.col(K.SNAPSHOT).cast("date"))
    paid = F.when(month == 3, F.lit("0")).otherwise(F.col("paid_amt").cast("string"))
    before = raw.withColumn("paid_amt", F.col("paid_amt").cast("string")).where(month != 11)
    after = raw.withColumn("paid_amt", paid).where(month != 7)
    states = [incremental.content_state(rows, [K.SNAPSHOT]) for rows in (before, after)]
    return incremental.changed_groups(*states, [K.SNAPSHOT])


@query
def gold_label(spark, sf):
    return labels(spark, sf)


@query
def gold_label_default_rate(spark, sf):
    return labels(spark, sf).groupBy("snapshot_date", "label_def").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("label").alias("defaults"),
        F.avg("label").alias("default_rate"),
    )


# --- Features -----------------------------------------------------------------------------


def silver_features(spark, sf):
    return (
        silver.silver_attributes(V.attributes_raw(spark, sf)),
        silver.silver_financials(V.financials_raw(spark, sf)),
        silver.silver_clickstream(V.clickstream(spark, sf)),
    )


@query
def silver_financials_clean(spark, sf):
    return silver.silver_financials(V.financials_raw(spark, sf))


@query
def silver_attributes_clean(spark, sf):
    return silver.silver_attributes(V.attributes_raw(spark, sf))


GOLD_SHOWN = [
    "Customer_ID",
    "snapshot_date",
    "Age",
    "Annual_Income",
    "Outstanding_Debt",
    *[f"fe_{i}" for i in range(1, 6)],
    "debt_to_income_ratio",
    "emi_to_salary_ratio",
    "high_credit_utilization_flag",
    "Credit_History_Age_Months",
]


@query
def gold_features(spark, sf):
    return gold.gold_features(*silver_features(spark, sf), fallback=False).select(*GOLD_SHOWN)


@query
def gold_features_fallback(spark, sf):
    return gold.gold_features(*silver_features(spark, sf)).select(*GOLD_SHOWN)


@query
def gold_derived_ratios(spark, sf):
    return gold.with_derived_features(silver.silver_financials(V.financials_raw(spark, sf))).select(
        "Customer_ID", "debt_to_income_ratio", "emi_to_salary_ratio", "high_credit_utilization_flag"
    )


@query
def credit_history_months(spark, sf):
    return (
        V.financials_raw(spark, sf)
        .groupBy(
            "Credit_History_Age",
            ratios.history_months(F.col("Credit_History_Age")).alias("months"),
        )
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


@query
def quantile_cap(spark, sf):
    features = gold.with_derived_features(silver.silver_financials(V.financials_raw(spark, sf)))
    bounds = profiling.ratio_bounds(features)
    return gold.repaired_features(features, bounds).select(
        "Customer_ID",
        "Annual_Income",
        "Monthly_Balance",
        "debt_to_income_ratio",
        "emi_to_salary_ratio",
        "high_credit_utilization_flag",
        "Credit_History_Age_Months",
    )


@query
def ratio_quantiles(spark, sf):
    features = gold.with_derived_features(silver.silver_financials(V.financials_raw(spark, sf)))
    return profiling.bounds_frame(spark, profiling.ratio_bounds(features))


# --- Data quality -------------------------------------------------------------------------


@query
def dq_duplicates(spark, sf):
    return quality.duplicate_keys(loans(spark, sf), ["loan_id", "installment_num"])


@query
def dq_join_coverage(spark, sf):
    attributes, financials, clicks = silver_features(spark, sf)
    return quality.join_coverage(attributes, {"financials": financials, "clickstream": clicks})


@query
def dq_all_null_columns(spark, sf):
    raw = V.loan_raw(spark, sf)
    checked = raw.withColumns(
        {
            "never_set": F.when(F.col("loan_id") == "", F.col("loan_id")),
            "unreadable": F.concat(F.lit("#"), "loan_id").try_cast("date"),
        }
    )
    return quality.all_null_columns(checked)


@query
def dq_partition_status(spark, sf):
    silver_table = loans(spark, sf)
    return quality.partition_status(
        {"silver": silver_table, "gold_label": labels(spark, sf)},
        "1994-11-01",
        "1996-12-01",
        {"gold_label": "1995-01-01"},
    )


@query
def dq_split_sanity(spark, sf):
    windows = months.training_windows(F.lit(TRAIN_DATE).cast("date"))
    joined = temporal.label_feature_join(labels(spark, sf), V.monthly_features(spark, sf))
    features = selection.model_features(joined.columns)
    return quality.split_sanity(joined, sampling.temporal_split(windows), features)


@query
def split_default_rate(spark, sf):
    windows = months.training_windows(F.lit(TRAIN_DATE).cast("date"))
    return (
        labels(spark, sf)
        .groupBy(sampling.temporal_split(windows).alias("split"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.round(F.avg("label"), 2).alias("default_rate"))
    )


@query
def dq_maturity(spark, sf):
    due = temporal.maturing_predictions(V.predictions(spark, sf), F.col("model_name"))
    return quality.maturity_check(due, EVALUATION_DATE)


# --- Joins across months, calendar --------------------------------------------------------


@query
def label_feature_join(spark, sf):
    return temporal.label_feature_join(labels(spark, sf), V.monthly_features(spark, sf))


def evaluated(spark, sf):
    due = temporal.maturing_predictions(V.predictions(spark, sf), F.col("model_name"))
    return temporal.prediction_label_join(
        temporal.matured(due, EVALUATION_DATE),
        temporal.customer_month_labels(labels(spark, sf)),
    )


@query
def prediction_label_join(spark, sf):
    return evaluated(spark, sf)


@query
def customer_month_labels(spark, sf):
    return temporal.customer_month_labels(labels(spark, sf))


@query
def prediction_defaults(spark, sf):
    """Predictions of an older table: no stored threshold, no stored class."""
    older = V.predictions(spark, sf).drop("prediction_threshold", "label")
    return temporal.maturing_predictions(older, "credit_model").drop("model_name")


@query
def unscored_snapshots(spark, sf):
    features = V.monthly_features(spark, sf)
    scored = V.predictions(spark, sf).where(F.col("snapshot_date") < F.lit("1999-05-01").cast("date"))
    return temporal.unscored_snapshots(features, scored, "1996-01-01", "2000-12-01")


@query
def training_windows(spark, sf):
    """Windows for every order month's last day as training date."""
    orders = V.table(spark, sf, "orders")
    dates = orders.select(F.last_day("o_orderdate").alias("train_date")).distinct()
    return dates.select("train_date", *[
        column.alias(name) for name, column in months.training_windows(F.col("train_date")).items()
    ])


@query
def month_sequence(spark, sf):
    """Months each customer has been buying, with month arithmetic on them."""
    spans = V.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("first_order"),
        F.max("o_orderdate").cast("date").alias("last_order"),
    )
    listed = F.explode(months.month_sequence(F.col("first_order"), F.col("last_order")))
    return spans.select(
        "o_custkey",
        listed.alias("month"),
        months.months_apart(F.col("first_order"), F.col("last_order")).alias("months_apart"),
        months.previous_month(F.col("first_order")).alias("month_before"),
    )


@query
def retrain_cadence(spark, sf):
    return registry.training_cadence(V.artifacts(spark, sf), F.lit("2024-12-01").cast("date"))


# --- Drift --------------------------------------------------------------------------------


def fitted(spark, sf, numeric, text=()):
    return drift.fit_buckets(V.drift_reference(spark, sf), numeric, text)


def drift_query(spark, sf, numeric, text=(), groups=()):
    buckets = fitted(spark, sf, numeric, text)
    return drift.drift_table(
        V.drift_reference(spark, sf), V.drift_current(spark, sf), buckets, [*numeric, *text], groups
    )


@query
def psi_score(spark, sf):
    return drift_query(spark, sf, ["model_score"]).select(
        F.col("csi").alias("psi"), "reference_count", "current_count", "bucket_count"
    )


@query
def csi_numeric(spark, sf):
    return drift_query(spark, sf, V.NUMERIC_DRIFT)


@query
def csi_categorical(spark, sf):
    return drift_query(spark, sf, [], V.TEXT_DRIFT)


@query
def csi_all_features(spark, sf):
    """Score row and all features for every current snapshot at once."""
    return drift_query(spark, sf, ["model_score", *V.NUMERIC_DRIFT], V.TEXT_DRIFT, ["snapshot_date"])


@query
def csi_from_stored_profile(spark, sf):
    """Drift of every current snapshot from the reference's profile, stored and read again."""
    numeric = ["model_score", *V.NUMERIC_DRIFT]
    path = f"{shared_folder(spark)}/profile"
    fitted_rows = drift.drift_profile(V.drift_reference(spark, sf), numeric, V.TEXT_DRIFT)
    revisions.commit(spark, path, drift.PROFILE, lambda _: fitted_rows)
    profile = revisions.read_revision(spark, path, drift.PROFILE)
    columns = [*numeric, *V.TEXT_DRIFT]
    return drift.drift_from_profile(profile, V.drift_current(spark, sf), columns, ["snapshot_date"])


@query
def drift_buckets(spark, sf):
    """Rows per bucket of reference and current, right-closed edges, missing and other apart."""
    columns = [*V.NUMERIC_DRIFT, *V.TEXT_DRIFT]
    buckets = fitted(spark, sf, V.NUMERIC_DRIFT, V.TEXT_DRIFT)
    sides = V.drift_rows(spark, sf).withColumn(
        "is_current", F.col("snapshot_date") >= F.lit(V.DRIFT_FROM).cast("date")
    )
    return drift.bucket_counts(sides, buckets, columns, ["is_current"])


def monitored(spark, sf):
    """PSI and worst CSI per current snapshot."""
    table = drift_query(
        spark, sf, ["model_score", *V.NUMERIC_DRIFT], V.TEXT_DRIFT, ["snapshot_date"]
    )
    score = selection.score_rows(table).select("snapshot_date", F.col("csi").alias("psi_score"))
    worst = drift.worst_feature(selection.feature_rows(table), ["snapshot_date"])
    return score.join(worst, "snapshot_date").withColumn("model_version", F.lit("credit_model"))


@query
def worst_feature(spark, sf):
    return monitored(spark, sf).select("snapshot_date", "max_csi", "max_csi_feature")


@query
def drift_status(spark, sf):
    return drift.with_statuses(monitored(spark, sf), 0.1, 0.25, 0.1, 0.25)


@query
def monitoring_summary(spark, sf):
    """The monitoring job's rows for every current snapshot."""
    detail = monitoring.drift_report(
        V.drift_reference(spark, sf),
        V.drift_current(spark, sf),
        [*V.NUMERIC_DRIFT, *V.TEXT_DRIFT],
    )
    windows = {"feature_start_date": "1995-01-01", "feature_end_date": "1999-12-31"}
    return monitoring.monitoring_summary(detail, "credit_model", windows).drop("created_at")


@query
def csi_ranked(spark, sf):
    """Report rows in reading order: per snapshot the score first, then features by CSI."""
    detail = drift_query(
        spark, sf, ["model_score", *V.NUMERIC_DRIFT], V.TEXT_DRIFT, ["snapshot_date"]
    )
    return monitoring.ordered_detail(detail).select("snapshot_date", "feature_name", "csi")


@query
def psi_trend(spark, sf):
    return drift.drift_trend(monitored(spark, sf)).select(
        "snapshot_date", "psi_score", "psi_previous", "psi_change", "psi_change_pct", "psi_trend"
    )


@query
def retrain_decision(spark, sf):
    """Decisions at the latest snapshot, with low limits; of one family nothing was monitored."""
    rows = drift.with_statuses(monitored(spark, sf), 0.01, 0.02, 0.01, 0.02)
    latest = rows.agg(F.max("snapshot_date")).first()[0]
    typed = rows.withColumn("model_type", F.lit(K.MODEL_TYPES[0]))
    return registry.retrain_decisions(typed, F.lit(latest))


@query
def top_levels(spark, sf):
    return drift.top_levels(V.drift_reference(spark, sf), V.TEXT_DRIFT, K.CATEGORICAL_TOP_N)


@query
def history_slice(spark, sf):
    table = drift_query(spark, sf, ["model_score", "total_price"], ["priority"], ["snapshot_date"])
    return (
        selection.score_rows(table)
        .withColumn("part", F.lit("score"))
        .unionByName(selection.feature_rows(table).withColumn("part", F.lit("feature")))
        .select("part", "snapshot_date", "feature_name", "csi")
    )


# --- Metrics ------------------------------------------------------------------------------


def by_month(spark, sf):
    return classification.score_counts(
        V.scores(spark, sf), ["snapshot_date"], F.col("model_predictions"), F.col("actual_label")
    )


@query
def auc_gini(spark, sf):
    ranked = classification.ranking_metrics(by_month(spark, sf), ["snapshot_date"])
    return ranked.select("snapshot_date", "auc", "gini")


@query
def auc_overall(spark, sf):
    """One AUC over all rows by a score that hardly repeats."""
    amounts = V.scores(spark, sf).withColumn("score", F.col("amount") / 200000)
    counts = classification.score_counts(amounts, [], F.col("score"), F.col("actual_label"))
    return classification.ranking_metrics(counts)


@query
def brier_logloss(spark, sf):
    ranked = classification.ranking_metrics(by_month(spark, sf), ["snapshot_date"])
    return ranked.select("snapshot_date", "brier", "log_loss")


@query
def confusion_metrics(spark, sf):
    counts = classification.confusion_counts(F.col("actual_label"), F.col("label"))
    return classification.with_class_metrics(
        V.scores(spark, sf).groupBy("snapshot_date").agg(*counts)
    )


@query
def score_to_class(spark, sf):
    stored = V.predictions(spark, sf)
    override = score_functions.score_class(F.col("model_predictions"), 0.65)
    own = score_functions.score_class(F.col("model_predictions"), F.col("prediction_threshold"))
    return stored.select(
        "Customer_ID", "snapshot_date", own.alias("own_class"), override.alias("override_class")
    )


def swept(spark, sf):
    scored = V.scores(spark, sf).withColumn("year", F.year("snapshot_date"))
    return classification.threshold_sweep(
        scored, ["year"], F.col("model_predictions"), F.col("actual_label")
    )


@query
def threshold_sweep(spark, sf):
    return swept(spark, sf)


@query
def best_threshold(spark, sf):
    return classification.best_threshold(swept(spark, sf), ["year"])


@query
def score_bands(spark, sf):
    scored = V.scores(spark, sf).withColumnRenamed("label", "predicted_label")
    return evaluation.score_bands(scored).drop("score_band")


@query
def score_bands_matured(spark, sf):
    return evaluation.score_bands(evaluated(spark, sf)).drop("score_band")


@query
def performance_state(spark, sf):
    return evaluation.performance_state(evaluated(spark, sf))


@query
def score_bands_from_state(spark, sf):
    return evaluation.state_bands(performance_state(spark, sf)).drop("score_band")


@query
def performance_summary(spark, sf):
    return evaluation.performance_summary(evaluated(spark, sf), EVALUATION_DATE).drop("created_at")


@query
def overall_performance(spark, sf):
    return selection.overall_performance(performance_summary(spark, sf))


@query
def monthly_performance(spark, sf):
    return selection.monthly_performance(performance_summary(spark, sf))


# --- Histories and registry ---------------------------------------------------------------


def month_totals(spark, sf):
    """A history: one row per order status and month, with a row count."""
    return (
        V.table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderstatus").alias("model_version"),
            F.trunc("o_orderdate", "month").alias("snapshot_date"),
        )
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


@query
def history_upsert(spark, sf):
    old = month_totals(spark, sf).where(F.year("snapshot_date") <= 1999)
    new = month_totals(spark, sf).where(F.year("snapshot_date") >= 1999).withColumn(
        "row_count", F.col("row_count") + 1000
    )
    return history.upserted(old, new, K.MONITORING_KEY)


@query
def history_in_order(spark, sf):
    return history.in_order(month_totals(spark, sf), "model_version", newest="snapshot_date")


@query
def keep_last_dedupe(spark, sf):
    """Of all line items of an order and line the last shipped; ties by part."""
    return history.latest_by_key(
        V.scores(spark, sf).select("loan_id", "line", "snapshot_date", "part", "amount"),
        ["loan_id", "line"],
        ["snapshot_date", "part", "amount"],
    )


@query
def latest_row(spark, sf):
    return history.latest_per_model(month_totals(spark, sf), "snapshot_date")


def reconciled(spark, sf):
    return registry.reconciled(V.artifacts(spark, sf), V.old_log(spark, sf))


@query
def registry_rejects(spark, sf):
    """Invalid artifacts with their reasons."""
    return registry.rejected_artifacts(V.artifacts(spark, sf))


@query
def registry_champions(spark, sf):
    return reconciled(spark, sf).select(
        "model_version", "model_type", "auc_oot", "auc_test", "auc_train", "champion", "challenger"
    )


@query
def registry_diff(spark, sf):
    return registry.version_changes(
        registry.valid_artifacts(V.artifacts(spark, sf)), V.old_log(spark, sf)
    )


@query
def registry_promotion(spark, sf):
    """Every artifact as a newcomer against the champions of all types but one."""
    known = reconciled(spark, sf).where(F.col("model_type") != "other")
    newcomers = registry.valid_artifacts(V.artifacts(spark, sf))
    return registry.promotion(known, newcomers).select(
        "model_version", "model_type", "champion", "challenger"
    )


@query
def registry_selection(spark, sf):
    """The type other has only a challenger and log_reg two champions here."""
    rows = reconciled(spark, sf).withColumn(
        "champion",
        F.when(F.col("model_type") == "other", 0)
        .when((F.col("model_type") == "log_reg") & (F.col("challenger") == 1), 1)
        .otherwise(F.col("champion")),
    )
    return registry.selection_by_type(rows)


@query
def version_counter(spark, sf):
    """Next version per base name; half of the base names have no version yet."""
    suppliers = V.table(spark, sf, "supplier")
    base = F.concat(F.lit("credit_model_"), F.col("s_nationkey").cast("string"))
    versions = suppliers.select(
        F.concat(base, F.lit("_v"), F.col("s_suppkey").cast("string")).alias("model_version")
    )
    names = F.explode(F.array(base, F.concat(base, F.lit("_new")))).alias("base_name")
    return registry.next_version_numbers(versions, suppliers.select(names).distinct())


# --- Profiles -----------------------------------------------------------------------------


@query
def column_profile(spark, sf):
    return profiling.column_profile(V.financials_raw(spark, sf))


@query
def numeric_describe(spark, sf):
    financials = silver.silver_financials(V.financials_raw(spark, sf))
    numeric, _ = selection.split_by_type(financials, financials.columns)
    return profiling.numeric_summary(financials, numeric)


@query
def histogram(spark, sf):
    return profiling.histograms(
        V.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], K.COLUMN_HISTOGRAM_BINS
    )


@query
def score_histogram(spark, sf):
    return profiling.histograms(
        V.scores(spark, sf), ["model_predictions"], K.SCORE_HISTOGRAM_BINS
    )


@query
def top_values(spark, sf):
    return profiling.top_values(V.scores(spark, sf), "part")


@query
def most_common_value(spark, sf):
    return profiling.most_common(
        V.financials_raw(spark, sf), ["Credit_Mix", "Credit_History_Age", "Payment_Behaviour"]
    )


@query
def table_facts(spark, sf):
    joined = temporal.label_feature_join(labels(spark, sf), V.monthly_features(spark, sf))
    return profiling.table_facts(joined, ["fe_largest", "fe_smallest", "fe_orders"], "label")


@query
def prediction_summary(spark, sf):
    return profiling.prediction_summary(V.scores(spark, sf))


@query
def snapshot_score_stats(spark, sf):
    return profiling.snapshot_score_stats(V.predictions(spark, sf))


@query
def lookback_snapshots(spark, sf):
    return profiling.lookback_snapshots(loans(spark, sf), 12, "2000-08-15")


@query
def sample_head(spark, sf):
    return profiling.sample_head(
        V.predictions(spark, sf).drop("model_name"), ["snapshot_date", "Customer_ID"]
    )


# --- Projections and sets -----------------------------------------------------------------


@query
def projection_helpers(spark, sf):
    """Rename, drop, constants, prefix and exclusion choice, type split and the all-null filter."""
    joined = temporal.label_feature_join(labels(spark, sf), V.monthly_features(spark, sf))
    features = selection.model_features(joined.columns)
    numeric, text = selection.split_by_type(joined, features)
    kept = selection.with_any_value(joined, features)
    return (
        kept.select("loan_id", "Customer_ID", *numeric, *text)
        .withColumnsRenamed({name: f"_fallback_{name}" for name in selection.prefixed(numeric)})
        .withColumn("source", F.lit("training"))
        .drop("order_status")
    )


@query
def membership(spark, sf):
    orders = V.table(spark, sf, "orders")
    kept = selection.member_or_other(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])
    return orders.groupBy(kept.alias("priority")).agg(F.count(F.lit(1)).alias("row_count"))


@query
def union_by_name(spark, sf):
    """Suppliers and customers as one table; a column one side lacks is null there."""
    customers = V.table(spark, sf, "customer").selectExpr(
        "c_name as name", "c_acctbal as balance", "c_mktsegment as segment"
    )
    suppliers = V.table(spark, sf, "supplier").selectExpr("s_acctbal as balance", "s_name as name")
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query
def known_model_versions(spark, sf):
    return history.known_versions(
        V.artifacts(spark, sf),
        V.old_log(spark, sf),
        month_totals(spark, sf),
        V.predictions(spark, sf).select(F.col("model_name").alias("model_version")),
    )


@query
def distinct_classes(spark, sf):
    return labels(spark, sf).groupBy("snapshot_date").agg(
        F.count_distinct("label").alias("label_classes")
    )


@query
def dirty_numbers(spark, sf):
    """The same dirty text read as float and as int."""
    raw = V.financials_raw(spark, sf)
    value = F.col("Num_of_Delayed_Payment")
    return raw.groupBy(
        value.alias("raw"),
        cleaning.repaired_float(value).alias("as_float"),
        cleaning.repaired_int(value).alias("as_int"),
    ).agg(F.count(F.lit(1)).alias("row_count"))


# --- Splits and models --------------------------------------------------------------------


@query
def stratified_split(spark, sf):
    amount = F.col("amount").cast("decimal(18,2)").cast("string")
    key = F.concat_ws("/", "loan_id", "line", "part", amount)
    rows = V.scores(spark, sf).withColumn("row_key", key)
    split = sampling.with_stratified_holdout(
        rows.select("row_key", "actual_label"), "actual_label", ["row_key"]
    )
    return split.groupBy("actual_label", "holdout").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("row_key").alias("last_key")
    )


def _fitted_model(spark, sf, model_type, params):
    """Label/feature join, temporal and stratified split, one parameter point, calibration."""
    return training.fit_model(
        labels(spark, sf),
        V.monthly_features(spark, sf),
        TRAIN_DATE,
        model_type,
        [params],
    )


@query
def logreg_train_score(spark, sf):
    fit = _fitted_model(
        spark, sf, K.LOG_REG, {"C": 1.0, "class_weight": "balanced", "max_iter": 500}
    )
    return modeling.with_score(V.monthly_features(spark, sf), fit.model).select(
        "Customer_ID", "snapshot_date", "model_predictions"
    )


@query
def gbt_train_score(spark, sf):
    fit = _fitted_model(
        spark,
        sf,
        K.BOOSTED_TREES,
        {
            "n_estimators": 25,
            "max_depth": 2,
            "learning_rate": 0.1,
            "subsample": 0.8,
            "colsample_bytree": 0.8,
            "gamma": 0,
            "min_child_weight": 1,
        },
    )
    return modeling.with_score(V.monthly_features(spark, sf), fit.model).select(
        "Customer_ID", "snapshot_date", "model_predictions"
    )


@query
def platt_calibrate(spark, sf):
    """Sigmoid calibration of the line item scores."""
    rows = V.scores(spark, sf).withColumn("label", F.col("actual_label"))
    scored = VectorAssembler(
        inputCols=["model_predictions"], outputCol=modeling.CALIBRATION_INPUT
    ).transform(rows)
    calibrated = modeling.fit_sigmoid(scored).transform(scored)
    return calibrated.groupBy("model_predictions").agg(
        F.max(vector_to_array(modeling.CALIBRATED)[1]).alias("calibrated"),
        F.count(F.lit(1)).alias("row_count"),
    )


@query
def bootstrap_sample(spark, sf):
    stored = V.predictions(spark, sf)
    return sampling.bootstrap_sample(stored, 0.5, K.SPLIT_SEED, ["Customer_ID", "snapshot_date"])
