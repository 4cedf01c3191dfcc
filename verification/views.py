"""Credit-shaped views over the star-schema tables.

Plain expressions only, mirrored in ``oracle.py``; every view covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE_SNAPSHOT = "2024-01-01"
DRIFT_FROM = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month_text(column: str) -> str:
    return f"cast(trunc({column}, 'month') as string)"


def loan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans as landed: text columns with some unreadable and some missing values."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).selectExpr(
        "cast(l_orderkey as string) as loan_id",
        "cast(o_custkey as string) as Customer_ID",
        f"{_month_text('o_orderdate')} as loan_start_date",
        "'10' as tenure",
        "cast(l_linenumber as string) as installment_num",
        "cast(o_totalprice as string) as loan_amt",
        "case when l_partkey % 97 = 0 then '0' else cast(l_extendedprice as string) end as due_amt",
        "case when l_partkey % 89 <> 0 then cast(l_extendedprice as string) end as paid_amt",
        "case when l_returnflag = 'R' then cast(l_extendedprice * (1 + l_orderkey % 4) as string)"
        " else '0' end as overdue_amt",
        "case when l_suppkey % 13 = 0 then 'n/a' else cast(o_totalprice as string) end as balance",
        f"{_month_text('l_shipdate')} as snapshot_date",
    )


def attributes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) as Customer_ID",
        "c_name as Name",
        "concat(cast(c_custkey % 1000 as string), '-', cast(c_nationkey as string)) as SSN",
        "concat(cast(c_nationkey * 6 - 10 as string), case when c_custkey % 10 = 0 then '_'"
        " when c_custkey % 23 = 0 then '.5' else '' end) as Age",
        "c_mktsegment as Occupation",
        f"'{FEATURE_SNAPSHOT}' as snapshot_date",
    )


def financials_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer finances as dirty text; sums are decimals, so they do not depend on row order."""
    spent = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"),
            F.min("o_totalprice").alias("smallest"),
            F.max("o_totalprice").alias("largest"),
            F.count(F.lit(1)).alias("n_orders"),
            F.max("o_orderpriority").alias("priority"),
        )
    )
    customers = table(spark, sf_dir, "customer")
    return customers.join(spent, customers["c_custkey"] == spent["o_custkey"], "left").selectExpr(
        "cast(c_custkey as string) as Customer_ID",
        "concat(cast(total as string), case when c_custkey % 7 = 0 then '_' else '' end)"
        " as Annual_Income",
        "case when c_custkey % 31 = 0 then 'abc' else cast(smallest as string) end"
        " as Monthly_Inhand_Salary",
        "concat('_', cast(c_acctbal as string), '_') as Changed_Credit_Limit",
        "cast(c_custkey % 25 - 2 as string) as Num_Credit_Inquiries",
        "cast(c_acctbal as string) as Outstanding_Debt",
        "cast(abs(c_acctbal) / 100 as string) as Credit_Utilization_Ratio",
        "case when c_custkey % 19 <> 0 then cast(largest as string) end as Total_EMI_per_month",
        "case when c_custkey % 11 = 0 then '__10000__' else cast(n_orders * 100 as string) end"
        " as Amount_invested_monthly",
        "case when c_custkey % 17 = 0 then '__-333333__' else cast(c_acctbal as string) end"
        " as Monthly_Balance",
        "cast(c_custkey % 20 as string) as Num_Bank_Accounts",
        "concat(cast(c_custkey % 18 as string), case when c_custkey % 5 = 0 then '_' else '' end)"
        " as Num_Credit_Card",
        "cast(c_custkey % 120 as string) as Interest_Rate",
        "cast(c_custkey % 9 - 1 as string) as Num_of_Loan",
        "cast(c_custkey % 70 - 5 as string) as Delay_from_due_date",
        "concat(cast(c_custkey % 30 as string), case when c_custkey % 4 = 0 then '.5' else '' end)"
        " as Num_of_Delayed_Payment",
        "c_mktsegment as Type_of_Loan",
        "case c_custkey % 3 when 0 then 'Good' when 1 then 'Standard' else 'Bad' end as Credit_Mix",
        "case when c_custkey % 13 = 0 then null"
        " when c_custkey % 29 = 0 then 'x'"
        " when c_custkey % 37 = 0 then '5 Years'"
        " else concat(cast(c_custkey % 31 as string), ' Years and ', cast(c_custkey % 12 as string),"
        " ' Months') end as Credit_History_Age",
        "case c_custkey % 3 when 0 then 'Yes' when 1 then 'No' else 'NM' end"
        " as Payment_of_Min_Amount",
        "priority as Payment_Behaviour",
        f"'{FEATURE_SNAPSHOT}' as snapshot_date",
    )


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per user, month and kind of event, kinds as columns fe_1 … fe_5."""
    kinds = ["click", "error", "purchase", "signup", "view"]  # fe_1 … fe_5
    by_kind = [
        F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(f"fe_{i}")
        for i, kind in enumerate(kinds, 1)
    ]
    events = table(spark, sf_dir, "events").withColumn(
        "snapshot_date", F.trunc("ts", "month")
    )
    return events.groupBy(
        F.col("user_id").cast("string").alias("Customer_ID"), "snapshot_date"
    ).agg(*by_kind)


def monthly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature store with one row per customer and order month."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_custkey").cast("string").alias("Customer_ID"),
            F.trunc("o_orderdate", "month").alias("snapshot_date"),
        )
        .agg(
            F.max("o_totalprice").alias("fe_largest"),
            F.min("o_totalprice").alias("fe_smallest"),
            F.count(F.lit(1)).alias("fe_orders"),
            F.min(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))).alias("priority"),
            F.max("o_orderstatus").alias("order_status"),
        )
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored rows: many tied scores, an actual and a predicted class."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey as string) as loan_id",
        "trunc(l_shipdate, 'month') as snapshot_date",
        "l_quantity / 50 as model_predictions",
        "0.5D as prediction_threshold",
        "cast(l_quantity / 50 >= 0.5D as int) as label",
        "cast(l_returnflag = 'R' as int) as actual_label",
        "l_linenumber as line",
        "l_extendedprice as amount",
        "l_partkey as part",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored prediction per customer and order month; thresholds differ by customer.

    The divisor gives scores without short decimals, so rounded averages do not end in ties.
    """
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_custkey").cast("string").alias("Customer_ID"),
            F.trunc("o_orderdate", "month").alias("snapshot_date"),
        )
        .agg((F.max("o_totalprice") / 600011).alias("model_predictions"))
        .withColumns(
            {
                "model_name": F.lit("credit_model"),
                "prediction_threshold": F.when(
                    F.col("Customer_ID").cast("long") % 3 == 0, F.lit(0.4)
                ).otherwise(F.lit(0.5)),
            }
        )
        .withColumn(
            "label", (F.col("model_predictions") >= F.col("prediction_threshold")).cast("int")
        )
    )


def drift_rows(spark: SparkSession, sf_dir: str, dates: str = "true") -> DataFrame:
    """Orders as a scored population with numeric and text features, some of them missing.

    ``dates`` is a condition on the order date, which reaches the scan.
    """
    return table(spark, sf_dir, "orders").where(dates).selectExpr(
        "trunc(o_orderdate, 'month') as snapshot_date",
        "o_totalprice / 600000 as model_score",
        "case when o_orderkey % 50 <> 0 then o_totalprice end as total_price",
        "o_custkey % 100 as customer_group",
        "1 as constant_value",
        "case when o_orderkey % 40 <> 0 then o_orderpriority end as priority",
        "o_orderstatus as order_status",
        "concat('clerk ', cast(o_custkey % 50 as string)) as clerk",
    )


NUMERIC_DRIFT = ["total_price", "customer_group", "constant_value"]
TEXT_DRIFT = ["priority", "order_status", "clerk"]


def drift_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_rows(spark, sf_dir, f"o_orderdate < date'{DRIFT_FROM}'")


def drift_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_rows(spark, sf_dir, f"o_orderdate >= date'{DRIFT_FROM}'")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as model artifacts: AUCs with ties, some invalid file stems and missing AUCs."""
    cents = "cast(round(s_acctbal * 100) as bigint)"
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_name as model_version",
        "case s_nationkey % 3 when 0 then 'xgboost' when 1 then 'log_reg' else 'other' end"
        " as model_type",
        "case when s_suppkey % 19 = 0 then concat(s_name, '_copy') else s_name end as file_stem",
        "cast(add_months(date'2024-01-01', cast(s_suppkey % 10 as int)) as string)"
        " as train_date",
        f"0.5D + pmod({cents}, 13) / 40D as auc_train",
        f"0.5D + pmod({cents}, 11) / 40D as auc_test",
        f"case when s_suppkey % 23 <> 0 then 0.5D + pmod({cents}, 7) / 40D end as auc_oot",
    )


def old_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier log: some of the artifacts, and some versions that are gone.

    It names one champion of type xgboost, several of type log_reg and none of type other.
    """
    models = artifacts(spark, sf_dir)
    usable = (F.col("file_stem") == F.col("model_version")) & F.col("auc_oot").isNotNull()
    first = (
        models.where((F.col("model_type") == "xgboost") & usable)
        .groupBy("model_type")
        .agg(F.min("model_version").alias("first_version"))
    )
    ending = F.substring("model_version", -1, 1)
    champion = F.when(
        F.col("model_type") == "xgboost", F.col("model_version") == F.col("first_version")
    ).otherwise((F.col("model_type") == "log_reg") & (ending == "2"))
    kept = (
        models.where(ending != "5")
        .join(F.broadcast(first), "model_type", "left")
        .select("model_version", "model_type", champion.cast("int").alias("champion"))
    )
    gone = models.where(ending == "7").select(
        F.concat("model_version", F.lit("_old")).alias("model_version"),
        "model_type",
        F.lit(0).alias("champion"),
    )
    return kept.unionByName(gone)
