"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

import re

from creditloom.constants import MODEL_TYPES
from verification.views import DRIFT_FROM, FEATURE_SNAPSHOT

EVALUATION_DATE = "2001-01-01"

# --- Views: name -> SQL; each may use the ones before it ----------------------------------

VIEWS: dict[str, str] = {
    "loan_raw": """
        SELECT l_orderkey::VARCHAR AS loan_id, o_custkey::VARCHAR AS Customer_ID,
          strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS loan_start_date,
          '10' AS tenure, l_linenumber::VARCHAR AS installment_num,
          o_totalprice::VARCHAR AS loan_amt,
          CASE WHEN l_partkey % 97 = 0 THEN '0' ELSE l_extendedprice::VARCHAR END AS due_amt,
          CASE WHEN l_partkey % 89 <> 0 THEN l_extendedprice::VARCHAR END AS paid_amt,
          CASE WHEN l_returnflag = 'R' THEN (l_extendedprice * (1 + l_orderkey % 4))::VARCHAR
            ELSE '0' END AS overdue_amt,
          CASE WHEN l_suppkey % 13 = 0 THEN 'n/a' ELSE o_totalprice::VARCHAR END AS balance,
          strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS snapshot_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "loan_typed": """
        SELECT loan_id, Customer_ID, loan_start_date::DATE AS loan_start_date,
          tenure::INTEGER AS tenure, installment_num::INTEGER AS installment_num,
          TRY_CAST(loan_amt AS FLOAT) AS loan_amt, TRY_CAST(due_amt AS FLOAT) AS due_amt,
          TRY_CAST(paid_amt AS FLOAT) AS paid_amt, TRY_CAST(overdue_amt AS FLOAT) AS overdue_amt,
          TRY_CAST(balance AS FLOAT) AS balance, snapshot_date::DATE AS snapshot_date
        FROM loan_raw""",
    "loan_missed": """
        SELECT loan_id, Customer_ID, loan_start_date, coalesce(tenure, 0) AS tenure,
          coalesce(installment_num, 0) AS installment_num, coalesce(loan_amt, 0) AS loan_amt,
          coalesce(due_amt, 0) AS due_amt, coalesce(paid_amt, 0) AS paid_amt,
          coalesce(overdue_amt, 0) AS overdue_amt, coalesce(balance, 0) AS balance,
          snapshot_date, coalesce(installment_num, 0) AS mob,
          coalesce(ceil(overdue_amt::DOUBLE / nullif(due_amt::DOUBLE, 0))::INTEGER, 0)
            AS installments_missed
        FROM loan_typed""",
    "loan_silver": """
        SELECT *, CASE WHEN overdue_amt > 0 THEN (snapshot_date - first_missed_date)::INTEGER
            ELSE 0 END AS dpd
        FROM (SELECT *, CASE WHEN installments_missed > 0
            THEN (snapshot_date - to_months(installments_missed))::DATE END AS first_missed_date
          FROM loan_missed)""",
    "gold_label": """
        SELECT loan_id, Customer_ID, CASE WHEN dpd >= 30 THEN 1 ELSE 0 END AS label,
          '30dpd_6mob' AS label_def, snapshot_date
        FROM loan_silver WHERE mob = 6""",
    "attributes_raw": f"""
        SELECT c_custkey::VARCHAR AS Customer_ID, c_name AS Name,
          (c_custkey % 1000)::VARCHAR || '-' || c_nationkey::VARCHAR AS SSN,
          (c_nationkey * 6 - 10)::VARCHAR || CASE WHEN c_custkey % 10 = 0 THEN '_'
            WHEN c_custkey % 23 = 0 THEN '.5' ELSE '' END AS Age,
          c_mktsegment AS Occupation, '{FEATURE_SNAPSHOT}' AS snapshot_date
        FROM customer""",
    "attributes": """
        SELECT Customer_ID, Name, SSN,
          CASE WHEN a BETWEEN 0 AND 100 THEN a END AS Age, Occupation, snapshot_date::DATE AS snapshot_date
        FROM (SELECT *, trunc(TRY_CAST(replace(Age, '_', '') AS DOUBLE))::INTEGER AS a
          FROM attributes_raw)""",
    "financials_raw": f"""
        SELECT c_custkey::VARCHAR AS Customer_ID,
          total::VARCHAR || CASE WHEN c_custkey % 7 = 0 THEN '_' ELSE '' END AS Annual_Income,
          CASE WHEN c_custkey % 31 = 0 THEN 'abc' ELSE smallest::VARCHAR END
            AS Monthly_Inhand_Salary,
          '_' || c_acctbal::VARCHAR || '_' AS Changed_Credit_Limit,
          (c_custkey % 25 - 2)::VARCHAR AS Num_Credit_Inquiries,
          c_acctbal::VARCHAR AS Outstanding_Debt,
          (abs(c_acctbal) / 100)::VARCHAR AS Credit_Utilization_Ratio,
          CASE WHEN c_custkey % 19 <> 0 THEN largest::VARCHAR END AS Total_EMI_per_month,
          CASE WHEN c_custkey % 11 = 0 THEN '__10000__' ELSE (n_orders * 100)::VARCHAR END
            AS Amount_invested_monthly,
          CASE WHEN c_custkey % 17 = 0 THEN '__-333333__' ELSE c_acctbal::VARCHAR END
            AS Monthly_Balance,
          (c_custkey % 20)::VARCHAR AS Num_Bank_Accounts,
          (c_custkey % 18)::VARCHAR || CASE WHEN c_custkey % 5 = 0 THEN '_' ELSE '' END
            AS Num_Credit_Card,
          (c_custkey % 120)::VARCHAR AS Interest_Rate,
          (c_custkey % 9 - 1)::VARCHAR AS Num_of_Loan,
          (c_custkey % 70 - 5)::VARCHAR AS Delay_from_due_date,
          (c_custkey % 30)::VARCHAR || CASE WHEN c_custkey % 4 = 0 THEN '.5' ELSE '' END
            AS Num_of_Delayed_Payment,
          c_mktsegment AS Type_of_Loan,
          CASE c_custkey % 3 WHEN 0 THEN 'Good' WHEN 1 THEN 'Standard' ELSE 'Bad' END AS Credit_Mix,
          CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'x'
            WHEN c_custkey % 37 = 0 THEN '5 Years'
            ELSE (c_custkey % 31)::VARCHAR || ' Years and ' || (c_custkey % 12)::VARCHAR
              || ' Months' END AS Credit_History_Age,
          CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'NM' END
            AS Payment_of_Min_Amount,
          priority AS Payment_Behaviour, '{FEATURE_SNAPSHOT}' AS snapshot_date
        FROM customer LEFT JOIN (
          SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) AS total, min(o_totalprice) AS smallest,
            max(o_totalprice) AS largest, count(*) AS n_orders, max(o_orderpriority) AS priority
          FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
    "financials_numbers": """
        SELECT Customer_ID,
          TRY_CAST(replace(Annual_Income, '_', '') AS FLOAT) AS Annual_Income,
          TRY_CAST(replace(Monthly_Inhand_Salary, '_', '') AS FLOAT) AS Monthly_Inhand_Salary,
          TRY_CAST(replace(Changed_Credit_Limit, '_', '') AS FLOAT) AS Changed_Credit_Limit,
          TRY_CAST(replace(Num_Credit_Inquiries, '_', '') AS FLOAT) AS Num_Credit_Inquiries,
          TRY_CAST(replace(Outstanding_Debt, '_', '') AS FLOAT) AS Outstanding_Debt,
          TRY_CAST(replace(Credit_Utilization_Ratio, '_', '') AS FLOAT) AS Credit_Utilization_Ratio,
          TRY_CAST(replace(Total_EMI_per_month, '_', '') AS FLOAT) AS Total_EMI_per_month,
          TRY_CAST(replace(Amount_invested_monthly, '_', '') AS FLOAT) AS Amount_invested_monthly,
          TRY_CAST(replace(Monthly_Balance, '_', '') AS FLOAT) AS Monthly_Balance,
          trunc(TRY_CAST(replace(Num_Bank_Accounts, '_', '') AS DOUBLE))::INTEGER AS Num_Bank_Accounts,
          trunc(TRY_CAST(replace(Num_Credit_Card, '_', '') AS DOUBLE))::INTEGER AS Num_Credit_Card,
          trunc(TRY_CAST(replace(Interest_Rate, '_', '') AS DOUBLE))::INTEGER AS Interest_Rate,
          trunc(TRY_CAST(replace(Num_of_Loan, '_', '') AS DOUBLE))::INTEGER AS Num_of_Loan,
          trunc(TRY_CAST(replace(Delay_from_due_date, '_', '') AS DOUBLE))::INTEGER AS Delay_from_due_date,
          trunc(TRY_CAST(replace(Num_of_Delayed_Payment, '_', '') AS DOUBLE))::INTEGER
            AS Num_of_Delayed_Payment,
          Type_of_Loan, Credit_Mix, Credit_History_Age, Payment_of_Min_Amount, Payment_Behaviour,
          snapshot_date::DATE AS snapshot_date
        FROM financials_raw""",
    "financials": """
        SELECT * REPLACE (
          CASE WHEN Annual_Income >= 0 THEN Annual_Income END AS Annual_Income,
          CASE WHEN Monthly_Inhand_Salary >= 0 THEN Monthly_Inhand_Salary END AS Monthly_Inhand_Salary,
          CASE WHEN Num_Credit_Inquiries >= 0 THEN Num_Credit_Inquiries END AS Num_Credit_Inquiries,
          CASE WHEN Outstanding_Debt >= 0 THEN Outstanding_Debt END AS Outstanding_Debt,
          CASE WHEN Credit_Utilization_Ratio >= 0 THEN Credit_Utilization_Ratio END
            AS Credit_Utilization_Ratio,
          CASE WHEN Total_EMI_per_month >= 0 THEN Total_EMI_per_month END AS Total_EMI_per_month,
          CASE WHEN Amount_invested_monthly >= 0 THEN Amount_invested_monthly END
            AS Amount_invested_monthly,
          CASE WHEN Monthly_Balance >= 0 THEN Monthly_Balance END AS Monthly_Balance,
          CASE WHEN Delay_from_due_date >= 0 THEN Delay_from_due_date END AS Delay_from_due_date,
          CASE WHEN Num_Bank_Accounts BETWEEN 0 AND 15 THEN Num_Bank_Accounts END AS Num_Bank_Accounts,
          CASE WHEN Num_Credit_Card BETWEEN 0 AND 15 THEN Num_Credit_Card END AS Num_Credit_Card,
          CASE WHEN Interest_Rate BETWEEN 0 AND 100 THEN Interest_Rate END AS Interest_Rate)
        FROM financials_numbers""",
    "clickstream": """
        SELECT user_id::VARCHAR AS Customer_ID, date_trunc('month', ts)::DATE AS snapshot_date,
          avg(value) FILTER (event_type = 'click') AS fe_1,
          avg(value) FILTER (event_type = 'error') AS fe_2,
          avg(value) FILTER (event_type = 'purchase') AS fe_3,
          avg(value) FILTER (event_type = 'signup') AS fe_4,
          avg(value) FILTER (event_type = 'view') AS fe_5
        FROM events GROUP BY ALL""",
    "gold_joined": """
        SELECT a.Customer_ID, a.snapshot_date, a.Age, f.* EXCLUDE (Customer_ID, snapshot_date),
          c.fe_1, c.fe_2, c.fe_3, c.fe_4, c.fe_5
        FROM attributes a
        LEFT JOIN financials f ON a.Customer_ID = f.Customer_ID AND a.snapshot_date = f.snapshot_date
        LEFT JOIN clickstream c ON a.Customer_ID = c.Customer_ID AND a.snapshot_date = c.snapshot_date""",
    "monthly_features": """
        SELECT o_custkey::VARCHAR AS Customer_ID, date_trunc('month', o_orderdate)::DATE AS snapshot_date,
          max(o_totalprice) AS fe_largest, min(o_totalprice) AS fe_smallest, count(*) AS fe_orders,
          min(o_orderpriority) FILTER (o_orderkey % 5 <> 0) AS priority,
          max(o_orderstatus) AS order_status
        FROM orders GROUP BY ALL""",
    "scores": """
        SELECT l_orderkey::VARCHAR AS loan_id, date_trunc('month', l_shipdate)::DATE AS snapshot_date,
          l_quantity / 50 AS model_predictions, 0.5::DOUBLE AS prediction_threshold,
          (l_quantity / 50 >= 0.5)::INTEGER AS label, (l_returnflag = 'R')::INTEGER AS actual_label,
          l_linenumber AS line, l_extendedprice AS amount, l_partkey AS part
        FROM lineitem""",
    "predictions": """
        SELECT *, (model_predictions >= prediction_threshold)::INTEGER AS label
        FROM (SELECT o_custkey::VARCHAR AS Customer_ID,
            date_trunc('month', o_orderdate)::DATE AS snapshot_date,
            max(o_totalprice) / 600011 AS model_predictions, 'credit_model' AS model_name,
            CASE WHEN o_custkey % 3 = 0 THEN 0.4 ELSE 0.5 END::DOUBLE AS prediction_threshold
          FROM orders GROUP BY o_custkey, date_trunc('month', o_orderdate))""",
    "month_labels": """
        SELECT Customer_ID, snapshot_date AS label_snapshot_date, max(label) AS actual_label,
          min(label_def) AS label_def
        FROM gold_label GROUP BY Customer_ID, snapshot_date""",
    "due_predictions": """
        SELECT * EXCLUDE (label), snapshot_date AS prediction_snapshot_date,
          (snapshot_date + INTERVAL 6 MONTH)::DATE AS label_snapshot_date,
          model_name AS model_version, label AS predicted_label
        FROM predictions""",
    "evaluated": f"""
        SELECT p.*, l.actual_label, l.label_def
        FROM due_predictions p JOIN month_labels l
          ON p.Customer_ID = l.Customer_ID AND p.label_snapshot_date = l.label_snapshot_date
        WHERE p.label_snapshot_date <= DATE '{EVALUATION_DATE}'""",
    "drift_rows": f"""
        SELECT date_trunc('month', o_orderdate)::DATE AS snapshot_date,
          o_totalprice / 600000 AS model_score,
          CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS total_price,
          o_custkey % 100 AS customer_group, 1 AS constant_value,
          CASE WHEN o_orderkey % 40 <> 0 THEN o_orderpriority END AS priority,
          o_orderstatus AS order_status, 'clerk ' || (o_custkey % 50)::VARCHAR AS clerk,
          date_trunc('month', o_orderdate)::DATE >= DATE '{DRIFT_FROM}' AS is_current
        FROM orders""",
    "drift_numbers": """
        UNPIVOT (SELECT is_current, snapshot_date, model_score,
            coalesce(total_price, 'NaN'::DOUBLE) AS total_price,
            customer_group::DOUBLE AS customer_group, constant_value::DOUBLE AS constant_value
          FROM drift_rows)
        ON model_score, total_price, customer_group, constant_value
        INTO NAME feature_name VALUE v""",
    "drift_edges": """
        SELECT feature_name, list_sort(list_distinct(quantile_cont(v,
          [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges
        FROM drift_numbers WHERE NOT is_current AND NOT isnan(v) GROUP BY feature_name""",
    "drift_texts": """
        UNPIVOT (SELECT is_current, snapshot_date, coalesce(priority, '__missing__') AS priority,
            coalesce(order_status, '__missing__') AS order_status,
            coalesce(clerk, '__missing__') AS clerk FROM drift_rows)
        ON priority, order_status, clerk INTO NAME feature_name VALUE level""",
    "drift_level_ranks": """
        SELECT feature_name, level, count(*) AS row_count,
          row_number() OVER (PARTITION BY feature_name ORDER BY count(*) DESC, level) AS level_rank
        FROM drift_texts WHERE NOT is_current GROUP BY feature_name, level""",
    "drift_bucketed": """
        SELECT is_current, snapshot_date, n.feature_name, 'numeric' AS feature_type,
          CASE WHEN len(edges) < 2 OR isnan(v) THEN '__missing__'
            ELSE len(list_filter(edges[2:-2], lambda e: e < v))::VARCHAR END AS bucket
        FROM drift_numbers n JOIN drift_edges e ON n.feature_name = e.feature_name
        UNION ALL
        SELECT is_current, snapshot_date, t.feature_name, 'categorical',
          CASE WHEN r.level IS NULL THEN '__other__' ELSE t.level END
        FROM drift_texts t LEFT JOIN (SELECT * FROM drift_level_ranks
            WHERE level_rank <= 5 OR level = '__missing__') r
          ON t.feature_name = r.feature_name AND t.level = r.level""",
    "drift_counts": """
        SELECT is_current, feature_name, feature_type, bucket, count(*) AS row_count
        FROM drift_bucketed GROUP BY ALL""",
    "csi": """
        SELECT feature_name, feature_type,
          sum((a - e) * ln(a / e)) AS csi, max(r_total) AS reference_count,
          max(c_total) AS current_count, count(*)::INTEGER AS bucket_count,
          CASE WHEN feature_type = 'categorical' THEN 5.0::DOUBLE END AS categorical_top_n
        FROM (SELECT *, greatest(r / greatest(r_total, 1e-6), 1e-6) AS e,
            greatest(c / greatest(c_total, 1e-6), 1e-6) AS a
          FROM (SELECT *, sum(r) OVER (PARTITION BY feature_name)::BIGINT AS r_total,
              sum(c) OVER (PARTITION BY feature_name)::BIGINT AS c_total
            FROM (SELECT feature_name, feature_type, bucket,
                sum(row_count) FILTER (NOT is_current) AS r0, coalesce(r0, 0)::DOUBLE AS r,
                sum(row_count) FILTER (is_current) AS c0, coalesce(c0, 0)::DOUBLE AS c
              FROM drift_counts GROUP BY feature_name, feature_type, bucket)))
        GROUP BY feature_name, feature_type""",
    "month_drift_counts": """
        SELECT snapshot_date, feature_name, bucket, count(*) AS row_count
        FROM drift_bucketed WHERE is_current GROUP BY ALL""",
    "month_csi": """
        WITH months AS (SELECT DISTINCT snapshot_date, feature_name FROM month_drift_counts),
        reference AS (SELECT * FROM drift_counts WHERE NOT is_current),
        domain AS (
          SELECT m.snapshot_date, r.feature_name, r.bucket
          FROM months m JOIN reference r ON m.feature_name = r.feature_name
          UNION SELECT snapshot_date, feature_name, bucket FROM month_drift_counts),
        sided AS (
          SELECT d.*, coalesce(r.row_count, 0)::DOUBLE AS r, coalesce(c.row_count, 0)::DOUBLE AS c,
            sum(coalesce(r.row_count, 0)) OVER w AS r_total,
            sum(coalesce(c.row_count, 0)) OVER w AS c_total
          FROM domain d
          LEFT JOIN reference r ON d.feature_name = r.feature_name AND d.bucket = r.bucket
          LEFT JOIN month_drift_counts c ON d.snapshot_date = c.snapshot_date
            AND d.feature_name = c.feature_name AND d.bucket = c.bucket
          WINDOW w AS (PARTITION BY d.snapshot_date, d.feature_name))
        SELECT snapshot_date, feature_name,
          CASE WHEN feature_name IN ('priority', 'order_status', 'clerk') THEN 'categorical'
            ELSE 'numeric' END AS feature_type,
          sum((greatest(c / c_total, 1e-6) - greatest(r / r_total, 1e-6))
            * ln(greatest(c / c_total, 1e-6) / greatest(r / r_total, 1e-6))) AS csi,
          max(r_total)::BIGINT AS reference_count, max(c_total)::BIGINT AS current_count,
          count(*)::INTEGER AS bucket_count,
          CASE WHEN feature_type = 'categorical' THEN 5.0::DOUBLE END AS categorical_top_n
        FROM sided GROUP BY snapshot_date, feature_name""",
    "monitored": """
        SELECT s.snapshot_date, s.csi AS psi_score, w.max_csi, w.max_csi_feature,
          'credit_model' AS model_version
        FROM month_csi s JOIN (
          SELECT snapshot_date, csi AS max_csi, feature_name AS max_csi_feature
          FROM month_csi WHERE feature_name <> 'model_score'
          QUALIFY row_number() OVER (PARTITION BY snapshot_date ORDER BY csi DESC, feature_name) = 1
        ) w ON s.snapshot_date = w.snapshot_date
        WHERE s.feature_name = 'model_score'""",
    "month_totals": """
        SELECT o_orderstatus AS model_version, date_trunc('month', o_orderdate)::DATE AS snapshot_date,
          count(*) AS row_count FROM orders GROUP BY ALL""",
    "artifacts": """
        SELECT s_name AS model_version,
          CASE s_nationkey % 3 WHEN 0 THEN 'xgboost' WHEN 1 THEN 'log_reg' ELSE 'other' END
            AS model_type,
          CASE WHEN s_suppkey % 19 = 0 THEN s_name || '_copy' ELSE s_name END AS file_stem,
          strftime(DATE '2024-01-01' + to_months((s_suppkey % 10)::INTEGER), '%Y-%m-%d') AS train_date,
          0.5 + ((cents % 13 + 13) % 13) / 40.0::DOUBLE AS auc_train,
          0.5 + ((cents % 11 + 11) % 11) / 40.0::DOUBLE AS auc_test,
          CASE WHEN s_suppkey % 23 <> 0 THEN 0.5 + ((cents % 7 + 7) % 7) / 40.0::DOUBLE END AS auc_oot
        FROM (SELECT *, round(s_acctbal * 100)::BIGINT AS cents FROM supplier)""",
    "valid_models": """
        SELECT * FROM artifacts WHERE file_stem = model_version AND auc_oot IS NOT NULL""",
    "old_log": """
        SELECT model_version, model_type,
          (CASE WHEN model_type = 'xgboost' THEN model_version = (
              SELECT min(model_version) FROM valid_models WHERE model_type = 'xgboost')
            ELSE model_type = 'log_reg' AND right(model_version, 1) = '2' END)::INTEGER AS champion
        FROM artifacts WHERE right(model_version, 1) <> '5'
        UNION ALL
        SELECT model_version || '_old', model_type, 0 FROM artifacts
        WHERE right(model_version, 1) = '7'""",
    "champions": """
        SELECT m.model_type, coalesce(k.kept, m.model_version) AS champion_version
        FROM (SELECT * FROM valid_models QUALIFY row_number() OVER (PARTITION BY model_type
            ORDER BY auc_oot DESC, auc_test DESC, auc_train DESC, model_version) = 1) m
        LEFT JOIN (SELECT o.model_type, min(o.model_version) AS kept FROM old_log o
            JOIN valid_models v ON o.model_version = v.model_version
            WHERE champion = 1 GROUP BY o.model_type HAVING count(*) = 1) k
          ON m.model_type = k.model_type""",
    "reconciled": """
        SELECT m.*, (m.model_version = c.champion_version)::INTEGER AS champion,
          (m.model_version <> c.champion_version AND row_number() OVER (
            PARTITION BY m.model_type, m.model_version = c.champion_version
            ORDER BY auc_oot DESC, auc_test DESC, auc_train DESC, m.model_version) = 1)::INTEGER
            AS challenger
        FROM valid_models m JOIN champions c ON m.model_type = c.model_type""",
}

_RATIOS = """
    CASE WHEN Annual_Income > 0 AND Outstanding_Debt >= 0
      THEN Outstanding_Debt::DOUBLE / Annual_Income::DOUBLE END AS debt_to_income_ratio,
    CASE WHEN Monthly_Inhand_Salary > 0 AND Total_EMI_per_month >= 0
      THEN Total_EMI_per_month::DOUBLE / Monthly_Inhand_Salary::DOUBLE END AS emi_to_salary_ratio,
    CASE WHEN Credit_Utilization_Ratio > 50 THEN 1 ELSE 0 END AS high_credit_utilization_flag"""
_HISTORY = """
    CASE WHEN Credit_History_Age IS NOT NULL THEN
      coalesce(TRY_CAST(regexp_extract(Credit_History_Age, '(\\d+)\\s+Years?', 1) AS INTEGER), 0) * 12
      + coalesce(TRY_CAST(regexp_extract(Credit_History_Age, '(\\d+)\\s+Months?', 1) AS INTEGER), 0)
    END"""


def _needed(sql: str) -> list[str]:
    """Views a statement uses, in definition order, with what those use."""
    wanted: set[str] = set()
    texts = [sql]
    while texts:
        words = set(re.findall(r"\w+", texts.pop()))
        for name in VIEWS:
            if name in words and name not in wanted:
                wanted.add(name)
                texts.append(VIEWS[name])
    return [name for name in VIEWS if name in wanted]


def _shaped(
    sql: str, dates: str = "", numbers: str = "", floats: str = "", digits: int = 9
) -> str:
    """The statement with its views, dates as text, doubles rounded and floats as they are."""
    replaced = [f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates.split()]
    replaced += [f"round({n}::DOUBLE, {digits}) + 0.0 AS {n}" for n in numbers.split()]
    replaced += [f"{f}::DOUBLE AS {f}" for f in floats.split()]
    body = f"SELECT * REPLACE ({', '.join(replaced)}) FROM ({sql})" if replaced else sql
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in _needed(sql))
    return f"WITH {views} {body}" if views else body


def _metrics(cells: str) -> str:
    """Class rates added to a statement with the columns tn, fp, fn and tp."""
    return f"""
      SELECT *, CASE WHEN precision + recall > 0
          THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
        (recall + specificity) / 2 AS balanced_accuracy, recall - false_positive_rate AS youden_j
      FROM (SELECT *,
        CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0 END AS accuracy,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
        CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity,
        CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS false_positive_rate
        FROM ({cells}))"""


_RATES = "accuracy precision recall specificity false_positive_rate f1 balanced_accuracy youden_j"


def _ranked(source: str, group: str) -> str:
    """AUC, Gini, Brier and log-loss by average ranks over rows (g, s, y)."""
    return f"""
      SELECT {group} auc, round(2 * auc - 1, 3) AS gini, brier, log_loss FROM (
        SELECT g, CASE WHEN p > 0 AND n > 0 THEN (ranks - p * (p + 1) / 2) / (p * n) END AS auc,
          brier, CASE WHEN p > 0 AND n > 0 THEN ll END AS log_loss
        FROM (SELECT g, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n,
            sum(CASE WHEN y = 1 THEN rk END)::DOUBLE AS ranks, avg((s - y) * (s - y)) AS brier,
            -avg(y * ln(least(greatest(s, 1e-15), 1 - 1e-15))
              + (1 - y) * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15))) AS ll
          FROM (SELECT *, (rank() OVER (PARTITION BY g ORDER BY s)
                + count(*) OVER (PARTITION BY g ORDER BY s)) / 2.0::DOUBLE AS rk
            FROM ({source})) GROUP BY g))"""


_MONTH_ROWS = "SELECT snapshot_date AS g, model_predictions AS s, actual_label AS y FROM scores"
_SWEEP_CELLS = """
    SELECT year, k / 100.0::DOUBLE AS threshold,
      sum((s >= k / 100.0::DOUBLE AND y = 1)::INTEGER)::BIGINT AS tp,
      sum((s >= k / 100.0::DOUBLE AND y = 0)::INTEGER)::BIGINT AS fp,
      sum((s < k / 100.0::DOUBLE AND y = 0)::INTEGER)::BIGINT AS tn,
      sum((s < k / 100.0::DOUBLE AND y = 1)::INTEGER)::BIGINT AS fn
    FROM (SELECT year(snapshot_date)::INTEGER AS year, model_predictions AS s, actual_label AS y
      FROM scores), range(1, 100) t(k)
    GROUP BY year, k"""
_SWEEP = _metrics(_SWEEP_CELLS)


def _bands(source: str) -> str:
    return f"""
      WITH edges AS (SELECT list_sort(list_distinct(quantile_cont(model_predictions,
          [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM {source})
      SELECT len(list_filter(e[2:-2], lambda x: x < model_predictions))::INTEGER AS band,
        count(*) AS row_count, min(model_predictions) AS min_score, max(model_predictions) AS max_score,
        avg(model_predictions) AS avg_score, avg(actual_label) AS actual_default_rate,
        avg(predicted_label) AS predicted_default_rate
      FROM {source}, edges GROUP BY band"""


def _histogram(source: str, columns: list[str], bins: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, least(floor(({c} - lo) / ((hi - lo) / {bins}.0::DOUBLE)),
          {bins - 1})::INTEGER AS bin, count(*) AS row_count
        FROM {source}, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {source})
        GROUP BY bin"""
        for c in columns
    )


FINANCIAL_TYPES = {
    "Customer_ID": "", "Annual_Income": "n", "Monthly_Inhand_Salary": "n",
    "Changed_Credit_Limit": "n", "Num_Credit_Inquiries": "n", "Outstanding_Debt": "n",
    "Credit_Utilization_Ratio": "n", "Total_EMI_per_month": "n", "Amount_invested_monthly": "n",
    "Monthly_Balance": "n", "Num_Bank_Accounts": "i", "Num_Credit_Card": "i", "Interest_Rate": "i",
    "Num_of_Loan": "i", "Delay_from_due_date": "i", "Num_of_Delayed_Payment": "i",
    "Type_of_Loan": "", "Credit_Mix": "", "Credit_History_Age": "", "Payment_of_Min_Amount": "",
    "Payment_Behaviour": "", "snapshot_date": "",
}
_FLOATS = " ".join(c for c, kind in FINANCIAL_TYPES.items() if kind == "n")
_NUMBERS = [c for c, kind in FINANCIAL_TYPES.items() if kind]
_LOAN_FLOATS = "loan_amt due_amt paid_amt overdue_amt balance"
_GOLD_FLOATS = "Annual_Income Outstanding_Debt"
_GOLD_NUMBERS = "fe_1 fe_2 fe_3 fe_4 fe_5 debt_to_income_ratio emi_to_salary_ratio"
_GOLD_SHOWN = f"""Customer_ID, snapshot_date, Age, Annual_Income, Outstanding_Debt,
    fe_1, fe_2, fe_3, fe_4, fe_5, {_RATIOS}, {_HISTORY} AS Credit_History_Age_Months"""


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    # Loans
    sql["bronze_snapshot_filter"] = _shaped(
        """SELECT loan_id, Customer_ID, loan_start_date, tenure, installment_num, snapshot_date
        FROM loan_raw WHERE snapshot_date = '1999-03-01'"""
    )
    sql["source_files"] = "SELECT 'orders.parquet' AS source_file, count(*) AS row_count FROM orders"
    sql["snapshot_row_counts"] = _shaped(
        "SELECT snapshot_date, count(*) AS row_count FROM loan_silver GROUP BY snapshot_date",
        "snapshot_date",
    )
    sql["snapshot_dates"] = _shaped(
        """SELECT DISTINCT snapshot_date FROM loan_silver
        WHERE snapshot_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
        "snapshot_date",
    )
    sql["range_scan_missing_months"] = _shaped(
        """SELECT m::DATE AS snapshot_date
        FROM generate_series(DATE '1994-06-01', DATE '2002-03-01', INTERVAL 1 MONTH) t(m)
        WHERE m::DATE NOT IN (SELECT snapshot_date FROM loan_silver)""",
        "snapshot_date",
    )
    sql["silver_loan_typed"] = _shaped(
        "SELECT * FROM loan_typed", "loan_start_date snapshot_date", floats=_LOAN_FLOATS
    )
    sql["silver_loan_dpd"] = _shaped(
        "SELECT * FROM loan_silver",
        "loan_start_date snapshot_date first_missed_date",
        floats=_LOAN_FLOATS,
    )
    sql["silver_dedupe"] = _shaped(
        "SELECT DISTINCT loan_id, installment_num, loan_start_date FROM loan_raw"
    )
    sql["changed_months"] = _shaped(
        """SELECT * FROM (WITH landed AS (
          SELECT * REPLACE (paid_amt::VARCHAR AS paid_amt), month(snapshot_date::DATE) AS m FROM loan_raw
        ), old AS (SELECT * FROM landed WHERE m <> 11
        ), new AS (
          SELECT * REPLACE (CASE WHEN m = 3 THEN '0' ELSE paid_amt END AS paid_amt) FROM landed WHERE m <> 7
        ), differing AS (
          SELECT snapshot_date FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new)
          UNION SELECT snapshot_date FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)
        )
        SELECT snapshot_date, CASE WHEN snapshot_date NOT IN (SELECT snapshot_date FROM old) THEN 'new'
          WHEN snapshot_date NOT IN (SELECT snapshot_date FROM new) THEN 'gone' ELSE 'changed' END AS reason
        FROM differing)"""
    )
    sql["gold_label"] = _shaped("SELECT * FROM gold_label", "snapshot_date")
    sql["gold_label_default_rate"] = _shaped(
        """SELECT snapshot_date, label_def, count(*) AS row_count, sum(label)::BIGINT AS defaults,
          avg(label) AS default_rate FROM gold_label GROUP BY snapshot_date, label_def""",
        "snapshot_date",
        "default_rate",
    )

    # Features
    sql["silver_financials_clean"] = _shaped(
        "SELECT * FROM financials", "snapshot_date", floats=_FLOATS
    )
    sql["silver_attributes_clean"] = _shaped("SELECT * FROM attributes", "snapshot_date")
    sql["gold_features"] = _shaped(
        f"SELECT {_GOLD_SHOWN} FROM gold_joined", "snapshot_date", _GOLD_NUMBERS, _GOLD_FLOATS
    )
    fallback = ", ".join(f"coalesce(g.fe_{i}, d.fe_{i}) AS fe_{i}" for i in range(1, 6))
    sql["gold_features_fallback"] = _shaped(
        f"""SELECT {_GOLD_SHOWN} FROM (
          SELECT g.* REPLACE ({fallback})
          FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY Customer_ID) AS rn
            FROM gold_joined) g
          LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY snapshot_date
              ORDER BY md5(Customer_ID || '|88')) AS rn FROM clickstream
            WHERE snapshot_date IN (SELECT snapshot_date FROM gold_joined
              GROUP BY snapshot_date HAVING count(fe_1) < count(*))) d
            ON g.snapshot_date = d.snapshot_date AND g.rn = d.rn)""",
        "snapshot_date",
        _GOLD_NUMBERS,
        _GOLD_FLOATS,
    )
    sql["gold_derived_ratios"] = _shaped(
        f"SELECT Customer_ID, {_RATIOS} FROM financials",
        numbers="debt_to_income_ratio emi_to_salary_ratio",
    )
    sql["credit_history_months"] = _shaped(
        f"""SELECT Credit_History_Age, ({_HISTORY})::INTEGER AS months, count(*) AS row_count
        FROM financials_raw GROUP BY ALL"""
    )
    caps = """quantile_cont(debt_to_income_ratio, [0.01, 0.99]) AS d,
        quantile_cont(emi_to_salary_ratio, [0.01, 0.99]) AS e"""
    sql["quantile_cap"] = _shaped(
        f"""SELECT Customer_ID, Annual_Income, Monthly_Balance,
          CASE WHEN debt_to_income_ratio IS NOT NULL
            THEN least(greatest(debt_to_income_ratio, d[1]), d[2]) END AS debt_to_income_ratio,
          CASE WHEN emi_to_salary_ratio IS NOT NULL
            THEN least(greatest(emi_to_salary_ratio, e[1]), e[2]) END AS emi_to_salary_ratio,
          high_credit_utilization_flag, months AS Credit_History_Age_Months
        FROM (SELECT *, {_RATIOS}, {_HISTORY} AS months FROM financials),
          (SELECT {caps} FROM (SELECT {_RATIOS} FROM financials))""",
        numbers="Annual_Income Monthly_Balance debt_to_income_ratio emi_to_salary_ratio",
    )
    sql["ratio_quantiles"] = _shaped(
        f"""WITH caps AS (SELECT {caps} FROM (SELECT {_RATIOS} FROM financials))
        SELECT 'debt_to_income_ratio' AS column_name, d[1] AS low, d[2] AS high FROM caps
        UNION ALL SELECT 'emi_to_salary_ratio', e[1], e[2] FROM caps""",
        numbers="low high",
    )

    # Data quality
    sql["dq_duplicates"] = _shaped(
        """SELECT loan_id, installment_num, count(*) AS row_count FROM loan_silver
        GROUP BY loan_id, installment_num HAVING count(*) > 1"""
    )
    sql["dq_join_coverage"] = _shaped(
        """SELECT a.snapshot_date, count(*) AS total_rows,
          count(f.Customer_ID) AS financials_matched, count(f.Customer_ID) = 0 AS financials_no_overlap,
          count(c.Customer_ID) AS clickstream_matched, count(c.Customer_ID) = 0 AS clickstream_no_overlap
        FROM attributes a
        LEFT JOIN financials f ON a.Customer_ID = f.Customer_ID AND a.snapshot_date = f.snapshot_date
        LEFT JOIN clickstream c ON a.Customer_ID = c.Customer_ID AND a.snapshot_date = c.snapshot_date
        GROUP BY a.snapshot_date""",
        "snapshot_date",
    )
    sql["dq_all_null_columns"] = _shaped(
        """SELECT column_name FROM (SELECT count(CASE WHEN loan_id = '' THEN 1 END) AS never_set,
            count(TRY_CAST('#' || loan_id AS DATE)) AS unreadable FROM loan_raw)
          UNPIVOT (n FOR column_name IN (never_set, unreadable)) WHERE n = 0"""
    )
    status = """SELECT '{0}' AS table_name, m::DATE AS snapshot_date, count(t.snapshot_date) AS row_count,
          CASE WHEN count(t.snapshot_date) > 0 THEN 'ok' {1} ELSE 'missing' END AS status
        FROM generate_series(DATE '1994-11-01', DATE '1996-12-01', INTERVAL 1 MONTH) g(m)
        LEFT JOIN {2} t ON t.snapshot_date = m::DATE GROUP BY m"""
    sql["dq_partition_status"] = _shaped(
        status.format("silver", "", "loan_silver")
        + " UNION ALL "
        + status.format(
            "gold_label", "WHEN m::DATE < DATE '1995-01-01' THEN 'allowed_empty'", "gold_label"
        ),
        "snapshot_date",
    )
    sql["dq_split_sanity"] = _shaped(
        """SELECT CASE WHEN l.snapshot_date BETWEEN DATE '1999-04-01' AND DATE '2000-03-31'
            THEN 'train_test' ELSE 'oot' END AS split, count(*) AS row_count,
          count(DISTINCT label) AS label_classes,
          count(f.Customer_ID) AS rows_with_features
        FROM gold_label l LEFT JOIN monthly_features f ON l.Customer_ID = f.Customer_ID
          AND f.snapshot_date = (l.snapshot_date - INTERVAL 6 MONTH)::DATE
        WHERE l.snapshot_date BETWEEN DATE '1999-04-01' AND DATE '2000-05-31'
        GROUP BY split"""
    )
    sql["split_default_rate"] = _shaped(
        """SELECT CASE WHEN snapshot_date BETWEEN DATE '1999-04-01' AND DATE '2000-03-31'
            THEN 'train_test' WHEN snapshot_date BETWEEN DATE '2000-04-01' AND DATE '2000-05-31'
            THEN 'oot' END AS split, count(*) AS row_count, round(avg(label), 2) AS default_rate
        FROM gold_label GROUP BY split""",
        numbers="default_rate",
    )
    sql["dq_maturity"] = _shaped(
        f"""SELECT count(*) AS prediction_count,
          count(*) FILTER (label_snapshot_date <= DATE '{EVALUATION_DATE}') AS matured_count,
          min(label_snapshot_date) AS earliest_label_date FROM due_predictions""",
        "earliest_label_date",
    )

    # Joins across months
    sql["label_feature_join"] = _shaped(
        """SELECT l.*, (l.snapshot_date - INTERVAL 6 MONTH)::DATE AS feature_snapshot_date,
          f.* EXCLUDE (Customer_ID, snapshot_date)
        FROM gold_label l LEFT JOIN monthly_features f ON l.Customer_ID = f.Customer_ID
          AND f.snapshot_date = (l.snapshot_date - INTERVAL 6 MONTH)::DATE""",
        "snapshot_date feature_snapshot_date",
        "fe_largest fe_smallest",
    )
    matured_dates = "snapshot_date prediction_snapshot_date label_snapshot_date"
    sql["prediction_label_join"] = _shaped(
        "SELECT * FROM evaluated", matured_dates, "model_predictions prediction_threshold"
    )
    sql["customer_month_labels"] = _shaped("SELECT * FROM month_labels", "label_snapshot_date")
    sql["prediction_defaults"] = _shaped(
        """SELECT * EXCLUDE (model_name, predicted_label) REPLACE (0.5::DOUBLE AS prediction_threshold),
          (model_predictions >= 0.5)::INTEGER AS predicted_label FROM due_predictions""",
        matured_dates,
        "model_predictions prediction_threshold",
    )
    sql["unscored_snapshots"] = _shaped(
        """SELECT DISTINCT snapshot_date FROM monthly_features
        WHERE snapshot_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-01'
          AND snapshot_date NOT IN (SELECT snapshot_date FROM predictions
            WHERE snapshot_date < DATE '1999-05-01')""",
        "snapshot_date",
    )
    windows = (
        "train_test_start_date train_test_end_date oot_start_date oot_end_date"
        " feature_start_date feature_end_date"
    )
    sql["training_windows"] = _shaped(
        """SELECT train_date, (oot_start_date - INTERVAL 12 MONTH)::DATE AS train_test_start_date,
          oot_start_date - 1 AS train_test_end_date, oot_start_date, oot_end_date,
          (oot_start_date - INTERVAL 12 MONTH - INTERVAL 6 MONTH)::DATE AS feature_start_date,
          (oot_end_date - INTERVAL 6 MONTH)::DATE AS feature_end_date
        FROM (SELECT train_date, (train_date - INTERVAL 2 MONTH)::DATE AS oot_start_date,
            train_date - 1 AS oot_end_date
          FROM (SELECT DISTINCT last_day(o_orderdate) AS train_date FROM orders))""",
        "train_date " + windows,
    )
    sql["month_sequence"] = _shaped(
        """SELECT o_custkey, m::DATE AS month,
          ((year(b) - year(a)) * 12 + month(b) - month(a))::INTEGER AS months_apart,
          (date_trunc('month', a) - INTERVAL 1 MONTH)::DATE AS month_before
        FROM (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, unnest(generate_series(
            date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
            INTERVAL 1 MONTH)) AS m FROM orders GROUP BY o_custkey)""",
        "month month_before",
    )
    sql["retrain_cadence"] = _shaped(
        """SELECT d AS last_train_date, since AS months_since, since >= 3 AS training_due
        FROM (SELECT d, ((2024 - year(d)) * 12 + 12 - month(d))::INTEGER AS since
          FROM (SELECT max(train_date::DATE) AS d FROM artifacts))""",
        "last_train_date",
    )

    # Drift
    sql["psi_score"] = _shaped(
        """SELECT csi AS psi, reference_count, current_count, bucket_count FROM csi
        WHERE feature_name = 'model_score'""",
        numbers="psi",
    )
    sql["csi_numeric"] = _shaped(
        "SELECT * FROM csi WHERE feature_type = 'numeric' AND feature_name <> 'model_score'",
        numbers="csi categorical_top_n",
    )
    sql["csi_categorical"] = _shaped(
        "SELECT * FROM csi WHERE feature_type = 'categorical'", numbers="csi categorical_top_n"
    )
    sql["csi_all_features"] = _shaped(
        "SELECT * FROM month_csi", "snapshot_date", "csi categorical_top_n"
    )
    sql["csi_from_stored_profile"] = sql["csi_all_features"]
    sql["drift_buckets"] = _shaped(
        """SELECT is_current, feature_name, bucket, row_count FROM drift_counts
        WHERE feature_name <> 'model_score'"""
    )
    sql["worst_feature"] = _shaped(
        "SELECT snapshot_date, max_csi, max_csi_feature FROM monitored", "snapshot_date", "max_csi"
    )
    status_of = "CASE WHEN {0} >= 0.25 THEN 'retrain_required' WHEN {0} >= 0.1 THEN 'warning' ELSE 'healthy' END"
    sql["drift_status"] = _shaped(
        f"""SELECT *, CASE WHEN psi_score >= 0.25 THEN 'retrain_required'
            WHEN psi_status = 'warning' OR csi_status = 'warning' THEN 'warning'
            ELSE 'healthy' END AS status
        FROM (SELECT *, {status_of.format('psi_score')} AS psi_status,
            {status_of.format('max_csi')} AS csi_status, psi_score >= 0.25 AS retrain_required
          FROM monitored)""",
        "snapshot_date",
        "psi_score max_csi",
    )
    sql["monitoring_summary"] = _shaped(
        f"""SELECT m.model_version, strftime(m.snapshot_date, '%Y-%m-%d') AS snapshot_date,
          strftime(m.snapshot_date, '%Y_%m_%d') AS snapshot_date_clean,
          '1995-01-01' AS reference_feature_start_date, '1999-12-31' AS reference_feature_end_date,
          s.reference_count, s.current_count, psi_score, psi_status, max_csi, max_csi_feature,
          csi_status, CASE WHEN psi_score >= 0.25 THEN 'retrain_required'
            WHEN psi_status = 'warning' OR csi_status = 'warning' THEN 'warning'
            ELSE 'healthy' END AS status, psi_score >= 0.25 AS retrain_required,
          0.1::DOUBLE AS psi_warning_threshold, 0.25::DOUBLE AS psi_retrain_threshold,
          0.1::DOUBLE AS csi_warning_threshold, 0.25::DOUBLE AS csi_retrain_threshold,
          5 AS categorical_top_n
        FROM (SELECT *, {status_of.format('psi_score')} AS psi_status,
            {status_of.format('max_csi')} AS csi_status FROM monitored) m
        JOIN month_csi s ON m.snapshot_date = s.snapshot_date AND s.feature_name = 'model_score'""",
        numbers="psi_score max_csi",
    )
    sql["csi_ranked"] = _shaped(
        "SELECT snapshot_date, feature_name, csi FROM month_csi", "snapshot_date", "csi"
    )
    sql["psi_trend"] = _shaped(
        """SELECT *, psi_change / nullif(psi_previous, 0) AS psi_change_pct,
          CASE WHEN psi_change > 0 THEN 'increased' WHEN psi_change < 0 THEN 'decreased'
            WHEN psi_change = 0 THEN 'flat' ELSE 'first snapshot' END AS psi_trend
        FROM (SELECT snapshot_date, psi_score,
            lag(psi_score) OVER (ORDER BY snapshot_date) AS psi_previous,
            psi_score - lag(psi_score) OVER (ORDER BY snapshot_date) AS psi_change FROM monitored)""",
        "snapshot_date",
        "psi_score psi_previous psi_change psi_change_pct",
    )
    sql["retrain_decision"] = _shaped(
        f"""SELECT model_type, model_type = '{MODEL_TYPES[0]}' AND psi_score >= 0.02 AS retrain_required
        FROM monitored, (VALUES ('xgboost'), ('log_reg')) t(model_type)
        WHERE snapshot_date = (SELECT max(snapshot_date) FROM monitored)"""
    )
    sql["top_levels"] = _shaped(
        """SELECT feature_name, level, row_count, level_rank::INTEGER AS level_rank
        FROM drift_level_ranks WHERE level_rank <= 5"""
    )
    sql["history_slice"] = _shaped(
        """SELECT CASE WHEN feature_name = 'model_score' THEN 'score' ELSE 'feature' END AS part,
          snapshot_date, feature_name, csi FROM month_csi
        WHERE feature_name IN ('model_score', 'total_price', 'priority')""",
        "snapshot_date",
        "csi",
    )

    # Metrics
    ranked = _ranked(_MONTH_ROWS, "g AS snapshot_date,")
    sql["auc_gini"] = _shaped(
        f"SELECT snapshot_date, auc, gini FROM ({ranked})", "snapshot_date", "auc gini"
    )
    sql["auc_overall"] = _shaped(
        _ranked("SELECT 1 AS g, amount / 200000 AS s, actual_label AS y FROM scores", ""),
        numbers="auc gini brier log_loss",
    )
    sql["brier_logloss"] = _shaped(
        f"SELECT snapshot_date, brier, log_loss FROM ({ranked})", "snapshot_date", "brier log_loss"
    )
    cells = """count(*) FILTER ({0} = 0 AND {1} = 0) AS tn, count(*) FILTER ({0} = 0 AND {1} = 1) AS fp,
        count(*) FILTER ({0} = 1 AND {1} = 0) AS fn, count(*) FILTER ({0} = 1 AND {1} = 1) AS tp"""
    month_cells = cells.format("actual_label", "label")
    sql["confusion_metrics"] = _shaped(
        _metrics(f"SELECT snapshot_date, {month_cells} FROM scores GROUP BY snapshot_date"),
        "snapshot_date",
        _RATES,
    )
    sql["score_to_class"] = _shaped(
        """SELECT Customer_ID, snapshot_date, label AS own_class,
          (model_predictions >= 0.65)::INTEGER AS override_class FROM predictions""",
        "snapshot_date",
    )
    sql["threshold_sweep"] = _shaped(_SWEEP, numbers="threshold " + _RATES)
    sql["best_threshold"] = _shaped(
        f"""SELECT * FROM ({_SWEEP}) QUALIFY row_number() OVER (PARTITION BY year
          ORDER BY youden_j DESC, f1 DESC, balanced_accuracy DESC, threshold) = 1""",
        numbers="threshold " + _RATES,
    )
    band_numbers = "min_score max_score avg_score actual_default_rate predicted_default_rate"
    sql["score_bands"] = _shaped(
        _bands("(SELECT * RENAME (label AS predicted_label) FROM scores)"), numbers=band_numbers
    )
    sql["score_bands_matured"] = _shaped(_bands("evaluated"), numbers=band_numbers)
    sql["score_bands_from_state"] = sql["score_bands_matured"]
    sql["performance_state"] = _shaped(
        """SELECT model_version, prediction_snapshot_date, label_snapshot_date, prediction_threshold,
          model_predictions AS score, predicted_label AS predicted, actual_label AS actual,
          count(*) AS rows
        FROM evaluated GROUP BY ALL""",
        "prediction_snapshot_date label_snapshot_date",
        "score prediction_threshold",
    )
    grouped = """SELECT *, unnest(['all_matured_predictions',
        strftime(prediction_snapshot_date, 'prediction_%Y_%m_%d')]) AS performance_group FROM evaluated"""
    group_ranks = _ranked(
        f"""SELECT performance_group AS g, model_predictions AS s, actual_label AS y
        FROM ({grouped})""",
        "g AS performance_group,",
    )
    group_cells = cells.format("actual_label", "predicted_label")
    rates = _metrics(f"""
        SELECT model_version, '{EVALUATION_DATE}' AS evaluation_date, performance_group,
          strftime(min(prediction_snapshot_date), '%Y-%m-%d') AS prediction_start_date,
          strftime(max(prediction_snapshot_date), '%Y-%m-%d') AS prediction_end_date,
          strftime(min(label_snapshot_date), '%Y-%m-%d') AS label_start_date,
          strftime(max(label_snapshot_date), '%Y-%m-%d') AS label_end_date,
          count(*) AS row_count, avg(actual_label) AS actual_default_rate,
          avg(model_predictions) AS avg_model_prediction,
          median(prediction_threshold) AS prediction_threshold,
          avg(predicted_label) AS predicted_default_rate, {group_cells}
        FROM ({grouped}) GROUP BY model_version, performance_group""")
    sql["performance_summary"] = _shaped(
        f"""SELECT r.* EXCLUDE (false_positive_rate, balanced_accuracy, youden_j),
          k.auc, k.gini, k.brier, k.log_loss
        FROM ({rates}) r JOIN ({group_ranks}) k ON r.performance_group = k.performance_group""",
        numbers="actual_default_rate avg_model_prediction prediction_threshold"
        " predicted_default_rate accuracy precision recall specificity f1 auc gini brier log_loss",
    )
    summary = sql["performance_summary"]
    sql["overall_performance"] = (
        f"SELECT * FROM ({summary}) WHERE performance_group = 'all_matured_predictions'"
    )
    sql["monthly_performance"] = f"""
        SELECT *, prediction_start_date AS prediction_snapshot_date FROM ({summary})
        WHERE performance_group LIKE 'prediction\\_%' ESCAPE '\\'"""

    # Histories and registry
    sql["history_upsert"] = _shaped(
        """SELECT model_version, snapshot_date,
          CASE WHEN year(snapshot_date) >= 1999 THEN row_count + 1000 ELSE row_count END AS row_count
        FROM month_totals""",
        "snapshot_date",
    )
    sql["history_in_order"] = _shaped("SELECT * FROM month_totals", "snapshot_date")
    sql["keep_last_dedupe"] = _shaped(
        """SELECT loan_id, line, snapshot_date, part, amount FROM scores
        QUALIFY row_number() OVER (PARTITION BY loan_id, line
          ORDER BY snapshot_date DESC, part DESC, amount DESC) = 1""",
        "snapshot_date",
        "amount",
    )
    sql["latest_row"] = _shaped(
        """SELECT * FROM month_totals QUALIFY row_number() OVER (
          PARTITION BY model_version ORDER BY snapshot_date DESC) = 1""",
        "snapshot_date",
    )
    sql["registry_rejects"] = _shaped(
        """SELECT file_stem, model_version, model_type, concat_ws('; ',
            CASE WHEN file_stem <> model_version THEN 'version is not the file''s name' END,
            CASE WHEN auc_oot IS NULL THEN 'no auc_oot' END) AS reason
        FROM artifacts WHERE file_stem <> model_version OR auc_oot IS NULL"""
    )
    sql["registry_champions"] = _shaped(
        """SELECT model_version, model_type, auc_oot, auc_test, auc_train, champion, challenger
        FROM reconciled""",
        numbers="auc_oot auc_test auc_train",
    )
    sql["registry_diff"] = _shaped(
        """SELECT model_version, 'added' AS change FROM valid_models
        WHERE model_version NOT IN (SELECT model_version FROM old_log)
        UNION ALL SELECT model_version, 'removed' FROM old_log
        WHERE model_version NOT IN (SELECT model_version FROM valid_models)"""
    )
    sql["registry_promotion"] = _shaped(
        """SELECT n.model_version, n.model_type, (c.model_version IS NULL)::INTEGER AS champion,
          coalesce((n.auc_test > c.auc_test AND n.auc_oot > c.auc_oot)::INTEGER, 0) AS challenger
        FROM valid_models n LEFT JOIN (SELECT * FROM reconciled WHERE champion = 1
          AND model_type <> 'other') c ON n.model_type = c.model_type"""
    )
    sql["registry_selection"] = _shaped(
        """SELECT model_type, CASE model_type WHEN 'log_reg' THEN 'more than one champion'
            WHEN 'other' THEN 'challenger' ELSE 'champion' END AS selection_source,
          CASE model_type WHEN 'log_reg' THEN NULL
            WHEN 'other' THEN max(model_version) FILTER (challenger = 1)
            ELSE max(model_version) FILTER (champion = 1) END AS model_version
        FROM reconciled GROUP BY model_type"""
    )
    sql["version_counter"] = _shaped(
        """SELECT base_name || suffix AS base_name, n + 1 AS next_number,
          base_name || suffix || '_v' || (n + 1)::VARCHAR AS model_version
        FROM (SELECT base_name, suffix, CASE WHEN suffix = '' THEN versions ELSE 0 END AS n
          FROM (SELECT 'credit_model_' || s_nationkey::VARCHAR AS base_name, count(*) AS versions
            FROM supplier GROUP BY base_name), (VALUES (''), ('_new')) t(suffix))"""
    )

    # Profiles
    sql["column_profile"] = _shaped(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, 'string' AS dtype, count(*) - count({c}) AS null_count,
            round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct,
            count(DISTINCT {c}) AS n_unique FROM financials_raw"""
            for c in FINANCIAL_TYPES
        ),
        numbers="null_pct",
    )
    sql["numeric_describe"] = _shaped(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}::DOUBLE), 4) AS mean,
            round(stddev_samp({c}::DOUBLE), 4) AS std, round(min({c})::DOUBLE, 4) AS min,
            round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25,
            round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50,
            round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round(max({c})::DOUBLE, 4) AS max
            FROM financials"""
            for c in _NUMBERS
        ),
        numbers="mean std min p25 p50 p75 max",
    )
    sql["histogram"] = _shaped(_histogram("orders", ["o_totalprice", "o_custkey"], 40))
    sql["score_histogram"] = _shaped(_histogram("scores", ["model_predictions"], 50))
    sql["top_values"] = _shaped(
        """SELECT part::VARCHAR AS value, count(*) AS row_count FROM scores GROUP BY value
        ORDER BY row_count DESC, value LIMIT 30"""
    )
    sql["most_common_value"] = _shaped(
        " UNION ALL ".join(
            f"""(SELECT '{c}' AS column_name, {c} AS most_common, count(*) AS row_count
            FROM financials_raw WHERE {c} IS NOT NULL GROUP BY {c}
            ORDER BY row_count DESC, {c} LIMIT 1)"""
            for c in ("Credit_Mix", "Credit_History_Age", "Payment_Behaviour")
        )
    )
    joined = """gold_label l LEFT JOIN monthly_features f ON l.Customer_ID = f.Customer_ID
          AND f.snapshot_date = (l.snapshot_date - INTERVAL 6 MONTH)::DATE"""
    sql["table_facts"] = _shaped(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, avg(({c} IS NULL)::INTEGER) AS missing_rate,
            stddev_samp({c}::DOUBLE) AS sample_std, avg(label) AS class_rate FROM {joined}"""
            for c in ("fe_largest", "fe_smallest", "fe_orders")
        ),
        numbers="missing_rate sample_std class_rate",
        digits=4,
    )
    sql["prediction_summary"] = _shaped(
        """SELECT snapshot_date, count(*) AS row_count, round(avg(model_predictions), 4) AS avg_score,
          round(min(model_predictions), 4) AS min_score, round(max(model_predictions), 4) AS max_score,
          round(avg(label), 4) AS predicted_default_rate,
          round(min(prediction_threshold), 4) AS prediction_threshold
        FROM scores GROUP BY snapshot_date""",
        "snapshot_date",
        "avg_score min_score max_score predicted_default_rate prediction_threshold",
    )
    sql["snapshot_score_stats"] = _shaped(
        """SELECT snapshot_date, count(*) AS row_count, avg(model_predictions) AS avg_score,
          avg(label) AS predicted_default_rate, median(model_predictions) AS median_score
        FROM predictions GROUP BY snapshot_date""",
        "snapshot_date",
        "avg_score predicted_default_rate median_score",
    )
    sql["lookback_snapshots"] = _shaped(
        """SELECT DISTINCT snapshot_date FROM loan_silver WHERE snapshot_date <= DATE '2000-08-01'
        ORDER BY snapshot_date DESC LIMIT 12""",
        "snapshot_date",
    )
    sql["sample_head"] = _shaped(
        """SELECT * EXCLUDE (model_name) FROM predictions ORDER BY snapshot_date, Customer_ID
        LIMIT 200""",
        "snapshot_date",
        "model_predictions prediction_threshold",
    )

    # Projections and sets
    sql["projection_helpers"] = _shaped(
        f"""SELECT l.loan_id, l.Customer_ID, f.fe_largest AS _fallback_fe_largest,
          f.fe_smallest AS _fallback_fe_smallest, f.fe_orders AS _fallback_fe_orders, f.priority,
          'training' AS source
        FROM {joined} WHERE f.Customer_ID IS NOT NULL""",
        numbers="_fallback_fe_largest _fallback_fe_smallest",
    )
    sql["membership"] = _shaped(
        """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority
            ELSE '__other__' END AS priority, count(*) AS row_count FROM orders GROUP BY 1"""
    )
    sql["union_by_name"] = _shaped(
        """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
        UNION ALL BY NAME SELECT s_acctbal AS balance, s_name AS name FROM supplier""",
        numbers="balance",
    )
    sql["known_model_versions"] = _shaped(
        """SELECT model_version FROM artifacts UNION SELECT model_version FROM old_log
        UNION SELECT model_version FROM month_totals UNION SELECT model_name FROM predictions"""
    )
    sql["distinct_classes"] = _shaped(
        """SELECT snapshot_date, count(DISTINCT label) AS label_classes FROM gold_label
        GROUP BY snapshot_date""",
        "snapshot_date",
    )
    sql["dirty_numbers"] = _shaped(
        """SELECT Num_of_Delayed_Payment AS raw,
          TRY_CAST(replace(Num_of_Delayed_Payment, '_', '') AS FLOAT) AS as_float,
          trunc(TRY_CAST(replace(Num_of_Delayed_Payment, '_', '') AS DOUBLE))::INTEGER AS as_int,
          count(*) AS row_count FROM financials_raw GROUP BY ALL""",
        floats="as_float",
    )
    sql["bootstrap_sample"] = _shaped(
        """SELECT Customer_ID, snapshot_date, model_predictions, model_name, prediction_threshold, label
        FROM (SELECT *, row_number() OVER (
            ORDER BY md5(Customer_ID || '|' || snapshot_date::VARCHAR || '|88')) AS place FROM predictions)
        JOIN (SELECT 1 + floor(('0x' || substr(md5('88|' || k), 1, 13))::BIGINT::DOUBLE
              / 4503599627370496::DOUBLE * rows::DOUBLE)::BIGINT AS place
          FROM (SELECT rows, unnest(range(0, floor(rows * 0.5 + 0.5)::BIGINT)) AS k
            FROM (SELECT count(*) AS rows FROM predictions))) USING (place)""",
        "snapshot_date",
        "model_predictions prediction_threshold",
    )
    sql["stratified_split"] = _shaped(
        """SELECT actual_label, rn <= ceil(n / 5.0) AS holdout, count(*) AS row_count,
          max(row_key) AS last_key
        FROM (SELECT *, row_number() OVER (PARTITION BY actual_label ORDER BY md5(row_key || '|88')) AS rn,
            count(*) OVER (PARTITION BY actual_label) AS n
          FROM (SELECT actual_label, concat_ws('/', loan_id, line, part,
              amount::DECIMAL(18,2)::VARCHAR) AS row_key FROM scores))
        GROUP BY actual_label, holdout"""
    )
    return sql
