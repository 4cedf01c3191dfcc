"""Fixed values.

Column names, defaults and text formats below are part of the data contract: other systems
read and write tables with exactly these names, so they are stated as they are.
"""

# --- Fixed values: keys -------------------------------------------------------------------
CUSTOMER = "Customer_ID"
SNAPSHOT = "snapshot_date"
FEATURE_KEY = [CUSTOMER, SNAPSHOT]

# --- Fixed values: silver typing ----------------------------------------------------------
LOAN_TYPES = {
    "loan_id": "string",
    "Customer_ID": "string",
    "loan_start_date": "date",
    "tenure": "int",
    "installment_num": "int",
    "loan_amt": "float",
    "due_amt": "float",
    "paid_amt": "float",
    "overdue_amt": "float",
    "balance": "float",
    "snapshot_date": "date",
}
FINANCIAL_FLOATS = [
    "Annual_Income",
    "Monthly_Inhand_Salary",
    "Changed_Credit_Limit",
    "Num_Credit_Inquiries",
    "Outstanding_Debt",
    "Credit_Utilization_Ratio",
    "Total_EMI_per_month",
    "Amount_invested_monthly",
    "Monthly_Balance",
]
FINANCIAL_INTS = [
    "Num_Bank_Accounts",
    "Num_Credit_Card",
    "Interest_Rate",
    "Num_of_Loan",
    "Delay_from_due_date",
    "Num_of_Delayed_Payment",
]
FINANCIAL_TEXTS = [
    "Customer_ID",
    "Type_of_Loan",
    "Credit_Mix",
    "Credit_History_Age",
    "Payment_of_Min_Amount",
    "Payment_Behaviour",
]
ATTRIBUTE_TEXTS = ["Customer_ID", "Name", "SSN", "Occupation"]
# Closed ranges; a value outside becomes null.
FINANCIAL_RANGES = {
    "Num_Bank_Accounts": (0, 15),
    "Num_Credit_Card": (0, 15),
    "Interest_Rate": (0, 100),
}
ATTRIBUTE_RANGES = {"Age": (0, 100)}
# A negative value becomes null.
FINANCIAL_NON_NEGATIVE = [
    "Delay_from_due_date",
    "Num_Credit_Inquiries",
    "Annual_Income",
    "Monthly_Inhand_Salary",
    "Outstanding_Debt",
    "Credit_Utilization_Ratio",
    "Total_EMI_per_month",
    "Amount_invested_monthly",
    "Monthly_Balance",
]

# --- Fixed values: gold -------------------------------------------------------------------
DEFAULT_DPD = 30
DEFAULT_MOB = 6
FEATURE_PREFIX = "fe_"
FALLBACK_SEED = 88
HIGH_UTILIZATION = 50
YEARS_PATTERN = r"(\d+)\s+Years?"
MONTHS_PATTERN = r"(\d+)\s+Months?"
CAPPED_RATIOS = ["debt_to_income_ratio", "emi_to_salary_ratio"]
CLIPPED_AT_ZERO = [
    "Annual_Income",
    "Monthly_Inhand_Salary",
    "Outstanding_Debt",
    "Total_EMI_per_month",
    "Amount_invested_monthly",
    "Monthly_Balance",
    "Credit_Utilization_Ratio",
]
RATIO_QUANTILES = ("0.01", "0.99")

# --- Fixed values: calendar ---------------------------------------------------------------
BACKFILL_START = "2023-01-01"
BACKFILL_END = "2024-12-01"
FIRST_MATURED_LABEL = "2023-07-01"
FIRST_TRAINING_DATE = "2024-09-01"
TRAINING_INTERVAL_MONTHS = 3
TRAIN_TEST_MONTHS = 12
OOT_MONTHS = 2
LABEL_LAG_MONTHS = 6

# --- Fixed values: modelling --------------------------------------------------------------
NON_FEATURES = [
    "Customer_ID",
    "snapshot_date",
    "feature_snapshot_date",
    "loan_id",
    "label",
    "label_def",
    "model_name",
    "model_predictions",
    "Name",
    "SSN",
    "Credit_History_Age",
]
HOLDOUT_FRACTION = "0.2"
SPLIT_SEED = 88
SEARCH_DRAWS = 25
LOG_REG = "log_reg"
BOOSTED_TREES = "xgboost"
MODEL_TYPES = [BOOSTED_TREES, LOG_REG]
MODEL_PREFIX = "credit_model_"
LOG_REG_GRID = {
    "C": [0.01, 0.1, 1.0, 10.0],
    "class_weight": [None, "balanced"],
    "max_iter": [500, 1000],
}
BOOSTED_TREES_GRID = {
    "n_estimators": [25, 30, 35],
    "max_depth": [2, 4, 6],
    "learning_rate": [0.01, 0.1],
    "subsample": [0.6, 0.8],
    "colsample_bytree": [0.6, 0.8],
    "gamma": [0, 0.1],
    "min_child_weight": [1, 3, 5],
}
CALIBRATION_METHOD = "sigmoid"
CALIBRATION_SELECTION = "fixed_sigmoid"
THRESHOLD_METRIC = "youden_j"
DEFAULT_THRESHOLD = 0.5
LOG_LOSS_CLIP = 1e-15
REGISTRY_COLUMNS = {
    "model_version": "string",
    "model_type": "string",
    "train_date": "string",
    "auc_train": "double",
    "auc_test": "double",
    "auc_oot": "double",
    "gini_train": "double",
    "gini_test": "double",
    "gini_oot": "double",
    "brier_train": "double",
    "brier_test": "double",
    "brier_oot": "double",
    "log_loss_train": "double",
    "log_loss_test": "double",
    "log_loss_oot": "double",
    "calibration_method": "string",
    "calibration_selection_metric": "string",
    "prediction_threshold": "double",
    "threshold_selection_metric": "string",
    "threshold_selection_score": "double",
    "oot_threshold_selection_score": "double",
    "champion": "int",
    "challenger": "int",
}

# --- Fixed values: monitoring and evaluation ----------------------------------------------
PSI_WARNING = 0.10
PSI_RETRAIN = 0.25
CSI_WARNING = 0.10
CSI_RETRAIN = 0.25
DEFAULT_BINS = 10
CATEGORICAL_TOP_N = 5
STABILITY_FLOOR = 1e-6
MISSING = "__missing__"
OTHER = "__other__"
SCORE_FEATURE = "model_score"
ALL_MATURED = "all_matured_predictions"
MONTH_GROUP_PREFIX = "prediction_"
ALL_SCORES_BAND = "all_scores"
RETRAIN_STATUS = "retrain_required"
WARNING_STATUS = "warning"
HEALTHY_STATUS = "healthy"
MONITORING_KEY = ["model_version", "snapshot_date"]
PERFORMANCE_KEY = ["model_version", "evaluation_date", "performance_group"]
PROFILE_TOP_VALUES = 30
SAMPLE_ROWS = 200
COLUMN_HISTOGRAM_BINS = 40
SCORE_HISTOGRAM_BINS = 50
