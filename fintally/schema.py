"""Ledger table schemas and the fixed values the results depend on."""
from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

TRANSACTIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("merchant", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("category_id", T.LongType(), True),
    T.StructField("account_id", T.LongType(), True),
    T.StructField("is_recurring", T.BooleanType(), False),
    T.StructField("recurring_group_id", T.LongType(), True),
    T.StructField("is_anomaly", T.BooleanType(), False),
    T.StructField("is_split", T.BooleanType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])

CATEGORIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType()), True),
    T.StructField("budget_amount", MONEY, False),
    T.StructField("color", T.StringType(), True),
])

ACCOUNTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("institution", T.StringType(), True),
    T.StructField("account_type", T.StringType(), False),
    T.StructField("last_four", T.StringType(), True),
    T.StructField("initial_balance", MONEY, False),
    T.StructField("balance_as_of_date", T.DateType(), True),
    T.StructField("is_active", T.BooleanType(), False),
])

RULES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("rule_type", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("category_id", T.LongType(), False),
    T.StructField("priority", T.LongType(), False),
    T.StructField("is_active", T.BooleanType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])

BILLS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("merchant", T.StringType(), True),
    T.StructField("amount", MONEY, False),
    T.StructField("frequency", T.StringType(), True),
    T.StructField("category_id", T.LongType(), True),
    T.StructField("account_id", T.LongType(), True),
    T.StructField("start_date", T.DateType(), True),
    T.StructField("next_due_date", T.DateType(), True),
    T.StructField("last_paid_date", T.DateType(), True),
    T.StructField("is_active", T.BooleanType(), False),
])

PAYMENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("recurring_id", T.LongType(), False),
    T.StructField("amount_paid", MONEY, True),
    T.StructField("due_date", T.DateType(), True),
    T.StructField("paid_date", T.DateType(), False),
    T.StructField("transaction_id", T.LongType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

SPLITS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("transaction_id", T.LongType(), False),
    T.StructField("category_id", T.LongType(), True),
    T.StructField("amount", MONEY, False),
    T.StructField("description", T.StringType(), True),
])

GOALS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("target_amount", MONEY, False),
    T.StructField("target_date", T.DateType(), True),
    T.StructField("is_active", T.BooleanType(), False),
])

CONTRIBUTIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("goal_id", T.LongType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("transaction_id", T.LongType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])

VECTORS = T.StructType([
    T.StructField("transaction_id", T.LongType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType()), False),
    T.StructField("merchant", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
])

CATEGORIZATION_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("transaction_id", T.LongType(), False),
    T.StructField("category_id", T.LongType(), False),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("explanation", T.StringType(), True),
    T.StructField("similar_transaction_ids", T.ArrayType(T.LongType()), True),
    T.StructField("created_at", T.TimestampType(), True),
])

# ---------------------------------------------------------------------------
# These must equal the reference's for equal results.
# ---------------------------------------------------------------------------

# Default categories, in id order (ids 1..14).
DEFAULT_CATEGORIES = [
    "Housing", "Transportation", "Food & Dining", "Utilities", "Healthcare",
    "Entertainment", "Shopping", "Personal Care", "Education", "Travel",
    "Subscriptions", "Income", "Transfer", "Other",
]

# Default budget settings (key, value text).
DEFAULT_SETTINGS = [
    ("monthly_income", "0"),
    ("savings_target_percent", "20"),
    ("emergency_fund_months", "6"),
    ("discretionary_warning_percent", "80"),
]

# Recurring detection: candidate intervals in test order, base tolerance, tolerance for
# intervals of a year or more, minimum group size.
RECURRING_INTERVALS = [7, 14, 28, 30, 31, 90, 365]
RECURRING_TOLERANCE_DAYS = 3
RECURRING_LONG_TOLERANCE_DAYS = 7
RECURRING_MIN_OCCURRENCES = 2

# Anomaly detection multipliers.
ANOMALY_IQR_MULTIPLIER = 1.5
ANOMALY_MEDIAN_MULTIPLIER = 3

# Nearest-neighbour categorisation.
TOP_K_SIMILAR = 5
MIN_MATCHES_FOR_AUTO = 3
AGREEMENT_THRESHOLD = 0.85
EMBEDDING_DIM = 384

# Amount bucket words for the embedding text: (<10 small, <50 medium, <200 large, else major).
AMOUNT_BUCKETS = [(10, "small"), (50, "medium"), (200, "large")]
AMOUNT_BUCKET_TOP = "major"

# Monthly-equivalent factors of a bill by frequency (unknown frequency -> 1).
BILL_MONTHLY_FACTORS = {
    "daily": 30.0,
    "weekly": 4.33,
    "biweekly": 2.17,
    "monthly": 1.0,
    "quarterly": 1.0 / 3.0,
    "yearly": 1.0 / 12.0,
    "annually": 1.0 / 12.0,
}

# Monthly-equivalent factors of an income by frequency (unknown -> 1).
INCOME_MONTHLY_FACTORS = {
    "weekly": 4.33,
    "biweekly": 2.17,
    "semimonthly": 2.0,
    "monthly": 1.0,
    "yearly": 1.0 / 12.0,
}

# Bill schedule steps: days for day-based frequencies, months for month-based ones.
BILL_STEP_DAYS = {"daily": 1, "weekly": 7, "biweekly": 14}
BILL_STEP_MONTHS = {"monthly": 1, "quarterly": 3, "yearly": 12, "annually": 12}

RULE_TYPES = ["merchant_contains", "merchant_exact", "description_contains", "amount_range"]
ACCOUNT_TYPES = ["checking", "savings", "credit", "investment"]
