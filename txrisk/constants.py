"""Values shared by every operator.

Everything in the "fixed values" blocks has to equal the published behaviour
that this library reproduces, so it is written out plainly and only here.
"""

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Transaction types; the position is the numeric code of the type.
TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]

# First letter of an account name -> numeric code.
ACCOUNT_KINDS = {"C": 0, "M": 1}

# Money columns that must not be negative.
BALANCES = ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]

# Model features, in order (training profile).
FEATURES = [
    "step", "amount", "oldbalanceOrg", "newbalanceOrig",
    "oldbalanceDest", "newbalanceDest", "type_encoded",
    "nameOrig_type", "nameDest_type", "amount_log",
    "balance_diff_orig", "balance_diff_dest",
    "amount_to_balance_orig", "amount_to_balance_dest",
    "is_zero_balance_orig", "is_zero_balance_dest",
    "is_large_amount", "is_transfer", "is_cash_out",
    "is_merchant_dest", "hour_of_day", "day_of_week",
    "risk_amount", "risk_zero_balance",
]

# Features of the online-serving profile, in order.
SERVING_FEATURES = [
    "step", "amount", "oldbalanceOrg", "newbalanceOrig",
    "oldbalanceDest", "newbalanceDest", "type_encoded",
    "nameOrig_type", "nameDest_type", "amount_log",
    "amount_to_balance_orig", "amount_to_balance_dest",
    "balance_diff_orig", "balance_diff_dest",
    "is_zero_balance_orig", "is_zero_balance_dest",
    "day_of_week", "hour_of_day", "is_cash_out",
    "is_large_amount", "is_merchant_dest",
]

# Severity -> factor used when reasons are weighed; default for other words.
SEVERITY_FACTORS = {"high": 1.0, "medium": 0.6, "low": 0.3}
OTHER_SEVERITY_FACTOR = 0.5
MISSING_SEVERITY = "low"
MISSING_WEIGHT = 0.5

# False-positive reduction.
FP_CONFIDENCE = 0.65
FP_MIN_REASONS = 2
FP_AMOUNT = 1000.0
FP_TARGET = 0.30
FP_THRESHOLDS = [0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85]

# Weights of the signs of an ordinary transaction.
LEGITIMACY_WEIGHTS = {"small_amount": 0.3, "is_payment": 0.25, "proportional": 0.25, "regular_pattern": 0.2}

# Transactions in an hour beyond which a customer is fast.
HIGH_VELOCITY = 10

# Topics of the message broker.
INPUT_TOPIC = "transactions_input"
OUTPUT_TOPIC = "fraud_predictions"

# Amount ranges of the report: right-closed, label of each.
AMOUNT_EDGES = [0.0, 100.0, 500.0, 1000.0, 5000.0, 10000.0]
AMOUNT_LABELS = ["0-100", "100-500", "500-1000", "1000-5000", "5000-10000", "10000+"]

# Seconds a state entry lives, per kind of entry.
TTL_SECONDS = {
    "customer": 3600, "pattern": 1800, "risk": 600, "fraud": 86400,
    "prediction": 3600, "features": 3600, "stats": 300,
}
PROFILE_TTL_SECONDS = 86400
COUNTER_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}
OTHER_COUNTER_SECONDS = 3600
# Kinds of state that erasing a customer removes.
ERASABLE_KINDS = ["customer", "pattern", "risk", "count"]

# Row limits of the reports.
SAMPLE_ROWS = 100000
SAMPLE_SEED = 42
SEARCH_SHOWN = 100
VIEW_ROWS = 1000
BATCH_MAX = 100

# Ensemble.
FOREST_WEIGHT = 0.3
BOOSTED_WEIGHT = 0.7
ENSEMBLE_CUT = 0.5

# Streaming pace.
BATCH_SECONDS = 5
BATCH_EVENTS = 1000
# ----------------------------------------------------------- end fixed values

# One schema for files, messages and streams.
TX_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.IntegerType()),
    T.StructField("isFlaggedFraud", T.IntegerType()),
])

TX_COLUMNS = TX_SCHEMA.fieldNames()
REQUEST_COLUMNS = TX_COLUMNS[:9]
NUMERIC_COLUMNS = ["step", "amount"] + BALANCES + ["isFraud", "isFlaggedFraud"]

REASONS_TYPE = "array<struct<code:string,severity:string,weight:double>>"
