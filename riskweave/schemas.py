"""Table and record schemas, and the closed value sets."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed value sets (fixed values).
REASON_CODES = ("VELOCITY", "AMOUNT_SPIKE", "GEO_TRAVEL")
CLASSIFICATIONS = ("CONFIRMED_FRAUD", "LIKELY_FRAUD", "SUSPICIOUS", "LEGITIMATE", "UNKNOWN")
CASE_ACTIONS = ("APPROVE", "DENY", "ESCALATE", "BLOCK_ACCOUNT")
DIMENSIONS = ("CATEGORY", "MERCHANT", "ACCOUNT")

# Columns of the change-log rows; every one is read as text and cast leniently.
TRANSACTION_FIELDS = (
    "transaction_id",
    "account_id",
    "merchant_id",
    "amount",
    "currency",
    "latitude",
    "longitude",
    "event_time",
)
MERCHANT_FIELDS = ("merchant_id", "name", "category", "risk_category", "country")
ACCOUNT_FIELDS = ("account_id", "owner_name", "tier", "country", "credit_limit", "risk_score")

STRING, DOUBLE, LONG, INT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TRANSACTION = _schema(
    transaction_id=STRING,
    account_id=STRING,
    merchant_id=STRING,
    amount=DOUBLE,
    currency=STRING,
    latitude=DOUBLE,
    longitude=DOUBLE,
    event_time_ms=LONG,
    op=STRING,
)

MERCHANT = _schema(merchant_id=STRING, name=STRING, category=STRING, risk_category=STRING, country=STRING)

ACCOUNT = _schema(
    account_id=STRING, owner_name=STRING, tier=STRING, country=STRING, credit_limit=DOUBLE, risk_score=DOUBLE
)

SCORED = _schema(
    transaction_id=STRING,
    account_id=STRING,
    merchant_id=STRING,
    amount=DOUBLE,
    currency=STRING,
    latitude=DOUBLE,
    longitude=DOUBLE,
    event_time_ms=LONG,
    merchant_category=STRING,
    merchant_risk=STRING,
    account_tier=STRING,
    account_country=STRING,
    risk_score=DOUBLE,
    score_breakdown=T.MapType(STRING, DOUBLE),
)

ANOMALY = _schema(
    id=STRING,
    transaction_id=STRING,
    account_id=STRING,
    reason_code=STRING,
    evidence=T.MapType(STRING, STRING),
    detected_at_ms=LONG,
)

SPEND = _schema(
    window_start_ms=LONG,
    window_end_ms=LONG,
    dimension=STRING,
    dimension_value=STRING,
    total_amount=DOUBLE,
    txn_count=LONG,
)

VERDICT = _schema(
    anomaly_event_id=STRING,
    is_fraud=T.BooleanType(),
    confidence=DOUBLE,
    ai_risk_score=INT,
    classification=STRING,
    reasoning=STRING,
    recommended_actions=T.ArrayType(STRING),
    model_used=STRING,
    analyzed_at_ms=LONG,
)

CASE_ACTION = _schema(id=STRING, anomaly_event_id=STRING, action=STRING, notes=STRING, performed_at_ms=LONG)

# Storage types: money is double in the jobs and decimal only where it is written.
STORED_DECIMALS = {"amount": "decimal(12,2)", "credit_limit": "decimal(12,2)", "total_amount": "decimal(14,2)"}
