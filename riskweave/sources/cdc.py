"""Change envelopes ``{"before", "after", "op", "ts_ms"}`` to typed rows.

Every leaf is read as text and cast leniently, because one bad field must not lose the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.json import parse_once
from riskweave.functions.times import if_positive, parse_millis, to_millis
from riskweave.schemas import ACCOUNT_FIELDS, MERCHANT_FIELDS, TRANSACTION, TRANSACTION_FIELDS

DELETE = "d"
CREATE = "c"
DEFAULT_CURRENCY = "USD"


def _envelope(fields: tuple[str, ...]) -> T.StructType:
    row = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    text = T.StringType()
    return T.StructType(
        [
            T.StructField("before", row),
            T.StructField("after", row),
            T.StructField("op", text),
            T.StructField("ts_ms", text),
            T.StructField("source", T.StructType([T.StructField("table", text)])),
        ]
    )


def parse_cdc(df: DataFrame, value_col: str = "value", fields: tuple[str, ...] = TRANSACTION_FIELDS) -> DataFrame:
    """Readable envelopes as columns before, after, op, ts_ms, deletes included."""
    return parse_once(df, value_col, _envelope(fields), "_e").select(
        *[c for c in df.columns if c != value_col],
        F.col("_e.before").alias("before"),
        F.col("_e.after").alias("after"),
        F.coalesce("_e.op", F.lit(CREATE)).alias("op"),
        F.col("_e.ts_ms").try_cast("bigint").alias("ts_ms"),
    )


def unwrap_cdc(df: DataFrame, value_col: str = "value", fields: tuple[str, ...] = TRANSACTION_FIELDS) -> DataFrame:
    """Envelopes that hold a row: no deletes, no missing ``after``, nothing unreadable."""
    return parse_cdc(df, value_col, fields).where((F.col("op") != DELETE) & F.col("after").isNotNull()).drop("before")


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"after.{name}"), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(f"after.{name}").try_cast("double"), F.lit(0.0))


def to_transactions(unwrapped: DataFrame) -> DataFrame:
    """Typed transactions with defaults for what is missing or unreadable.

    The event time falls back to the envelope's time and then to the time of ingestion.
    """
    carried = [c for c in unwrapped.columns if c not in ("after", "op", "ts_ms", "ingest_ts")]
    ingested = F.col("ingest_ts") if "ingest_ts" in unwrapped.columns else F.current_timestamp()
    event_time = F.coalesce(if_positive(F.col("_event_ms")), if_positive(F.col("ts_ms")), to_millis(ingested))
    currency = _text("currency")
    typed = {
        "transaction_id": _text("transaction_id"),
        "account_id": _text("account_id"),
        "merchant_id": _text("merchant_id"),
        "amount": _number("amount"),
        "currency": F.when(currency == "", DEFAULT_CURRENCY).otherwise(currency),
        "latitude": _number("latitude"),
        "longitude": _number("longitude"),
        "event_time_ms": event_time,
        "op": F.col("op"),
    }
    # A projection of its own, so that the time is parsed once and not wherever it is used.
    timed = unwrapped.withColumn("_event_ms", parse_millis(F.col("after.event_time")))
    return timed.select(*carried, *[typed[name].alias(name) for name in TRANSACTION.fieldNames()])


def keep_first_version(txns: DataFrame, order_col: str) -> DataFrame:
    """One row per transaction id: updates do not count a second time."""
    values = [c for c in txns.columns if c != "transaction_id"]
    first = F.min_by(F.struct(*values), order_col).alias("_row")
    return txns.groupBy("transaction_id").agg(first).select("transaction_id", "_row.*").select(*txns.columns)


def to_merchants(changes: DataFrame) -> DataFrame:
    """Typed merchant rows of parsed changes; the order columns and ``op`` stay."""
    return _profile(changes, "merchant_id", MERCHANT_FIELDS, numbers=())


def to_accounts(changes: DataFrame) -> DataFrame:
    return _profile(changes, "account_id", ACCOUNT_FIELDS, numbers=("credit_limit", "risk_score"))


def _profile(changes: DataFrame, key: str, fields: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    # A delete carries its key in ``before`` only.
    def value(name: str) -> Column:
        column = F.col(f"after.{name}")
        if name == key:
            column = F.coalesce(column, F.col(f"before.{name}"))
        return (column.try_cast("double") if name in numbers else column).alias(name)

    others = [c for c in changes.columns if c not in ("before", "after")]
    return changes.select(*others, *[value(name) for name in fields]).where(F.col(key).isNotNull())
