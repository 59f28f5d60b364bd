"""The profiles of the moment, replayed from their change topics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from riskweave.schemas import ACCOUNT_FIELDS, MERCHANT_FIELDS
from riskweave.sources.cdc import parse_cdc, to_accounts, to_merchants
from riskweave.sources.change_stream import TOPICS, read_change_stream
from riskweave.sources.snapshots import latest_per_key

ORDER = ["ts_ms", "offset"]


def read_merchants(spark: SparkSession, source: Mapping[str, str], topic: str = TOPICS["merchants"]) -> DataFrame:
    """Last state of each merchant, from the beginning of the topic on."""
    changes = read_change_stream(spark, source, topic, streaming=False)
    log = to_merchants(parse_cdc(changes, fields=MERCHANT_FIELDS))
    return latest_per_key(log, "merchant_id", ORDER).select(*MERCHANT_FIELDS)


def read_accounts(spark: SparkSession, source: Mapping[str, str], topic: str = TOPICS["accounts"]) -> DataFrame:
    """Last state of each account, from the beginning of the topic on."""
    changes = read_change_stream(spark, source, topic, streaming=False)
    log = to_accounts(parse_cdc(changes, fields=ACCOUNT_FIELDS))
    return latest_per_key(log, "account_id", ORDER).select(*ACCOUNT_FIELDS)
