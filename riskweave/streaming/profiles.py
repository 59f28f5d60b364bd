"""Profiles as tables that change streams keep current, so that no job replays a topic.

One job per topic merges each micro-batch of changes into a keyed table; a deleted profile stays as a mark, so
that an older change that comes late doesn't bring it back. The score job reads the tables by their newest head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.schemas import ACCOUNT, ACCOUNT_FIELDS, MERCHANT, MERCHANT_FIELDS
from riskweave.sources.cdc import DELETE, parse_cdc, to_accounts, to_merchants
from riskweave.sources.change_stream import TOPICS, read_change_stream
from riskweave.sources.keyed_table import KeyedTable
from riskweave.streaming.jobs import JobConfig, start_batches

#: Per kind of profile: its key, its columns, its row type and how changes become rows.
KINDS = {
    "merchants": ("merchant_id", MERCHANT_FIELDS, MERCHANT, to_merchants),
    "accounts": ("account_id", ACCOUNT_FIELDS, ACCOUNT, to_accounts),
}
ORDER = ("ts_ms", "offset")


def profile_table(spark: SparkSession, path: str, kind: str, buckets: int = 64) -> KeyedTable:
    """The table of one kind of profile."""
    key, fields, row, _ = KINDS[kind]
    typed = ", ".join(f"{f} {row[f].dataType.simpleString()}" for f in fields)
    return KeyedTable(spark, path, f"{typed}, op string, ts_ms bigint, offset bigint", (key,), ORDER, buckets=buckets)


def current_profiles(table: KeyedTable) -> DataFrame:
    """The profiles of the moment, without deleted ones."""
    return table.read().where(~F.col("op").eqNullSafe(F.lit(DELETE))).drop("op", *ORDER)


def start_profile_job(spark: SparkSession, cfg: JobConfig, kind: str, buckets: int = 64) -> StreamingQuery:
    """Merge the changes of one topic into the table in ``cfg.table``, from the beginning of the topic on."""
    _, fields, _, typed = KINDS[kind]
    table = profile_table(spark, cfg.table, kind, buckets)
    records = read_change_stream(spark, cfg.source, TOPICS[kind], starting="earliest")
    changes = typed(parse_cdc(records, fields=fields))
    # A change without a time counts as the oldest.
    changes = changes.withColumns({"ts_ms": F.coalesce("ts_ms", F.lit(0)), "offset": F.coalesce("offset", F.lit(-1))})
    return start_batches(changes, cfg, kind, lambda batch, batch_id: table.write(batch, batch_id))
