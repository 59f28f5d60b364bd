"""Current state from change logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELETE = "d"


def latest_per_key(df: DataFrame, key: str | list[str], order_cols: list[str], op_col: str | None = "op") -> DataFrame:
    """The last row of each key; keys whose last change is a delete are gone.

    Partial winners are formed before the shuffle, so a key that changes often costs no more than others.
    """
    keys = [key] if isinstance(key, str) else list(key)
    values = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*order_cols)).alias("_row")
    rows = df.groupBy(*keys).agg(last).select(*keys, "_row.*").select(*df.columns)
    return rows if op_col is None else rows.where(~F.col(op_col).eqNullSafe(F.lit(DELETE)))


def snapshot_plus_changes(
    snapshot: DataFrame, changes: DataFrame, key: str | list[str], order_cols: list[str], op_col: str = "op"
) -> DataFrame:
    """Current state from an initial snapshot and the changes after it.

    Snapshot rows have no position in the log, so they rank before every change; they count as read
    (``r``) rows.
    """
    columns = [c for c in changes.columns if c not in (op_col, *order_cols)]
    first = snapshot.select(*columns, F.lit("r").alias(op_col)).withColumn("_logged", F.lit(0))
    both = first.unionByName(changes.withColumn("_logged", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, key, ["_logged", *order_cols], op_col).select(*columns)


def versions(df: DataFrame, key: str, time_col: str, order_cols: list[str]) -> DataFrame:
    """One row per key and time of change: of changes at the same time the last one counts."""
    return latest_per_key(df, [key, time_col], order_cols, op_col=None)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
