"""Keyed writes as DataFrame operators: target and new rows in, new table out.

New rows are reduced to one per key before they meet the target, so no key repeats in the join and a
hot key cannot skew it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """One row per key, the last by ``order_col``; partial results are formed before the shuffle."""
    if order_col is None:
        return rows.dropDuplicates(keys)
    values = [c for c in rows.columns if c not in keys]
    # The row itself breaks ties of the order column, so the choice does not depend on arrival.
    sortable = [c for c in values if "map<" not in rows.schema[c].dataType.simpleString()]
    latest = F.max_by(F.struct(*values), F.struct(order_col, *[c for c in sortable if c != order_col]))
    return rows.groupBy(*keys).agg(latest.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: list[str],
    update_cols: list[str] | None = None,
    order_col: str | None = None,
) -> DataFrame:
    """Insert new keys, and replace ``update_cols`` (default: all but the keys) of known keys."""
    replaced = set(update_cols if update_cols is not None else [c for c in target.columns if c not in keys])
    latest = last_per_key(updates, keys, order_col).select(*target.columns)
    old = target.withColumn("_old", F.lit(True)).alias("old")
    new = latest.withColumn("_new", F.lit(True)).alias("new")
    joined = old.join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full_outer")
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def pick(name: str):
        from_new = is_new if name in replaced else is_new & ~is_old
        return F.when(from_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return joined.select(*[pick(c) for c in target.columns])


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """Append the rows whose key is not in the target; the first of repeated keys if ``order_col`` is given."""
    if order_col is None:
        first = rows.dropDuplicates(keys)
    else:
        values = [c for c in rows.columns if c not in keys]
        chosen = F.min_by(F.struct(*values), order_col).alias("_row")
        first = rows.groupBy(*keys).agg(chosen).select(*keys, "_row.*")
    absent = first.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(absent.select(*target.columns))


def append_idempotent(target: DataFrame, rows: DataFrame, id_cols: list[str]) -> DataFrame:
    """Append, where a row that was written before (same ``id_cols``) is not written again."""
    return insert_if_absent(target, rows, id_cols)
