"""Ordered per-key computations that do not depend on a key fitting into one task.

A window partitioned by key puts all rows of the key into one task. Keys that hold many rows are
therefore taken out, spread evenly over range partitions of (key, order), and stored with the
number of their partition as slot. Each slot is computed on its own, and what happened in the earlier
slots of the key is carried in from one small summary row per slot. The spread looks at the whole
order, so a burst of rows at one moment is cut as well.

A slot has about the same number of rows whatever the total is, until there are a thousand slots. The tables of large keys and of slots are
joined without a hint: Spark broadcasts them if their measured size allows it. All other keys, normally
all there are, take the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import store

SLOT = "_slot"


@dataclass(frozen=True)
class SplitPolicy:
    """When a key is cut.

    A key is cut if it has more than ``min_rows`` rows; its slots hold about ``slot`` rows, by default one
    ``slots_per_share``-th of that. There are ``most_slots`` at most, beyond that they hold more rows each: a slot is a
    task and a range, which the driver hears of, and its rows are sorted on disk where memory is short.
    """

    min_rows: int = 2_000_000
    slots_per_share: int = 2
    slot: int | None = None
    most_slots: int = 1000

    @property
    def slot_rows(self) -> int:
        return self.slot or max(1, self.min_rows // self.slots_per_share)


@dataclass(frozen=True)
class LargeKeys:
    """The keys to cut and into how many slots."""

    keys: DataFrame
    names: list[str]
    slots: int

    def of(self, df: DataFrame) -> DataFrame:
        """The rows of these keys."""
        return df.join(self.keys, self._same(df), "left_semi")

    def others(self, df: DataFrame) -> DataFrame:
        return df.join(self.keys, self._same(df), "left_anti")

    def _same(self, df: DataFrame) -> list[Column]:
        return [df[name].eqNullSafe(self.keys[f"_large_{name}"]) for name in self.names]


def large_keys(df: DataFrame, keys: list[str], policy: SplitPolicy = SplitPolicy()) -> LargeKeys | None:
    """The keys to cut, or None. Reads the key columns once."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > policy.min_rows)
    found = store(counts, "large-keys")
    rows = found.agg(F.sum("_rows")).first()[0]
    if not rows:
        return None
    table = found.select(*[F.col(key).alias(f"_large_{key}") for key in keys])
    return LargeKeys(table, keys, max(2, min(policy.most_slots, math.ceil(rows / policy.slot_rows))))


def spread(rows: DataFrame, keys: list[str], order: list[str], slots: int) -> DataFrame:
    """Rows stored with a slot each; slots follow the order within every key and are about equally large.

    The slot has to be stored: range bounds come from a sample, and a second evaluation could draw them
    elsewhere. Copies that agree in the whole order are told apart by a number of their own.
    """
    numbered = rows.withColumn("_copy", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(slots, *keys, *order, "_copy")
    return store(ranged.withColumn(SLOT, F.spark_partition_id().cast("bigint")), "slots").drop("_copy")


def earlier_slots(keys: list[str]):
    """Window over slot summaries: all slots of the key before this one."""
    return Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Join slot carries to the rows of their slots."""
    on = [*keys, SLOT]
    named = carry.select(*[F.col(c).alias(f"_of_{c}") if c in on else F.col(c) for c in carry.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    return rows.join(named, same, "left").drop(*[f"_of_{c}" for c in on])


@dataclass(frozen=True)
class Running:
    """A running aggregate that can be cut: over rows, of one slot, and joined with its carry."""

    over_rows: Callable[[Column], Column]
    of_slot: Callable[[Column, Column], Column]
    join: Callable[[Column, Column], Column]


LATEST = Running(
    over_rows=lambda value: F.last(value, ignorenulls=True),
    of_slot=lambda value, rank: F.max_by(value, F.when(value.isNotNull(), rank)),
    join=lambda carried, local: F.coalesce(local, carried),
)

LARGEST = Running(
    over_rows=F.max,
    of_slot=lambda value, rank: F.max(value),
    join=lambda carried, local: F.greatest(carried, local),
)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    name: str,
    kind: Running,
    policy: SplitPolicy = SplitPolicy(),
    inclusive: bool = False,
) -> DataFrame:
    """Add ``name``: the running aggregate of ``value`` over the earlier rows of the key.

    ``inclusive`` counts the row itself.
    """
    base = df.withColumn("_value", value)
    large = large_keys(base, keys, policy)

    def local(rows: DataFrame, parts: list[str], target: str) -> DataFrame:
        window = Window.partitionBy(*parts).orderBy(*order)
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        return rows.withColumn(target, kind.over_rows(F.col("_value")).over(frame)).drop("_value")

    if large is None:
        return local(base, keys, name)
    cut = spread(large.of(base), keys, order, large.slots)
    totals = cut.groupBy(*keys, SLOT).agg(kind.of_slot(F.col("_value"), F.struct(*order)).alias("_total"))
    carry = totals.select(*keys, SLOT, kind.over_rows(F.col("_total")).over(earlier_slots(keys)).alias("_carried"))
    joined = with_carry(local(cut, [*keys, SLOT], "_local"), carry, keys)
    finished = joined.withColumn(name, kind.join(F.col("_carried"), F.col("_local"))).drop(SLOT, "_carried", "_local")
    return local(large.others(base), keys, name).unionByName(finished)


def merge_ordered(
    left: DataFrame, right: DataFrame, key: str, time_col: str, payload: str, policy: SplitPolicy = SplitPolicy()
) -> DataFrame:
    """Add to each row of ``left`` the ``payload`` of the last ``right`` row of its key at or before its time."""
    both = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(key, time_col, payload).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    merged = running(both, [key], [time_col, "_side"], F.col(payload), payload, LATEST, policy, inclusive=True)
    return merged.where(F.col("_side") == 1).drop("_side")
