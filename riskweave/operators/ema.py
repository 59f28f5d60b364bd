"""Exponential moving average of an account's amounts, as a feature next to the score.

``ema = (1 - alpha) * previous + alpha * amount``, started at the account's first amount.

A closed form over a whole account overflows, because it divides by powers of ``1 - alpha``. The rows
are therefore numbered and grouped into blocks that are short enough for double precision; a block
starts from the end of the block before it. The ends of blocks are chained by doubling: each takes up the end of the
block before it, then that of two blocks before, of four and so on, until double precision holds nothing older.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.ordered import SLOT, SplitPolicy, large_keys, spread, with_carry

KEYS = ["account_id"]
ORDER = ["event_time_ms", "transaction_id"]
BLOCK_WEIGHT = 1e-12  # weight of a block's start at its end
DECADES = 640  # between the largest and the least number of double precision


def account_ema(
    txns: DataFrame,
    alpha: float = 0.1,
    policy: SplitPolicy = SplitPolicy(),
    before: DataFrame | None = None,
    many: int | None = None,
) -> DataFrame:
    """``ema`` after each transaction: account_id, transaction_id, event_time_ms, ema.

    ``before`` (account_id, start) has the averages that accounts had before all of ``txns``. ``many`` is the number of
    ``txns`` where it is known: so few that no account can have enough rows to be cut aren't counted by account.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie between 0 and 1")
    base = txns.select(*KEYS, *ORDER, F.coalesce("amount", F.lit(0.0)).alias("amount"))
    large = None if many is not None and many <= policy.min_rows else large_keys(base, KEYS, policy)
    whole = _started(_within(large.others(base) if large else base, KEYS, alpha), before)
    averages = _finish(whole, alpha)
    if large:
        rows = _within(spread(large.of(base), KEYS, ORDER, large.slots), [*KEYS, SLOT], alpha)
        averages = averages.unionByName(_finish(with_carry(rows, _slot_starts(rows, alpha, before), KEYS), alpha))
    return averages


def _started(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """Adds _start: the average before the rows, or the first amount of an account that has none."""
    if before is None:
        return rows.withColumn("_start", F.col("_first"))
    known = before.select(*[F.col(key).alias(f"_of_{key}") for key in KEYS], F.col("start").alias("_before"))
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in KEYS]
    joined = rows.join(known, same, "left").withColumn("_start", F.coalesce("_before", "_first"))
    return joined.drop("_before", *known.columns)


def _finish(rows: DataFrame, alpha: float) -> DataFrame:
    """Adds what the start value still weighs after the rows since then."""
    half = F.pow(F.lit(1.0 - alpha), F.col("_row") / 2)  # no zero where the product isn't
    return rows.select(*KEYS, "transaction_id", "event_time_ms", (F.col("_own") + F.col("_start") * half * half).alias("ema"))


def _within(rows: DataFrame, parts: list[str], alpha: float) -> DataFrame:
    """Adds _row (number in the partition), _first (first amount) and _own: the average started at zero."""
    keep = 1.0 - alpha
    size = max(1, math.floor(math.log(BLOCK_WEIGHT) / math.log(keep)))
    part = Window.partitionBy(*parts).orderBy(*ORDER)
    numbered = rows.withColumns(
        {
            "_row": F.row_number().over(part),
            "_first": F.first("amount").over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    ).withColumns(
        {
            "_block": F.floor((F.col("_row") - 1) / size),
            "_step": ((F.col("_row") - 1) % size + 1).cast("double"),
        }
    )
    block = Window.partitionBy(*parts, "_block").orderBy("_row")
    growth = F.pow(F.lit(keep), -F.col("_step"))
    scaled = F.sum(F.col("amount") * growth).over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_block = numbered.withColumn("_in_block", scaled * alpha * F.pow(F.lit(keep), F.col("_step")))
    by_row = Window.partitionBy(*parts).orderBy("_row")
    ends = F.col("_step") == float(size)
    chained = in_block.withColumn("_end", F.when(ends, F.col("_in_block")))
    blocks = math.ceil(DECADES / -(size * math.log10(keep)))  # so many blocks back, nothing is left of any amount
    for level in range(math.ceil(math.log2(max(2, blocks)))):
        # The weight is applied in halves, which are no zero where the product isn't.
        half = keep ** (size * 2**level / 2)
        older = F.coalesce(F.lag("_end", size * 2**level).over(by_row), F.lit(0.0))
        chained = chained.withColumn("_end", F.col("_end") + older * half * half)
    before = F.coalesce(F.last("_end", ignorenulls=True).over(by_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return chained.withColumn("_own", F.col("_in_block") + before * F.pow(F.lit(keep), F.col("_step"))).drop(
        "_block", "_step", "_in_block", "_end"
    )


def _slot_starts(rows: DataFrame, alpha: float, before: DataFrame | None = None) -> DataFrame:
    """The average at the start of each slot of the cut accounts.

    Only the one summary row per slot goes through pandas; their number is bounded by the split policy.
    """
    ends = rows.groupBy(*KEYS, SLOT).agg(
        F.max("_row").alias("rows"), F.max_by("_own", "_row").alias("own"), F.first("_first").alias("_first")
    )
    ends = _started(ends, before)
    keep = 1.0 - alpha

    def chain(slots: pd.DataFrame) -> pd.DataFrame:
        slots = slots.sort_values(SLOT)
        starts, value = [], slots["_start"].iloc[0]
        for rows, own in zip(slots["rows"], slots["own"], strict=True):
            starts.append(value)
            value = own + value * keep**rows
        return pd.DataFrame({KEYS[0]: slots[KEYS[0]], SLOT: slots[SLOT], "_start": starts})

    return ends.groupBy(*KEYS).applyInPandas(chain, f"{KEYS[0]} string, {SLOT} bigint, _start double")
