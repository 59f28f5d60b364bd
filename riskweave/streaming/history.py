"""Account history as keyed state: the facts of ``account_history``, one micro-batch at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskweave.operators.rules import DEFAULT_RULES, Rule, apply_rules, history_rows
from riskweave.params import RuleParams

#: Accounts are dealt to so many places by a hash, and state is read and written once per place and micro-batch: a call to
#: the state store costs more than the sums of an account. A checkpoint's number of places never changes.
PLACES, PLACE = 1024, "_place"
ROW = ("transaction_id", "event_time_ms", "amount", "latitude", "longitude")
WAITING = ("account_id", *ROW)
WAITING_SCHEMA = "account_id string, transaction_id string, event_time_ms long, amount double, latitude double, longitude double"
FACT_SCHEMA = (
    "account_id string, transaction_id string, event_time_ms long, amount double, latitude double, longitude double, "
    "recent_count long, prior_count long, prior_mean double, prior_stddev double, "
    "prev_latitude double, prev_longitude double, prev_event_time_ms long"
)
FACT_COLUMNS = [part.split()[0] for part in FACT_SCHEMA.split(", ")]
#: Objects in a table, so that missing values stay null and are not taken for numbers.
NULLABLE = ("prior_mean", "prev_latitude", "prev_longitude", "prev_event_time_ms")
STATE_SCHEMA = (
    "accounts array<struct<account_id string, n long, mean double, squares double, latitude double, longitude double, "
    "located_ms long, times array<long>, seen_ms long, ends_ms long>>"
)
NEW = (0, 0.0, 0.0, None, None, None, ())

SUMMARY = "summary"


class AnomalyProcessor(StatefulProcessor):
    """Emits each row of an account with the account's facts just before it. A key is a place with many accounts.

    State per account: three numbers about the amounts, the last location, and the event
    times inside the velocity window; those of a place's accounts are one value. The rows of a micro-batch are put in
    event-time order; between micro-batches arrival order counts, and late rows count like all others. ``strict_order``
    holds rows back until the watermark has passed them, so that order between micro-batches is event-time order too, at
    the price of the watermark delay and of the rows behind it.

    The rows of one place in one micro-batch are held in memory: bound them with the source's
    ``maxOffsetsPerTrigger`` or ``maxBytesPerTrigger``.

    With ``idle_ms`` the state of an account that has had no row for so long is removed, and the account starts
    anew. The time is that of the machine, so this goes with arrival order only.
    """

    def __init__(self, params: RuleParams = RuleParams(), strict_order: bool = False, idle_ms: int | None = None):
        if strict_order and idle_ms is not None:
            raise ValueError("state expires by the machine's time, strict order goes by event time")
        self.params = params
        self.strict_order = strict_order
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A place without rows ends as a whole, its accounts one by one when it has some.
        self.summary = handle.getValueState(SUMMARY, STATE_SCHEMA, self.idle_ms)
        self.waiting = handle.getListState("waiting", WAITING_SCHEMA) if self.strict_order else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([batch[list(WAITING)] for batch in rows], ignore_index=True)
        if not self.strict_order:
            yield self._facts(arrived, None if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs())
            return
        self.waiting.appendList(list(arrived.itertuples(index=False, name=None)))
        first = int(arrived["event_time_ms"].min())
        # Read to the end: the JVM keeps an iterator that isn't.
        if all(timer > first for timer in list(self.handle.listTimers())):
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame([tuple(row) for row in self.waiting.get()], columns=list(WAITING))
        due = held["event_time_ms"] <= watermark
        if due.all():
            self.waiting.clear()
        else:
            later = held[~due]
            self.waiting.put(list(later.itertuples(index=False, name=None)))
            self.handle.registerTimer(int(later["event_time_ms"].min()))
        if due.any():
            yield self._facts(held[due], None)

    def close(self) -> None:
        pass

    def _facts(self, rows: pd.DataFrame, now_ms: int | None) -> pd.DataFrame:
        stored = self.summary.get()
        held = {}
        for account, *values, seen_ms, ends_ms in stored[0] if stored else ():
            if now_ms is None or ends_ms > now_ms:
                held[account] = (*values, seen_ms, ends_ms)
        ends_ms = None if now_ms is None else now_ms + self.idle_ms
        arrived: dict[str | None, list[tuple]] = {}
        for account, *row in _plain(rows, WAITING):
            arrived.setdefault(account, []).append(tuple(row))
        found = []
        for account, its_rows in arrived.items():
            n, mean, squares, latitude, longitude, located_ms, times = held[account][:7] if account in held else NEW
            facts, state = row_facts(its_rows, (n, mean, squares), (latitude, longitude, located_ms), times or (), self.params.window_ms)
            found.extend((account, *fact) for fact in facts)
            held[account] = (*state, now_ms, ends_ms)
        self.summary.update(([(account, *values) for account, values in held.items()],))
        return _table(found, FACT_COLUMNS)


def _plain(rows: pd.DataFrame, names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of Python values, with null for a text that is missing."""
    kinds = {"event_time_ms": np.int64, "amount": np.float64, "latitude": np.float64, "longitude": np.float64}
    columns = [
        rows[c].to_numpy(kinds[c]).tolist() if c in kinds else [v if isinstance(v, str) else None for v in rows[c]] for c in names
    ]
    return zip(*columns, strict=True)


def _table(facts: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = dict(zip(names, zip(*facts, strict=True), strict=True))
    return pd.DataFrame({c: pd.Series(values, dtype=object) if c in NULLABLE else list(values) for c, values in columns.items()})


def _in_order(row: tuple) -> tuple:
    """By time and id, rows without an id last."""
    return row[1], row[0] is None, row[0] or ""


def row_facts(
    rows: list[tuple], amounts: tuple[int, float, float], place: tuple, times: Sequence[int], window_ms: int
) -> tuple[list[tuple], tuple]:
    """Facts of each of an account's rows, in event-time order, and the state after the last one.

    ``times`` are those kept from earlier rows. A row drops the times that have left its window, and counts
    the ones that are left with its own, also those that lie ahead of a late row.

    Plain numbers: most accounts have a few rows in a micro-batch, fewer than columns pay for.
    """
    kept, seen, facts = sorted(times), [], []
    rows = sorted(rows, key=_in_order)
    count, mean, around = amounts
    squares = around
    # Sums of distances from a value near the amounts keep their digits.
    origin = mean if count else rows[0][2]
    first = second = 0.0
    old = new = 0  # times before these places have left the window, which only moves ahead
    for row in rows:
        _, now, amount, latitude, longitude = row
        limit = now - window_ms
        seen.append(now)
        while old < len(kept) and kept[old] < limit:
            old += 1
        while seen[new] < limit:
            new += 1
        spread = math.sqrt(around / (count - 1)) if count > 1 else 0.0
        facts.append((*row, len(kept) - old + len(seen) - new, count, mean if count else None, spread, *place))
        count += 1
        gap = amount - origin
        first += gap
        second += gap * gap
        mean = origin + first / count
        around = squares + second - first * first / count
        if around < 0:  # rounding; what is no number stays so
            around = 0.0
        if not (latitude == 0.0 and longitude == 0.0):
            place = (latitude, longitude, now)
    return facts, (count, mean, around, *place, sorted(kept[old:] + seen[new:]))


def account_facts(
    rows: pd.DataFrame, amounts: tuple[int, float, float], place: tuple, times: list[int], window_ms: int
) -> tuple[pd.DataFrame, tuple]:
    """``row_facts`` of a table."""
    facts, state = row_facts(list(_plain(rows, ROW)), amounts, place, times, window_ms)
    return _table(facts, FACT_COLUMNS[1:]), state


def stream_facts(
    scored: DataFrame,
    params: RuleParams = RuleParams(),
    strict_order: bool = False,
    idle_ms: int | None = None,
    places: int = PLACES,
) -> DataFrame:
    """Stream of rows with account facts.

    With ``strict_order`` the rows carry a watermark on ``event_time``; without it they carry none, as rows
    behind a watermark would not reach the state.
    """
    narrow = history_rows(scored, ["transaction_id"], ("event_time",) if strict_order else ())
    dealt = narrow.withColumn(PLACE, F.pmod(F.xxhash64("account_id"), F.lit(places)).cast("int"))
    facts = dealt.groupBy(PLACE).transformWithStateInPandas(
        statefulProcessor=AnomalyProcessor(params, strict_order, idle_ms),
        outputStructType=FACT_SCHEMA,
        outputMode="Append",
        timeMode="EventTime" if strict_order else "None" if idle_ms is None else "ProcessingTime",
    )
    previous = F.struct(
        F.col("prev_latitude").alias("latitude"),
        F.col("prev_longitude").alias("longitude"),
        F.col("prev_event_time_ms").alias("event_time_ms"),
    )
    return facts.withColumn("previous", F.when(F.col("prev_event_time_ms").isNotNull(), previous)).drop(
        "prev_latitude", "prev_longitude", "prev_event_time_ms"
    )


def stream_anomalies(
    scored: DataFrame,
    params: RuleParams = RuleParams(),
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    strict_order: bool = False,
    idle_ms: int | None = None,
) -> DataFrame:
    """Stream of anomalies, by the same rules as in batch."""
    return apply_rules(stream_facts(scored, params, strict_order, idle_ms), params, rules)


def account_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the anomaly job holds of each account after its last micro-batch, read from the job's checkpoint.

    ``recent_count`` counts the event times of the window that ends with the account's last row.
    """
    held = spark.read.format("statestore").option("stateVarName", SUMMARY).load(checkpoint)
    # State that expires is stored with its end.
    value = "value.value" if "value" in held.schema["value"].dataType.fieldNames() else "value"
    accounts = held.select(F.explode(f"{value}.accounts").alias("v"))
    # Accounts that had ended by the last micro-batch lie in their place until it has rows.
    there = F.coalesce(F.col("v.ends_ms") > accounts.agg(F.max("v.seen_ms")).scalar(), F.lit(True))
    n, squares = F.col("v.n"), F.col("v.squares")
    return accounts.where(there).select(
        "v.account_id",
        n.alias("amount_count"),
        F.col("v.mean").alias("amount_mean"),
        F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(F.lit(0.0)).alias("amount_stddev"),
        "v.latitude",
        "v.longitude",
        "v.located_ms",
        F.size("v.times").cast("bigint").alias("recent_count"),
    )
