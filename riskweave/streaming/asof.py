"""The profile version in force at each transaction, where both come as streams.

State per key: its versions by the time they hold from, and the transactions that the watermark hasn't passed, because a
version in force at their time may still come. When it passes them they are emitted with their version, and the versions
that no later transaction can need are dropped. Keys share places by a hash, so that a micro-batch calls the state store a
few times per place and not per key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from riskweave.sources.cdc import DELETE, parse_cdc, to_transactions, unwrap_cdc
from riskweave.sources.change_stream import TOPICS, read_change_stream
from riskweave.sources.sinks import append_batch
from riskweave.streaming.jobs import JobConfig, start_batches, stream_session
from riskweave.streaming.profiles import KINDS

#: Transactions that are emitted at once.
CHUNK = 10_000
#: Keys are dealt to so many places by a hash; a checkpoint's number of places never changes.
PLACES = 256
KEY, AT, ORDER, BODY, VERSION = "of_key", "at_ms", "version_order", "body", "version"
VERSIONS = f"versions array<struct<{KEY} string, valid_from long, {ORDER} long, {VERSION} string>>"
OUTPUT = f"{BODY} string, {VERSION} string"


class VersionProcessor(StatefulProcessor):
    """Emits each transaction once, with the version of its key in force at its time or null before the first one.

    Rows with a ``version_order`` are versions; of several that hold from one time the highest order counts. A row that
    comes behind the watermark is dropped, as its place has been passed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getValueState("versions", VERSIONS)
        self.waiting = handle.getListState("waiting", f"{KEY} string, {AT} long, {BODY} string")

    def _held(self) -> dict[str, dict[int, tuple[int, str]]]:
        """Order and version by key and the time from which it holds."""
        held: dict[str, dict[int, tuple[int, str]]] = {}
        for key, at, order, version in (self.versions.get() or ([],))[0]:
            held.setdefault(key, {})[at] = (order, version)
        return held

    def _hold(self, held: dict[str, dict[int, tuple[int, str]]]) -> None:
        self.versions.update(([(key, at, *known[at]) for key, known in held.items() for at in known],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, new = None, []
        for batch in rows:
            is_version = batch[ORDER].notna()
            new += batch.loc[is_version, [KEY, AT, ORDER, BODY]].itertuples(index=False, name=None)
            due = batch.loc[~is_version, [KEY, AT, BODY]]
            if len(due):
                asked = due.itertuples(index=False, name=None)
                self.waiting.appendList([(k if isinstance(k, str) else None, int(at), body) for k, at, body in asked])
            earliest = int(batch[AT].min())
            first = earliest if first is None else min(first, earliest)
        if new:
            held = self._held()
            for of, at, order, body in new:
                known, at, order = held.setdefault(of, {}), int(at), int(order)
                if at not in known or known[at][0] < order:
                    known[at] = (order, body)
            self._hold(held)
        # The earliest timer looks after all that comes later. Read to the end: the JVM keeps an iterator that isn't.
        if first is not None and all(timer > first for timer in list(self.handle.listTimers())):
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        times = {of: sorted(known) for of, known in held.items()}
        later, found = [], []
        for of, at, body in self.waiting.get():
            if at > watermark:
                later.append((of, at, body))
                continue
            place = bisect_right(times.get(of, []), at)
            found.append((body, held[of][times[of][place - 1]][1] if place else None))
            if len(found) == CHUNK:
                yield pd.DataFrame(found, columns=[BODY, VERSION])
                found = []
        if found:
            yield pd.DataFrame(found, columns=[BODY, VERSION])
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        ahead, dropped = [at for _, at, _ in later], False
        for of, known in times.items():
            passed = bisect_right(known, watermark)
            for at in known[: max(0, passed - 1)]:  # the last one passed still holds
                del held[of][at]
                dropped = True
            ahead += known[passed : passed + 1]
        if dropped:
            self._hold(held)
        if ahead:  # the timer that has just expired is still listed
            self.handle.registerTimer(min(ahead))

    def close(self) -> None:
        pass


def _timed(at_ms: Column | str) -> Column:
    return F.timestamp_millis(at_ms).alias("event_time")


def stream_asof(
    txns: DataFrame,
    versions: DataFrame,
    key: str,
    valid_from: str,
    order_col: str,
    time_col: str = "event_time_ms",
    tolerance: str = "5 seconds",
    salts: int = 4,
    places: int = PLACES,
) -> DataFrame:
    """``enrich_asof`` of two streams: all columns of ``txns`` and struct ``version`` (null before the first one).

    The watermark is that of the stream that is behind, so a stream that rests holds the other one back. The
    transactions of a key are dealt to ``salts`` places with a copy of its versions each, so that a hot key is split. A task
    holds the versions and the transactions ahead of the watermark of one of ``places`` and salt. Rows without a key have no version
    and pass through state like others; rows without a time can't be placed and are left out, as are versions
    without an order.
    """
    rows = txns.where(F.col(time_col).isNotNull())
    known = versions.where(F.col(valid_from).isNotNull() & F.col(order_col).isNotNull())
    body = F.to_json(F.struct(*txns.columns), {"ignoreNullFields": "false"})
    payload = F.struct(*[c for c in versions.columns if c != key])
    # A key that is null must not find the versions of a null key.
    asked = rows.select(
        F.col(key).cast("string").alias(KEY),
        F.pmod(F.xxhash64(body), F.lit(salts)).cast("int").alias("_salt"),
        F.col(time_col).cast("bigint").alias(AT),
        F.lit(None).cast("bigint").alias(ORDER),
        body.alias(BODY),
        _timed(time_col),
    ).withWatermark("event_time", tolerance)
    given = known.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias(KEY),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        F.col(valid_from).cast("bigint").alias(AT),
        F.col(order_col).cast("bigint").alias(ORDER),
        F.to_json(payload).alias(BODY),
        _timed(valid_from),
    ).withWatermark("event_time", tolerance)
    found = (
        asked.unionByName(given)
        .withColumn("_place", F.pmod(F.xxhash64(KEY), F.lit(places)).cast("int"))
        .groupBy("_place", "_salt")
        .transformWithStateInPandas(
            statefulProcessor=VersionProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
        )
    )
    kept = versions.select(payload.alias("v")).schema["v"].dataType
    # Parsed once: a generator keeps the optimizer from parsing per column.
    parsed = found.select(
        F.inline(F.array(F.struct(F.from_json(BODY, txns.schema).alias("_row"), F.from_json(VERSION, kept).alias(VERSION))))
    )
    return parsed.select("_row.*", VERSION)


def start_asof_job(spark: SparkSession, cfg: JobConfig, profiles: Mapping[str, str], kind: str = "merchants", salts: int = 4) -> StreamingQuery:
    """Change records to transactions with struct ``version``: their profile as the topic of ``kind`` had it at their time.

    A change holds from its time on, of changes at one time the one of the highest offset; from a delete on there is no
    profile.
    """
    key, fields, _, typed = KINDS[kind]
    txns = to_transactions(unwrap_cdc(read_change_stream(stream_session(spark), cfg.source, cfg.raw_topic))).drop("topic", "offset")
    changes = typed(parse_cdc(read_change_stream(spark, profiles, TOPICS[kind], starting="earliest"), fields=fields))
    log = changes.select(*fields, "op", "ts_ms", F.coalesce("offset", F.lit(-1)).alias("offset"))
    rows = stream_asof(txns, log, key, "ts_ms", "offset", tolerance=cfg.tolerance, salts=salts)
    there = ~F.col("version.op").eqNullSafe(F.lit(DELETE))
    return start_batches(
        rows.withColumn("version", F.when(there, F.col("version"))), cfg, f"asof-{kind}", lambda batch, batch_id: append_batch(batch, cfg.table, batch_id)
    )
