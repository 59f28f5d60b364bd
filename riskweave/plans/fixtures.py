"""The payment tables as views over the generated test tables.

Suppliers stand for merchants, customers for accounts and events for transactions. Gaps in the
dimensions make look-ups miss, and every 20th transaction has no location. Ids are padded so that
text order is event order.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.rules import detect_anomalies
from riskweave.operators.spend import spend_union
from riskweave.params import RuleParams
from riskweave.plans.batch import score
from riskweave.session import store, use_utc
from riskweave.sources.cdc import DELETE

# The events are sparse, so the velocity rule looks at half days here.
PARAMS = RuleParams(max_txn=4, window_ms=12 * 3_600_000)
DAY_MS = 86_400_000


def number(text: str) -> Column:
    return F.col(text).cast("bigint")


class Fixture:
    """The views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = use_utc(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def merchants(self) -> DataFrame:
        kind = F.col("s_suppkey") % 6
        joined = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        category = F.element_at(
            F.array(*[F.lit(c) for c in ("RETAIL", "TRAVEL", "FOOD", "CRYPTO", "FUEL", "UNKNOWN")]),
            (kind + 1).cast("int"),
        )
        risk = F.when(kind == 1, "MEDIUM").when(kind.isin(3, 5), "HIGH").otherwise("LOW")
        return joined.where(F.col("s_suppkey") % 7 != 3).select(
            F.col("s_suppkey").cast("string").alias("merchant_id"),
            F.col("s_name").alias("name"),
            category.alias("category"),
            risk.alias("risk_category"),
            F.col("n_name").alias("country"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        key = F.col("c_custkey")
        joined = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.where(key % 11 != 5).select(
            key.cast("string").alias("account_id"),
            F.col("c_name").alias("owner_name"),
            F.when(key % 3 == 0, "STANDARD").when(key % 3 == 1, "PREMIUM").otherwise("VIP").alias("tier"),
            F.when(F.col("c_nationkey") < 15, "US").otherwise(F.col("n_name")).alias("country"),
            (F.lit(1000) + key % 50 * 500).cast("double").alias("credit_limit"),
            ((key % 10).cast("double") / 10).alias("risk_score"),
        )

    def as_transactions(self, events: DataFrame) -> DataFrame:
        """Event rows, of a batch or a stream, as transactions."""
        event, user = F.col("event_id"), F.col("user_id")
        suppliers = self.table("supplier").select(F.count(F.lit(1)).alias("n")).scalar()
        nowhere = event % 20 == 0
        jump = F.when(event % 50 == 7, 40).otherwise(0)
        latitude = ((user * 37) % 120 - 60 + jump).cast("double") + (event % 5).cast("double") / 100
        longitude = ((user * 53) % 300 - 150).cast("double") + (event % 7).cast("double") / 100
        return events.select(
            F.lpad(event.cast("string"), 12, "0").alias("transaction_id"),
            user.cast("string").alias("account_id"),
            (event % suppliers).cast("string").alias("merchant_id"),
            F.col("value").alias("amount"),
            F.lit("USD").alias("currency"),
            F.when(nowhere, 0.0).otherwise(latitude).alias("latitude"),
            F.when(nowhere, 0.0).otherwise(longitude).alias("longitude"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time_ms"),
            F.when(event % 97 == 0, DELETE).when(event % 41 == 0, "u").otherwise("c").alias("op"),
        )

    @cached_property
    def all_transactions(self) -> DataFrame:
        return self.as_transactions(self.table("events"))

    @cached_property
    def transactions(self) -> DataFrame:
        """Without the deleted ones."""
        return self.all_transactions.where(F.col("op") != DELETE)

    @cached_property
    def scored(self) -> DataFrame:
        return score(self.transactions, self.merchants, self.accounts)

    @cached_property
    def anomalies(self) -> DataFrame:
        return detect_anomalies(self.transactions, PARAMS)

    @cached_property
    def anomaly_table(self) -> DataFrame:
        """The anomalies as a stored table, which is how the case layer finds them."""
        return store(self.anomalies, "anomalies")

    @cached_property
    def spend(self) -> DataFrame:
        return spend_union(self.scored)

    @cached_property
    def verdicts(self) -> DataFrame:
        """Two of three anomalies have a verdict."""
        n = number("transaction_id")
        points = (n * 13 % 101).cast("int")
        label = (
            F.when(points >= 85, "CONFIRMED_FRAUD")
            .when(points >= 70, "LIKELY_FRAUD")
            .when(points >= 40, "SUSPICIOUS")
            .when(points >= 10, "LEGITIMATE")
            .otherwise("UNKNOWN")
        )
        return self.anomaly_table.where(n % 3 != 0).select(
            F.concat(F.lit("verdict-"), "id").alias("id"),
            F.col("id").alias("anomaly_event_id"),
            (points >= 70).alias("is_fraud"),
            (points / 100).cast("double").alias("confidence"),
            points.alias("ai_risk_score"),
            label.alias("classification"),
            F.concat(F.lit("score "), points.cast("string")).alias("reasoning"),
            F.array(F.lower(label)).alias("recommended_actions"),
            F.lit("fixture").alias("model_used"),
            (F.col("detected_at_ms") + 1000).alias("analyzed_at_ms"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Up to three actions per case."""
        n = number("transaction_id")
        numbers = F.slice(F.array(*map(F.lit, (1, 2, 3))), 1, (n % 4).cast("int"))
        steps = self.anomaly_table.withColumn("k", F.explode(numbers))
        names = F.array(*[F.lit(a) for a in ("APPROVE", "DENY", "ESCALATE", "BLOCK_ACCOUNT")])
        return steps.select(
            F.concat_ws("#", "id", F.col("k").cast("string")).alias("id"),
            F.col("id").alias("anomaly_event_id"),
            F.element_at(names, ((n + F.col("k")) % 4 + 1).cast("int")).alias("action"),
            F.concat(F.lit("step "), F.col("k").cast("string")).alias("notes"),
            (F.col("detected_at_ms") + F.col("k") * 60_000).alias("performed_at_ms"),
        )

    @cached_property
    def last_event(self) -> datetime:
        """The same as a value, as a panel knows its clock: a bound that scans can use."""
        return self.table("events").where(F.col("event_id") % 97 != 0).agg(F.max("ts")).first()[0] or datetime(1970, 1, 1)

    @cached_property
    def as_of_ms(self) -> Column:
        """The clock of the dashboards: the last event."""
        return self.transactions.select(F.max("event_time_ms").alias("t")).scalar()

    @cached_property
    def envelopes(self) -> DataFrame:
        """The transactions as change records, with the oddities that occur in such logs."""
        event = F.col("event_id")
        txn = self.as_transactions(self.table("events"))
        rows = txn.withColumn("event_id", number("transaction_id"))
        iso = F.date_format(F.timestamp_millis("event_time_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        after = F.struct(
            "transaction_id",
            "account_id",
            "merchant_id",
            F.when(event % 23 == 1, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"),
            F.when(event % 19 == 2, "").otherwise(F.col("currency")).alias("currency"),
            F.when(event % 20 != 0, F.col("latitude")).alias("latitude"),
            F.when(event % 20 != 0, F.col("longitude")).alias("longitude"),
            F.when(event % 7 == 3, F.col("event_time_ms").cast("string"))
            .when(event % 29 != 5, iso)
            .alias("event_time"),
        )
        body = F.to_json(
            F.struct(
                F.when(event % 31 != 4, after).alias("after"),
                F.when(event % 37 != 6, F.col("op")).alias("op"),
                (F.col("event_time_ms") + 250).alias("ts_ms"),
            )
        )
        text = F.when(event % 53 == 8, F.substring(body, 1, 40)).otherwise(body)
        return rows.select(text.alias("value"), F.lit("transactions.raw").alias("topic"), event.alias("offset"))

    def profile_changes(self, table: DataFrame, key: str, changed: str) -> DataFrame:
        """Change records of a profile table: a snapshot row each, an update for some, a delete for some."""
        n = number(key)
        row = F.struct(*table.columns)
        marked = F.concat(F.col(changed), F.lit("+"))
        update = F.struct(*[(marked if c == changed else F.col(c)).alias(c) for c in table.columns])
        gone = F.struct(F.col(key))
        snapshot = F.to_json(F.struct(row.alias("after"), F.lit("r").alias("op"), F.lit(1000).alias("ts_ms")))
        updated = F.to_json(F.struct(update.alias("after"), F.lit("u").alias("op"), (n + 2000).alias("ts_ms")))
        deleted = F.to_json(F.struct(gone.alias("before"), F.lit("d").alias("op"), (n + 3000).alias("ts_ms")))
        records = F.array_compact(F.array(snapshot, F.when(n % 4 == 0, updated), F.when(n % 13 == 6, deleted)))
        return table.select(F.posexplode(records).alias("offset", "value")).select(
            F.col("offset").cast("bigint").alias("offset"), "value"
        )

    def profile_versions(self, table: DataFrame, key: str, changed: str) -> DataFrame:
        """Three versions of each profile, ten days apart; the first one only holds from some time on."""
        steps = F.array(*[F.lit(k) for k in (0, 1, 2)])
        n = number(key)
        start = F.unix_millis(F.lit("2024-01-01T00:00:00Z").cast("timestamp"))
        return table.select(
            key, F.col(changed), n.alias("_n"), F.explode(steps).alias("revision")
        ).select(
            key,
            F.concat(F.col(changed), F.lit("/"), F.col("revision").cast("string")).alias(changed),
            "revision",
            (start + F.col("revision") * (10 * DAY_MS) + F.col("_n") % 5 * DAY_MS).alias("valid_from_ms"),
        )
