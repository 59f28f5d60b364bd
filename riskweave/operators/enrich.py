"""Left joins that add merchant and account profiles to transactions.

No join is hinted: Spark broadcasts a profile table only when its measured size is under the
session's threshold, and otherwise shuffles and splits skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ordered import SplitPolicy, merge_ordered
from riskweave.params import AccountDefaults, MerchantDefaults


def enrich_merchants(
    txns: DataFrame, merchants: DataFrame, defaults: MerchantDefaults = MerchantDefaults()
) -> DataFrame:
    """Add merchant_name, merchant_category, merchant_risk and merchant_miss; ``merchants`` has one row per id."""
    profiles = merchants.select(
        "merchant_id",
        F.struct("name", "category", "risk_category").alias("_merchant"),
    )
    return (
        txns.join(profiles, "merchant_id", "left")
        .withColumn("merchant_miss", F.col("_merchant").isNull())
        .withColumns(_merchant_columns(defaults))
        .drop("_merchant")
    )


def _merchant_columns(defaults: MerchantDefaults) -> dict:
    # A known merchant keeps its own values, also null ones; only a miss gets the defaults.
    miss = F.col("merchant_miss")
    return {
        "merchant_name": F.when(miss, defaults.name).otherwise(F.col("_merchant.name")),
        "merchant_category": F.when(miss, defaults.category).otherwise(F.col("_merchant.category")),
        "merchant_risk": F.when(miss, defaults.risk_category).otherwise(F.col("_merchant.risk_category")),
    }


def enrich_accounts(txns: DataFrame, accounts: DataFrame, defaults: AccountDefaults = AccountDefaults()) -> DataFrame:
    """Add account_tier, account_country, account_risk and account_miss; ``accounts`` has one row per id."""
    profiles = accounts.select("account_id", F.struct("tier", "country", "risk_score").alias("_account"))
    return (
        txns.join(profiles, "account_id", "left")
        .withColumn("account_miss", F.col("_account").isNull())
        .withColumns(_account_columns(defaults))
        .drop("_account")
    )


def _account_columns(defaults: AccountDefaults) -> dict:
    miss = F.col("account_miss")
    return {
        "account_tier": F.when(miss, defaults.tier).otherwise(F.col("_account.tier")),
        "account_country": F.when(miss, defaults.country).otherwise(F.col("_account.country")),
        "account_risk": F.when(miss, defaults.risk_score).otherwise(F.col("_account.risk_score")),
    }


def enrich(
    txns: DataFrame,
    merchants: DataFrame,
    accounts: DataFrame,
    merchant_defaults: MerchantDefaults = MerchantDefaults(),
    account_defaults: AccountDefaults = AccountDefaults(),
) -> DataFrame:
    """Both enrichments."""
    return enrich_accounts(enrich_merchants(txns, merchants, merchant_defaults), accounts, account_defaults)


def enrich_asof(
    txns: DataFrame,
    versions: DataFrame,
    key: str,
    valid_from: str,
    time_col: str = "event_time_ms",
    policy: SplitPolicy = SplitPolicy(),
) -> DataFrame:
    """Add the profile version in force at each transaction, as struct ``version`` (null before the first one).

    A version holds from ``valid_from`` until the next version of its key. Both inputs are merged
    in time order instead of joined, so a key with many versions and many transactions costs one
    sort, not their product.
    """
    payload = [c for c in versions.columns if c != key]
    right = versions.select(key, F.col(valid_from).alias(time_col), F.struct(*payload).alias("version"))
    return merge_ordered(txns, right, key, time_col, "version", policy)
