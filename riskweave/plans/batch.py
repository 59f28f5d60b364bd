"""Batch form of the scoring, anomaly and spend jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskweave.operators.enrich import enrich
from riskweave.operators.ordered import SplitPolicy
from riskweave.operators.rules import detect_anomalies
from riskweave.operators.score import score_transactions
from riskweave.operators.spend import spend_union
from riskweave.params import RuleParams, Weights


@dataclass(frozen=True)
class Results:
    scored: DataFrame
    anomalies: DataFrame
    spend: DataFrame


def score(txns: DataFrame, merchants: DataFrame, accounts: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Transactions to scored transactions; no shuffle unless a profile table is too large to broadcast."""
    return score_transactions(enrich(txns, merchants, accounts), weights)


def run(
    txns: DataFrame,
    merchants: DataFrame,
    accounts: DataFrame,
    params: RuleParams = RuleParams(),
    weights: Weights = Weights(),
    policy: SplitPolicy = SplitPolicy(),
) -> Results:
    """All results of one set of transactions.

    The rules read transaction columns only, so they take the transactions and not the joined rows.
    """
    scored = score(txns, merchants, accounts, weights)
    return Results(scored, detect_anomalies(txns, params, policy), spend_union(scored))
