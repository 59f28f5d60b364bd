"""Parameters of the scoring and anomaly rules."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class MerchantDefaults:
    """Profile used when a merchant is not known (fixed values)."""

    name: str = "Unknown"
    category: str = "UNKNOWN"
    risk_category: str = "MEDIUM"


@dataclass(frozen=True)
class AccountDefaults:
    """Profile used when an account is not known (fixed values)."""

    tier: str = "STANDARD"
    country: str = "US"
    risk_score: float = 0.3


@dataclass(frozen=True)
class Weights:
    """Weights of the five score terms (fixed values)."""

    amount: float = 0.25
    amount_ceiling: float = 10000.0
    merchant_high: float = 0.35
    merchant_medium: float = 0.15
    merchant_other: float = 0.05
    account: float = 0.20
    night: float = 0.10
    night_until_hour: int = 6
    cross_border: float = 0.10
    home_country: str = "US"


@dataclass(frozen=True)
class RuleParams:
    """Thresholds of the three anomaly rules."""

    max_txn: int = 10
    window_ms: int = 60_000
    z_threshold: float = 3.0
    min_history: int = 5
    max_kmh: float = 900.0

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> RuleParams:
        """Defaults, overridden by the environment variables below."""
        env = os.environ if env is None else env
        base = cls()
        seconds = env.get("ANOMALY_VELOCITY_WINDOW_SECS")
        return cls(
            max_txn=int(env.get("ANOMALY_VELOCITY_MAX_TXN", base.max_txn)),
            window_ms=base.window_ms if seconds is None else int(seconds) * 1000,
            z_threshold=float(env.get("ANOMALY_ZSCORE_THRESHOLD", base.z_threshold)),
            min_history=int(env.get("ANOMALY_ZSCORE_MIN_HISTORY", base.min_history)),
            max_kmh=float(env.get("ANOMALY_GEO_MAX_SPEED_KMH", base.max_kmh)),
        )


@dataclass(frozen=True)
class SpendSpec:
    """One spend roll-up: a label, the column it groups by, a window length."""

    dimension: str
    column: str
    width_ms: int


MINUTE_MS = 60_000

SPEND_SPECS = (
    SpendSpec("CATEGORY", "merchant_category", MINUTE_MS),
    SpendSpec("MERCHANT", "merchant_id", MINUTE_MS),
    SpendSpec("ACCOUNT", "account_id", 5 * MINUTE_MS),
)

# Event-time bounds of the streams, in milliseconds (fixed values).
LATE_TOLERANCE_MS = 5_000
LATE_DROP_MS = 10_000
