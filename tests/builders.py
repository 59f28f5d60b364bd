"""Small inputs."""

from __future__ import annotations

import random

START = 1_700_000_000_000
COLUMNS = "transaction_id string, account_id string, merchant_id string, amount double, currency string, latitude double, longitude double, event_time_ms long, op string"


def txn(n, account="a", amount=10.0, lat=0.0, lon=0.0, at=0, merchant="m", op="c"):
    return {
        "transaction_id": f"{n:06d}",
        "account_id": account,
        "merchant_id": merchant,
        "amount": float(amount),
        "currency": "USD",
        "latitude": float(lat),
        "longitude": float(lon),
        "event_time_ms": START + at,
        "op": op,
    }


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)


def random_rows(count: int, seed: int, accounts: int = 6, hot_share: float = 0.4) -> list[dict]:
    """Rows with ties, missing places and one account that holds a large share."""
    rng = random.Random(seed)
    rows, now = [], 0
    for n in range(count):
        now += rng.choice([0, 0, 500, 5_000, 40_000, 400_000])
        account = "hot" if rng.random() < hot_share else f"acc{rng.randrange(accounts)}"
        somewhere = rng.random() > 0.2
        rows.append(
            txn(
                n,
                account,
                round(rng.lognormvariate(3, 1.2), 2),
                rng.uniform(-60, 60) if somewhere else 0.0,
                rng.uniform(-170, 170) if somewhere else 0.0,
                now,
            )
        )
    return rows
