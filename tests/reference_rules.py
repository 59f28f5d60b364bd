"""The account rules row by row in plain Python, for comparison on small inputs."""

from __future__ import annotations

import math
from collections import defaultdict

from riskweave.params import RuleParams


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def simulate(rows: list[dict], params: RuleParams) -> set[tuple]:
    """(transaction_id, reason_code) of all flags; rows are taken in (event_time_ms, transaction_id) order."""
    flags = set()
    times, amounts, place = defaultdict(list), defaultdict(list), {}
    for row in sorted(rows, key=lambda r: (r["event_time_ms"], r["transaction_id"])):
        account, now, amount = row["account_id"], row["event_time_ms"], row["amount"]
        times[account] = [t for t in times[account] if t >= now - params.window_ms] + [now]
        if len(times[account]) > params.max_txn:
            flags.add((row["transaction_id"], "VELOCITY"))
        history = amounts[account]
        if len(history) >= params.min_history and len(history) > 1:
            mean = math.fsum(history) / len(history)
            spread = math.sqrt(math.fsum((x - mean) ** 2 for x in history) / (len(history) - 1))
            if spread > 0 and (amount - mean) / spread > params.z_threshold:
                flags.add((row["transaction_id"], "AMOUNT_SPIKE"))
        history.append(amount)
        lat, lon = row["latitude"], row["longitude"]
        if (lat, lon) != (0.0, 0.0):
            if account in place:
                km = haversine(*place[account][:2], lat, lon)
                hours = max((now - place[account][2]) / 3_600_000, 1e-9)
                if km / hours > params.max_kmh:
                    flags.add((row["transaction_id"], "GEO_TRAVEL"))
            place[account] = (lat, lon, now)
    return flags
