"""Column expressions shared by the operators. Everything stays JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

# Fees in basis points and score constants.
MAKER_BPS = 2.0
TAKER_BPS = 10.0
WILSON_Z = 1.96
WILSON_Z_EXACT = 1.959963984540054
LOG_EPS = 1e-6

# Horizons in hours, and the width of the issue bucket in hours.
HORIZON_HOURS = {"1h": 1, "4h": 4, "12h": 12, "24h": 24}
BUCKET_HOURS = {"1h": 1, "4h": 4, "12h": 1, "24h": 1}


def rounded(col, digits: int = 6) -> Column:
    """Round for reports; adding zero turns a negative zero into zero."""
    return F.round(col, digits) + F.lit(0.0)


def clip(col, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col, F.lit(lo)), F.lit(hi))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p, eps: float = LOG_EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def iso_utc(ms) -> Column:
    """Epoch milliseconds to ``yyyy-MM-ddTHH:mm:ssZ`` (session zone is UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso_ms(text) -> Column:
    """ISO-8601 text to epoch milliseconds; a text without zone counts as UTC."""
    return F.unix_millis(F.try_to_timestamp(text))


def hour_utc(ms) -> Column:
    return F.floor(F.pmod(ms, F.lit(DAY_MS)) / F.lit(HOUR_MS)).cast("int")


def weekday_mon0(ms) -> Column:
    """Monday is 0. The epoch began on a Thursday."""
    return F.pmod(F.floor(ms / F.lit(DAY_MS)) + F.lit(3), F.lit(7)).cast("int")


def floor_to(ms, width_ms) -> Column:
    width = F.lit(width_ms) if isinstance(width_ms, int) else width_ms
    return ms - F.pmod(ms, width)


def outcome(direction, entry, close) -> Column:
    """1 when the call was right. An exact tie is wrong both ways."""
    return (
        F.when(close == entry, 0)
        .when(direction == "up", (close > entry).cast("int"))
        .otherwise((close < entry).cast("int"))
    )


def actual_return(entry, close) -> Column:
    return (close - entry) / entry


def brier_component(p, o) -> Column:
    return (p - o) * (p - o)


def logloss_component(p, o) -> Column:
    q = clip(p, LOG_EPS, 1 - LOG_EPS)
    return -(o * F.ln(q) + (F.lit(1) - o) * F.ln(F.lit(1.0) - q))


def signed_return(direction, ret) -> Column:
    return F.when(direction == "up", ret).otherwise(-ret)


def fee_adjusted_bps(signed, fee_bps: float) -> Column:
    return signed * F.lit(10000.0) - F.lit(fee_bps)


def wilson_lower(p, n, z: float = WILSON_Z, floor: bool = True) -> Column:
    """Score interval lower bound. ``floor=False`` gives the unfloored form (null at n=0)."""
    z2 = z * z
    m = F.nullif(n.cast("double"), F.lit(0.0))
    den = F.lit(1.0) + F.lit(z2) / m
    centre = p + F.lit(z2) / (F.lit(2.0) * m)
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / m + F.lit(z2) / (F.lit(4.0) * m * m))
    lower = (centre - margin) / den
    if not floor:
        return lower
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), lower))


def invalidation_level(direction, entry, pct: float = 0.05) -> Column:
    """Five percent against the call, two decimals, half-even."""
    return F.when(direction == "down", F.bround(entry * (1 + pct), 2)).otherwise(
        F.bround(entry * (1 - pct), 2)
    )
