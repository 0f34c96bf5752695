"""Column builders for one series window ``w`` (see ``blocks.windowed``), and recurrences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY_MS, HOUR_MS, weekday_mon0
from tidemark.operators.blocks import SERIES, affine_scan, prefix_scan, windowed


def trailing_return(close: str, w: WindowSpec, lag: int) -> Column:
    """ln(c[t]/c[t-lag]); zero while the series is short or a price is not positive."""
    prev, cur = F.lag(close, lag).over(w), F.col(close)
    return F.when((prev > 0) & (cur > 0), F.ln(cur / prev)).otherwise(0.0)


def log_return(close: str, w: WindowSpec) -> Column:
    return trailing_return(close, w, 1)


def realized_vol(log_ret: str, w: WindowSpec, n: int) -> Column:
    return F.coalesce(F.stddev_samp(log_ret).over(w.rowsBetween(-(n - 1), 0)), F.lit(0.0))


def sma_prefix(col: str, w: WindowSpec, n: int) -> Column:
    return F.avg(col).over(w.rowsBetween(-(n - 1), 0))


def sma_strict(col: str, w: WindowSpec, n: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(frame) == n, F.avg(col).over(frame))


def sma_prior(col: str, w: WindowSpec, n: int) -> Column:
    return F.avg(col).over(w.rowsBetween(-n, -1))


def relative(value, base) -> Column:
    return F.when(base > 0, (value - base) / base).otherwise(0.0)


def volume_ratio(volume: str, w: WindowSpec, n: int) -> Column:
    v = F.col(volume)
    mean = F.avg(F.when(v > 0, v)).over(w.rowsBetween(-(n - 1), 0))
    return F.when(mean.isNull(), 1.0).when(v > 0, v / mean).otherwise(1.0)


def calendar_columns(open_ms: str = "open_time_ms") -> dict[str, Column]:
    """Hour and fractional weekday on a circle; Monday is 0."""
    t = F.col(open_ms)
    hour = F.floor(F.pmod(t, F.lit(DAY_MS)) / F.lit(HOUR_MS))
    day = F.pmod(t / F.lit(float(DAY_MS)) + F.lit(3.0), F.lit(7.0))
    turn = 2.0 * math.pi
    return {
        "hour_sin": F.sin(turn * hour / 24.0),
        "hour_cos": F.cos(turn * hour / 24.0),
        "dow_sin": F.sin(turn * day / 7.0),
        "dow_cos": F.cos(turn * day / 7.0),
        "is_weekend": (weekday_mon0(t) >= 5).cast("double"),
    }


def ema_terms(value: Column, n: int, idx: str = "row_idx") -> tuple[float, Column]:
    """(a, b) of the EMA with k = 2/(n+1), seeded with the first value."""
    k = 2.0 / (n + 1.0)
    return 1.0 - k, F.when(F.col(idx) == 1, value).otherwise(value * F.lit(k))


def ema(df: DataFrame, col: str, n: int, name: str | None = None, keys=SERIES) -> DataFrame:
    name = name or f"ema_{n}"
    if n <= 1:
        return df.withColumn(name, F.col(col))
    return affine_scan(df, {name: ema_terms(F.col(col), n)}, keys=keys)


def wilder_columns(close: str, w: WindowSpec, n: int, idx: str = "row_idx") -> dict[str, Column]:
    """Driving terms of Wilder's averages: plain mean at row n+1, then a 1/n share."""
    move = F.col(close) - F.lag(close).over(w)
    out = {}
    for name, part in (("_gain", F.greatest(move, F.lit(0.0))), ("_loss", F.greatest(-move, F.lit(0.0)))):
        out[name] = part
    return out


def wilder_terms(part: str, w: WindowSpec, n: int, idx: str = "row_idx") -> Column:
    seed = F.avg(part).over(w.rowsBetween(-(n - 1), 0))
    return F.when(F.col(idx) <= n, 0.0).when(F.col(idx) == n + 1, seed).otherwise(F.col(part) / n)


def rsi_value(gain: Column, loss: Column, n: int, idx: str = "row_idx") -> Column:
    return (
        F.when(F.col(idx) <= n, 50.0)
        .when(loss == 0, 100.0)
        .otherwise(100.0 - 100.0 / (1.0 + gain / loss))
    )


def rsi_wilder(df: DataFrame, close: str = "close", n: int = 14, name: str = "rsi", keys=SERIES) -> DataFrame:
    def build(f, w):
        for c, expr in wilder_columns(close, w, n).items():
            f = f.withColumn(c, expr)
        return f.withColumn("_bg", wilder_terms("_gain", w, n)).withColumn("_bl", wilder_terms("_loss", w, n))

    a = (n - 1) / n
    driven = windowed(df, build, before=n + 1, keys=keys)
    done = affine_scan(driven, {"_ag": (a, F.col("_bg")), "_al": (a, F.col("_bl"))}, keys=keys)
    return done.withColumn(name, rsi_value(F.col("_ag"), F.col("_al"), n)).select(*df.columns, name)


def oi_delta(df: DataFrame, oi: str = "open_interest", name: str = "open_interest_delta", keys=SERIES) -> DataFrame:
    """Relative change against the last known open interest; 0 without one."""
    lagged = windowed(df, lambda f, w: f.withColumn("_prev1", F.lag(oi).over(w)), before=1, keys=keys)
    known = prefix_scan(lagged, {"_known": ("last", F.col("_prev1"))}, keys=keys)
    cur, prev = F.col(oi), F.col("_known")
    delta = F.when(cur.isNull() | prev.isNull() | (prev == 0), 0.0).otherwise((cur - prev) / prev)
    return known.withColumn(name, delta).select(*df.columns, name)


def presence(col: Column, fill: float = 0.0) -> tuple[Column, Column]:
    """(filled value, 1/0 flag whether it was there)."""
    return F.coalesce(col, F.lit(fill)), col.isNotNull().cast("double")


REGIMES = ("bull", "bear", "chop", "unknown")


def onehot_regime(col: Column) -> dict[str, Column]:
    known = F.when(col.isin(*REGIMES), col).otherwise("unknown")
    return {f"regime_{r}": (known == r).cast("double") for r in REGIMES}
