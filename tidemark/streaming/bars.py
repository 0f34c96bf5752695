"""Streaming bars, archive and rolling metrics. Times are TIMESTAMP columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELAY = "15 minutes"


def stream_bars(ticks: DataFrame, delay: str = DELAY, width: str = "1 hour") -> DataFrame:
    """Bars of (series_id, ts, event_id, price, size); in append mode only closed bars leave."""
    at = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("series_id", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("series_id", F.col("w.start").alias("open_time"), F.col("w.end").alias("close_time"), "open", "high", "low", "close", "volume")
    )


def stream_archive(rows: DataFrame, keys=("series_id", "open_time"), time: str = "open_time", delay: str = "2 hours") -> DataFrame:
    """First arrival per key within the watermark; later arrivals never override."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_daily(resolved: DataFrame, delay: str = DELAY) -> DataFrame:
    """Counts and sums by day of issue, model and horizon: each row is in one window of the state."""
    return (
        resolved.withWatermark("issued_at", delay)
        .groupBy(F.window("issued_at", "1 day").alias("w"), "model_version", "horizon")
        .agg(F.count("*").alias("n"), F.sum("o").alias("hits"), F.sum("signed").alias("signed"))
        .select(F.col("w.start").alias("day"), "model_version", "horizon", "n", "hits", "signed")
    )


def rolling(daily: DataFrame, days: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """Sliding windows of all lengths from the closed days, one step a day.

    A window is reported once the last day that the stream has closed is in it or behind it.
    """
    kinds = F.array(*[F.struct(F.lit(n).alias("days"), F.sequence(F.lit(0), F.lit(n - 1)).alias("back")) for n in days])
    each = daily.select("*", F.inline(kinds)).select("*", F.explode("back").alias("_k"))
    start = F.unix_millis("day") - F.col("_k").cast("long") * 86_400_000
    sums = each.groupBy("days", start.alias("start_ms"), "model_version", "horizon").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), (F.sum("signed") / F.sum("n") * 10000.0 - 2.0).alias("expectancy_maker_2bps"))
    closed = daily.agg(F.unix_millis(F.max("day")) + 86_400_000).scalar()
    return sums.filter(F.col("start_ms") + F.col("days").cast("long") * 86_400_000 <= closed)


def stream_resolve(forecasts: DataFrame, bars: DataFrame, wait: str = "2 hours") -> DataFrame:
    """Forecasts with the bar that closes at their target; unmatched ones leave with nulls
    only after the watermark has passed the target, until then they stay in state.

    forecasts: forecast_id, series_id, target_time; bars: series_id, close_time, close.
    """
    f = forecasts.withWatermark("target_time", wait)
    b = bars.withColumnRenamed("series_id", "bar_series").withWatermark("close_time", wait)
    same = (F.col("series_id") == F.col("bar_series")) & (F.col("target_time") == F.col("close_time"))
    return f.join(b, same, "leftOuter").drop("bar_series")
