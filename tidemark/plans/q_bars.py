"""Queries over bars: building, closing, checking, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import bars as B
from tidemark.plans import inputs as I
from tidemark.plans.oracle import r, sql
from tidemark.plans.registry import query, report

OHLC = ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))
BAR = ("series_id", "open_time_ms", "open", "high", "low", "close", "volume")


@query("tick_to_bar", sql(f"SELECT series_id, open_time_ms, close_time_ms, {OHLC} FROM q_bars"))
def tick_to_bar(spark, d):
    return report(B.tick_to_bar(I.ticks(spark, d)).select(*BAR, "close_time_ms"))


@query("closed_bars", sql(f"""
SELECT series_id, open_time_ms, {OHLC} FROM q_bars
WHERE close_time_ms <= (SELECT max(ts_us) // 1000 FROM q_ticks)"""))
def closed_bars(spark, d):
    ticks = I.ticks(spark, d)
    now = ticks.agg(F.floor(F.max("ts_us") / 1000).cast("long")).scalar()
    return report(B.closed_bars(B.tick_to_bar(ticks), now).select(*BAR))


@query("closed_bars_positional", sql(f"""
SELECT series_id, open_time_ms, {OHLC} FROM q_bars WHERE row_idx < n_rows OR n_rows < 2"""))
def closed_bars_positional(spark, d):
    return report(B.closed_bars_positional(I.hourly(spark, d)).select(*BAR))


@query("archive_closed_filter", sql(f"""
SELECT series_id, open_time_ms, {OHLC} FROM q_bars
WHERE CASE WHEN volume >= 60 THEN close_time_ms ELSE open_time_ms + 3600000 END
   <= (SELECT max(ts_us) // 1000 FROM q_ticks)"""))
def archive_closed_filter(spark, d):
    ticks = I.ticks(spark, d)
    bars = B.tick_to_bar(ticks).withColumn("close_time_ms", F.when(F.col("volume") >= 60, F.col("close_time_ms")))
    fetched = ticks.agg(F.floor(F.max("ts_us") / 1000).cast("long")).scalar()
    return report(B.archive_closed_filter(bars, fetched).select(*BAR))


# A faulty copy of the bars: prices shifted by the volume so that each rule is broken somewhere.
BROKEN = """
SELECT series_id, row_idx, open_time_ms,
       CASE WHEN volume = 0 THEN NULL ELSE open END AS open,
       CASE WHEN volume > 250 THEN high - 50 ELSE high END AS high, low,
       CASE WHEN volume < 5 THEN -close ELSE close END AS close,
       CASE WHEN volume > 300 THEN open_time_ms - 3600000 ELSE close_time_ms END AS close_time_ms
FROM q_bars"""
FAULTS = {
    "open": "(open IS NULL OR open <= 0)",
    "high": "high <= 0",
    "low": "low <= 0",
    "close": "close <= 0",
    "high_below_low": "high < low",
    "open_outside": "(open < low OR open > high)",
    "close_outside": "(close < low OR close > high)",
    "close_before_open": "close_time_ms <= open_time_ms",
    "not_monotonic": "close_time_ms < prev_close",
}
_FAULT_SQL = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in FAULTS.items())


@query("validate_bars", sql(f"""
SELECT series_id, open_time_ms, concat_ws(',', {_FAULT_SQL}) AS faults
FROM (SELECT *, lag(close_time_ms) OVER (PARTITION BY series_id ORDER BY row_idx) AS prev_close FROM q_broken) x
""", q_broken=BROKEN))
def validate_bars(spark, d):
    v = F.col("volume")
    broken = I.hourly(spark, d).select(
        "series_id", "row_idx", "open_time_ms", "low",
        F.when(v != 0, F.col("open")).alias("open"),
        F.when(v > 250, F.col("high") - 50).otherwise(F.col("high")).alias("high"),
        F.when(v < 5, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(v > 300, F.col("open_time_ms") - 3_600_000).otherwise(F.col("close_time_ms")).alias("close_time_ms"),
    )
    return B.validate_bars(broken).select("series_id", "open_time_ms", F.concat_ws(",", "faults").alias("faults"))


@query("validate_bars_source", sql("""
SELECT series_id, count(*) AS n FROM q_broken WHERE open IS NOT NULL GROUP BY 1""", q_broken=BROKEN))
def validate_bars_source(spark, d):
    bars = I.hourly(spark, d).withColumn("open", F.when(F.col("volume") != 0, F.col("open")))
    return B.reject_incomplete_bars(bars).groupBy("series_id").agg(F.count("*").alias("n"))


@query("gap_scan", sql("""
SELECT series_id, open_time_ms + 3600000 AS gap_start_ms, nx AS gap_end_ms, (nx - open_time_ms) // 3600000 - 1 AS missing,
       n_bars, n_slots, round(n_bars * 100.0 / n_slots, 6) + 0.0 AS coverage_pct
FROM (SELECT *, lead(open_time_ms) OVER (PARTITION BY series_id ORDER BY row_idx) AS nx FROM q_bars) x
JOIN (SELECT series_id, count(*) AS n_bars, (max(open_time_ms) - min(open_time_ms)) // 3600000 + 1 AS n_slots FROM q_bars GROUP BY 1) c USING (series_id)
WHERE nx > open_time_ms + 3600000"""))
def gap_scan(spark, d):
    bars = I.hourly(spark, d)
    return report(B.gap_scan(bars).join(B.coverage(bars), "series_id"))


@query("resample_bars", sql(f"""
SELECT series_id, open_time_ms, open_time_ms + 14400000 AS close_time_ms, {OHLC}, n_bars FROM (
SELECT series_id, open_time_ms // 14400000 * 14400000 AS open_time_ms, first(open ORDER BY row_idx) AS open, max(high) AS high, min(low) AS low,
       last(close ORDER BY row_idx) AS close, sum(volume) AS volume, count(*) AS n_bars FROM q_bars b GROUP BY series_id, b.open_time_ms // 14400000 * 14400000) x"""))
def resample_bars(spark, d):
    return report(B.resample_bars(I.hourly(spark, d)).drop("interval"))


@query("resample_positional", sql(f"""
SELECT series_id, open_time_ms, {OHLC} FROM (
SELECT series_id, min(open_time_ms) AS open_time_ms, first(open ORDER BY row_idx) AS open, max(high) AS high, min(low) AS low,
       last(close ORDER BY row_idx) AS close, sum(volume) AS volume
FROM q_bars WHERE (row_idx - 1) // 4 * 4 < n_rows - 4 GROUP BY series_id, (row_idx - 1) // 4) x"""))
def resample_positional(spark, d):
    return report(B.resample_positional(I.hourly(spark, d)))


WIDTHS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}


@query("timeframe_set", sql(
    "SELECT series_id, interval, count(DISTINCT bucket) AS n_bars, true AS available FROM ("
    + " UNION ALL ".join(f"SELECT series_id, '{k}' AS interval, ts_us // {w * 1000} AS bucket FROM q_ticks" for k, w in WIDTHS.items())
    + ") x GROUP BY 1, 2"))
def timeframe_set(spark, d):
    ticks = I.ticks(spark, d)
    frames = None
    for interval in B.INTERVAL_MS:
        bars = B.tick_to_bar(ticks, interval).select("series_id", "interval", "open_time_ms")
        frames = bars if frames is None else frames.unionByName(bars)
    return B.timeframe_set(frames)


@query("kline_export", sql("""
SELECT series_id, concat_ws('|', open_time_ms, open, high, low, close, volume, close_time_ms, '0', '0', '0', '0', '0') AS kline FROM q_bars"""))
def kline_export(spark, d):
    from tidemark.sources.klines import kline_export as export

    return export(I.hourly(spark, d)).select("series_id", F.concat_ws("|", "kline").alias("kline"))
