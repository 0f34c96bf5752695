"""Bars: building, closing, checking and regrouping OHLCV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import HOUR_MS
from tidemark.operators.blocks import SERIES, windowed, with_row_index

INTERVAL_MS = {
    "1m": 60_000,
    "5m": 300_000,
    "15m": 900_000,
    "1h": HOUR_MS,
    "4h": 4 * HOUR_MS,
    "1d": 24 * HOUR_MS,
}


def tick_order(ts_us="ts_us", tie="event_id") -> Column:
    """Total order of ticks as one DECIMAL(38): time first, then the id.

    A fixed-width number (unlike a struct) keeps ``min_by``/``max_by`` in a hash
    aggregation; a struct would make Spark sort all ticks before the partial aggregate.
    """
    return (F.col(ts_us).cast("decimal(16,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")


def tick_to_bar(
    ticks: DataFrame, interval: str = "1h", keys=SERIES, width_ms: int | None = None, order: Column | None = None, carry: dict[str, str] | None = None
) -> DataFrame:
    """OHLCV per key and clock interval; ``carry`` maps a bar column to the numeric tick
    column whose last value it takes.

    One hash aggregation with map-side partials: a hot series shrinks to its bars
    before the shuffle.
    """
    width = width_ms or INTERVAL_MS[interval]
    open_ms = (F.floor(F.col("ts_us") / F.lit(width * 1000)) * F.lit(width)).cast("long")
    rows = ticks.withColumn("_at", tick_order() if order is None else order)
    return (
        rows.groupBy(*keys, open_ms.alias("open_time_ms"))
        .agg(
            F.min_by("price", "_at").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_at").alias("close"),
            F.sum("size").alias("volume"),
            *[F.max_by(c, "_at").alias(n) for n, c in (carry or {}).items()],
        )
        .withColumn("interval", F.lit(interval))
        .withColumn("close_time_ms", F.col("open_time_ms") + F.lit(width))
    )


def indexed(bars: DataFrame, keys=SERIES, interval: str = "1h") -> DataFrame:
    return with_row_index(bars, keys=keys, span=4096 * INTERVAL_MS[interval])


def closed_bars(bars: DataFrame, now_ms: Column) -> DataFrame:
    return bars.filter(F.col("close_time_ms") <= now_ms)


def closed_bars_positional(bars: DataFrame, include_live: bool = False) -> DataFrame:
    """Drop the newest bar of each series; a series of one bar passes through."""
    if include_live:
        return bars
    tail = bars.groupBy(*SERIES).agg(F.max("open_time_ms").alias("_last"), F.count("*").alias("_n"))
    return (
        bars.join(tail, list(SERIES))
        .filter((F.col("open_time_ms") < F.col("_last")) | (F.col("_n") < 2))
        .drop("_last", "_n")
    )


def archive_closed_filter(bars: DataFrame, fetched_ms: Column) -> DataFrame:
    """Keep bars closed at fetch time; no close means open + 1 h, no fetch time keeps all."""
    close = F.coalesce(F.col("close_time_ms"), F.col("open_time_ms") + HOUR_MS)
    return bars.filter(fetched_ms.isNull() | (close <= fetched_ms))


def bar_faults() -> Column:
    """Array of the rules a bar breaks; ``_prev_close`` is the close time of the bar before."""
    def bad(c):
        v = F.col(c)
        return v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf"))

    rules = {
        "open": bad("open"),
        "high": bad("high"),
        "low": bad("low"),
        "close": bad("close"),
        "high_below_low": F.col("high") < F.col("low"),
        "open_outside": (F.col("open") < F.col("low")) | (F.col("open") > F.col("high")),
        "close_outside": (F.col("close") < F.col("low")) | (F.col("close") > F.col("high")),
        "close_before_open": F.col("close_time_ms") <= F.col("open_time_ms"),
        "not_monotonic": F.col("close_time_ms") < F.col("_prev_close"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def validate_bars(bars: DataFrame) -> DataFrame:
    """Add ``faults``; needs ``row_idx``."""
    def build(f, w):
        return f.withColumn("_prev_close", F.lag("close_time_ms").over(w))

    return windowed(bars, build, before=1).withColumn("faults", bar_faults()).drop("_prev_close")


def reject_incomplete_bars(bars: DataFrame) -> DataFrame:
    """Source test before a fallback is taken: a missing price is never filled in."""
    return bars.filter(
        F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    )


def gap_scan(bars: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Runs of missing slots between neighbouring bars; needs ``row_idx``.

    Looking at neighbours gives the same slots as a full grid and an anti-join, without
    building the grid.
    """
    def build(f, w):
        return f.withColumn("_next", F.lead("open_time_ms").over(w))

    gaps = windowed(bars, build, before=0, after=1)
    return gaps.filter(F.col("_next") > F.col("open_time_ms") + width_ms).select(
        *SERIES,
        (F.col("open_time_ms") + width_ms).alias("gap_start_ms"),
        F.col("_next").alias("gap_end_ms"),
        ((F.col("_next") - F.col("open_time_ms")) / width_ms - 1).cast("long").alias("missing"),
    )


def coverage(bars: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    slots = ((F.max("open_time_ms") - F.min("open_time_ms")) / width_ms + 1).cast("long")
    return (
        bars.groupBy(*SERIES)
        .agg(F.count("*").alias("n_bars"), slots.alias("n_slots"))
        .withColumn("coverage_pct", F.col("n_bars") * 100.0 / F.col("n_slots"))
    )


def resample_bars(bars: DataFrame, interval: str = "4h") -> DataFrame:
    """Clock-aligned regrouping of finer bars."""
    width = INTERVAL_MS[interval]
    return (
        bars.groupBy(*SERIES, (F.floor(F.col("open_time_ms") / width) * width).cast("long").alias("_open"))
        .agg(
            F.min_by("open", "open_time_ms").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_time_ms").alias("close"),
            F.sum("volume").alias("volume"),
            F.count("*").alias("n_bars"),
        )
        .withColumnRenamed("_open", "open_time_ms")
        .withColumn("close_time_ms", F.col("open_time_ms") + width)
        .withColumn("interval", F.lit(interval))
    )


def resample_positional(bars: DataFrame, group: int = 4) -> DataFrame:
    """Groups of ``group`` consecutive rows; the final group is left out. Needs ``row_idx``."""
    sizes = bars.groupBy(*SERIES).agg(F.max("row_idx").alias("_n"))
    cut = bars.join(sizes, list(SERIES)).withColumn("_g", F.floor((F.col("row_idx") - 1) / group))
    return (
        cut.filter(F.col("_g") * group < F.col("_n") - group)
        .groupBy(*SERIES, "_g")
        .agg(
            F.min("open_time_ms").alias("open_time_ms"),
            F.min_by("open", "row_idx").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "row_idx").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .drop("_g")
    )


def timeframe_set(frames: DataFrame) -> DataFrame:
    """Bars per series and interval; a series is available if 15m, 1h or 4h has bars."""
    usable = F.col("interval").isin("15m", "1h", "4h")
    per = frames.groupBy(*SERIES, "interval").agg(F.count("*").alias("n_bars"))
    able = per.groupBy(*SERIES).agg(F.bool_or(usable & (F.col("n_bars") > 0)).alias("available"))
    return per.join(able, list(SERIES))
