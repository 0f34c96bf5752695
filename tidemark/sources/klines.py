"""Array-form bars of four venue layouts, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import HOUR_MS

# Position of each field (0-based), seconds or milliseconds, and whether the
# close time is given inclusively, derived from the width, or absent.
LAYOUTS = {
    "binance": {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "unit_ms": 1, "close_at": 6},
    "coinbase": {"open": 3, "high": 2, "low": 1, "close": 4, "volume": 5, "unit_ms": 1000, "close_at": None},
    "kraken": {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 6, "unit_ms": 1000, "close_at": None},
    "coingecko": {"open": 1, "high": 2, "low": 3, "close": 4, "volume": None, "unit_ms": 1, "close_at": None},
}
HALF_HOUR_MS = HOUR_MS // 2


def scan_kline_array(payloads: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Bars from (series_id, source, payload): payload is a JSON array of arrays.

    A row with a value that does not cast is dropped. Close times become exclusive.
    """
    rows = payloads.select(
        "series_id", "source", F.explode_outer(F.from_json("payload", "array<array<string>>")).alias("k")
    )

    def by_layout(value):
        out = F.lit(None)
        for source, lay in LAYOUTS.items():
            out = F.when(F.col("source") == source, value(lay)).otherwise(out)
        return out

    def field(name):
        return by_layout(
            lambda lay: F.lit(None).cast("double") if lay[name] is None else F.get("k", F.lit(lay[name])).try_cast("double")
        )

    start = by_layout(lambda lay: F.get("k", F.lit(0)).try_cast("long") * lay["unit_ms"])
    end = by_layout(
        lambda lay: F.lit(None).cast("long") if lay["close_at"] is None else F.get("k", F.lit(lay["close_at"])).try_cast("long") + 1
    )
    bars = rows.select(
        "series_id",
        "source",
        start.alias("open_time_ms"),
        *[field(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
        end.alias("_end"),
    )
    whole = F.col("open_time_ms").isNotNull()
    for c in ("open", "high", "low", "close"):
        whole = whole & F.col(c).isNotNull()
    return (
        bars.filter(whole & (F.col("volume").isNotNull() | (F.col("source") == "coingecko")))
        .withColumn("close_time_ms", F.coalesce("_end", F.col("open_time_ms") + width_ms))
        .drop("_end")
    )


def to_payload(bars: DataFrame, source: str) -> DataFrame:
    """The raw form of one venue: one JSON array per series and day."""
    lay = LAYOUTS[source]
    width = max(v for v in lay.values() if isinstance(v, int) and v < 100) + 1
    cells = [F.lit("0")] * max(width, 6 if source != "coingecko" else 5)
    cells[0] = (F.col("open_time_ms") / lay["unit_ms"]).cast("long").cast("string")
    for c in ("open", "high", "low", "close", "volume"):
        if lay[c] is not None:
            cells[lay[c]] = F.col(c).cast("string")
    if lay["close_at"] is not None:
        cells[lay["close_at"]] = (F.col("close_time_ms") - 1).cast("string")
    day = F.floor(F.col("open_time_ms") / (24 * HOUR_MS)).alias("day")
    return bars.groupBy("series_id", day).agg(F.to_json(F.collect_list(F.array(*cells))).alias("payload")).select(
        "series_id", F.lit(source).alias("source"), "payload"
    )


def scan_price_bars(bars: DataFrame) -> DataFrame:
    """Closing prices by close second; a half-hour source answers only full hours."""
    hourly_close = F.col("close_time_ms") % HOUR_MS == 0
    return bars.filter((F.col("source") != "coingecko") | hourly_close).select(
        "series_id",
        "source",
        F.bround(F.col("close_time_ms") / 1000.0).cast("long").alias("close_s"),
        "open_time_ms",
        "close_time_ms",
        "close",
    )


def kline_export(bars: DataFrame) -> DataFrame:
    """12-field string arrays as the venues send them."""
    named = [F.col(c).cast("string") for c in ("open_time_ms", "open", "high", "low", "close", "volume", "close_time_ms")]
    return bars.select("series_id", F.array(*named, *[F.lit("0")] * 5).alias("kline"))
