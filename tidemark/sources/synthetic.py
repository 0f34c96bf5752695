"""Seeded bars for tests: AR(1) log returns on a rising hourly clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import HOUR_MS
from tidemark.operators.blocks import affine_scan, prefix_scan


def synthetic_bars(spark: SparkSession, n: int = 1200, seed: int = 42, base: float = 60000.0, series: int = 1, phi: float = 0.15, sigma: float = 0.004) -> DataFrame:
    """``series`` series of ``n`` bars with ``row_idx``; the same seed gives the same bars."""
    rows = spark.range(n * series).select(
        F.concat(F.lit("s"), (F.col("id") / n).cast("int").cast("string")).alias("series_id"),
        (F.col("id") % n + 1).alias("row_idx"),
        (F.randn(seed) * sigma).alias("_e"),
        F.rand(seed + 1).alias("_u"),
    )
    walk = affine_scan(rows, {"_r": (phi, F.col("_e"))})
    walk = prefix_scan(walk, {"_x": ("sum", F.col("_r"))})
    close = F.exp(F.col("_x")) * base
    open_ = F.exp(F.col("_x") - F.col("_r")) * base
    wick = F.col("_u") * sigma / 2
    open_ms = (F.col("row_idx") - 1) * HOUR_MS + 1_735_689_600_000
    return walk.select(
        "series_id",
        "row_idx",
        open_ms.alias("open_time_ms"),
        (open_ms + HOUR_MS).alias("close_time_ms"),
        open_.alias("open"),
        (F.greatest(open_, close) * (1 + wick)).alias("high"),
        (F.least(open_, close) * (1 - wick)).alias("low"),
        close.alias("close"),
        (100 + 50 * F.col("_u")).alias("volume"),
        F.lit("1h").alias("interval"),
        F.lit("synthetic").alias("source"),
    )
