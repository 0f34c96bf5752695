"""Causal market regimes: trend by EMA of log returns, volatility against its running median."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import SERIES, affine_scan, windowed
from tidemark.operators.indicators import ema_terms, log_return, realized_vol
from tidemark.sources.store import settle

# Fixed values.
COARSE = ("bull", "bear", "chop", "unknown")
FINE = (
    "trend_up_high_vol",
    "trend_up_low_vol",
    "trend_down_high_vol",
    "trend_down_low_vol",
    "chop_high_vol",
    "chop_low_vol",
    "unknown",
)
TREND_EPS = 1e-4
WARMUP = 24


def trend_scores(bars: DataFrame, trend_window: int = 24, vol_window: int = 24) -> DataFrame:
    """Add ``log_return``, ``vol_score`` and ``trend_score``; needs ``row_idx``."""
    def build(f, w):
        f = f.withColumn("log_return", log_return("close", w))
        return f.withColumn("vol_score", realized_vol("log_return", w, vol_window))

    scored = settle(windowed(bars, build, before=vol_window + 1))
    return affine_scan(scored, {"trend_score": ema_terms(F.col("log_return"), trend_window)})


def coarse_label(trend="trend_score", idx: str = "row_idx", warmup: int = WARMUP):
    t = F.col(trend)
    return (
        F.when(F.col(idx) <= warmup, "unknown")
        .when(t > TREND_EPS, "bull")
        .when(t < -TREND_EPS, "bear")
        .otherwise("chop")
    )


def regime_labels(bars: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """Add ``coarse``, ``fine`` and ``vol_threshold``."""
    marked = causal_median(trend_scores(bars), "vol_score", "vol_threshold")
    coarse = coarse_label(warmup=warmup)
    side = F.when(coarse == "bull", "trend_up").when(coarse == "bear", "trend_down").otherwise("chop")
    vol = F.when(F.col("vol_score") >= F.col("vol_threshold"), "high_vol").otherwise("low_vol")
    fine = F.when(F.col("row_idx") <= warmup, "unknown").otherwise(F.concat_ws("_", side, vol))
    return marked.withColumn("coarse", coarse).withColumn("fine", fine)


def median_feed(df: DataFrame, col: str, keys, idx: str, rows: int, bands: int) -> DataFrame:
    """Rows of every block (``_i``, ``_x``) and the values of its past that it needs (``_i`` null).

    Adding at most ``rows`` values moves the median by at most ``rows`` ranks, so a block
    needs from its past only the values whose rank lies near the middle. Values are cut
    into ``bands`` by approximate quantiles; band counts per block tell which bands hold
    those ranks and how many values lie below them. Only the distinct values (with
    counts) of these bands are sent to the block.

    ``rows`` and ``bands`` are minima: both are at least the square root of the longest
    series, so that a block is sent a few times ``rows`` values however long the series is,
    and the grid of blocks and bands is no larger than the series.
    """
    longest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    side = math.isqrt(longest) + 1
    rows, bands = max(rows, side), max(bands, side)
    base = df.withColumn("_blk", F.floor((F.col(idx) - 1) / F.lit(rows))).withColumn("_x", F.col(col))
    cuts = base.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("_x", [i / bands for i in range(1, bands)], bands * 20)).alias("_cuts")
    )
    # Band = number of cuts at or below the value, found by the cuts below it.
    values = (
        base.groupBy(*keys, "_blk", "_x").agg(F.count("*").alias("_c"))
        .join(cuts, keys)
        .withColumn("_band", F.size(F.filter("_cuts", lambda c: c <= F.col("_x"))))
        .drop("_cuts")
    )
    per_band = values.groupBy(*keys, "_blk", "_band").agg(F.sum("_c").alias("_n"))
    # Running band counts on the (block, band) grid: what a block finds in its past.
    last = base.groupBy(*keys).agg(F.max("_blk").alias("_last"))
    grid = (
        per_band.select(*keys, "_band").distinct().join(last, keys)
        .select(*keys, "_band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_blk"))
    )
    along = Window.partitionBy(*keys, "_band").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    past = (
        grid.join(per_band, [*keys, "_blk", "_band"], "left")
        .select(*keys, F.col("_blk").alias("_to"), "_band", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_n"))
        .filter(F.col("_n") > 0)
    )
    up = Window.partitionBy(*keys, "_to").orderBy("_band")
    ranked = past.withColumn("_hi", F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_lo", F.col("_hi") - F.col("_n")
    )
    size = F.col("_to") * rows
    near = (F.col("_hi") >= F.floor(size / 2) - rows) & (F.col("_lo") <= F.floor(size / 2) + rows + 1)
    wanted = ranked.filter(near).select(*keys, F.col("_to"), "_band", "_lo")
    sent = (
        values.join(wanted, [*keys, "_band"])
        .filter(F.col("_blk") < F.col("_to"))
        .groupBy(*keys, F.col("_to").alias("_blk"), "_x")
        .agg(F.sum("_c").alias("_c"), F.min("_lo").alias("_lo"))
    )
    current = base.select(*keys, "_blk", F.col(idx).alias("_i"), "_x", F.lit(0).cast("long").alias("_c"), F.lit(None).cast("long").alias("_lo"))
    return current.unionByName(sent.withColumn("_i", F.lit(None).cast("long")))


def causal_median(
    df: DataFrame, col: str, name: str, keys=SERIES, idx: str = "row_idx", rows: int = 2048, bands: int = 512
) -> DataFrame:
    """Exact running median of ``col`` over rows 1..i of each key, cut into row blocks.

    Each block follows the median row by row from the values near the middle of its past
    (``median_feed``). No group holds a whole series, and equal values travel as one count.
    """
    keys = list(keys)
    df = settle(df)
    feed = median_feed(df, col, keys, idx, rows, bands)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields), f"{idx} bigint", f"{name} double"])

    def follow(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        old = pdf[pdf["_i"].isna()].sort_values("_x")
        new = pdf[pdf["_i"].notna()].sort_values("_i")
        below = int(old["_lo"].min()) if len(old) else 0
        medians = _follow_median(
            old["_x"].to_numpy(),
            old["_c"].to_numpy(),
            below,
            int(new["_i"].iloc[0]) - 1,
            new["_x"].to_numpy(),
        )
        out = {k: [key[j]] * len(new) for j, k in enumerate(keys)}
        return pd.DataFrame({**out, idx: new["_i"].astype("int64").to_numpy(), name: medians})

    medians = feed.groupBy(*keys, "_blk").applyInPandas(follow, schema)
    return df.join(medians, [*keys, idx])


def _follow_median(xs, counts, below: int, seen: int, incoming) -> np.ndarray:
    """Median after each incoming value, given the middle of the past as (value, count).

    All values, old and new, are ranked once; a Fenwick tree over the ranks gives the
    k-th smallest after every insert.
    """
    vals = np.unique(np.concatenate([xs, incoming]))
    size = len(vals)
    tree = np.zeros(size + 1, dtype=np.int64)
    weight = np.zeros(size + 1, dtype=np.int64)
    np.add.at(weight, np.searchsorted(vals, xs) + 1, counts.astype(np.int64))
    np.cumsum(weight, out=weight)
    pos = np.arange(1, size + 1)
    tree[1:] = weight[pos] - weight[pos - (pos & -pos)]
    top = 1 << (size.bit_length() - 1) if size else 0
    # Values below every sent band stay below; new values under the lowest one count too.
    def kth(k: int) -> float:
        at, step = 0, top
        while step:
            nxt = at + step
            if nxt <= size and tree[nxt] < k:
                k -= tree[nxt]
                at = nxt
            step >>= 1
        return vals[at]

    out = np.empty(len(incoming))
    for j, slot in enumerate(np.searchsorted(vals, incoming) + 1):
        while slot <= size:
            tree[slot] += 1
            slot += slot & -slot
        n = seen + j + 1
        low = kth((n + 1) // 2 - below)
        out[j] = low if n % 2 else 0.5 * (low + kth(n // 2 + 1 - below))
    return out


def regime_last(labels: DataFrame) -> DataFrame:
    """Label of the newest bar per series; under 30 bars it is unknown."""
    return labels.groupBy(*SERIES).agg(
        F.max("row_idx").alias("n_bars"),
        F.max_by("coarse", "row_idx").alias("_coarse"),
        F.max_by("fine", "row_idx").alias("fine"),
    ).select(*SERIES, "n_bars", F.when(F.col("n_bars") < 30, "unknown").otherwise(F.col("_coarse")).alias("coarse"), "fine")


def regime_distribution(labels: DataFrame) -> DataFrame:
    """Count and share of every fine and coarse label per series, zeros included."""
    def counts(col, names):
        return [F.struct(F.lit(col).alias("level"), F.lit(n).alias("label"), F.sum((F.col(col) == n).cast("long")).alias("n")) for n in names]

    per = labels.groupBy(*SERIES).agg(
        F.count("*").alias("total"), F.array(*counts("fine", FINE), *counts("coarse", COARSE)).alias("_rows")
    )
    return per.select(*SERIES, "total", F.inline("_rows")).withColumn("share", F.col("n") / F.col("total"))
