"""Drift detectors over ordered streams of values: one row per observation and stream.

Every detector needs a 1-based ``row_idx`` per stream and works on row blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import affine_scan, prefix_scan, windowed
from tidemark.sources.store import settle

# Fixed values.
PH = {"threshold": 50.0, "alpha": 1e-4, "min_n": 30, "direction": "both"}
EWMA = {"fast_alpha": 0.1, "slow_alpha": 0.005, "k_sigma": 3.0, "min_n": 30}
KS = {"reference_size": 200, "recent_size": 50, "alpha": 0.01, "min_recent": 30}
KS_COEFFICIENT = {0.10: 1.224, 0.05: 1.358, 0.025: 1.480, 0.01: 1.628, 0.005: 1.731}
DETECTORS = ("page_hinkley", "ewma", "kswin")


def page_hinkley(df: DataFrame, keys: Sequence[str], x: str = "x", **config) -> DataFrame:
    """Add ``ph_mean``, ``ph_cum``, ``ph_min``, ``ph_max``, ``ph_alarm``: three prefix scans.

    The detector has no feedback from its alarms, so the loop is three nested running
    aggregates: mean, sum of (x - mean - alpha), and the extremes of that sum.
    """
    c = {**PH, **config}
    n = F.col("row_idx")
    f = settle(prefix_scan(df, {"_sum": ("sum", F.col(x))}, keys).withColumn("ph_mean", F.col("_sum") / n))
    f = settle(prefix_scan(f, {"ph_cum": ("sum", F.col(x) - F.col("ph_mean") - c["alpha"])}, keys))
    f = prefix_scan(f, {"_lo": ("min", F.col("ph_cum")), "_hi": ("max", F.col("ph_cum"))}, keys)
    lo, hi = F.least(F.lit(0.0), "_lo"), F.greatest(F.lit(0.0), "_hi")
    up, down = F.col("ph_cum") - lo > c["threshold"], hi - F.col("ph_cum") > c["threshold"]
    fired = {"up": up, "down": down, "both": up | down}[c["direction"]]
    return f.withColumn("ph_min", lo).withColumn("ph_max", hi).withColumn("ph_alarm", (n >= c["min_n"]) & fired).drop("_sum", "_lo", "_hi")


def ewma_drift(df: DataFrame, keys: Sequence[str], x: str = "x", **config) -> DataFrame:
    """Add ``fast_ewma``, ``slow_mean``, ``ewma_var``, ``ewma_alarm``: two affine scans."""
    c = {**EWMA, **config}
    first, v = F.col("row_idx") == 1, F.col(x)

    def terms(alpha, value):
        return 1 - alpha, F.when(first, value).otherwise(value * alpha)

    f = affine_scan(df, {"fast_ewma": terms(c["fast_alpha"], v), "slow_mean": terms(c["slow_alpha"], v)}, keys)
    f = settle(windowed(f, lambda g, w: g.withColumn("_prev", F.lag("fast_ewma").over(w)), before=1, keys=keys))
    diff = v - F.col("_prev")
    step = F.when(first, 0.0).otherwise(diff * diff * c["fast_alpha"])
    f = affine_scan(f, {"ewma_var": (1 - c["fast_alpha"], step)}, keys)
    sigma = F.sqrt(F.greatest(F.col("ewma_var"), F.lit(0.0)))
    gap = F.abs(F.col("fast_ewma") - F.col("slow_mean"))
    alarm = (F.col("row_idx") >= c["min_n"]) & (sigma > 0) & (gap > sigma * c["k_sigma"])
    return f.withColumn("ewma_alarm", alarm).drop("_prev")


def ks_distance(reference: Column, recent: Column, m: Column, n: Column) -> Column:
    """Largest gap of two empirical distributions given as arrays of m and n values.

    Both samples are walked in one sorted merge; at equal values the reference side
    advances first, one value at a time, and the gap is taken after every step. Once a
    side is used up the gap can only shrink, so the walk may run to the end.
    """
    marked = F.concat(
        F.transform(reference, lambda v: F.struct(v.alias("v"), F.lit(0).alias("side"))),
        F.transform(recent, lambda v: F.struct(v.alias("v"), F.lit(1).alias("side"))),
    )
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("d"))

    def step(acc, e):
        i, j = acc["i"] + 1 - e["side"], acc["j"] + e["side"]
        return F.struct(i.alias("i"), j.alias("j"), F.greatest(acc["d"], F.abs(i / m - j / n)).alias("d"))

    return F.aggregate(F.array_sort(marked), start, step, lambda acc: acc["d"])


def ks_window(df: DataFrame, keys: Sequence[str], x: str = "x", **config) -> DataFrame:
    """Add ``ks_d``, ``ks_recent_n``, ``ks_alarm``: one bounded frame of the last 250 values."""
    c = {**KS, **config}
    ref, rec, least = c["reference_size"], c["recent_size"], c["min_recent"]
    span = ref + rec

    def build(f, w):
        return f.withColumn("_vals", F.collect_list(F.struct("row_idx", F.col(x).alias("v"))).over(w.rowsBetween(-(span - 1), 0)))

    f = windowed(df, build, before=span - 1, keys=keys)
    r = F.greatest(F.lit(0), F.least(F.col("row_idx") - ref, F.lit(rec))).cast("int")
    f = f.withColumn("ks_recent_n", r)
    ready = F.col("ks_recent_n") >= least
    vals = F.transform("_vals", lambda e: e["v"])
    size, k = F.size("_vals"), F.col("ks_recent_n")
    recent = F.slice(vals, size - k + 1, F.greatest(k, F.lit(1)))
    reference = F.slice(vals, F.greatest(size - k - ref + 1, F.lit(1)), F.lit(ref))
    critical = F.lit(KS_COEFFICIENT[c["alpha"]]) * F.sqrt((F.lit(float(ref)) + k) / (F.lit(float(ref)) * k))
    return (
        f.withColumn("ks_d", F.when(ready, ks_distance(reference, recent, F.lit(float(ref)), k.cast("double"))))
        .withColumn("ks_alarm", F.coalesce(ready & (F.col("ks_d") > critical), F.lit(False)))
        .drop("_vals")
    )


def snapshot_columns(keys: Sequence[str], rows: DataFrame, detector: str) -> DataFrame:
    """Last state of a detector per stream, with alarm count, last alarm and positions."""
    alarm = {"page_hinkley": "ph_alarm", "ewma": "ewma_alarm", "kswin": "ks_alarm"}[detector]
    state = {
        "page_hinkley": ("ph_mean", "ph_cum", "ph_min", "ph_max"),
        "ewma": ("fast_ewma", "slow_mean", "ewma_var"),
        "kswin": ("ks_d", "ks_recent_n"),
    }[detector]
    last = F.max_by(F.to_json(F.struct(*[F.round(c, 9).alias(c) for c in state])), "row_idx")
    return rows.groupBy(*keys).agg(
        F.lit(detector).alias("detector"),
        F.max("row_idx").alias("n"),
        F.count_if(alarm).alias("alarm_count"),
        F.max(F.when(F.col(alarm), F.col("row_idx"))).alias("last_alarm_at"),
        F.min(F.when(F.col(alarm), F.col("row_idx"))).alias("first_alarm_at"),
        last.alias("state"),
    )


def alarm_positions(keys: Sequence[str], rows: DataFrame, detector: str) -> DataFrame:
    """One row per alarm: 0-based position in the stream (kept long, never collected)."""
    alarm = {"page_hinkley": "ph_alarm", "ewma": "ewma_alarm", "kswin": "ks_alarm"}[detector]
    return rows.filter(alarm).select(*keys, F.lit(detector).alias("detector"), (F.col("row_idx") - 1).alias("alarm_at"))


def drift_run(errors: DataFrame, features: DataFrame, keys: Sequence[str], ph: dict | None = None, ewma: dict | None = None, ks: dict | None = None) -> DataFrame:
    """Snapshots of all three detectors; errors feed two of them, features the third."""
    parts = [
        snapshot_columns(keys, page_hinkley(errors, keys, **(ph or {})), "page_hinkley"),
        snapshot_columns(keys, ewma_drift(errors, keys, **(ewma or {})), "ewma"),
        snapshot_columns(keys, ks_window(features, keys, **(ks or {})), "kswin"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def recent_alarms(errors: DataFrame, keys: Sequence[str], order: Sequence[str], look_back: int = 100, ph: dict | None = None, ewma: dict | None = None) -> DataFrame:
    """(keys, drift_alarms): alarms of both error detectors over each stream's newest ``look_back`` values.

    ``errors`` has the keys, the columns of ``order`` and ``x``. Map tasks keep the newest rows of a
    stream only, so that no more than ``look_back`` rows of a stream meet for each of them.
    """
    keys = list(keys)
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    kept = errors.select(*keys, *order, "x").withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= look_back)
    rows = settle(kept.withColumn("row_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_back"))).cast("long")).select(*keys, "row_idx", "x"))
    found = [page_hinkley(rows, keys, **(ph or {})).select(*keys, F.col("ph_alarm").alias("_a")), ewma_drift(rows, keys, **(ewma or {})).select(*keys, F.col("ewma_alarm").alias("_a"))]
    return found[0].unionByName(found[1]).groupBy(*keys).agg(F.count_if("_a").alias("drift_alarms"))


def retrain_candidate(snapshots: DataFrame, keys: Sequence[str], regimes: DataFrame | None = None) -> DataFrame:
    """Trigger rows (detectors that fired) per stream, joined with regime metrics when given."""
    trig = snapshots.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("alarm_count") > 0, F.col("detector")))).alias("triggers"),
        F.max("n").alias("sample_size"),
        F.sum("alarm_count").alias("alarms"),
    )
    return trig if regimes is None else trig.join(regimes, list(keys), "left")


def per_regime_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n, hit at 0.5, Brier and base rate by regime of (p_up, y)."""
    p, y = F.col("p_up"), F.col("y")
    return rows.groupBy(*keys, F.coalesce("regime", F.lit("unknown")).alias("regime")).agg(
        F.count("*").alias("n"),
        F.avg(((p >= 0.5).cast("int") == y).cast("int")).alias("hit_rate"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg("y").alias("base_rate"),
    )
