"""Accuracy metrics over the joined ledger (one row per forecast, resolution columns nullable)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.scalar import DAY_MS
from tidemark.operators.blocks import prefix_scan, with_row_index
from tidemark.sources.store import settle

# Fixed values.
MIN_N_DISPLAY = 20
ECE_BINS, ECE_MIN_N = 5, 50
WINDOW_DAYS = (7, 30, 90)
TAPE_MIN_N, TAPE_LAST = 5, 30
RECENT_ROWS = 50
DIMENSIONS = {
    "by_horizon": ("horizon",),
    "by_model_version": ("model_version",),
    "by_model_horizon": ("model_version", "horizon"),
    "by_direction": ("direction",),
    "by_regime": ("regime",),
    "global": (),
}
_DIM_COLS = ("model_version", "horizon", "direction", "regime")
PROB_SPAN = 1 << 20


def resolved(joined: DataFrame) -> DataFrame:
    return joined.filter(F.col("status") == "resolved")


def scored(rows: DataFrame) -> DataFrame:
    """Resolved rows with the columns the aggregates read."""
    return resolved(rows).select(
        "*",
        F.col("direction_correct").cast("int").alias("o"),
        F.col("probability").alias("p"),
        S.signed_return(F.col("direction"), F.col("actual_return")).alias("signed"),
        F.coalesce("regime_at_issue", F.lit("unknown")).alias("regime"),
    )


def _base_aggs() -> list[Column]:
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    return [
        F.count("*").alias("n"),
        F.sum("o").alias("_hits"),
        F.avg("brier_component").alias("brier"),
        F.avg("logloss_component").alias("logloss"),
        F.avg("signed").alias("_exp"),
        F.sum((F.col("actual_return") > 0).cast("int")).alias("_rose"),
        F.count_if(up).alias("n_up"),
        F.count_if(down).alias("n_down"),
        F.count_if(up & (F.col("o") == 1)).alias("_hit_up"),
        F.count_if(down & (F.col("o") == 1)).alias("_hit_down"),
    ]


def _finish(agg: DataFrame, keys: Sequence[str], min_n: int) -> DataFrame:
    n = F.nullif(F.col("n").cast("double"), F.lit(0.0))
    hit, up = F.col("_hits") / n, F.col("_rose") / n
    return agg.select(
        *keys,
        "n",
        hit.alias("hit_rate"),
        "brier",
        "logloss",
        S.wilson_lower(hit, F.col("n")).alias("wilson_lb_95"),
        hit.alias("base_rate"),
        F.greatest(hit, 1 - hit).alias("baseline_hit_rate"),
        (hit * (1 - hit)).alias("baseline_brier"),
        up.alias("always_up_rate"),
        (1 - up).alias("always_down_rate"),
        (hit - F.greatest(up, 1 - up)).alias("vs_majority_pp"),
        (F.col("_exp") * 10000.0).alias("expectancy_bps"),
        S.fee_adjusted_bps(F.col("_exp"), S.MAKER_BPS).alias("expectancy_maker_2bps"),
        S.fee_adjusted_bps(F.col("_exp"), S.TAKER_BPS).alias("expectancy_taker_10bps"),
        "n_up",
        "n_down",
        (F.col("_hit_up") / F.nullif(F.col("n_up").cast("double"), F.lit(0.0))).alias("hit_up"),
        (F.col("_hit_down") / F.nullif(F.col("n_down").cast("double"), F.lit(0.0))).alias("hit_down"),
        (F.col("n") >= min_n).alias("display_ready"),
    )


def bucket_metrics(rows: DataFrame, keys: Sequence[str], min_n: int = MIN_N_DISPLAY) -> DataFrame:
    """The whole metric set per bucket, calibration error included; one aggregation each."""
    base = _finish(rows.groupBy(*keys).agg(*_base_aggs()), keys, min_n)
    return base.join(ece_quantile(rows, keys), list(keys), "left")


def _label(cols: Sequence[str]) -> tuple[Column, Column]:
    """Dimension name and bucket text from the grouping columns of GROUPING SETS."""
    gid = F.col("_gid")
    dim, bucket = F.lit(None).cast("string"), F.lit(None).cast("string")
    width = len(_DIM_COLS)
    for name, used in DIMENSIONS.items():
        mask = sum(1 << (width - 1 - i) for i, c in enumerate(_DIM_COLS) if c not in used)
        text = F.concat_ws("|", *used) if used else F.lit("all")
        dim = F.when(gid == mask, name).otherwise(dim)
        bucket = F.when(gid == mask, text).otherwise(bucket)
    return dim, bucket


def _dimension_sets(extra: Sequence[str] = ()) -> list[list[Column]]:
    return [[F.col(c) for c in (*used, *extra)] for used in DIMENSIONS.values()]


def metrics_by_dims(rows: DataFrame, min_n: int = MIN_N_DISPLAY) -> DataFrame:
    """Every report dimension in one GROUPING SETS pass, one row per (dimension, bucket)."""
    cols = [F.col(c) for c in _DIM_COLS]
    agg = rows.groupingSets(_dimension_sets(), *cols).agg(F.grouping_id().alias("_gid"), *_base_aggs())
    dim, bucket = _label(_DIM_COLS)
    keys = ["dimension", "bucket"]
    base = _finish(agg.withColumn("dimension", dim).withColumn("bucket", bucket), keys, min_n)
    pairs = rows.groupingSets(_dimension_sets(["p"]), *cols, F.col("p")).agg(
        (F.grouping_id() / 2).cast("long").alias("_gid"), F.count("*").alias("c"), F.sum("o").alias("so")
    )
    pairs = pairs.select(dim.alias("dimension"), bucket.alias("bucket"), "p", "c", "so")
    return base.join(ece_from_pairs(pairs, keys), keys, "left")


def ece_quantile(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = rows.groupBy(*keys, "p").agg(F.count("*").alias("c"), F.sum("o").alias("so"))
    return ece_from_pairs(pairs, keys)


def ece_from_pairs(pairs: DataFrame, keys: Sequence[str], bins: int = ECE_BINS, min_n: int = ECE_MIN_N) -> DataFrame:
    """Calibration error over equal-count bins; equal probabilities never part.

    ``pairs`` holds (keys, p, c rows, so hits). The running count before a probability
    is built in two levels (span totals, then inside the span), so no task sorts all
    probabilities of a bucket.
    """
    keys = list(keys)
    spanned = settle(pairs).withColumn("_span", F.floor(F.col("p") * PROB_SPAN))
    totals = spanned.groupBy(*keys, "_span").agg(F.sum("c").alias("_c"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_span", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(whole).alias("n")
    )
    inside = Window.partitionBy(*keys, "_span").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = spanned.withColumn("_in", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(offsets, [*keys, "_span"])
    bin_no = F.least(F.lit(bins - 1), F.floor((F.col("_off") + F.col("_in")) * bins / F.col("n")))
    binned = ranked.groupBy(*keys, "n", bin_no.alias("bin")).agg(
        F.sum("c").alias("c"), F.sum("so").alias("so"), F.sum(F.col("p") * F.col("c")).alias("sp")
    )
    gap = F.abs(F.col("sp") - F.col("so")) / F.col("n")
    return binned.groupBy(*keys).agg(F.when(F.max("n") >= min_n, F.sum(gap)).alias("ece"))


def dedupe_bucket(rows: DataFrame, keys=("series_id", "model_version", "horizon", "issued_ms")) -> DataFrame:
    """One row per bucket plus ``duplicates`` dropped; needs ``file_pos``.

    The first row in file order stays unless it carries ``issued_at_actual_ms`` and a
    later row carries an earlier one. As two ``min_by`` aggregates this merges map-side.
    """
    row = F.struct(*[c for c in rows.columns if c not in keys])
    actual = F.col("issued_at_actual_ms")
    best = F.min_by(row, F.when(actual.isNotNull(), F.struct(actual, F.col("file_pos"))))
    first = F.min_by(row, "file_pos")
    agg = rows.groupBy(*keys).agg(first.alias("_first"), best.alias("_best"), (F.count("*") - 1).alias("duplicates"))
    kept = F.when(F.col("_first.issued_at_actual_ms").isNull(), F.col("_first")).otherwise(F.col("_best"))
    return agg.withColumn("_row", kept).select(*keys, "_row.*", "duplicates")


def _in_windows(clock: str, now_ms: Column) -> DataFrame:
    cases = [
        F.struct(F.lit(d).alias("window_days"), (F.col(clock) >= now_ms - F.lit(d * DAY_MS)).alias("inside"))
        for d in WINDOW_DAYS
    ]
    return F.inline(F.array(*cases))


def rolling_resolved(rows: DataFrame, now_ms: Column, min_n: int = MIN_N_DISPLAY) -> DataFrame:
    """Full metrics of the rows resolved in the last 7, 30 and 90 days."""
    inside = rows.select("*", _in_windows("resolved_ms", now_ms)).filter("inside")
    return bucket_metrics(inside, ["window_days"], min_n)


def rolling_issued(rows: DataFrame, now_ms: Column) -> DataFrame:
    """Compact metrics by issue time per horizon and model x horizon; empty windows stay."""
    model_horizon = F.concat_ws("|", "model_version", "horizon")
    buckets = F.array(
        F.struct(F.lit("by_horizon").alias("dimension"), F.col("horizon").alias("bucket")),
        F.struct(F.lit("by_model_horizon").alias("dimension"), model_horizon.alias("bucket")),
    )
    spread = rows.select("*", _in_windows("issued_ms", now_ms)).select("*", F.inline(buckets))

    def inside(c):
        return F.when(F.col("inside"), F.col(c))

    agg = spread.groupBy("dimension", "bucket", "window_days").agg(
        F.count_if("inside").alias("n"),
        F.avg(inside("o")).alias("hit_rate"),
        F.avg(inside("brier_component")).alias("brier"),
        F.avg(inside("signed")).alias("_exp"),
    )
    return agg.select(
        "dimension",
        "bucket",
        "window_days",
        "n",
        "hit_rate",
        "brier",
        (F.col("_exp") * 10000.0).alias("expectancy_bps"),
        S.fee_adjusted_bps(F.col("_exp"), S.MAKER_BPS).alias("expectancy_maker_2bps"),
        F.when(F.col("n") > 0, S.wilson_lower(F.col("hit_rate"), F.col("n"))).alias("wilson_lb_95"),
    )


def edge_scoreboard(by_horizon: DataFrame, min_n: int = MIN_N_DISPLAY) -> DataFrame:
    """Horizons ranked by maker expectancy; input is ``bucket_metrics`` by horizon."""
    maker, vs = F.col("expectancy_maker_2bps"), F.col("vs_majority_pp")
    tradeable = (F.col("n") >= min_n) & (maker > 0) & (vs > 0)
    return by_horizon.select(
        "horizon", "n", "hit_rate", "expectancy_maker_2bps", "vs_majority_pp", F.coalesce(tradeable, F.lit(False)).alias("tradeable")
    ).orderBy(F.desc_nulls_last("expectancy_maker_2bps"), "horizon")


def recent_rows(joined: DataFrame, limit: int = RECENT_ROWS) -> DataFrame:
    """Newest rows by (issued, id); outcome columns only when resolved."""
    ok = F.coalesce(F.col("status") == "resolved", F.lit(False))
    return (
        joined.select(
            "forecast_id",
            "issued_ms",
            "model_version",
            "horizon",
            "direction",
            "probability",
            "entry_price",
            "target_ms",
            ok.alias("resolved"),
            F.when(ok, F.col("actual_close")).alias("actual_close"),
            F.when(ok, F.col("actual_return") * 10000.0).alias("actual_return_bps"),
            F.when(ok, F.col("direction_correct")).alias("direction_correct"),
            F.when(ok, F.col("resolved_ms")).alias("resolved_ms"),
        )
        .orderBy(F.desc("issued_ms"), F.desc("forecast_id"))
        .limit(limit)
    )


TAPE_KEYS = ("series_id", "model_version", "horizon")


def tape_curve(rows: DataFrame, keys=TAPE_KEYS) -> DataFrame:
    """Every resolved forecast as a one-unit paper trade with the running curve."""
    trades = scored(rows).withColumn("ret_bps_gross", F.col("signed") * 10000.0)
    trades = trades.withColumn("ret_bps_maker", F.col("ret_bps_gross") - S.MAKER_BPS)
    trades = settle(with_row_index(trades, keys, ("issued_ms", "forecast_id"), name="trade_no"))
    curve = settle(prefix_scan(trades, {"cum_bps": ("sum", F.col("ret_bps_maker"))}, keys, "trade_no"))
    curve = prefix_scan(curve, {"_top": ("max", F.col("cum_bps"))}, keys, "trade_no")
    peak = F.greatest(F.lit(0.0), F.col("_top"))
    return curve.withColumn("peak_bps", peak).withColumn("drawdown_bps", peak - F.col("cum_bps")).drop("_top")


#: Issue times of one block of a tape, and blocks that are joined at once.
TAPE_SPAN_MS, TAPE_FAN = 4096 * S.HOUR_MS, 512


def joined_tapes(blocks: Column) -> Column:
    """One summary of stretches of a tape, in order: trades, wins, sum, highest and lowest running
    sum (from 0) and deepest fall below an earlier high. The operation is associative."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("wins"), *[F.lit(0.0).alias(c) for c in ("total", "top", "low", "fall")])

    def add(a: Column, b: Column) -> Column:
        low = a["total"] + b["low"]
        return F.struct(
            (a["n"] + b["n"]).alias("n"),
            (a["wins"] + b["wins"]).alias("wins"),
            (a["total"] + b["total"]).alias("total"),
            F.greatest(a["top"], a["total"] + b["top"]).alias("top"),
            F.least(a["low"], low).alias("low"),
            F.greatest(a["fall"], b["fall"], a["top"] - low).alias("fall"),
        )

    return F.aggregate(blocks, none, add)


def trade_tape(rows: DataFrame, keys=TAPE_KEYS, min_n: int = TAPE_MIN_N, span: int = TAPE_SPAN_MS, fan: int = TAPE_FAN) -> DataFrame:
    """Totals and deepest drawdown of every paper-trade tape.

    Blocks of issue time are summed up alone and joined in order, ``fan`` at a time; no running
    curve is stored.
    """
    keys = list(keys)
    trades = scored(rows).select(*keys, "issued_ms", "forecast_id", "o", (F.col("signed") * 10000.0 - S.MAKER_BPS).alias("_x"), F.floor(F.col("issued_ms") / span).alias("_b"))
    inside = Window.partitionBy(*keys, "_b").orderBy("issued_ms", "forecast_id").rowsBetween(Window.unboundedPreceding, 0)
    run = trades.withColumn("_cum", F.sum("_x").over(inside))
    run = run.withColumn("_high", F.greatest(F.lit(0.0), F.max("_cum").over(inside)))
    parts = [F.count("*").alias("n"), F.sum("o").cast("long").alias("wins"), F.sum("_x").alias("total"), F.max("_high").alias("top"), F.least(F.lit(0.0), F.min("_cum")).alias("low"), F.max(F.col("_high") - F.col("_cum")).alias("fall")]
    names = ("n", "wins", "total", "top", "low", "fall")
    tapes = run.groupBy(*keys, "_b").agg(*parts).select(*keys, "_b", F.struct(*names).alias("t"))
    while True:
        tapes = tapes.withColumn("_up", F.floor(F.col("_b") / fan)).groupBy(*keys, "_up").agg(F.array_sort(F.collect_list(F.struct("_b", "t"))).alias("_l"))
        tapes = settle(tapes.select(*keys, F.col("_up").alias("_b"), joined_tapes(F.transform("_l", lambda x: x["t"])).alias("t")))
        if tapes.groupBy(*keys).count().filter("count > 1").isEmpty():
            break
    n = F.col("t.n")
    return tapes.filter(n >= min_n).select(
        *keys,
        n.alias("n"),
        F.col("t.wins").alias("wins"),
        F.col("t.total").alias("sum_bps_maker"),
        F.col("t.fall").alias("max_drawdown_bps_maker"),
        (F.col("t.wins") / n).alias("hit_rate"),
        (F.col("t.total") / n).alias("avg_bps_maker"),
    )


def last_trades(curve: DataFrame, keys=TAPE_KEYS, last: int = TAPE_LAST, min_n: int = TAPE_MIN_N) -> DataFrame:
    """Newest ``last`` trades per group of at least ``min_n``."""
    sizes = curve.groupBy(*keys).agg(F.max("trade_no").alias("_n"))
    return curve.join(sizes, list(keys)).filter((F.col("_n") >= min_n) & (F.col("trade_no") > F.col("_n") - last)).drop("_n")
