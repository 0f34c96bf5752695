"""Feature frame, targets and alignment of side series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import HOUR_MS
from tidemark.operators import indicators as ind
from tidemark.operators.blocks import SERIES, affine_scan, prefix_scan, windowed, with_row_index
from tidemark.operators.regime import coarse_label
from tidemark.sources.store import settle

# Feature order, and horizons in bars.
FEATURES = (
    "log_return_1",
    "realized_vol",
    "volume_ratio",
    "rsi_14",
    "ema_distance",
    "funding_rate",
    "funding_present",
    "open_interest_delta",
    "open_interest_present",
    "fear_greed_norm",
    "fear_greed_present",
    "source_freshness_log",
    "source_freshness_present",
    "regime_bull",
    "regime_bear",
    "regime_chop",
    "regime_unknown",
    "sma24_rel",
    "sma72_rel",
    "down_confirmed",
    "ret_4h",
    "ret_24h",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "is_weekend",
)
HORIZON_BARS = {"1h": 1, "4h": 4, "12h": 12, "24h": 24}
AUX = {"funding_rate": "double", "open_interest": "double", "fear_greed_value": "double", "freshness_s": "double"}


def aux_tail_align(bars: DataFrame, aux: DataFrame, columns) -> DataFrame:
    """Side rows matched to bars by position from the end; both carry ``row_idx``."""
    def from_end(df):
        sizes = df.groupBy(*SERIES).agg(F.max("row_idx").alias("_n"))
        return df.join(sizes, list(SERIES)).withColumn("_tail", F.col("_n") - F.col("row_idx")).drop("_n")

    side = from_end(aux).select(*SERIES, "_tail", *columns)
    return from_end(bars).join(side, [*SERIES, "_tail"], "left").drop("_tail")


def asof_join(bars: DataFrame, snapshots: DataFrame, columns, at: str = "snapshot_ms") -> DataFrame:
    """Newest snapshot at or before each bar close: union, number, carry the last one."""
    left = bars.select("*", F.col("close_time_ms").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).alias("_snap"))
    packed = F.struct(*[F.col(c) for c in columns], F.col(at))
    names = [c for c in bars.columns if c not in SERIES]
    right = snapshots.select(
        *SERIES, *[F.lit(None).alias(c) for c in names], F.col(at).alias("_t"), F.lit(0).alias("_kind"), packed.alias("_snap")
    )
    line = settle(with_row_index(left.unionByName(right), SERIES, ("_t", "_kind"), name="_line"))
    carried = prefix_scan(line, {"_last": ("last", F.col("_snap"))}, idx="_line")
    return carried.filter("_kind = 1").select(*bars.columns, *[F.col(f"_last.{c}").alias(c) for c in (*columns, at)])


def add_aux(bars: DataFrame, aux: DataFrame | None = None) -> DataFrame:
    if aux is None:
        return bars.select("*", *[F.lit(None).cast(t).alias(c) for c, t in AUX.items()])
    return aux_tail_align(bars, aux, list(AUX))


def feature_frame(bars: DataFrame, aux: DataFrame | None = None, ema_period: int = 20, rsi_period: int = 14) -> DataFrame:
    """All 27 features per bar plus ``close``, ``prev_close`` and ``regime``; needs ``row_idx``.

    One halo pass holds every bounded window, one affine scan all four recurrences.
    """
    def build(f, w):
        f = f.withColumns({"_lr": ind.log_return("close", w), **ind.wilder_columns("close", w, rsi_period)})
        return f.withColumns(
            {
                "realized_vol": ind.realized_vol("_lr", w, 24),
                "volume_ratio": ind.volume_ratio("volume", w, 24),
                "_sma24": ind.sma_prefix("close", w, 24),
                "_sma72": ind.sma_prefix("close", w, 72),
                "ret_4h": ind.trailing_return("close", w, 4),
                "ret_24h": ind.trailing_return("close", w, 24),
                "prev_close": F.coalesce(F.lag("close").over(w), F.lit(0.0)),
                "_bg": ind.wilder_terms("_gain", w, rsi_period),
                "_bl": ind.wilder_terms("_loss", w, rsi_period),
            }
        )

    f = settle(windowed(add_aux(bars, aux), build, before=73))
    f = settle(ind.oi_delta(f))
    shrink = (rsi_period - 1) / rsi_period
    f = affine_scan(
        f,
        {
            "_ema": ind.ema_terms(F.col("close"), ema_period),
            "_trend": ind.ema_terms(F.col("_lr"), 24),
            "_ag": (shrink, F.col("_bg")),
            "_al": (shrink, F.col("_bl")),
        },
    )
    funding, has_funding = ind.presence(F.col("funding_rate"))
    fng, has_fng = ind.presence(F.col("fear_greed_value") / 100.0, 0.5)
    fresh = F.col("freshness_s")
    regime = coarse_label("_trend")
    rel24, rel72 = ind.relative(F.col("close"), F.col("_sma24")), ind.relative(F.col("close"), F.col("_sma72"))
    made = {
        "log_return_1": F.col("_lr"),
        "realized_vol": F.col("realized_vol"),
        "volume_ratio": F.col("volume_ratio"),
        "rsi_14": ind.rsi_value(F.col("_ag"), F.col("_al"), rsi_period) / 100.0,
        "ema_distance": ind.relative(F.col("close"), F.col("_ema")),
        "funding_rate": funding,
        "funding_present": has_funding,
        "open_interest_delta": F.col("open_interest_delta"),
        "open_interest_present": F.col("open_interest").isNotNull().cast("double"),
        "fear_greed_norm": fng,
        "fear_greed_present": has_fng,
        "source_freshness_log": F.coalesce(F.when(fresh > -1, F.ln(fresh + 1.0)), F.lit(0.0)),
        "source_freshness_present": fresh.isNotNull().cast("double"),
        **ind.onehot_regime(regime),
        "sma24_rel": rel24,
        "sma72_rel": rel72,
        "down_confirmed": ((rel24 < 0) & (rel72 < 0)).cast("double"),
        "ret_4h": F.col("ret_4h"),
        "ret_24h": F.col("ret_24h"),
        **ind.calendar_columns(),
    }
    return f.select(
        *SERIES, "row_idx", "open_time_ms", "close", "prev_close", regime.alias("regime"), *[made[c].alias(c) for c in FEATURES]
    )


def direction_target(bars: DataFrame, horizons: dict[str, int] | None = None, close: str = "close") -> DataFrame:
    """Long table (row, horizon, y, target close) for all horizons in one halo pass.

    The last h rows and rows with a price that is not positive are dropped.
    """
    horizons = horizons or HORIZON_BARS
    reach = max(horizons.values())

    def build(f, w):
        ahead = [
            F.struct(F.lit(h).alias("horizon"), F.lead(close, n).over(w).alias("target_close"), F.lead("open_time_ms", n).over(w).alias("target_open_ms"))
            for h, n in horizons.items()
        ]
        return f.withColumn("_ahead", F.array(*ahead))

    rows = windowed(bars, build, before=0, after=reach).select("*", F.inline("_ahead")).drop("_ahead")
    return rows.filter((F.col(close) > 0) & (F.col("target_close") > 0)).withColumn(
        "y", (F.col("target_close") > F.col(close)).cast("int")
    )


def direction_target_exact(bars: DataFrame, horizons: dict[str, int] | None = None, close: str = "close", step_ms: int = HOUR_MS) -> DataFrame:
    """As ``direction_target``, with the bar that opens exactly the horizon later.

    Rows whose target falls into a gap are dropped, where a row offset would reach beyond it. Each
    row asks for its few target times, and an equality join finds them.
    """
    keys = list(SERIES)
    offers = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n * step_ms).cast("long").alias("_ahead")) for h, n in (horizons or HORIZON_BARS).items()])
    asked = bars.select("*", F.inline(offers)).withColumn("target_open_ms", F.col("open_time_ms") + F.col("_ahead")).drop("_ahead")
    found = bars.select(*keys, F.col("open_time_ms").alias("target_open_ms"), F.col(close).alias("target_close"))
    rows = asked.join(found, [*keys, "target_open_ms"])
    return rows.filter((F.col(close) > 0) & (F.col("target_close") > 0)).withColumn("y", (F.col("target_close") > F.col(close)).cast("int"))


def row_meta(frame: DataFrame) -> DataFrame:
    """What the rule baselines read of a feature row."""
    return frame.select(
        *SERIES, "row_idx", "log_return_1", F.col("rsi_14").alias("rsi"), "ema_distance", "regime", "close", "prev_close"
    )
