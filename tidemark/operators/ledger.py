"""Forecast ledger: signals, issuing, checks, resolution and the joined ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.scalar import BUCKET_HOURS, HORIZON_HOURS, HOUR_MS
from tidemark.operators.blocks import SERIES, affine_scan, windowed
from tidemark.operators.indicators import ema_terms, log_return, sma_prior
from tidemark.operators.regime import coarse_label
from tidemark.sources.store import settle

# Fixed values of the three rule models.
BASELINE = "v0.1.0-baseline-shadow"
POLICY = "v0.2.0-shadow-policy24"
GUARD = "v0.3.0-shadow-guard24"
SIGNAL_VERSION = {BASELINE: "shadow-v0.1.0", POLICY: "shadow-policy24-v0.1.0", GUARD: "shadow-guard24-v0.1.0"}
CREATED_BY = {
    BASELINE: "scheduled-issuer/baseline-shadow",
    POLICY: "scheduled-issuer/policy24",
    GUARD: "scheduled-issuer/guard24",
}
MODEL_HORIZONS = {BASELINE: ("1h", "4h", "12h", "24h"), POLICY: ("12h", "24h"), GUARD: ("12h", "24h")}
PROB_FLOOR, PROB_CEIL = 0.5005, 0.55
POLICY_SKIP_HOUR = 20
GUARD_REL_ABSTAIN, GUARD_HIGH_BAND = 0.01, 0.005
GUARD_PROB_HIGH, GUARD_PROB_LOW = 0.55, 0.52
STALENESS_HOURS = 6
MAX_BACKDATE_MS = 15 * 60_000
ENTRY_SYMBOLS = {"binance": "BTCUSDT", "coinbase": "BTC-USD", "kraken": "XBTUSD"}
HORIZONS = ("1h", "4h", "12h", "24h", "1d", "7d", "30d")
DIRECTIONS = ("up", "down")
REGIMES = ("bull", "bear", "chop", "unknown")
FORECAST_STATUSES = ("open", "resolved", "voided", "superseded")
RESOLUTION_STATUSES = ("resolved", "voided")
FORECAST_FIELDS = (
    "forecast_id",
    "issued_at",
    "asset",
    "horizon",
    "target_time",
    "target_rule",
    "direction",
    "probability",
    "entry_price",
    "model_version",
    "signal_version",
    "regime_at_issue",
    "feature_snapshot_uri",
    "source_snapshot_uri",
    "confidence_reason",
    "invalidation",
    "created_by",
    "status",
)
RESOLUTION_FIELDS = (
    "forecast_id",
    "resolved_at",
    "actual_close",
    "actual_return",
    "direction_correct",
    "brier_component",
    "logloss_component",
    "status",
    "resolver_version",
    "candle_open_time",
    "candle_close_time",
    "price_source",
)
OUTCOME_FIELDS = RESOLUTION_FIELDS[1:7]
RESOLVER_VERSION = "resolver-v0.2.0"
DEFAULT_CHAIN = ("binance", "coingecko", "kraken")
ENTRY_VENUES = ("binance", "coinbase", "kraken")


# ── signals ──────────────────────────────────────────────────────────────────
def signal_state(bars: DataFrame) -> DataFrame:
    """Per bar: prior means, next bar and regime; everything the rule models read."""
    def build(f, w):
        return (
            f.withColumn("sma24", sma_prior("close", w, 24))
            .withColumn("sma72", sma_prior("close", w, 72))
            .withColumn("log_return", log_return("close", w))
            .withColumn("next_close_ms", F.lead("close_time_ms").over(w))
        )

    state = settle(windowed(bars, build, before=72, after=1))
    state = affine_scan(state, {"trend_score": ema_terms(F.col("log_return"), 24)})
    regime = F.when(F.col("row_idx") < 30, "unknown").otherwise(coarse_label())
    return state.withColumn("regime", regime)


def _prior_rel() -> Column:
    sma, last = F.col("sma24"), F.col("close")
    return F.when(sma <= 0, 0.0).otherwise(F.abs(last - sma) / sma)


def _prior_reason() -> Column:
    text = F.format_string("shadow:sma24 last=%.2f sma=%.2f rel=%.4f", F.col("close"), F.col("sma24"), _prior_rel())
    return F.when(F.col("row_idx") < 2, "insufficient-history").otherwise(text)


def _call() -> Column:
    return F.when((F.col("row_idx") < 2) | (F.col("close") >= F.col("sma24")), "up").otherwise("down")


def _within_band(bump: Column) -> Column:
    return F.when(F.col("row_idx") < 2, PROB_FLOOR).otherwise(S.clip(F.lit(PROB_FLOOR) + bump, PROB_FLOOR, PROB_CEIL))


def signal_baseline(run_ms: Column | None = None) -> dict[str, Column]:
    """Up at or above the prior mean; the further away, the more confident."""
    bump = F.least(_prior_rel(), F.lit(PROB_CEIL - PROB_FLOOR))
    return {"direction": _call(), "probability": _within_band(bump), "reason": _prior_reason()}


def signal_policy24(run_ms: Column | None = None) -> dict[str, Column]:
    """Same call with stepped, inverted confidence; no issue in one hour of the day."""
    rel = _prior_rel()
    strength = F.when(rel <= 0.001, 0.7).when(rel <= 0.003, 1.0).when(rel <= 0.005, 0.55).when(rel <= 0.01, 0.25).otherwise(0.05)
    short = F.col("row_idx") < 2
    reason = F.concat(F.when(short, "policy24:").otherwise("policy24:inv_conf|"), _prior_reason())
    return {"direction": _call(), "probability": _within_band(strength * (PROB_CEIL - PROB_FLOOR)), "reason": reason}


def signal_guard24(run_ms: Column) -> dict[str, Column]:
    """Abstains on short history, large moves, unconfirmed downs and weekend downs."""
    last, s24, s72 = F.col("close"), F.col("sma24"), F.col("sma72")
    rel = (last - s24) / F.when(s24 > 0, s24)
    core = F.format_string("rel=%.4f|sma24=%.2f|sma72=%.2f", rel, s24, s72)
    stop = (
        F.when(F.col("row_idx") < 73, F.concat(F.lit("insufficient-history|have="), F.col("row_idx"), F.lit("|need=73")))
        .when(s24 <= 0, "degenerate-sma24")
        .when(F.abs(rel) > GUARD_REL_ABSTAIN, F.concat(F.lit("rel-extreme|"), core))
        .when((last < s24) & (last >= s72), F.concat(F.lit("no-sma72-confirm|"), core))
        .when((last < s24) & (S.weekday_mon0(run_ms) >= 5), F.concat(F.lit("weekend-down|"), core))
    )
    high = F.abs(rel) < GUARD_HIGH_BAND
    reason = F.when(stop.isNotNull(), F.concat(F.lit("guard24:abstain="), stop)).otherwise(
        F.concat(F.lit("guard24:"), core, F.lit("|band="), F.when(high, "high").otherwise("low"))
    )
    return {
        "direction": F.when(stop.isNotNull(), "abstain").when(last >= s24, "up").otherwise("down"),
        "probability": F.when(stop.isNull(), F.when(high, GUARD_PROB_HIGH).otherwise(GUARD_PROB_LOW)),
        "reason": reason,
    }


SIGNALS = {BASELINE: signal_baseline, POLICY: signal_policy24, GUARD: signal_guard24}


# ── issuing ──────────────────────────────────────────────────────────────────
def issue_bucket(run_ms: Column, horizon: Column) -> Column:
    """Start of the issue bucket: 1 h or 4 h of the day."""
    width = F.when(horizon == "4h", 4 * HOUR_MS).otherwise(HOUR_MS)
    return S.floor_to(run_ms, width)


def run_clock(state: DataFrame) -> DataFrame:
    """One row per hourly run: at the close of a bar and while it is at most 6 h old."""
    last_run = F.least(
        F.coalesce(F.col("next_close_ms") - HOUR_MS, F.col("close_time_ms")),
        F.col("close_time_ms") + STALENESS_HOURS * HOUR_MS,
    )
    return state.withColumn("run_ms", F.explode_outer(F.sequence(F.col("close_time_ms"), last_run, F.lit(HOUR_MS))))


def issue_attempts(state: DataFrame, models=(BASELINE, GUARD), max_backdate_ms: int | None = MAX_BACKDATE_MS) -> DataFrame:
    """Every (run, model, horizon) with its call and the reason it was not issued, if any."""
    return attempts_of(run_clock(state), models, max_backdate_ms)


def attempts_of(runs: DataFrame, models=(BASELINE, GUARD), max_backdate_ms: int | None = MAX_BACKDATE_MS) -> DataFrame:
    """As ``issue_attempts``, for rows that have their ``run_ms``; row by row, so also on a stream."""
    run = F.col("run_ms")
    calls = [
        F.struct(
            F.lit(model).alias("model_version"),
            *[c.alias(n) for n, c in SIGNALS[model](run).items()],
            F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(HORIZON_HOURS[h] * HOUR_MS).cast("long").alias("delta_ms")) for h in MODEL_HORIZONS[model]]).alias("_offers"),
        )
        for model in models
    ]
    # One row per model first, so that a call is worked out once and not per horizon.
    tried = runs.select("*", F.inline(F.array(*calls))).select("*", F.inline_outer("_offers")).drop("_offers")
    tried = tried.withColumn("issued_ms", issue_bucket(run, F.col("horizon")))
    late = run - F.col("issued_ms")
    skip = F.when(F.col("direction") == "abstain", "abstain").when(
        (F.col("model_version") == POLICY) & (S.hour_utc(run) == POLICY_SKIP_HOUR), "skip_hour"
    )
    if max_backdate_ms is not None:
        skip = F.coalesce(skip, F.when(late > max_backdate_ms, "backfill_guard"))
    return tried.withColumn("skipped", skip)


def forecast_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def forecast_rows(attempts: DataFrame) -> DataFrame:
    """Ledger rows of the attempts that were not skipped.

    Several runs can open the same bucket when the backdating guard is off; the first
    run wins, as one aggregation with map-side partials.
    """
    issued = attempts.filter(F.col("skipped").isNull())
    first = issued.groupBy(*SERIES, "model_version", "horizon", "issued_ms").agg(
        F.min_by(
            F.struct("delta_ms", "direction", "probability", "reason", "close", "regime", "source", "run_ms"), "run_ms"
        ).alias("r")
    )
    iso = S.iso_utc(F.col("issued_ms"))
    level = S.invalidation_level(F.col("r.direction"), F.col("r.close"))
    sign = F.when(F.col("r.direction") == "down", "> ").otherwise("< ")
    return first.select(
        forecast_id(F.col("series_id"), F.col("model_version"), F.col("horizon"), iso).alias("forecast_id"),
        *SERIES,
        "issued_ms",
        "horizon",
        (F.col("issued_ms") + F.col("r.delta_ms")).alias("target_ms"),
        F.when(F.col("r.direction") == "up", "close_above_entry").otherwise("close_below_entry").alias("target_rule"),
        F.col("r.direction").alias("direction"),
        F.col("r.probability").alias("probability"),
        F.col("r.close").alias("entry_price"),
        "model_version",
        _lookup(SIGNAL_VERSION, F.col("model_version")).alias("signal_version"),
        F.col("r.regime").alias("regime_at_issue"),
        F.lit("bars/1h").alias("feature_snapshot_uri"),
        F.lit("bars/1h").alias("source_snapshot_uri"),
        F.col("r.reason").alias("confidence_reason"),
        F.concat(F.lit("price "), sign, F.format_string("%.2f", level), F.lit(" before target")).alias("invalidation"),
        _lookup(CREATED_BY, F.col("model_version")).alias("created_by"),
        F.lit("open").alias("status"),
        F.col("r.run_ms").alias("issued_at_actual_ms"),
        F.coalesce(F.col("r.source"), F.lit("unknown")).alias("entry_source"),
        _lookup(ENTRY_SYMBOLS, F.col("r.source")).alias("entry_symbol"),
    )


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def issue_replay(bars: DataFrame, models=(BASELINE, GUARD), max_backdate_ms: int | None = MAX_BACKDATE_MS) -> DataFrame:
    """All forecasts the rule models would have issued over the bars (needs ``row_idx``)."""
    return forecast_rows(issue_attempts(signal_state(bars), models, max_backdate_ms))


def issue_dedupe(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows whose (series, model, horizon, bucket) is not in the ledger yet."""
    keys = [*SERIES, "model_version", "horizon", "_bucket"]
    bucket = issue_bucket(F.col("issued_ms"), F.col("horizon"))
    taken = existing.filter(F.col("horizon").isin(*HORIZON_HOURS)).withColumn("_bucket", bucket).select(*keys)
    return new.withColumn("_bucket", bucket).join(taken, keys, "left_anti").drop("_bucket")


def manual_issue(rows: DataFrame) -> DataFrame:
    """Forecast rows from parameters: series, horizon, direction, probability, price, time."""
    hours = F.when(F.col("horizon") == "1d", 24).when(F.col("horizon") == "7d", 168).when(F.col("horizon") == "30d", 720)
    for h, n in HORIZON_HOURS.items():
        hours = hours.when(F.col("horizon") == h, n)
    return rows.select(
        forecast_id(F.lit("manual"), F.col("series_id"), F.col("horizon"), F.col("issued_ms").cast("string")).alias("forecast_id"),
        *SERIES,
        "issued_ms",
        "horizon",
        (F.col("issued_ms") + hours.cast("long") * HOUR_MS).alias("target_ms"),
        F.when(F.col("direction") == "up", "close_above_entry").otherwise("close_below_entry").alias("target_rule"),
        "direction",
        "probability",
        "entry_price",
        F.lit("manual").alias("created_by"),
        F.lit("open").alias("status"),
    )


def shadow_forecast_row(preds: DataFrame) -> DataFrame:
    """Ledger rows from (series_id, model_id, horizon, p_up, entry_price, issued_ms, regime)."""
    p = F.when((F.col("p_up") > 0) & (F.col("p_up") < 1), F.col("p_up")).otherwise(S.clip(F.col("p_up"), 1e-4, 1 - 1e-4))
    up = p >= 0.5
    delta = F.lit(None).cast("long")
    for h, n in HORIZON_HOURS.items():
        delta = F.when(F.col("horizon") == h, n * HOUR_MS).otherwise(delta)
    regime = F.when(F.col("regime").isin(*REGIMES), F.col("regime")).otherwise("unknown")
    return preds.filter(F.col("model_id").startswith("shadow-")).select(
        forecast_id(F.col("series_id"), F.col("model_id"), F.col("horizon"), S.iso_utc(F.col("issued_ms"))).alias("forecast_id"),
        *SERIES,
        "issued_ms",
        "horizon",
        (F.col("issued_ms") + delta).alias("target_ms"),
        F.when(up, "close_above_entry").otherwise("close_below_entry").alias("target_rule"),
        F.when(up, "up").otherwise("down").alias("direction"),
        F.when(up, p).otherwise(F.lit(1.0) - p).alias("probability"),
        F.col("entry_price").cast("double").alias("entry_price"),
        F.col("model_id").alias("model_version"),
        regime.alias("regime_at_issue"),
        F.lit("open").alias("status"),
    )


# ── checks ───────────────────────────────────────────────────────────────────
def _reasons(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))


def validate_forecast(rows: DataFrame) -> DataFrame:
    """Add ``reasons``, the broken rules. Times are ISO text; a null field is a missing one."""
    issued, target = S.parse_iso_ms(F.col("issued_at")), S.parse_iso_ms(F.col("target_time"))
    missing = {f"missing:{f}": F.col(f).isNull() for f in FORECAST_FIELDS}
    return rows.withColumn(
        "reasons",
        _reasons(
            {
                **missing,
                "horizon": ~F.col("horizon").isin(*HORIZONS),
                "direction": ~F.col("direction").isin(*DIRECTIONS),
                "regime": ~F.col("regime_at_issue").isin(*REGIMES),
                "status": ~F.col("status").isin(*FORECAST_STATUSES),
                "probability": ~((F.col("probability") > 0) & (F.col("probability") < 1)),
                "entry_price": ~(F.col("entry_price") > 0),
                "target_time": ~(target > issued),
            }
        ),
    )


def validate_resolution(rows: DataFrame) -> DataFrame:
    missing = {f"missing:{f}": F.col(f).isNull() for f in RESOLUTION_FIELDS}
    return rows.withColumn(
        "reasons",
        _reasons(
            {
                **missing,
                "status": ~F.col("status").isin(*RESOLUTION_STATUSES),
                "actual_close": ~(F.col("actual_close") > 0),
                "direction_correct": F.lit(dict(rows.dtypes)["direction_correct"] != "boolean"),
            }
        ),
    )


def reject_resolution_fields(rows: DataFrame) -> DataFrame:
    """Add ``carried``: outcome fields a forecast row may not carry but does."""
    have = [f for f in OUTCOME_FIELDS if f in rows.columns]
    return rows.withColumn("carried", F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in have])))


def append_guard(new: DataFrame, existing_ids: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """Rows that may be appended: unseen id, and (for resolutions) a known forecast."""
    ok = new.join(existing_ids.select("forecast_id"), "forecast_id", "left_anti")
    return ok if known_ids is None else ok.join(known_ids.select("forecast_id"), "forecast_id", "left_semi")


# ── resolution ───────────────────────────────────────────────────────────────
def open_forecasts(forecasts: DataFrame, resolutions: DataFrame, now_ms: Column) -> DataFrame:
    due = forecasts.filter((F.col("status") != "superseded") & (F.col("target_ms") <= now_ms))
    return due.join(resolutions.select("forecast_id"), "forecast_id", "left_anti")


def probe_table(price_bars: DataFrame, now_ms: Column, by_source: bool) -> DataFrame:
    """Bars by the close second they may answer, one second of tolerance each way.

    The bars are copied to three seconds instead of the (far more) forecasts; the exact
    second wins over one below, that over one above.
    """
    keys = [*SERIES, *(["source"] if by_source else []), "target_s"]
    at = F.bround(F.col("close_time_ms") / 1000.0).cast("long")
    probes = F.array(
        F.struct(F.lit(0).alias("rank"), at.alias("target_s")),
        F.struct(F.lit(1).alias("rank"), (at + 1).alias("target_s")),
        F.struct(F.lit(2).alias("rank"), (at - 1).alias("target_s")),
    )
    bar = F.struct(
        F.col("close").alias("actual_close"),
        F.col("open_time_ms").alias("candle_open_ms"),
        F.col("close_time_ms").alias("candle_close_ms"),
        F.col("source").alias("price_source"),
    )
    return (
        price_bars.filter(F.col("close_time_ms") <= now_ms)
        .withColumn("bar", bar)
        .select(*SERIES, "source", "bar", F.inline(probes))
        .groupBy(*keys)
        .agg(F.min_by("bar", "rank").alias("bar"))
    )


def resolve_exact(forecasts: DataFrame, price_bars: DataFrame, now_ms: Column) -> DataFrame:
    """Forecasts with the bar that closes at their target; unmatched ones drop out."""
    probes = probe_table(price_bars, now_ms, by_source=False)
    target = F.bround(F.col("target_ms") / 1000.0).cast("long")
    due = forecasts.filter(F.col("target_ms") <= now_ms).withColumn("target_s", target)
    return due.join(probes, [*SERIES, "target_s"]).select(*forecasts.columns, "bar.*")


def resolve_venue_first(forecasts: DataFrame, venue_bars: DataFrame, now_ms: Column, chain=DEFAULT_CHAIN) -> DataFrame:
    """As ``resolve_exact``, taking the entry venue first, then the default chain.

    The candidates of one second are at most one per venue and travel as a small array.
    """
    probes = probe_table(venue_bars, now_ms, by_source=True)
    options = probes.groupBy(*SERIES, "target_s").agg(F.collect_list(F.struct("source", "bar")).alias("_options"))
    target = F.bround(F.col("target_ms") / 1000.0).cast("long")
    due = forecasts.filter(F.col("target_ms") <= now_ms).withColumn("target_s", target)
    venue = F.lower(F.trim("entry_source"))
    venue = F.when(venue.isin(*ENTRY_VENUES), venue)

    def pick(source: Column) -> Column:
        return F.get(F.filter("_options", lambda o: o["source"] == source), F.lit(0))["bar"]

    best = F.coalesce(pick(venue), *[pick(F.lit(c)) for c in chain])
    joined = due.join(options, [*SERIES, "target_s"]).withColumn("bar", best)
    return joined.filter(F.col("bar").isNotNull()).select(*forecasts.columns, "bar.*")


def score(matched: DataFrame, resolved_ms: Column) -> DataFrame:
    """Resolution rows of matched forecasts."""
    ret = S.actual_return(F.col("entry_price"), F.col("actual_close"))
    o = S.outcome(F.col("direction"), F.col("entry_price"), F.col("actual_close"))
    return matched.select(
        "forecast_id",
        resolved_ms.alias("resolved_ms"),
        "actual_close",
        ret.alias("actual_return"),
        (o == 1).alias("direction_correct"),
        S.brier_component(F.col("probability"), o).alias("brier_component"),
        S.logloss_component(F.col("probability"), o).alias("logloss_component"),
        F.lit("resolved").alias("status"),
        F.lit(RESOLVER_VERSION).alias("resolver_version"),
        "candle_open_ms",
        "candle_close_ms",
        "price_source",
        source_tag(F.col("price_source")).alias("resolution_source"),
    )


def source_tag(price_source: Column) -> Column:
    return F.substring_index(price_source, ":", 1)


RESOLVE_DELAY_MS = 5 * 60_000


def resolve_run(forecasts: DataFrame, resolutions: DataFrame, venue_bars: DataFrame, now_ms: Column) -> DataFrame:
    """New resolution rows of everything due; a forecast without a bar stays open."""
    due = open_forecasts(forecasts, resolutions, now_ms)
    return score(resolve_venue_first(due, venue_bars, now_ms), F.col("candle_close_ms") + RESOLVE_DELAY_MS)


def ledger_join(forecasts: DataFrame, resolutions: DataFrame, arrival: str | None = None) -> DataFrame:
    """Forecasts with their resolution (or nulls); the last of several resolutions counts."""
    res = resolutions
    if arrival:
        names = [c for c in res.columns if c not in ("forecast_id", arrival)]
        res = res.groupBy("forecast_id").agg(F.max_by(F.struct(*names), arrival).alias("r")).select("forecast_id", "r.*")
    return forecasts.drop("status").join(res, "forecast_id", "left")


def venue_match_audit(joined: DataFrame) -> DataFrame:
    return (
        joined.filter(F.col("status") == "resolved")
        .withColumn("resolution_venue", source_tag(F.col("price_source")))
        .groupBy("entry_source", "resolution_venue")
        .agg(F.count("*").alias("n"))
        .withColumn("venue_match", F.col("entry_source") == F.col("resolution_venue"))
    )
