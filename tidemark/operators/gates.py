"""Signal gates, promotion gates and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import SERIES
from tidemark.operators.ledger import BASELINE, GUARD, POLICY

# Fixed values.
PREFERRED_MODELS = (GUARD, BASELINE, POLICY)
SIGNAL_GATES = {"min_n": 40, "min_wilson": 0.50, "r30_min_n": 20, "r30_min_hit": 0.52}
PROMOTION_GATES = {
    "min_resolved_total": 30,
    "min_resolved_per_horizon": 30,
    "min_shadow_days": 14,
    "max_brier": 0.245,
    "max_log_loss": 0.68,
    "max_ece": 0.08,
    "must_beat_baseline_brier": True,
    "min_baseline_brier_margin": 0.005,
    "no_severe_drift": True,
    "require_manual_approval": True,
    "must_have_out_of_sample": True,
    "min_oof_folds": 3,
    "regime_coverage_min": 2,
}
REGISTRY_STATUSES = ("active", "skipped", "paused")
REGISTRY_FIELDS = ("model_id", "kind", "horizon", "features_version", "trained_at", "shadow_status", "fixture_only")


def signal_pick(forecasts: DataFrame, horizons=("24h",)) -> DataFrame:
    """Per series the newest forecast of the best-ranked model that issued at all."""
    rank = F.lit(99)
    for i, m in reversed(list(enumerate(PREFERRED_MODELS))):
        rank = F.when(F.col("model_version") == m, i).otherwise(rank)
    row = F.struct(*[c for c in forecasts.columns if c not in SERIES])
    best = F.min_by(row, F.struct(rank, -F.col("issued_ms"), F.col("forecast_id")))
    return forecasts.filter(F.col("horizon").isin(*horizons)).groupBy(*SERIES).agg(best.alias("r")).select(*SERIES, "r.*")


def signal_gates(picked: DataFrame, all_time: DataFrame, rolling30: DataFrame, now_ms: Column) -> DataFrame:
    """Gate each picked forecast on the record of its own model and horizon.

    ``all_time`` / ``rolling30`` carry the metrics per (series, model, horizon).
    """
    keys = [*SERIES, "model_version", "horizon"]
    a = all_time.select(*keys, "n", "hit_rate", "wilson_lb_95", "vs_majority_pp", "expectancy_maker_2bps")
    r = rolling30.select(
        *keys, F.col("n").alias("r30_n"), F.col("hit_rate").alias("r30_hit"), F.col("expectancy_maker_2bps").alias("r30_maker")
    )
    j = picked.join(a, keys, "left").join(r, keys, "left")
    g = SIGNAL_GATES
    n, n30 = F.coalesce("n", F.lit(0)), F.coalesce("r30_n", F.lit(0))

    def fails(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    reasons = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), "bucket_missing"),
            F.when(n < g["min_n"], F.format_string("n_resolved %d < " + str(g["min_n"]), n)),
            F.when(fails(F.col("wilson_lb_95") > g["min_wilson"]), "wilson_lb_95"),
            F.when(n30 < g["r30_min_n"], F.format_string("rolling_30d_n %d < " + str(g["r30_min_n"]), n30)),
            F.when(fails(F.col("r30_hit") >= g["r30_min_hit"]), "rolling_30d_hit_rate"),
            F.when(fails(F.col("r30_maker") > 0), "rolling_30d_expectancy"),
            F.when(F.col("target_ms") <= now_ms, "expired"),
        )
    )
    return j.withColumn("reasons", reasons).withColumn(
        "status", F.when(F.size("reasons") == 0, "actionable_paper").otherwise("shadow")
    )


def signal_status(series: DataFrame, gated: DataFrame) -> DataFrame:
    """Every series with its signal status; ``halted`` when nothing was issued."""
    return series.select(*SERIES).distinct().join(gated, list(SERIES), "left").withColumn(
        "status", F.coalesce("status", F.lit("halted"))
    )


def promotion_gates(candidates: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Long table candidate x gate.

    Columns read: candidate_id, horizon, resolved_total, resolved_horizon, shadow_days,
    brier, log_loss, ece, best_baseline_brier, drift_alarms, n_folds, regimes_covered
    (null: gate left out), approved_by, approved_at.
    """
    g = {**PROMOTION_GATES, **(overrides or {})}

    def text(*parts):
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])

    def at_least(name, col, need):
        return name, F.col(col) >= need, text(f"{col}=", F.coalesce(F.col(col).cast("string"), F.lit("none")), f" need>={need}")

    def at_most(name, col, need, default=None):
        value = F.coalesce(F.col(col), F.lit(default)) if default is not None else F.col(col)
        shown = F.coalesce(F.format_string("%.4f", value), F.lit("none"))
        return name, value <= need, text(f"{col}=", F.when(value.isNull(), "none").otherwise(shown), f" need<={need}")

    checks = [
        at_least("resolved_total", "resolved_total", g["min_resolved_total"]),
        at_least("resolved_per_horizon", "resolved_horizon", g["min_resolved_per_horizon"]),
        at_least("shadow_days", "shadow_days", g["min_shadow_days"]),
        at_most("brier", "brier", g["max_brier"], 1.0),
        at_most("log_loss", "log_loss", g["max_log_loss"], 1.0),
        at_most("ece", "ece", g["max_ece"]),
    ]
    if g["must_beat_baseline_brier"]:
        margin = F.col("best_baseline_brier") - F.coalesce("brier", F.lit(1.0))
        checks.append(("beats_baseline_brier", margin >= g["min_baseline_brier_margin"], text("margin need>=", g["min_baseline_brier_margin"])))
    if g["no_severe_drift"]:
        checks.append(("no_severe_drift", F.col("drift_alarms") == 0, text("alarms=", F.col("drift_alarms"), " need=0")))
    if g["must_have_out_of_sample"]:
        checks.append(at_least("out_of_sample", "n_folds", g["min_oof_folds"]))
    checks.append(at_least("regime_coverage", "regimes_covered", g["regime_coverage_min"]))
    if g["require_manual_approval"]:
        given = (F.coalesce("approved_by", F.lit("")) != "") & (F.coalesce("approved_at", F.lit("")) != "")
        checks.append(("manual_approval", given, F.when(given, "approved").otherwise("not_yet_approved")))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("gate"),
                F.coalesce(ok, F.lit(False)).alias("passed"),
                F.coalesce(detail, F.lit("none")).alias("detail"),
            )
            for name, ok, detail in checks
        ]
    )
    long = candidates.select("candidate_id", "horizon", F.col("regimes_covered").alias("_cov"), F.inline(rows))
    return long.filter((F.col("gate") != "regime_coverage") | F.col("_cov").isNotNull()).drop("_cov")


def promotion_decision(gates: DataFrame) -> DataFrame:
    """Ready only when every gate passed; never promotes by itself."""
    return gates.groupBy("candidate_id", "horizon").agg(
        F.bool_and("passed").alias("ready_for_promotion"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))).alias("failing"),
    )


def validate_registry(entries: DataFrame) -> DataFrame:
    """Add ``reasons``: missing fields, id prefix, status, promotion date."""
    rules = {f"missing:{f}": F.col(f).isNull() for f in REGISTRY_FIELDS}
    rules["model_id"] = ~F.col("model_id").startswith("shadow-")
    rules["shadow_status"] = ~F.col("shadow_status").isin(*REGISTRY_STATUSES)
    rules["promoted_at"] = F.coalesce(F.col("promoted_at") != "", F.lit(False))
    found = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    return entries.withColumn("reasons", F.array_compact(F.array(*found)))


def registry_upsert(registry: DataFrame, entries: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Replace by model id, else append: the entry with the largest arrival number stays."""
    both = registry.unionByName(entries)
    row = F.struct(*[c for c in both.columns if c != "model_id"])
    return both.groupBy("model_id").agg(F.max_by(row, arrival).alias("r")).select("model_id", "r.*")
