"""Feeds: provider choice, completeness, source health, freshness, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CORE_FIELDS = ("funding_rate", "open_interest_btc")
RICH_FIELDS = ("mark_price", "long_short_ratio", "long_account_pct", "short_account_pct")
DERIVATIVE_FIELDS = ("funding_rate", "next_funding_time_ms", "mark_price", "open_interest_btc", "long_short_ratio", "long_account_pct", "short_account_pct")
BUDGET_S = {
    "candles_1m": 2700,
    "candles_5m": 2700,
    "candles_15m": 3600,
    "candles_1h": 5400,
    "candles_4h": 18000,
    "candles_1d": 93600,
    "derivatives": 1800,
    "sentiment": 86400,
}
SCHEMA_VERSION = "phase2-data-v1"


def classify_completeness() -> Column:
    """A missing core field degrades, a missing rich field makes it partial."""
    def lacks(fields):
        out = F.lit(False)
        for f in fields:
            out = out | F.col(f).isNull()
        return out

    return F.when(lacks(CORE_FIELDS), "degraded").when(lacks(RICH_FIELDS), "partial_ok").otherwise("ok")


def missing_note() -> Column:
    names = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in DERIVATIVE_FIELDS]))
    return F.when(F.size(names) > 0, F.concat(F.lit("missing:"), F.concat_ws(",", names)))


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """One attempt per provider in a run (the last), so a run holds few rows."""
    row = F.struct(*[c for c in attempts.columns if c not in ("kind", "run_id", "source")])
    return (
        attempts.groupBy("kind", "run_id", "source").agg(F.max_by(row, F.struct("fetched_us", "attempt_id")).alias("r")).select("kind", "run_id", "source", "r.*")
    )


def provider_select(attempts: DataFrame) -> DataFrame:
    """Chosen attempt per (kind, run): first ok by priority, else partial_ok, else degraded
    with data; otherwise a synthetic failed row naming what was tried.

    ``attempts``: kind, run_id, source, priority, status, data, fetched_us; one row per
    provider and run (``latest_attempts``).
    """
    tier = (
        F.when(F.col("status") == "ok", 0)
        .when(F.col("status") == "partial_ok", 1)
        .when((F.col("status") == "degraded") & F.col("data").isNotNull(), 2)
    )
    order = F.when(tier.isNotNull(), F.struct(tier.alias("tier"), F.col("priority").alias("p")))
    took = F.struct("source", "status", "data")
    tried = F.array_sort(F.collect_list(F.struct("priority", "source", "status")))
    agg = attempts.groupBy("kind", "run_id").agg(
        F.min_by(took, order).alias("best"), F.max_by("source", "priority").alias("last_source"), tried.alias("tried")
    )
    ok = F.col("best").isNotNull()
    labels = F.transform("tried", lambda a: F.concat_ws(":", a["source"], a["status"]))
    return agg.select(
        "kind",
        "run_id",
        F.when(ok, F.col("best.source")).otherwise(F.col("last_source")).alias("source"),
        F.when(ok, F.col("best.status")).otherwise("failed").alias("status"),
        F.when(ok, F.col("best.data")).alias("data"),
        F.when(~ok, "all providers failed").alias("error"),
        F.when(~ok, labels).otherwise(F.array().cast("array<string>")).alias("notes"),
    )


def snapshot_envelope(chosen: DataFrame, attempts: DataFrame) -> DataFrame:
    """Artifact row: the chosen result plus all attempts of the run in priority order."""
    tried = attempts.groupBy("kind", "run_id").agg(
        F.max("fetched_us").alias("fetched_us"),
        F.array_sort(F.collect_list(F.struct("priority", "source", "status", "latency_ms"))).alias("attempts"),
    )
    return chosen.join(tried, ["kind", "run_id"]).select(F.lit(SCHEMA_VERSION).alias("schema_version"), "*")


def source_health(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Overall status: failed over degraded over partial_ok/stale over ok."""
    code = (
        F.when(F.col("status") == "failed", 3).when(F.col("status") == "degraded", 2).when(F.col("status").isin("partial_ok", "stale"), 1).otherwise(0)
    )
    worst = F.max(code)
    overall = F.when(worst == 3, "failed").when(worst == 2, "degraded").when(worst == 1, "partial_ok").otherwise("ok")
    return parts.groupBy(*by).agg(overall.alias("overall"), F.count("*").alias("n_sources"))


def freshness_check(latest: DataFrame, now_ms: Column) -> DataFrame:
    """Age of each kind against its budget; (kind, fetched_ms) -> age_s, stale."""
    budget = F.lit(None).cast("long")
    for kind, s in BUDGET_S.items():
        budget = F.when(F.col("kind") == kind, s).otherwise(budget)
    age = (now_ms - F.col("fetched_ms")) / 1000.0
    return latest.withColumn("age_s", age).withColumn("budget_s", budget.cast("long")).withColumn("stale", F.col("age_s") > F.col("budget_s"))
