"""Replayed ledger over the tick table, written once per query to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators import metrics as M
from tidemark.plans import inputs as I

ALL_MODELS = (L.BASELINE, L.POLICY, L.GUARD)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every forecast the three rule models issue over the hourly bars."""
    bars = I.hourly(spark, sf_dir)
    return I.derived(spark, sf_dir, "forecasts", lambda: L.issue_replay(bars, ALL_MODELS))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.issue_attempts(state(spark, sf_dir), ALL_MODELS)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = I.hourly(spark, sf_dir)
    return I.derived(spark, sf_dir, "signal_state", lambda: L.signal_state(bars))


def ledger_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, forecasts, resolutions)."""
    bars, fc = I.hourly(spark, sf_dir), forecasts(spark, sf_dir)
    matched = L.resolve_exact(fc, bars, I.now_ms(bars))
    return bars, fc, L.score(matched, F.col("candle_close_ms") + L.RESOLVE_DELAY_MS)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fc, res = ledger_parts(spark, sf_dir)
    return I.derived(spark, sf_dir, "joined", lambda: L.ledger_join(fc, res))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scored(joined(spark, sf_dir))


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as the reports read it: one row per bucket.

    Every bucket is first written twice, the second time later and with the opposite outcome,
    so that a report that counted rows instead of buckets would differ.
    """
    rows = joined(spark, sf_dir)
    twice = F.array(
        F.struct(F.lit(0).alias("_writer"), F.col("issued_at_actual_ms").alias("_actual"), F.col("direction_correct").alias("_right")),
        F.struct(F.lit(1).alias("_writer"), (F.col("issued_at_actual_ms") + 1000).alias("_actual"), (~F.col("direction_correct")).alias("_right")),
    )
    written = rows.select("*", F.inline(twice)).withColumns(
        {"issued_at_actual_ms": F.col("_actual"), "direction_correct": F.col("_right"), "file_pos": F.col("issued_ms") * 10 + F.col("_writer")}
    ).drop("_writer", "_actual", "_right")
    kept = lambda: M.dedupe_bucket(written).select(*rows.columns)
    return I.derived(spark, sf_dir, "deduped", kept)


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored, deduplicated ledger."""
    return M.scored(deduped(spark, sf_dir))


def contrarian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored ledger with every call turned round, for reports that need an edge."""
    flip = F.when(F.col("direction") == "up", "down").otherwise("up")
    turned = joined(spark, sf_dir).withColumn("direction", flip)
    right = L.S.outcome(F.col("direction"), F.col("entry_price"), F.col("actual_close")) == 1
    return M.scored(turned.withColumn("direction_correct", right))
