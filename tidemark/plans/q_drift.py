"""Drift queries: error streams are the log-loss components of the ledger, features are bar prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import drift as R
from tidemark.operators.blocks import with_row_index
from tidemark.operators.metrics import TAPE_KEYS
from tidemark.plans import inputs as I
from tidemark.plans import ledger_data as D
from tidemark.plans.oracle import cte, r, sql
from tidemark.plans.registry import query, report

_c = F.col
# Thresholds small enough that the detectors fire on the test streams.
PH_CONFIG = {"threshold": 0.05, "alpha": 1e-4}
EWMA_CONFIG = {"k_sigma": 0.5}
ONE = ("series_id",)


def errors(spark, d):
    """Log-loss components per (series, model, horizon) in issue order."""
    rows = D.scored(spark, d).select(*TAPE_KEYS, "issued_ms", "forecast_id", _c("logloss_component").alias("x"))
    return I.derived(spark, d, "error_stream", lambda: with_row_index(rows, TAPE_KEYS, ("issued_ms", "forecast_id")))


def prices(spark, d):
    return I.hourly(spark, d).select("series_id", "row_idx", _c("close").alias("x"))


cte("q_err", """
SELECT series_id, model_version, horizon, issued_ms, logloss_component AS x, row_number() OVER k AS row_idx
FROM q_resolved WINDOW k AS (PARTITION BY series_id, model_version, horizon ORDER BY issued_ms, forecast_id)
""")
_K = "PARTITION BY series_id, model_version, horizon ORDER BY row_idx"
cte("q_ph", f"""
SELECT *, least(0.0, min(cum) OVER (w ROWS UNBOUNDED PRECEDING)) AS lo, greatest(0.0, max(cum) OVER (w ROWS UNBOUNDED PRECEDING)) AS hi FROM (
SELECT *, sum(x - mean - 1e-4) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM (
SELECT *, avg(x) OVER (w ROWS UNBOUNDED PRECEDING) AS mean FROM q_err WINDOW w AS ({_K})) a WINDOW w AS ({_K})) b WINDOW w AS ({_K})
""")
cte("q_ph_alarm", "SELECT *, row_idx >= 30 AND (cum - lo > 0.05 OR hi - cum > 0.05) AS alarm FROM q_ph")
cte("q_ew", """
SELECT series_id, model_version, horizon, row_idx, x AS fast, x AS slow, CAST(0.0 AS DOUBLE) AS var FROM q_err WHERE row_idx = 1
UNION ALL
SELECT e.series_id, e.model_version, e.horizon, e.row_idx, 0.1 * e.x + 0.9 * p.fast, 0.005 * e.x + 0.995 * p.slow, 0.1 * (e.x - p.fast) * (e.x - p.fast) + 0.9 * p.var
FROM q_ew p JOIN q_err e ON e.series_id = p.series_id AND e.model_version = p.model_version AND e.horizon = p.horizon AND e.row_idx = p.row_idx + 1
""")
cte("q_ew_alarm", "SELECT *, row_idx >= 30 AND var > 0 AND abs(fast - slow) > 0.5 * sqrt(var) AS alarm FROM q_ew")
# Values of both windows are ranked by (value, window); the gap after each is compared.
cte("q_ks", """
SELECT series_id, row_idx, r, max(abs(seen_ref / 200.0 - seen_rec / CAST(r AS DOUBLE))) AS d FROM (
SELECT a.series_id, a.row_idx, a.r, sum(CAST(NOT is_rec AS INTEGER)) OVER w AS seen_ref, sum(CAST(is_rec AS INTEGER)) OVER w AS seen_rec
FROM (SELECT a.series_id, a.row_idx, a.r, b.close AS v, b.row_idx > a.row_idx - a.r AS is_rec
      FROM (SELECT series_id, row_idx, least(row_idx - 200, 50) AS r FROM q_bars WHERE row_idx >= 230) a
      JOIN q_bars b ON b.series_id = a.series_id AND b.row_idx > a.row_idx - a.r - 200 AND b.row_idx <= a.row_idx) a
WINDOW w AS (PARTITION BY a.series_id, a.row_idx ORDER BY v, is_rec ROWS UNBOUNDED PRECEDING)) x
WHERE seen_ref <= 200 GROUP BY 1, 2, 3
""")
cte("q_ks_alarm", "SELECT *, d > 1.628 * sqrt((200.0 + r) / (200.0 * r)) AS alarm FROM q_ks")
_NAMES = "series_id, model_version, horizon, row_idx"


@query("page_hinkley", sql(f"SELECT {_NAMES}, {r('mean', 'ph_mean', 6)}, {r('cum', 'ph_cum', 6)}, {r('lo', 'ph_min', 6)}, {r('hi', 'ph_max', 6)}, alarm AS ph_alarm FROM q_ph_alarm"))
def page_hinkley(spark, d):
    out = R.page_hinkley(errors(spark, d), TAPE_KEYS, **PH_CONFIG)
    return report(out.select(*TAPE_KEYS, "row_idx", "ph_mean", "ph_cum", "ph_min", "ph_max", "ph_alarm"))


@query("ewma_drift", sql(f"SELECT {_NAMES}, {r('fast', 'fast_ewma', 8)}, {r('slow', 'slow_mean', 8)}, {r('var', 'ewma_var', 8)}, alarm AS ewma_alarm FROM q_ew_alarm"))
def ewma_drift(spark, d):
    out = R.ewma_drift(errors(spark, d), TAPE_KEYS, **EWMA_CONFIG)
    return report(out.select(*TAPE_KEYS, "row_idx", "fast_ewma", "slow_mean", "ewma_var", "ewma_alarm"), 8)


@query("ks_window", sql(f"SELECT series_id, row_idx, {r('d', 'ks_d')}, alarm AS ks_alarm FROM q_ks_alarm"))
def ks_window(spark, d):
    out = R.ks_window(prices(spark, d), ONE)
    return report(out.filter("ks_recent_n >= 30").select("series_id", "row_idx", "ks_d", "ks_alarm"))


def _streams(spark, d):
    """Error streams of every model and horizon, and the price stream of every series."""
    price = [F.lit("price").alias("model_version"), F.lit("1h").alias("horizon")]
    return errors(spark, d).select(*TAPE_KEYS, "row_idx", "x"), prices(spark, d).select("*", *price)


_SNAP = """
SELECT series_id, model_version, horizon, '{0}' AS detector, max(row_idx) AS n, count(*) FILTER (alarm) AS alarm_count, max(row_idx) FILTER (alarm) AS last_alarm_at, min(row_idx) FILTER (alarm) AS first_alarm_at
FROM {1} GROUP BY series_id, model_version, horizon"""
cte("q_snaps", _SNAP.format("page_hinkley", "q_ph_alarm") + " UNION ALL " + _SNAP.format("ewma", "q_ew_alarm")
    + " UNION ALL " + _SNAP.format("kswin", "(SELECT b.series_id, 'price' AS model_version, '1h' AS horizon, b.row_idx, coalesce(k.alarm, false) AS alarm FROM q_bars b LEFT JOIN q_ks_alarm k ON k.series_id = b.series_id AND k.row_idx = b.row_idx) s"))


@query("drift_run", sql("SELECT * FROM q_snaps"))
def drift_run(spark, d):
    err, feat = _streams(spark, d)
    return R.drift_run(err, feat, TAPE_KEYS, PH_CONFIG, EWMA_CONFIG).drop("state")


@query("drift_alarms", sql("""
SELECT series_id, model_version, horizon, 'page_hinkley' AS detector, row_idx - 1 AS alarm_at FROM q_ph_alarm WHERE alarm
UNION ALL SELECT series_id, model_version, horizon, 'ewma', row_idx - 1 FROM q_ew_alarm WHERE alarm
UNION ALL SELECT series_id, 'price', '1h', 'kswin', row_idx - 1 FROM q_ks_alarm WHERE alarm"""))
def drift_alarms(spark, d):
    err, feat = _streams(spark, d)
    parts = (
        R.alarm_positions(TAPE_KEYS, R.page_hinkley(err, TAPE_KEYS, **PH_CONFIG), "page_hinkley"),
        R.alarm_positions(TAPE_KEYS, R.ewma_drift(err, TAPE_KEYS, **EWMA_CONFIG), "ewma"),
        R.alarm_positions(TAPE_KEYS, R.ks_window(feat, TAPE_KEYS), "kswin"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


cte("q_up", """
SELECT series_id, regime, CASE WHEN direction = 'up' THEN p ELSE 1 - p END AS p_up, CAST(actual_return > 0 AS INTEGER) AS y FROM q_resolved
""")


def _p_up(spark, d):
    p = F.when(_c("direction") == "up", _c("p")).otherwise(1 - _c("p"))
    return D.scored(spark, d).select("series_id", "regime", p.alias("p_up"), (_c("actual_return") > 0).cast("int").alias("y"))


@query("per_regime_metrics", sql(f"""
SELECT series_id, regime, count(*) AS n, {r('avg(CAST(CAST(p_up >= 0.5 AS INTEGER) = y AS INTEGER))', 'hit_rate')}, {r('avg((p_up - y) * (p_up - y))', 'brier')}, {r('avg(y)', 'base_rate')} FROM q_up GROUP BY 1, 2"""))
def per_regime_metrics(spark, d):
    return report(R.per_regime_metrics(_p_up(spark, d), ("series_id",)))


@query("retrain_candidate", sql(f"""
SELECT t.series_id, t.triggers, t.sample_size, t.alarms, m.regime, m.n, m.brier FROM (
SELECT series_id, coalesce(string_agg(DISTINCT detector, ',' ORDER BY detector) FILTER (alarm_count > 0), '') AS triggers, max(n) AS sample_size, CAST(sum(alarm_count) AS BIGINT) AS alarms FROM q_snaps GROUP BY 1) t
JOIN (SELECT series_id, regime, count(*) AS n, {r('avg((p_up - y) * (p_up - y))', 'brier')} FROM q_up GROUP BY 1, 2) m USING (series_id)"""))
def retrain_candidate(spark, d):
    err, feat = _streams(spark, d)
    snaps = R.drift_run(err, feat, TAPE_KEYS, PH_CONFIG, EWMA_CONFIG)
    regimes = R.per_regime_metrics(_p_up(spark, d), ONE).select("series_id", "regime", "n", "brier")
    out = R.retrain_candidate(snaps, ONE, regimes)
    return report(out.withColumn("triggers", F.concat_ws(",", "triggers")))
