"""Queries over ledger traffic: checks, guards, resolution by venue, manual and shadow rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import ledger as L
from tidemark.plans import inputs as I
from tidemark.plans import ledger_data as D
from tidemark.plans.oracle import cte, r, sql
from tidemark.plans.registry import query, report

_c = F.col


def _hour():
    return S.hour_utc(F.col("issued_ms"))


cte("q_fh", "SELECT *, CAST((issued_ms // 3600000) % 24 AS INTEGER) AS hr FROM q_forecasts")


@query("validate_forecast", sql("""
SELECT forecast_id, concat_ws(',', CASE WHEN hr = 7 THEN 'missing:created_by' END, CASE WHEN probability > 0.54 THEN 'horizon' END, CASE WHEN hr = 2 THEN 'direction' END,
  CASE WHEN hr = 6 THEN 'regime' END, CASE WHEN hr = 5 THEN 'status' END, CASE WHEN horizon = '4h' THEN 'probability' END, CASE WHEN hr = 3 THEN 'entry_price' END,
  CASE WHEN hr = 4 THEN 'target_time' END) AS reasons FROM q_fh"""))
def validate_forecast(spark, d):
    iso = S.iso_utc(_c("issued_ms"))
    rows = D.forecasts(spark, d).select(
        "forecast_id",
        iso.alias("issued_at"),
        _c("series_id").alias("asset"),
        F.when(_c("probability") > 0.54, "9h").otherwise(_c("horizon")).alias("horizon"),
        F.when(_hour() == 4, iso).otherwise(S.iso_utc(_c("target_ms"))).alias("target_time"),
        "target_rule",
        F.when(_hour() == 2, "flat").otherwise(_c("direction")).alias("direction"),
        F.when(_c("horizon") == "4h", 1.0).otherwise(_c("probability")).alias("probability"),
        F.when(_hour() == 3, -_c("entry_price")).otherwise(_c("entry_price")).alias("entry_price"),
        "model_version",
        "signal_version",
        F.when(_hour() == 6, "boom").otherwise(_c("regime_at_issue")).alias("regime_at_issue"),
        "feature_snapshot_uri",
        "source_snapshot_uri",
        "confidence_reason",
        "invalidation",
        F.when(_hour() != 7, _c("created_by")).alias("created_by"),
        F.when(_hour() == 5, "closed").otherwise(_c("status")).alias("status"),
    )
    return L.validate_forecast(rows).select("forecast_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("validate_resolution", sql("""
SELECT forecast_id, concat_ws(',', CASE WHEN direction_correct AND signed > 0.01 THEN 'missing:price_source' END, CASE WHEN signed < -0.01 THEN 'status' END,
  CASE WHEN signed BETWEEN -0.001 AND 0.001 THEN 'actual_close' END) AS reasons FROM q_resolved"""))
def validate_resolution(spark, d):
    signed = _c("signed")
    rows = D.M.scored(D.joined(spark, d)).select(
        "forecast_id",
        S.iso_utc(_c("resolved_ms")).alias("resolved_at"),
        F.when((signed >= -0.001) & (signed <= 0.001), 0.0).otherwise(_c("actual_close")).alias("actual_close"),
        "actual_return",
        "direction_correct",
        "brier_component",
        "logloss_component",
        F.when(signed < -0.01, "done").otherwise(_c("status")).alias("status"),
        "resolver_version",
        S.iso_utc(_c("candle_open_ms")).alias("candle_open_time"),
        S.iso_utc(_c("candle_close_ms")).alias("candle_close_time"),
        F.when(~(_c("direction_correct") & (signed > 0.01)), _c("price_source")).alias("price_source"),
    )
    return L.validate_resolution(rows).select("forecast_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("reject_resolution_fields", sql("""
SELECT forecast_id, CASE WHEN status = 'resolved' THEN 'resolved_at,actual_close,actual_return,direction_correct,brier_component,logloss_component' ELSE '' END AS carried FROM q_joined"""))
def reject_resolution_fields(spark, d):
    rows = D.joined(spark, d).withColumnRenamed("resolved_ms", "resolved_at")
    return L.reject_resolution_fields(rows).select("forecast_id", F.concat_ws(",", "carried").alias("carried"))


@query("open_forecasts", sql("""
SELECT forecast_id, horizon, model_version FROM q_forecasts
WHERE target_ms <= (SELECT max(close_time_ms) FROM q_bars) AND model_version <> 'v0.2.0-shadow-policy24'
  AND forecast_id NOT IN (SELECT forecast_id FROM q_score WHERE horizon IN ('1h', '4h'))"""))
def open_forecasts(spark, d):
    bars, fc, res = D.ledger_parts(spark, d)
    retired = F.when(_c("model_version") == L.POLICY, "superseded").otherwise(_c("status"))
    short = fc.filter(_c("horizon").isin("1h", "4h")).select("forecast_id")
    done = res.join(short, "forecast_id", "left_semi")
    out = L.open_forecasts(fc.withColumn("status", retired), done, I.now_ms(bars))
    return out.select("forecast_id", "horizon", "model_version")


@query("append_guard", sql("""
SELECT forecast_id FROM q_score WHERE horizon <> '1h' AND model_version <> 'v0.2.0-shadow-policy24'"""))
def append_guard(spark, d):
    _, fc, res = D.ledger_parts(spark, d)
    stored = fc.filter("horizon = '1h'")
    known = fc.filter(_c("model_version") != L.POLICY)
    return L.append_guard(res, stored, known).select("forecast_id")


@query("issue_dedupe", sql("""
SELECT forecast_id FROM q_forecasts WHERE NOT (model_version = 'v0.1.0-baseline-shadow' AND regime_at_issue = 'bull')"""))
def issue_dedupe(spark, d):
    fc = D.forecasts(spark, d)
    stored = fc.filter((_c("model_version") == L.BASELINE) & (_c("regime_at_issue") == "bull"))
    return L.issue_dedupe(fc, stored).select("forecast_id")


@query("issue_summary", sql("""
SELECT model_version, horizon, coalesce(skipped, 'issued') AS result, count(*) AS n FROM q_tried GROUP BY 1, 2, 3"""))
def issue_summary(spark, d):
    """Runs issued and filtered per model, horizon and cause."""
    return D.attempts(spark, d).groupBy("model_version", "horizon", F.coalesce("skipped", F.lit("issued")).alias("result")).agg(F.count("*").alias("n"))


cte("q_venue_match", """
SELECT f.*, coalesce(a.source, b.source, g.source, k.source) AS price_source,
       CASE WHEN a.source IS NOT NULL THEN a.close WHEN b.source IS NOT NULL THEN b.close WHEN g.source IS NOT NULL THEN g.close ELSE k.close END AS actual_close,
       coalesce(a.close_time_ms, b.close_time_ms, g.close_time_ms, k.close_time_ms) AS candle_close_ms
FROM q_forecasts f LEFT JOIN q_venue_bars a ON a.series_id = f.series_id AND a.close_time_ms = f.target_ms AND a.source = f.entry_source
LEFT JOIN q_venue_bars b ON b.series_id = f.series_id AND b.close_time_ms = f.target_ms AND b.source = 'binance'
LEFT JOIN (SELECT series_id, close_time_ms, close + 1 AS close, 'coingecko' AS source FROM q_venue_bars WHERE source = 'kraken' AND open_time_ms // 3600000 % 3 = 0) g
  ON g.series_id = f.series_id AND g.close_time_ms = f.target_ms
LEFT JOIN q_venue_bars k ON k.series_id = f.series_id AND k.close_time_ms = f.target_ms AND k.source = 'kraken'
WHERE coalesce(a.source, b.source, g.source, k.source) IS NOT NULL
""")


def _chain_bars(spark, d):
    """Bars of every member of the chain; the price index quotes every third hour."""
    venue = I.venue_bars(spark, d)
    third = F.pmod(F.floor(F.col("open_time_ms") / 3_600_000), F.lit(3)) == 0
    index = venue.filter((F.col("source") == "kraken") & third).withColumns({"source": F.lit("coingecko"), "close": F.col("close") + 1})
    return venue.unionByName(index)


@query("resolve_venue_first", sql(f"SELECT forecast_id, price_source, candle_close_ms, {r('actual_close', 'actual_close')} FROM q_venue_match"))
def resolve_venue_first(spark, d):
    venue = _chain_bars(spark, d)
    out = L.resolve_venue_first(D.forecasts(spark, d), venue, I.now_ms(venue))
    return report(out.select("forecast_id", "price_source", "candle_close_ms", "actual_close"))


@query("resolve_run", sql(f"""
SELECT forecast_id, price_source AS resolution_source, {r('(actual_close - entry_price) / entry_price', 'actual_return', 9)}, actual_close <> entry_price AND (direction = 'up') = (actual_close > entry_price) AS direction_correct,
       candle_close_ms + 300000 AS resolved_ms FROM q_venue_match WHERE horizon <> '1h'"""))
def resolve_run(spark, d):
    fc, venue = D.forecasts(spark, d), _chain_bars(spark, d)
    done = fc.filter("horizon = '1h'").select("forecast_id")
    out = L.resolve_run(fc, done, venue, I.now_ms(venue))
    return report(out.select("forecast_id", "resolution_source", "actual_return", "direction_correct", "resolved_ms"), 9)


@query("venue_match_audit", sql("""
SELECT entry_source, price_source AS resolution_venue, count(*) AS n, entry_source = price_source AS venue_match FROM q_venue_match GROUP BY 1, 2"""))
def venue_match_audit(spark, d):
    fc, venue = D.forecasts(spark, d), _chain_bars(spark, d)
    tagged = venue.withColumn("source", F.col("source"))
    res = L.score(L.resolve_venue_first(fc, tagged, I.now_ms(venue)), _c("candle_close_ms"))
    return L.venue_match_audit(L.ledger_join(fc, res))


@query("manual_issue", sql("""
SELECT series_id, horizon, issued_ms, issued_ms + h * 3600000 AS target_ms, CASE WHEN up THEN 'close_above_entry' ELSE 'close_below_entry' END AS target_rule,
       sha256('manual|' || series_id || '|' || horizon || '|' || issued_ms) AS forecast_id, round(p, 6) + 0.0 AS probability FROM (
SELECT o_orderpriority AS series_id, CASE o_orderstatus WHEN 'P' THEN '1h' WHEN 'F' THEN '1d' ELSE '7d' END AS horizon, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 24 ELSE 168 END AS h,
       epoch_ms(o_orderdate) AS issued_ms, o_totalprice > 200000 AS up, o_totalprice / 1000000 AS p FROM orders) x"""))
def manual_issue(spark, d):
    o = I.table(spark, d, "orders")
    rows = o.select(
        _c("o_orderpriority").alias("series_id"),
        F.when(_c("o_orderstatus") == "P", "1h").when(_c("o_orderstatus") == "F", "1d").otherwise("7d").alias("horizon"),
        F.unix_millis(_c("o_orderdate").cast("timestamp")).alias("issued_ms"),
        F.when(_c("o_totalprice") > 200000, "up").otherwise("down").alias("direction"),
        (_c("o_totalprice") / 1000000).alias("probability"),
        _c("o_totalprice").alias("entry_price"),
    )
    return report(L.manual_issue(rows).select("series_id", "horizon", "issued_ms", "target_ms", "target_rule", "forecast_id", "probability"))


@query("shadow_forecast_row", sql(f"""
SELECT series_id, issued_ms, target_ms, horizon, direction, {r("CASE WHEN direction = 'up' THEN p ELSE 1 - p END", 'probability', 9)}, {r('close', 'entry_price')}, regime AS regime_at_issue,
       sha256(series_id || '|shadow-rule-4h|4h|' || strftime(make_timestamp(issued_ms * 1000), '%Y-%m-%dT%H:%M:%SZ')) AS forecast_id FROM (
SELECT *, close_time_ms AS issued_ms, close_time_ms + 14400000 AS target_ms, '4h' AS horizon, CASE WHEN p >= 0.5 THEN 'up' ELSE 'down' END AS direction FROM (
SELECT *, greatest(1e-4, least(1 - 1e-4, (close - 10000) / 100)) AS p FROM q_state) x) y"""))
def shadow_forecast_row(spark, d):
    preds = D.state(spark, d).select(
        "series_id", F.lit("shadow-rule-4h").alias("model_id"), F.lit("4h").alias("horizon"), ((_c("close") - 10000) / 100).alias("p_up"),
        _c("close").alias("entry_price"), _c("close_time_ms").alias("issued_ms"), "regime",
    )
    out = L.shadow_forecast_row(preds)
    return report(out.select("series_id", "issued_ms", "target_ms", "horizon", "direction", "probability", "entry_price", "regime_at_issue", "forecast_id"), 9)
