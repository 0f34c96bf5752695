"""Slice hunt, signal choice and gates over the replayed ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gates as G
from tidemark.operators import metrics as M
from tidemark.operators import slices as H
from tidemark.plans import inputs as I
from tidemark.plans import ledger_data as D
from tidemark.plans.oracle import BASE_AGGS, cte, finish, r, sql, wilson
from tidemark.plans.registry import query, report

cte("q_rel", """
SELECT *, TRY_CAST(nullif(regexp_extract(confidence_reason, 'rel=([0-9.]+)', 1), '') AS DOUBLE) AS rel,
       CAST((issued_ms // 3600000) % 24 AS INTEGER) AS hr, (issued_ms // 86400000 + 3) % 7 AS dow FROM q_resolved
""")
cte("q_turned", """
SELECT * REPLACE (CASE direction WHEN 'up' THEN 'down' ELSE 'up' END AS direction, CASE WHEN actual_close = entry_price THEN 0 ELSE 1 - o END AS o, -signed AS signed) FROM q_banded
""")
cte("q_banded", """
SELECT *, CASE WHEN rel < 0.001 THEN 'rel<0.1%' WHEN rel < 0.003 THEN 'rel_0.1-0.3%' WHEN rel < 0.005 THEN 'rel_0.3-0.5%' WHEN rel < 0.01 THEN 'rel_0.5-1%'
               WHEN rel IS NOT NULL THEN 'rel>=1%' END AS band, printf('%02d', hr) AS hh FROM q_rel
""")
cte("q_slices", """
SELECT unnest(list_filter([
  'horizon=' || horizon, 'horizon=' || horizon || '|dir=' || direction, 'horizon=' || horizon || '|regime=' || regime,
  'model=' || model_version || '|horizon=' || horizon, 'dir=' || direction, 'regime=' || regime, 'hour_utc=' || hh, 'dow=' || dow,
  'horizon=' || horizon || '|hour_utc=' || hh, 'horizon=' || horizon || '|dow=' || dow, 'sma_' || band, 'horizon=' || horizon || '|sma_' || band,
  CASE WHEN horizon IN ('12h', '24h') THEN 'policy:h12_24_only' END, CASE WHEN horizon IN ('12h', '24h') AND hr <> 20 THEN 'policy:h12_24_skip_hour20' END,
  CASE WHEN horizon IN ('12h', '24h') AND rel < 0.005 THEN 'policy:h12_24_mild_rel' END], lambda x: x IS NOT NULL)) AS slice, ledger, o, signed, actual_return
FROM (SELECT 'turned' AS ledger, * FROM q_turned UNION ALL SELECT 'plain', * FROM q_banded) x
""")
cte("q_both_ranked", f"""
SELECT *, ex * 10000 - 2 + 50 * lift + 10 * lower_b AS score FROM (
SELECT *, greatest(0.0, {wilson('hit', 'n')}) AS lower_b, hit - greatest(up, 1 - up) AS lift, greatest(up, 1 - up) AS maj
FROM (SELECT ledger, slice, count(*) AS n, avg(o) AS hit, avg(signed) AS ex, avg(CAST(actual_return > 0 AS INTEGER)) AS up FROM q_slices GROUP BY 1, 2) a
WHERE n >= CASE WHEN slice LIKE '%hour_utc=%' OR slice LIKE '%dow=%' THEN 12 ELSE 20 END) b
WHERE ex * 10000 - 2 > 0 OR lift > 0
""")
cte("q_ranked", "SELECT * EXCLUDE (ledger) FROM q_both_ranked WHERE ledger = 'turned'")
cte("q_tradeable", "SELECT * FROM q_ranked WHERE n >= 20 AND ex * 10000 - 2 > 0 AND lift > 0")


@query("rel_parse", sql("SELECT forecast_id, rel, band FROM q_banded"))
def rel_parse(spark, d):
    rel = H.rel_parse(F.col("confidence_reason"))
    return D.scored(spark, d).select("forecast_id", rel.alias("rel"), H.rel_band(rel).alias("band"))


@query("slice_hunt", sql(f"""
SELECT ledger, slice, n, {r('hit', 'hit_rate')}, {r('lower_b', 'wilson_lb_95')}, {r('lift', 'vs_majority_pp')}, {r('ex * 10000', 'expectancy_bps')},
       {r('ex * 10000 - 2', 'expectancy_maker_2bps')}, {r('maj', 'majority_rate')}, {r('score', 'score')} FROM q_both_ranked"""))
def slice_hunt(spark, d):
    """Slices of the ledger as it is, and of the one with every call turned round."""
    cols = ["confidence_reason", "issued_ms", "horizon", "direction", "regime", "model_version", "o", "signed", "actual_return"]
    plain, turned = (rows.select(F.lit(n).alias("ledger"), *cols) for n, rows in (("plain", D.scored(spark, d)), ("turned", D.contrarian(spark, d))))
    return report(H.slice_hunt(plain.unionByName(turned), ("ledger",)))


# The reflected CRC-32 of an ASCII text: a number over 255 brings in a byte, a zero shifts a bit.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[256::BIGINT + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0] for c in string_split(slice, '')])),
  lambda c, e: CASE WHEN e > 255 THEN xor(c, e - 256) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""
_COLS = f"slice, n, {r('hit', 'hit_rate')}, {r('ex * 10000 - 2', 'expectancy_maker_2bps')}, {r('lift', 'vs_majority_pp')}, {r('score', 'score')}"


@query("hunt_report", sql(f"""
SELECT *, NULL AS experiment_id, NULL AS hypothesis FROM (SELECT 'top_tradeable' AS section, * FROM (SELECT {_COLS} FROM q_tradeable ORDER BY q_tradeable.score DESC, slice LIMIT 25) a
UNION ALL SELECT 'best', * FROM (SELECT {_COLS} FROM q_ranked ORDER BY (n >= 20 AND ex * 10000 - 2 > 0 AND lift > 0) DESC, q_ranked.score DESC, slice LIMIT 1) e
UNION ALL SELECT 'top_exploratory', * FROM (SELECT {_COLS} FROM q_ranked ORDER BY q_ranked.score DESC, slice LIMIT 40) b
UNION ALL SELECT 'improvement_target', * FROM (SELECT {_COLS} FROM q_ranked WHERE slice = 'horizon=24h') c) plain
UNION ALL SELECT 'next_experiments', *, 'auto-' || lpad(CAST({CRC} % 10000000 AS VARCHAR), 7, '0'), 'slice ' || slice || ' keeps a positive expectancy beyond n=' || n FROM (SELECT {_COLS} FROM q_tradeable ORDER BY q_tradeable.score DESC, slice LIMIT 8) d2
  WHERE NOT (slice LIKE 'horizon=%' AND slice NOT LIKE '%|%')"""))
def hunt_report(spark, d):
    return report(H.hunt_report(I.settle(H.slice_hunt(D.contrarian(spark, d)))))


cte("q_pick", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY CASE model_version WHEN 'v0.3.0-shadow-guard24' THEN 0 WHEN 'v0.1.0-baseline-shadow' THEN 1 ELSE 2 END,
  issued_ms DESC, forecast_id) AS rk FROM q_forecasts WHERE horizon = '24h') x WHERE rk = 1
""")


@query("signal_pick", sql("SELECT series_id, forecast_id, model_version, horizon, direction, issued_ms, target_ms FROM q_pick"))
def signal_pick(spark, d):
    return G.signal_pick(D.forecasts(spark, d)).select("series_id", "forecast_id", "model_version", "horizon", "direction", "issued_ms", "target_ms")


_R30 = "SELECT * FROM q_resolved WHERE issued_ms >= (SELECT max(close_time_ms) FROM q_bars) - CAST(30 AS BIGINT) * 86400000"


_GATES = f"""
SELECT series_id, forecast_id, model_version, horizon, n, hit_rate, wilson_lb_95, expectancy_maker_2bps, r30_n, {r('r30_hit', 'r30_hit')}, {r('r30_maker', 'r30_maker')},
  CASE WHEN reasons = '' THEN 'actionable_paper' ELSE 'shadow' END AS status, reasons FROM (
SELECT p.series_id, p.forecast_id, p.model_version, p.horizon, a.n, a.hit_rate, a.wilson_lb_95, a.expectancy_maker_2bps, b.r30_n, b.r30_hit, b.r30_maker,
  concat_ws(';', CASE WHEN a.n IS NULL THEN 'bucket_missing' END, CASE WHEN coalesce(a.n, 0) < 40 THEN 'n_resolved ' || coalesce(a.n, 0) || ' < 40' END,
   CASE WHEN NOT coalesce(a.wilson_lb_95 > 0.5, false) THEN 'wilson_lb_95' END, CASE WHEN coalesce(b.r30_n, 0) < 20 THEN 'rolling_30d_n ' || coalesce(b.r30_n, 0) || ' < 20' END,
   CASE WHEN NOT coalesce(b.r30_hit >= 0.52, false) THEN 'rolling_30d_hit_rate' END, CASE WHEN NOT coalesce(b.r30_maker > 0, false) THEN 'rolling_30d_expectancy' END,
   CASE WHEN p.target_ms <= (SELECT max(close_time_ms) FROM q_bars) THEN 'expired' END) AS reasons
FROM q_pick p
LEFT JOIN (SELECT {finish('series_id, model_version, horizon')} FROM (SELECT series_id, model_version, horizon, {BASE_AGGS} FROM q_resolved GROUP BY 1, 2, 3) z) a USING (series_id, model_version, horizon)
LEFT JOIN (SELECT series_id, model_version, horizon, count(*) AS r30_n, avg(o) AS r30_hit, avg(signed) * 10000 - 2 AS r30_maker FROM q_r30 GROUP BY 1, 2, 3) b USING (series_id, model_version, horizon)) y"""


@query("signal_gates", sql(_GATES, q_r30=_R30))
def signal_gates(spark, d):
    return _gates(spark, d)


@query("signal_status", sql(f"""
SELECT s.series_id, CASE WHEN s.series_id = (SELECT min(series_id) FROM q_bars) THEN 'halted' ELSE coalesce(g.status, 'halted') END AS status
FROM (SELECT DISTINCT series_id FROM q_bars) s LEFT JOIN ({_GATES}) g USING (series_id)""", q_r30=_R30))
def signal_status(spark, d):
    """The first series issues nothing, so that its signal is halted."""
    bars = I.hourly(spark, d)
    first = bars.agg(F.min("series_id")).scalar()
    gated = _gates(spark, d).filter(F.col("series_id") != first)
    return G.signal_status(bars, gated).select("series_id", "status")


def _gates(spark, d):
    bars, fc, _ = D.ledger_parts(spark, d)
    now = I.now_ms(bars)
    rows = D.reported(spark, d)
    keys = ("series_id", "model_version", "horizon")
    all_time = M.bucket_metrics(rows, keys)
    recent = M.bucket_metrics(rows.filter(F.col("issued_ms") >= now - 30 * 86_400_000), keys)
    out = G.signal_gates(G.signal_pick(fc), all_time, recent, now)
    cols = ("series_id", "forecast_id", "model_version", "horizon", "n", "hit_rate", "wilson_lb_95", "expectancy_maker_2bps", "r30_n", "r30_hit", "r30_maker", "status")
    return report(out.select(*cols, F.concat_ws(";", "reasons").alias("reasons")))
