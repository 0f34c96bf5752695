"""Common table expressions of the SQL side, joined up on demand by ``sql``."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, text: str) -> None:
    CTES[name] = text.strip()


def sql(final: str, **local: str) -> str:
    """``final`` preceded by every CTE it needs, in dependency order."""
    known = {**CTES, **{k: v.strip() for k, v in local.items()}}
    order: list[str] = []

    def need(text: str, owner: str | None) -> None:
        for word in re.findall(r"[a-z_][a-z0-9_]*", text):
            if word in known and word != owner and word not in order:
                need(known[word], word)
                if word not in order:
                    order.append(word)

    need(final, None)
    if not order:
        return final.strip()
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{known[n]}\n)" for n in order) + "\n" + final.strip()


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {alias}"


cte("q_ticks", """
SELECT event_type AS series_id, epoch_us(ts) AS ts_us, event_id, value + 10000.0 AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size,
       CASE user_id % 3 WHEN 0 THEN 'binance' WHEN 1 THEN 'coinbase' ELSE 'kraken' END AS venue
FROM events
""")
cte("q_bars0", """
SELECT series_id, CAST(floor(ts_us / 3600000000.0) AS BIGINT) * 3600000 AS open_time_ms,
       first(price ORDER BY ts_us, event_id) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts_us, event_id) AS close, sum(size) AS volume,
       last(venue ORDER BY ts_us, event_id) AS source
FROM q_ticks GROUP BY ALL
""")
cte("q_bars", """
SELECT *, open_time_ms + 3600000 AS close_time_ms,
       row_number() OVER (PARTITION BY series_id ORDER BY open_time_ms) AS row_idx,
       count(*) OVER (PARTITION BY series_id) AS n_rows
FROM q_bars0
""")
cte("q_venue_bars", """
SELECT series_id, venue AS source, CAST(floor(ts_us / 3600000000.0) AS BIGINT) * 3600000 AS open_time_ms,
       CAST(floor(ts_us / 3600000000.0) AS BIGINT) * 3600000 + 3600000 AS close_time_ms,
       first(price ORDER BY ts_us, event_id) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts_us, event_id) AS close, sum(size) AS volume
FROM q_ticks GROUP BY ALL
""")
cte("q_daily0", """
SELECT l_returnflag AS series_id, CAST(floor(epoch_ms(l_shipdate) / 86400000.0) AS BIGINT) * 86400000 AS open_time_ms,
       first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
       sum(l_quantity) AS volume
FROM lineitem GROUP BY ALL
""")
cte("q_daily", """
SELECT *, open_time_ms + 86400000 AS close_time_ms,
       row_number() OVER (PARTITION BY series_id ORDER BY open_time_ms) AS row_idx,
       count(*) OVER (PARTITION BY series_id) AS n_rows
FROM q_daily0
""")
cte("q_lr", """
SELECT *, CASE WHEN lag(close) OVER w > 0 AND close > 0 THEN ln(close / lag(close) OVER w) ELSE 0.0 END AS lr,
       lead(close_time_ms) OVER w AS next_close_ms, lag(close) OVER w AS prev_close
FROM q_bars WINDOW w AS (PARTITION BY series_id ORDER BY row_idx)
""")
cte("q_scores", """
SELECT *, coalesce(stddev_samp(lr) OVER (PARTITION BY series_id ORDER BY row_idx ROWS 23 PRECEDING), 0.0) AS vol
FROM q_lr
""")
cte("q_trend", """
SELECT series_id, row_idx, lr AS trend FROM q_lr WHERE row_idx = 1
UNION ALL
SELECT l.series_id, l.row_idx, 0.08 * l.lr + 0.92 * t.trend
FROM q_trend t JOIN q_lr l ON l.series_id = t.series_id AND l.row_idx = t.row_idx + 1
""")
cte("q_state", """
SELECT b.*, t.trend,
       CASE WHEN b.row_idx < 30 THEN 'unknown' WHEN t.trend > 1e-4 THEN 'bull' WHEN t.trend < -1e-4 THEN 'bear' ELSE 'chop' END AS regime,
       avg(b.close) OVER (PARTITION BY b.series_id ORDER BY b.row_idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS sma24,
       avg(b.close) OVER (PARTITION BY b.series_id ORDER BY b.row_idx ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) AS sma72
FROM q_lr b JOIN q_trend t ON b.series_id = t.series_id AND b.row_idx = t.row_idx
""")
cte("q_runs", """
SELECT *, unnest(generate_series(close_time_ms,
         least(coalesce(next_close_ms - 3600000, close_time_ms), close_time_ms + 21600000), 3600000)) AS run_ms
FROM q_state
""")
cte("q_calls", """
SELECT *, CASE WHEN row_idx < 2 OR close >= sma24 THEN 'up' ELSE 'down' END AS call,
       CASE WHEN sma24 <= 0 THEN 0.0 ELSE abs(close - sma24) / sma24 END AS arel,
       (close - sma24) / sma24 AS rel, CAST((run_ms // 86400000 + 3) % 7 AS INTEGER) AS dow,
       CAST((run_ms // 3600000) % 24 AS INTEGER) AS hr,
       CASE WHEN row_idx < 2 THEN 'insufficient-history'
            ELSE printf('shadow:sma24 last=%.2f sma=%.2f rel=%.4f', close, sma24, abs(close - sma24) / sma24) END AS base_reason,
       printf('rel=%.4f|sma24=%.2f|sma72=%.2f', (close - sma24) / sma24, sma24, sma72) AS core
FROM q_runs
""")
cte("q_guard", """
SELECT *, CASE WHEN row_idx < 73 THEN 'insufficient-history|have=' || row_idx || '|need=73'
               WHEN abs(rel) > 0.01 THEN 'rel-extreme|' || core
               WHEN close < sma24 AND close >= sma72 THEN 'no-sma72-confirm|' || core
               WHEN close < sma24 AND dow >= 5 THEN 'weekend-down|' || core END AS stop
FROM q_calls
""")
cte("q_attempts", """
SELECT c.*, m.model_version, m.horizon, m.h, run_ms - run_ms % (CASE WHEN m.horizon = '4h' THEN 14400000 ELSE 3600000 END) AS issued_ms,
       CASE m.model_version WHEN 'v0.3.0-shadow-guard24' THEN CASE WHEN stop IS NOT NULL THEN 'abstain' WHEN close >= sma24 THEN 'up' ELSE 'down' END ELSE call END AS direction,
       CASE m.model_version
         WHEN 'v0.3.0-shadow-guard24' THEN CASE WHEN stop IS NULL THEN CASE WHEN abs(rel) < 0.005 THEN 0.55 ELSE 0.52 END END
         WHEN 'v0.1.0-baseline-shadow' THEN CASE WHEN row_idx < 2 THEN 0.5005 ELSE greatest(0.5005, least(0.55, 0.5005 + least(arel, 0.55 - 0.5005))) END
         ELSE CASE WHEN row_idx < 2 THEN 0.5005 ELSE 0.5005 + (0.55 - 0.5005) * CASE WHEN arel <= 0.001 THEN 0.7 WHEN arel <= 0.003 THEN 1.0 WHEN arel <= 0.005 THEN 0.55 WHEN arel <= 0.01 THEN 0.25 ELSE 0.05 END END
       END AS probability,
       CASE m.model_version
         WHEN 'v0.3.0-shadow-guard24' THEN CASE WHEN stop IS NOT NULL THEN 'guard24:abstain=' || stop ELSE 'guard24:' || core || '|band=' || CASE WHEN abs(rel) < 0.005 THEN 'high' ELSE 'low' END END
         WHEN 'v0.1.0-baseline-shadow' THEN base_reason
         ELSE CASE WHEN row_idx < 2 THEN 'policy24:' ELSE 'policy24:inv_conf|' END || base_reason END AS reason
FROM q_guard c, (VALUES ('v0.1.0-baseline-shadow', '1h', 1), ('v0.1.0-baseline-shadow', '4h', 4), ('v0.1.0-baseline-shadow', '12h', 12),
  ('v0.1.0-baseline-shadow', '24h', 24), ('v0.2.0-shadow-policy24', '12h', 12), ('v0.2.0-shadow-policy24', '24h', 24),
  ('v0.3.0-shadow-guard24', '12h', 12), ('v0.3.0-shadow-guard24', '24h', 24)) m(model_version, horizon, h)
""")
cte("q_tried", """
SELECT *, CASE WHEN direction = 'abstain' THEN 'abstain'
               WHEN model_version = 'v0.2.0-shadow-policy24' AND hr = 20 THEN 'skip_hour'
               WHEN run_ms - issued_ms > 900000 THEN 'backfill_guard' END AS skipped
FROM q_attempts
""")
cte("q_forecasts", """
SELECT sha256(series_id || '|' || model_version || '|' || horizon || '|' || strftime(make_timestamp(issued_ms * 1000), '%Y-%m-%dT%H:%M:%SZ')) AS forecast_id,
       series_id, issued_ms, horizon, issued_ms + h * 3600000 AS target_ms, direction, probability, close AS entry_price,
       CASE WHEN direction = 'up' THEN 'close_above_entry' ELSE 'close_below_entry' END AS target_rule,
       model_version, regime AS regime_at_issue, reason AS confidence_reason, run_ms AS issued_at_actual_ms, source AS entry_source
FROM q_tried WHERE skipped IS NULL
""")
cte("q_now", "SELECT max(close_time_ms) AS now_ms FROM q_bars0, (SELECT 3600000 AS w) s, LATERAL (SELECT open_time_ms + w AS close_time_ms)")
cte("q_score", """
SELECT m.*, (actual_close - entry_price) / entry_price AS actual_return,
       CASE WHEN actual_close = entry_price THEN 0 WHEN direction = 'up' THEN CAST(actual_close > entry_price AS INTEGER) ELSE CAST(actual_close < entry_price AS INTEGER) END AS o
FROM q_match m
""")
cte("q_match", """
SELECT f.*, b.close AS actual_close, b.open_time_ms AS candle_open_ms, b.close_time_ms AS candle_close_ms, b.source AS price_source
FROM q_forecasts f JOIN q_bars b ON b.series_id = f.series_id AND b.close_time_ms = f.target_ms
""")
cte("q_joined", """
SELECT f.*, s.actual_close, s.actual_return, s.o, s.o = 1 AS direction_correct, s.candle_close_ms, s.price_source,
       (f.probability - s.o) * (f.probability - s.o) AS brier_component,
       -(s.o * ln(greatest(1e-6, least(1 - 1e-6, f.probability))) + (1 - s.o) * ln(1 - greatest(1e-6, least(1 - 1e-6, f.probability)))) AS logloss_component,
       s.candle_close_ms + 300000 AS resolved_ms, CASE WHEN s.forecast_id IS NOT NULL THEN 'resolved' END AS status
FROM q_forecasts f LEFT JOIN q_score s ON f.forecast_id = s.forecast_id
""")
cte("q_resolved", """
SELECT *, probability AS p, CASE WHEN direction = 'up' THEN actual_return ELSE -actual_return END AS signed, regime_at_issue AS regime
FROM q_joined WHERE status = 'resolved'
""")

BASE_AGGS = """count(*) AS n, sum(o) AS hits, avg(brier_component) AS brier, avg(logloss_component) AS logloss, avg(signed) AS ex,
 sum(CAST(actual_return > 0 AS INTEGER)) AS rose, count(*) FILTER (direction = 'up') AS n_up, count(*) FILTER (direction = 'down') AS n_down,
 count(*) FILTER (direction = 'up' AND o = 1) AS hu, count(*) FILTER (direction = 'down' AND o = 1) AS hd"""


def wilson(p: str, n: str, z: str = "1.96") -> str:
    z2 = f"({z} * {z})"
    return (
        f"(({p} + {z2} / (2.0 * {n}) - {z} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n}))) / (1 + {z2} / {n}))"
    )


def finish(keys: str) -> str:
    """The metric columns over an aggregate with the columns of BASE_AGGS."""
    hit, up = "(hits / CAST(n AS DOUBLE))", "(rose / CAST(n AS DOUBLE))"
    cols = [
        keys,
        "n",
        r(hit, "hit_rate"),
        r("brier", "brier"),
        r("logloss", "logloss"),
        r(f"greatest(0.0, {wilson(hit, 'n')})", "wilson_lb_95"),
        r(hit, "base_rate"),
        r(f"greatest({hit}, 1 - {hit})", "baseline_hit_rate"),
        r(f"{hit} * (1 - {hit})", "baseline_brier"),
        r(up, "always_up_rate"),
        r(f"1 - {up}", "always_down_rate"),
        r(f"{hit} - greatest({up}, 1 - {up})", "vs_majority_pp"),
        r("ex * 10000", "expectancy_bps"),
        r("ex * 10000 - 2", "expectancy_maker_2bps"),
        r("ex * 10000 - 10", "expectancy_taker_10bps"),
        "n_up",
        "n_down",
        r("hu / nullif(CAST(n_up AS DOUBLE), 0)", "hit_up"),
        r("hd / nullif(CAST(n_down AS DOUBLE), 0)", "hit_down"),
        "n >= 20 AS display_ready",
    ]
    return ", ".join(cols)


def ece(pairs: str, keys: str) -> str:
    """Quantile calibration error per ``keys`` of a CTE with columns keys, p, o."""
    return f"""
SELECT {keys}, CASE WHEN max(n) >= 50 THEN sum(abs(sp - so) / n) END AS ece FROM (
  SELECT {keys}, n, least(4, before * 5 // n) AS bin, sum(p * c) AS sp, sum(so) AS so FROM (
    SELECT *, coalesce(sum(c) OVER (PARTITION BY {keys} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(c) OVER (PARTITION BY {keys}) AS n
    FROM (SELECT {keys}, p, count(*) AS c, sum(o) AS so FROM {pairs} GROUP BY {keys}, p) g) b
  GROUP BY {keys}, n, bin) z
GROUP BY {keys}"""


cte("q_dims", """
SELECT 'by_horizon' AS dimension, horizon AS bucket, * FROM q_resolved
UNION ALL SELECT 'by_model_version', model_version, * FROM q_resolved
UNION ALL SELECT 'by_model_horizon', model_version || '|' || horizon, * FROM q_resolved
UNION ALL SELECT 'by_direction', direction, * FROM q_resolved
UNION ALL SELECT 'by_regime', regime, * FROM q_resolved
UNION ALL SELECT 'global', 'all', * FROM q_resolved
""")
