"""Queries over one series at a time: indicators, features, targets, regimes, levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.operators import indicators as ind
from tidemark.operators import levels as V
from tidemark.operators import regime as R
from tidemark.operators.blocks import windowed
from tidemark.operators.ledger import issue_bucket as bucket_of
from tidemark.plans import inputs as I
from tidemark.plans.oracle import cte, r, sql
from tidemark.plans.registry import query, report

AT = ("series_id", "open_time_ms")
W = "OVER (PARTITION BY series_id ORDER BY row_idx{})"


def over(frame=""):
    return W.format(f" ROWS {frame}" if frame else "")


def _windowed(name, select_sql, make, before, digits=8, after=0):
    """A query that adds window columns to the hourly bars, and its SQL."""
    def run(spark, d):
        def build(f, w):
            return f.withColumns(make(w))

        bars = windowed(I.hourly(spark, d), build, before=before, after=after)
        return report(bars.select(*AT, *make_names), digits)

    make_names = [p.split(" AS ")[-1].strip() for p in select_sql]
    body = ", ".join(r(p.rsplit(" AS ", 1)[0], p.rsplit(" AS ", 1)[1], digits) for p in select_sql)
    query(name, sql(f"SELECT series_id, open_time_ms, {body} FROM q_scores"))(run)


def ret_sql(lag):
    prev = f"lag(close, {lag}) {over()}"
    return f"CASE WHEN {prev} > 0 AND close > 0 THEN ln(close / {prev}) ELSE 0.0 END"


_windowed("log_return", ["lr AS log_return"], lambda w: {"log_return": ind.log_return("close", w)}, 1)
_windowed(
    "trailing_return",
    [f"{ret_sql(4)} AS ret_4h", f"{ret_sql(24)} AS ret_24h"],
    lambda w: {"ret_4h": ind.trailing_return("close", w, 4), "ret_24h": ind.trailing_return("close", w, 24)},
    24,
)
_windowed("sma_prefix", [f"avg(close) {over('23 PRECEDING')} AS sma"], lambda w: {"sma": ind.sma_prefix("close", w, 24)}, 24, 6)
_windowed(
    "sma_strict",
    [f"CASE WHEN row_idx >= 24 THEN avg(close) {over('23 PRECEDING')} END AS sma"],
    lambda w: {"sma": ind.sma_strict("close", w, 24)},
    24,
    6,
)
_windowed(
    "sma_prior",
    [f"avg(close) {over('BETWEEN 24 PRECEDING AND 1 PRECEDING')} AS sma"],
    lambda w: {"sma": ind.sma_prior("close", w, 24)},
    24,
    6,
)
_REL = "(close - avg(close) {0}) / avg(close) {0}"
_windowed(
    "sma_rel",
    [_REL.format(over("23 PRECEDING")) + " AS sma24_rel", _REL.format(over("71 PRECEDING")) + " AS sma72_rel"],
    lambda w: {
        "sma24_rel": ind.relative(F.col("close"), ind.sma_prefix("close", w, 24)),
        "sma72_rel": ind.relative(F.col("close"), ind.sma_prefix("close", w, 72)),
    },
    72,
)
_windowed(
    "down_confirmed",
    [f"CASE WHEN close < avg(close) {over('23 PRECEDING')} - 1e-9 AND close < avg(close) {over('71 PRECEDING')} - 1e-9 THEN 1.0 ELSE 0.0 END AS down_confirmed"],
    lambda w: {
        "down_confirmed": (
            (F.col("close") < ind.sma_prefix("close", w, 24) - 1e-9) & (F.col("close") < ind.sma_prefix("close", w, 72) - 1e-9)
        ).cast("double")
    },
    72,
)
_VMEAN = f"avg(CASE WHEN volume > 0 THEN volume END) {over('23 PRECEDING')}"
_windowed(
    "volume_ratio",
    [f"CASE WHEN {_VMEAN} IS NULL THEN 1.0 WHEN volume > 0 THEN volume / {_VMEAN} ELSE 1.0 END AS volume_ratio"],
    lambda w: {"volume_ratio": ind.volume_ratio("volume", w, 24)},
    24,
)
_DAY = "((open_time_ms / 86400000.0 + 3.0) - 7 * floor((open_time_ms / 86400000.0 + 3.0) / 7))"
_HOUR = "((open_time_ms // 3600000) % 24)"
CALENDAR_SQL = {
    "hour_sin": f"sin(2 * pi() * {_HOUR} / 24.0)",
    "hour_cos": f"cos(2 * pi() * {_HOUR} / 24.0)",
    "dow_sin": f"sin(2 * pi() * {_DAY} / 7.0)",
    "dow_cos": f"cos(2 * pi() * {_DAY} / 7.0)",
    "is_weekend": f"CASE WHEN {_DAY} >= 5 THEN 1.0 ELSE 0.0 END",
}
_windowed("calendar_cyclic", [f"{v} AS {k}" for k, v in CALENDAR_SQL.items()], lambda w: ind.calendar_columns(), 0)


@query("realized_vol", sql(f"SELECT series_id, open_time_ms, {r('vol', 'realized_vol', 9)} FROM q_scores"))
def realized_vol(spark, d):
    def build(f, w):
        return f.withColumn("_lr", ind.log_return("close", w)).withColumn("realized_vol", ind.realized_vol("_lr", w, 24))

    return report(windowed(I.hourly(spark, d), build, before=25).select(*AT, "realized_vol"), 9)


cte("q_ema20", """
SELECT series_id, row_idx, close AS ema FROM q_bars WHERE row_idx = 1
UNION ALL
SELECT b.series_id, b.row_idx, b.close * (2.0 / 21) + e.ema * (1 - 2.0 / 21)
FROM q_ema20 e JOIN q_bars b ON b.series_id = e.series_id AND b.row_idx = e.row_idx + 1
""")
cte("q_moves", """
SELECT *, greatest(close - lag(close) OVER w, 0.0) AS gain, greatest(lag(close) OVER w - close, 0.0) AS loss
FROM q_bars WINDOW w AS (PARTITION BY series_id ORDER BY row_idx)
""")
cte("q_wilder", """
SELECT series_id, CAST(15 AS BIGINT) AS row_idx, avg(gain) AS g, avg(loss) AS l FROM q_moves WHERE row_idx BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14
UNION ALL
SELECT m.series_id, m.row_idx, (w.g * 13 + m.gain) / 14, (w.l * 13 + m.loss) / 14
FROM q_wilder w JOIN q_moves m ON m.series_id = w.series_id AND m.row_idx = w.row_idx + 1
""")
cte("q_rsi", """
SELECT b.series_id, b.row_idx, CASE WHEN w.g IS NULL THEN 50.0 WHEN w.l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1 + w.g / w.l) END AS rsi
FROM q_bars b LEFT JOIN q_wilder w ON b.series_id = w.series_id AND b.row_idx = w.row_idx
""")


@query("ema", sql(f"SELECT series_id, open_time_ms, {r('ema', 'ema_20')} FROM q_ema20 JOIN q_bars USING (series_id, row_idx)"))
def ema(spark, d):
    return report(ind.ema(I.hourly(spark, d), "close", 20).select(*AT, "ema_20"))


@query("ema_distance", sql(f"SELECT series_id, open_time_ms, {r('(close - ema) / ema', 'ema_distance', 9)} FROM q_ema20 JOIN q_bars USING (series_id, row_idx)"))
def ema_distance(spark, d):
    bars = ind.ema(I.hourly(spark, d), "close", 20)
    return report(bars.select(*AT, ind.relative(F.col("close"), F.col("ema_20")).alias("ema_distance")), 9)


@query("rsi_wilder", sql(f"SELECT series_id, open_time_ms, {r('rsi', 'rsi')} FROM q_rsi JOIN q_bars USING (series_id, row_idx)"))
def rsi_wilder(spark, d):
    return report(ind.rsi_wilder(I.hourly(spark, d)).select(*AT, "rsi"))


# Side series: hourly venue bars stand in for derivatives and sentiment snapshots; an hour takes
# the first venue that has one (their order is that of their names).
def aux_series(spark, d):
    bars = I.venue_bars(spark, d)
    names = [c for c in bars.columns if c not in ("series_id", "open_time_ms", "source")]
    best = bars.groupBy("series_id", "open_time_ms").agg(F.min_by(F.struct(*names), "source").alias("b")).select("series_id", "open_time_ms", "b.*")
    one = I.settle(B.indexed(best))
    return one.select(
        "series_id",
        "row_idx",
        "open_time_ms",
        F.col("close_time_ms").alias("snapshot_ms"),
        F.when(F.col("volume") > 0, (F.col("close") - F.col("open")) / F.col("open")).alias("funding_rate"),
        F.when(F.col("volume") >= 20, F.col("volume")).alias("open_interest"),
        F.when(F.col("volume") >= 10, F.floor(F.col("high") - I.PRICE_BASE).cast("double")).alias("fear_greed_value"),
        F.when(F.col("volume") >= 5, F.col("volume") * 60.0).alias("freshness_s"),
    )


cte("q_aux", """
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY open_time_ms) AS row_idx, count(*) OVER (PARTITION BY series_id) AS n_rows,
       open_time_ms, close_time_ms AS snapshot_ms,
       CASE WHEN volume > 0 THEN (close - open) / open END AS funding_rate, CASE WHEN volume >= 20 THEN volume END AS open_interest,
       CASE WHEN volume >= 10 THEN floor(high - 10000) END AS fear_greed_value, CASE WHEN volume >= 5 THEN volume * 60.0 END AS freshness_s
FROM (SELECT * FROM q_venue_bars QUALIFY row_number() OVER (PARTITION BY series_id, open_time_ms ORDER BY source) = 1) v
""")
cte("q_aligned", """
SELECT b.*, a.funding_rate, a.open_interest, a.fear_greed_value, a.freshness_s
FROM q_scores b LEFT JOIN q_aux a ON a.series_id = b.series_id AND a.n_rows - a.row_idx = b.n_rows - b.row_idx
""")
cte("q_oi", """
SELECT *, last_value(open_interest IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_oi
FROM q_aligned
""")
OI_SQL = "CASE WHEN open_interest IS NULL OR prev_oi IS NULL OR prev_oi = 0 THEN 0.0 ELSE (open_interest - prev_oi) / prev_oi END"
AUX_COLS = ("funding_rate", "open_interest", "fear_greed_value", "freshness_s")


@query("aux_tail_align", sql("SELECT series_id, open_time_ms, " + ", ".join(r(c, c, 9) for c in AUX_COLS) + " FROM q_aligned"))
def aux_tail_align(spark, d):
    return report(X.aux_tail_align(I.hourly(spark, d), aux_series(spark, d), AUX_COLS).select(*AT, *AUX_COLS), 9)


@query("asof_join", sql(f"""
SELECT b.series_id, b.open_time_ms, a.snapshot_ms, {r('a.funding_rate', 'funding_rate', 9)}
FROM q_bars b ASOF LEFT JOIN q_aux a ON a.series_id = b.series_id AND a.snapshot_ms <= b.close_time_ms"""))
def asof_join(spark, d):
    bars = I.hourly(spark, d).select("series_id", "open_time_ms", "close_time_ms")
    return report(X.asof_join(bars, aux_series(spark, d), ["funding_rate"]).drop("close_time_ms"), 9)


@query("oi_delta", sql(f"SELECT series_id, open_time_ms, {r(OI_SQL, 'open_interest_delta', 9)} FROM q_oi"))
def oi_delta(spark, d):
    bars = X.add_aux(I.hourly(spark, d), aux_series(spark, d))
    return report(ind.oi_delta(bars).select(*AT, "open_interest_delta"), 9)


PRESENCE_SQL = {
    "funding_rate": "coalesce(funding_rate, 0.0)",
    "funding_present": "CAST(funding_rate IS NOT NULL AS DOUBLE)",
    "fear_greed_norm": "coalesce(fear_greed_value / 100.0, 0.5)",
    "fear_greed_present": "CAST(fear_greed_value IS NOT NULL AS DOUBLE)",
    "source_freshness_log": "coalesce(ln(1 + freshness_s), 0.0)",
    "source_freshness_present": "CAST(freshness_s IS NOT NULL AS DOUBLE)",
}


@query("presence_impute", sql("SELECT series_id, open_time_ms, " + ", ".join(r(v, k, 9) for k, v in PRESENCE_SQL.items()) + " FROM q_aligned"))
def presence_impute(spark, d):
    f = X.add_aux(I.hourly(spark, d), aux_series(spark, d))
    funding, has_funding = ind.presence(F.col("funding_rate"))
    fng, has_fng = ind.presence(F.col("fear_greed_value") / 100.0, 0.5)
    fresh, has_fresh = ind.presence(F.ln(F.col("freshness_s") + 1.0))
    out = {"funding_rate": funding, "funding_present": has_funding, "fear_greed_norm": fng, "fear_greed_present": has_fng,
           "source_freshness_log": fresh, "source_freshness_present": has_fresh}
    return report(f.select(*AT, *[c.alias(n) for n, c in out.items()]), 9)


cte("q_regime", """
SELECT s.*, t.trend, CASE WHEN s.row_idx <= 24 THEN 'unknown' WHEN t.trend > 1e-4 THEN 'bull' WHEN t.trend < -1e-4 THEN 'bear' ELSE 'chop' END AS coarse
FROM q_scores s JOIN q_trend t ON s.series_id = t.series_id AND s.row_idx = t.row_idx
""")
cte("q_median", f"""
SELECT *, quantile_cont(vol, 0.5) {over('UNBOUNDED PRECEDING')} AS threshold FROM q_regime
""")
cte("q_labels", """
SELECT *, CASE WHEN row_idx <= 24 THEN 'unknown'
  ELSE CASE coarse WHEN 'bull' THEN 'trend_up' WHEN 'bear' THEN 'trend_down' ELSE 'chop' END
       || CASE WHEN vol >= threshold - 1e-12 THEN '_high_vol' ELSE '_low_vol' END END AS fine FROM q_median
""")


@query("onehot_regime", sql("SELECT series_id, open_time_ms, " + ", ".join(
    f"CAST(coarse = '{x}' AS DOUBLE) AS regime_{x}" for x in ind.REGIMES) + " FROM q_regime"))
def onehot_regime(spark, d):
    f = R.trend_scores(I.hourly(spark, d)).withColumn("coarse", R.coarse_label())
    return f.select(*AT, *[c.alias(n) for n, c in ind.onehot_regime(F.col("coarse")).items()])


@query("causal_median", sql(f"SELECT series_id, open_time_ms, {r('threshold', 'vol_threshold', 9)} FROM q_median"))
def causal_median(spark, d):
    f = R.trend_scores(I.hourly(spark, d))
    return report(R.causal_median(f, "vol_score", "vol_threshold").select(*AT, "vol_threshold"), 9)


@query("regime_labels", sql(f"SELECT series_id, open_time_ms, coarse, fine, {r('trend', 'trend_score', 9)}, {r('vol', 'vol_score', 9)} FROM q_labels"))
def regime_labels(spark, d):
    return report(R.regime_labels(I.hourly(spark, d)).select(*AT, "coarse", "fine", "trend_score", "vol_score"), 9)


@query("regime_last", sql("""
SELECT series_id, n_rows AS n_bars, CASE WHEN n_rows < 30 THEN 'unknown' ELSE coarse END AS coarse, fine FROM q_labels WHERE row_idx = n_rows"""))
def regime_last(spark, d):
    return R.regime_last(R.regime_labels(I.hourly(spark, d)))


@query("regime_distribution", sql("""
SELECT s.series_id, s.total, l.level, l.label, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / s.total, 6) + 0.0 AS share
FROM (SELECT series_id, count(*) AS total FROM q_bars GROUP BY 1) s
CROSS JOIN (SELECT 'fine' AS level, unnest(['trend_up_high_vol', 'trend_up_low_vol', 'trend_down_high_vol', 'trend_down_low_vol', 'chop_high_vol', 'chop_low_vol', 'unknown']) AS label
      UNION ALL SELECT 'coarse', unnest(['bull', 'bear', 'chop', 'unknown'])) l
LEFT JOIN (SELECT series_id, 'fine' AS level, fine AS label, count(*) AS n FROM q_labels GROUP BY 1, 3
      UNION ALL SELECT series_id, 'coarse', coarse, count(*) FROM q_labels GROUP BY 1, 3) c USING (series_id, level, label)"""))
def regime_distribution(spark, d):
    return report(R.regime_distribution(R.regime_labels(I.hourly(spark, d))))


_SMA24, _SMA72 = f"avg(close) {over('23 PRECEDING')}", f"avg(close) {over('71 PRECEDING')}"
FEATURE_SQL = {
    "log_return_1": "lr",
    "realized_vol": "vol",
    "volume_ratio": f"CASE WHEN {_VMEAN} IS NULL THEN 1.0 WHEN volume > 0 THEN volume / {_VMEAN} ELSE 1.0 END",
    "rsi_14": "rsi / 100.0",
    "ema_distance": "(close - ema) / ema",
    **PRESENCE_SQL,
    "open_interest_delta": OI_SQL,
    "open_interest_present": "CAST(open_interest IS NOT NULL AS DOUBLE)",
    **{f"regime_{x}": f"CAST(coarse = '{x}' AS DOUBLE)" for x in ind.REGIMES},
    "sma24_rel": f"(close - {_SMA24}) / {_SMA24}",
    "sma72_rel": f"(close - {_SMA72}) / {_SMA72}",
    "down_confirmed": f"CASE WHEN close < {_SMA24} - 1e-9 AND close < {_SMA72} - 1e-9 THEN 1.0 ELSE 0.0 END",
    "ret_4h": ret_sql(4),
    "ret_24h": ret_sql(24),
    **CALENDAR_SQL,
}
cte("q_feature_base", """
SELECT o.*, e.ema, w.rsi, g.coarse FROM q_oi o
JOIN q_ema20 e ON e.series_id = o.series_id AND e.row_idx = o.row_idx
JOIN q_rsi w ON w.series_id = o.series_id AND w.row_idx = o.row_idx
JOIN q_regime g ON g.series_id = o.series_id AND g.row_idx = o.row_idx
""")


@query("feature_frame", sql("SELECT series_id, open_time_ms, " + ", ".join(r(v, k, 8) for k, v in FEATURE_SQL.items()) + " FROM q_feature_base"))
def feature_frame(spark, d):
    frame = X.feature_frame(I.hourly(spark, d), aux_series(spark, d))
    return report(frame.select(*AT, *X.FEATURES), 8)


@query("row_meta", sql(f"""
SELECT series_id, row_idx, {r('lr', 'log_return_1', 8)}, {r('rsi / 100.0', 'rsi', 8)}, {r('(close - ema) / ema', 'ema_distance', 8)}, coarse AS regime,
       {r('close', 'close', 8)}, {r('coalesce(prev_close, 0.0)', 'prev_close', 8)} FROM q_feature_base"""))
def row_meta(spark, d):
    return report(X.row_meta(X.feature_frame(I.hourly(spark, d))), 8)


@query("direction_target", sql("SELECT * FROM (" + " UNION ALL ".join(f"""
SELECT series_id, open_time_ms, '{h}' AS horizon, lead(open_time_ms, {n}) {over()} AS target_open_ms, CAST(lead(close, {n}) {over()} > close AS INTEGER) AS y FROM q_bars"""
    for h, n in X.HORIZON_BARS.items()) + ") x WHERE target_open_ms IS NOT NULL"))
def direction_target(spark, d):
    return X.direction_target(I.hourly(spark, d)).select(*AT, "horizon", "target_open_ms", "y")


@query("direction_target_exact", sql(" UNION ALL ".join(f"""
SELECT a.series_id, a.open_time_ms, '{h}' AS horizon, b.open_time_ms AS target_open_ms, CAST(b.close > a.close AS INTEGER) AS y
FROM q_bars a JOIN q_bars b ON b.series_id = a.series_id AND b.open_time_ms = a.open_time_ms + {n * 3_600_000}""" for h, n in X.HORIZON_BARS.items())))
def direction_target_exact(spark, d):
    return X.direction_target_exact(I.hourly(spark, d)).select(*AT, "horizon", "target_open_ms", "y")


# ── levels ───────────────────────────────────────────────────────────────────
def _clock(spark, d):
    return I.ticks(spark, d).agg(F.floor(F.max("ts_us") / 1000).cast("long")).scalar()


cte("q_clock", "SELECT max(ts_us) // 1000 AS now_ms FROM q_ticks")
cte("q_h", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY open_time_ms DESC) AS back FROM q_bars WHERE close_time_ms <= (SELECT now_ms FROM q_clock)")
cte("q_d", """
SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY open_time_ms DESC) AS back, count(*) OVER (PARTITION BY series_id) AS n_days FROM (
SELECT series_id, CAST(floor(ts_us / 86400000000.0) AS BIGINT) * 86400000 AS open_time_ms, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts_us, event_id) AS close FROM q_ticks GROUP BY ALL) x
WHERE open_time_ms + 86400000 <= (SELECT now_ms FROM q_clock)
""")
PIVOT_SQL = ", ".join([
    r("(high + low + close) / 3", "pivot_classic"), r("2 * ((high + low + close) / 3) - low", "r1"), r("2 * ((high + low + close) / 3) - high", "s1"),
    r("(high + low + close) / 3 + (high - low)", "r2"), r("(high + low + close) / 3 - (high - low)", "s2")])


def _closed(spark, d):
    now = _clock(spark, d)
    ticks = I.ticks(spark, d)
    days = I.settle(B.indexed(I.settle(B.closed_bars(B.tick_to_bar(ticks, "1d"), now)), interval="1d"))
    return B.closed_bars(I.hourly(spark, d), now), days, now


@query("recent_high_low", sql(f"SELECT series_id, {r('max(high)', 'recent_high')}, {r('min(low)', 'recent_low')} FROM q_h WHERE back <= 24 GROUP BY 1"))
def recent_high_low(spark, d):
    return report(V.recent_high_low(_closed(spark, d)[0]))


@query("vwap_session", sql(f"""
SELECT series_id, {r('sum((high + low + close) / 3 * volume) FILTER (t) / sum(volume) FILTER (t)', 'vwap_session')}
FROM (SELECT *, volume > 0 AND open_time_ms >= (SELECT now_ms // 86400000 * 86400000 FROM q_clock) AS t FROM q_h) x GROUP BY 1"""))
def vwap_session(spark, d):
    h, _, now = _closed(spark, d)
    return report(V.vwap_session(h, now))


@query("pivot_levels", sql(f"SELECT series_id, {PIVOT_SQL} FROM q_d WHERE back = 1"))
def pivot_levels(spark, d):
    return report(V.pivot_levels(_closed(spark, d)[1]))


@query("key_levels", sql(f"""
SELECT h.series_id, h.n AS closed_1h_count, x.n_days AS closed_1d_count, h.recent_high, h.recent_low, v.vwap_session, p.pivot_classic, p.r1, p.s1, p.r2, p.s2,
       x.sma_20, x.sma_50, x.sma_200, false AS degraded, 'ok' AS status,
       concat_ws(';', CASE WHEN x.n_days < 20 THEN 'insufficient daily bars for SMAs' END, CASE WHEN x.n_days >= 20 AND x.sma_50 IS NULL THEN 'sma_50 needs 50+ daily closes' END,
                 CASE WHEN x.n_days >= 20 AND x.sma_200 IS NULL THEN 'sma_200 needs 200+ daily closes' END) AS notes
FROM (SELECT series_id, count(*) AS n, {r('max(high) FILTER (back <= 24)', 'recent_high')}, {r('min(low) FILTER (back <= 24)', 'recent_low')} FROM q_h GROUP BY 1) h
JOIN (SELECT series_id, {r('sum((high + low + close) / 3 * volume) FILTER (t) / sum(volume) FILTER (t)', 'vwap_session')}
      FROM (SELECT *, volume > 0 AND open_time_ms >= (SELECT now_ms // 86400000 * 86400000 FROM q_clock) AS t FROM q_h) z GROUP BY 1) v USING (series_id)
JOIN (SELECT series_id, {PIVOT_SQL} FROM q_d WHERE back = 1) p USING (series_id)
JOIN (SELECT series_id, n_days, {r('CASE WHEN n_days >= 20 THEN avg(close) FILTER (back <= 20) END', 'sma_20')},
      {r('CASE WHEN n_days >= 50 THEN avg(close) FILTER (back <= 50) END', 'sma_50')}, {r('CASE WHEN n_days >= 200 THEN avg(close) FILTER (back <= 200) END', 'sma_200')}
      FROM q_d GROUP BY 1, n_days) x USING (series_id)"""))
def key_levels(spark, d):
    h, days, now = _closed(spark, d)
    return report(V.key_levels(h, days, now).withColumn("notes", F.concat_ws(";", "notes")))


cte("q_change", f"SELECT *, CASE WHEN lag(open, 23) {over()} > 0 THEN (close - lag(open, 23) {over()}) / lag(open, 23) {over()} * 100 END AS change_pct FROM q_bars")
cte("q_tc", f"""
SELECT *, sum(CAST(close > open AS INTEGER)) {over('6 PRECEDING')} AS up_7, coalesce(sum(rise) {over('3 PRECEDING')}, 0) AS rises_5
FROM (SELECT *, CAST(close > lag(close) {over()} AS INTEGER) AS rise FROM q_change) x
""")
cte("q_quotes", """
SELECT *, close AS price, CASE WHEN up_7 >= 5 THEN 'BULLISH' WHEN up_7 <= 2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend_7,
       CASE WHEN row_idx < 3 THEN 'UNKNOWN' WHEN rises_5 >= 4 THEN 'BULLISH' WHEN rises_5 <= 1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend_5 FROM q_tc
""")
cte("q_levels", """
SELECT series_id, 'ma' AS name, avg(close) AS level, true AS is_top FROM q_bars GROUP BY 1 UNION ALL
SELECT series_id, 'peak', max(high) * 0.97, true FROM q_bars GROUP BY 1 UNION ALL
SELECT series_id, 'floor', min(low) * 1.003, false FROM q_bars GROUP BY 1 UNION ALL
SELECT series_id, 'base', avg(low), false FROM q_bars GROUP BY 1
""")


def _quotes(spark, d):
    bars = I.hourly(spark, d)
    q = V.trend_count(V.daily_change(bars)).withColumn("price", F.col("close")).withColumn("trend", F.col("trend_7"))
    stats = bars.groupBy("series_id").agg(
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("name"), c.alias("level"), F.lit(t).alias("is_top"))
            for n, c, t in (("ma", F.avg("close"), True), ("peak", F.max("high") * 0.97, True),
                            ("floor", F.min("low") * 1.003, False), ("base", F.avg("low"), False))
        ]))
    )
    return q, stats


@query("daily_change", sql(f"SELECT series_id, open_time_ms, {r('change_pct', 'change_pct')} FROM q_change"))
def daily_change(spark, d):
    return report(V.daily_change(I.hourly(spark, d)).select(*AT, "change_pct"))


@query("trend_count", sql("SELECT series_id, open_time_ms, CAST(up_7 AS BIGINT) AS up_7, CAST(rises_5 AS BIGINT) AS rises_5, trend_7, trend_5 FROM q_quotes"))
def trend_count(spark, d):
    return V.trend_count(I.hourly(spark, d)).select(*AT, "up_7", "rises_5", "trend_7", "trend_5")


_AWAY = "((price - level) / level * 100)"


@query("level_events", sql(f"""
SELECT series_id, open_time_ms, 'LARGE_MOVE' AS event, 'HIGH' AS severity, NULL AS level_name FROM q_quotes WHERE abs(change_pct) >= 3
UNION ALL SELECT series_id, open_time_ms, 'TREND', 'LOW', NULL FROM q_quotes WHERE trend_7 <> 'NEUTRAL'
UNION ALL SELECT * FROM (SELECT q.series_id, open_time_ms,
  CASE WHEN is_top THEN CASE WHEN {_AWAY} > 0 AND {_AWAY} < 2 THEN 'APPROACHING' WHEN {_AWAY} >= 0 AND change_pct > 2 THEN 'BREAK_UP' END
       ELSE CASE WHEN {_AWAY} > -2 AND {_AWAY} < 0 AND change_pct < -1 THEN 'TESTING_SUPPORT' WHEN {_AWAY} < -2 AND change_pct < -2 THEN 'BREAK_DOWN' END END AS event,
  CASE WHEN is_top THEN CASE WHEN {_AWAY} > 0 AND {_AWAY} < 2 THEN 'MEDIUM' ELSE 'HIGH' END
       ELSE CASE WHEN {_AWAY} > -2 AND {_AWAY} < 0 AND change_pct < -1 THEN 'MEDIUM' ELSE 'HIGH' END END AS severity, name
  FROM q_quotes q JOIN q_levels l ON q.series_id = l.series_id) e WHERE event IS NOT NULL"""))
def level_events(spark, d):
    return V.level_events(*_quotes(spark, d))


@query("level_events_strict", sql("""
SELECT series_id, open_time_ms, 'LARGE_MOVE' AS event, NULL AS level_name FROM q_quotes WHERE abs(change_pct) >= 3
UNION ALL SELECT series_id, open_time_ms, CASE WHEN (close - open) / open * 10 > 0.05 THEN 'FUNDING_HIGH' ELSE 'FUNDING_LOW' END, NULL FROM q_quotes WHERE abs((close - open) / open * 10) > 0.05
UNION ALL SELECT * FROM (SELECT q.series_id, open_time_ms,
  CASE WHEN is_top THEN CASE WHEN price > level * 0.99 AND price < level * 1.01 THEN 'APPROACHING' WHEN price > level AND change_pct > 0 THEN 'BROKE_ABOVE' END
       ELSE CASE WHEN price < level * 1.02 AND change_pct < 0 THEN 'TESTING_SUPPORT' WHEN price < level AND change_pct < -2 THEN 'BROKE_BELOW' END END AS event, name
  FROM q_quotes q JOIN q_levels l ON q.series_id = l.series_id) e WHERE event IS NOT NULL"""))
def level_events_strict(spark, d):
    quotes, levels = _quotes(spark, d)
    funding = (F.col("close") - F.col("open")) / F.col("open") * 10
    return V.level_events_strict(quotes.withColumn("funding", funding), levels)


@query("level_position", sql("""
SELECT q.series_id, open_time_ms, coalesce(string_agg(name, ',' ORDER BY level) FILTER (price > level), '') AS above_levels,
       coalesce(string_agg(name, ',' ORDER BY level) FILTER (price <= level), '') AS below_levels,
       round(min(level) FILTER (level > price), 6) + 0.0 AS nearest_resist, round(max(level) FILTER (level <= price), 6) + 0.0 AS nearest_support
FROM q_quotes q JOIN q_levels l ON q.series_id = l.series_id GROUP BY 1, 2"""))
def level_position(spark, d):
    out = V.level_position(*_quotes(spark, d))
    return report(out.withColumns({c: F.concat_ws(",", c) for c in ("above_levels", "below_levels")}))


@query("issue_bucket", sql("""
SELECT series_id, open_time_ms, h.horizon, close_time_ms // h.w * h.w AS bucket_ms FROM q_bars,
 (VALUES ('1h', 3600000), ('4h', 14400000), ('12h', 3600000), ('24h', 3600000)) h(horizon, w)"""))
def issue_bucket(spark, d):
    rows = I.hourly(spark, d).select(*AT, "close_time_ms", F.explode(F.array(*[F.lit(h) for h in S.BUCKET_HOURS])).alias("horizon"))
    return rows.select(*AT, "horizon", bucket_of(F.col("close_time_ms"), F.col("horizon")).alias("bucket_ms"))
