"""Documented market rules over daily bars, an option book and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import strategies as X
from tidemark.operators.blocks import with_row_index
from tidemark.plans import inputs as I
from tidemark.plans import ledger_data as D
from tidemark.plans.oracle import cte, r, sql
from tidemark.plans.q_series import over
from tidemark.plans.registry import query, report

_c = F.col
AT = ("series_id", "open_time_ms")

cte("q_book", """
SELECT 'LI-' || strftime(l_shipdate, '%y%m') || '-' || CAST(CAST(floor(l_extendedprice / l_quantity / 5000) AS BIGINT) * 5000 AS VARCHAR) || '-' || CASE l_linestatus WHEN 'F' THEN 'C' ELSE 'P' END AS instrument,
       sum(l_quantity) AS open_interest FROM lineitem GROUP BY 1
""")
cte("q_strikes", """
SELECT split_part(instrument, '-', 2) AS expiry, CAST(split_part(instrument, '-', 3) AS BIGINT) AS strike, sum(CASE WHEN split_part(instrument, '-', 4) = 'C' THEN open_interest ELSE 0.0 END)::DOUBLE AS call_oi,
       sum(CASE WHEN split_part(instrument, '-', 4) = 'P' THEN open_interest ELSE 0.0 END)::DOUBLE AS put_oi FROM q_book GROUP BY 1, 2
""")


def strikes(spark, d):
    li = I.table(spark, d, "lineitem")
    strike = (F.floor(_c("l_extendedprice") / _c("l_quantity") / 5000) * 5000).cast("long").cast("string")
    name = F.concat_ws("-", F.lit("LI"), F.date_format("l_shipdate", "yyMM"), strike, F.when(_c("l_linestatus") == "F", "C").otherwise("P"))
    return X.opt_oi_by_strike(li.groupBy(name.alias("instrument")).agg(F.sum("l_quantity").alias("open_interest")))


@query("opt_oi_by_strike", sql("SELECT expiry, strike, call_oi, put_oi, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY expiry ORDER BY call_oi + put_oi DESC, strike) AS INTEGER) AS place FROM q_strikes) x WHERE place <= 10"))
def opt_oi_by_strike(spark, d):
    return X.top_strikes(strikes(spark, d))


@query("opt_pcr", sql(f"SELECT expiry, {r('sum(put_oi) / nullif(sum(call_oi), 0)', 'pcr')}, sum(call_oi) AS call_oi, sum(put_oi) AS put_oi FROM q_strikes GROUP BY 1"))
def opt_pcr(spark, d):
    return report(X.opt_pcr(strikes(spark, d)))


@query("opt_max_pain", sql(f"""
SELECT expiry, first(strike ORDER BY pain, strike) AS max_pain, {r('min(pain)', 'pain', 3)} FROM (
SELECT p.expiry, p.strike, sum(k.call_oi * greatest(0, p.strike - k.strike) + k.put_oi * greatest(0, k.strike - p.strike)) AS pain
FROM q_strikes p JOIN q_strikes k ON p.expiry = k.expiry GROUP BY 1, 2) x GROUP BY 1"""))
def opt_max_pain(spark, d):
    return report(X.opt_max_pain(strikes(spark, d)), 3)


# ── derivatives: daily metrics derived from the daily bars ───────────────────
METRICS = {
    "funding": "(close / open - 1) * 0.1",
    "oi_change_4w": "(volume / 500 - 1) * 50",
    "dvol": "(high - low) / high * 100",
    "pcr": "low / open",
    "basis": "(close - open) / open * 20",
    "term_slope": "close - open",
    "long_pct": "open / (open + close) * 100",
    "oi_mcap_pct": "volume / 200",
}
cte("q_dm", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in METRICS.items()) + " FROM q_daily")


def daily_metrics(spark, d):
    return I.daily(spark, d).selectExpr("*", *[f"{v} AS {k}" for k, v in METRICS.items()])


@query("deriv_alerts", sql(" UNION ALL ".join(
    f"SELECT series_id, open_time_ms, '{n}' AS alert, {r(c, 'value')} FROM q_dm WHERE {c} {op} {lim}" for n, c, op, lim in X.ALERTS)))
def deriv_alerts(spark, d):
    return report(X.deriv_alerts(daily_metrics(spark, d), AT))


_BULL = "(funding < -0.01)::INT + (pcr > 0.75)::INT + (dvol > 80)::INT + (term_slope < 0)::INT + (oi_change_4w <= -30)::INT + (long_pct < 42)::INT"
_BEAR = "(funding > 0.05)::INT + (pcr < 0.45)::INT + (dvol < 45)::INT + (oi_mcap_pct > 3)::INT + (basis > 15)::INT + (long_pct > 65)::INT"


@query("deriv_confluence", sql(f"SELECT series_id, open_time_ms, {_BULL} AS bullish, {_BEAR} AS bearish, CASE WHEN {_BULL} >= 4 THEN 'bottom' WHEN {_BEAR} >= 4 THEN 'top' ELSE 'none' END AS confluence FROM q_dm"))
def deriv_confluence(spark, d):
    return X.deriv_confluence(daily_metrics(spark, d)).select(*AT, "bullish", "bearish", "confluence")


_PREMIUM = "((greatest(0, low - open) - greatest(0, open - high)) / close + (close - open) / close / 1000)"


@query("funding_rate", sql(f"""
SELECT series_id, open_time_ms, {r('f', 'funding', 9)}, {r('f * 1095', 'funding_annual', 6)} FROM (SELECT *, greatest(-0.003, least(0.003, p + greatest(-0.0005, least(0.0005, 0.0001 - p)))) AS f FROM (SELECT *, {_PREMIUM} AS p FROM q_daily) x) y"""))
def funding_rate(spark, d):
    premium = X.premium_index(_c("low"), _c("high"), _c("open"), _c("close")) + (_c("close") - _c("open")) / _c("close") / 1000
    f = X.funding_rate(premium)
    out = I.daily(spark, d).select(*AT, (F.round(f, 9) + 0.0).alias("funding"), (F.round(X.funding_annual(f), 6) + 0.0).alias("funding_annual"))
    return out


@query("basis_annual", sql(f"""
SELECT series_id, open_time_ms, {r('b', 'basis')}, CASE WHEN b < 0 THEN 'backwardation' WHEN b < 2 THEN 'at_or_below_bill' WHEN b < 5 THEN 'flat' WHEN b <= 15 THEN 'normal_contango' ELSE 'steep_contango' END AS curve
FROM (SELECT *, (close - open) / open * (365.0 / 3000) * 100 AS b FROM q_daily) x"""))
def basis_annual(spark, d):
    b = X.basis_annual(_c("close"), _c("open"), F.lit(3000.0))
    return report(I.daily(spark, d).select(*AT, b.alias("basis"), X.curve_class(b).alias("curve")))


@query("oi_quadrant", sql(f"""
SELECT series_id, open_time_ms, CASE WHEN dp > 0 AND dv > 0 THEN 'long_build_up' WHEN dp > 0 AND dv < 0 THEN 'short_covering' WHEN dp < 0 AND dv > 0 THEN 'short_build_up' WHEN dp < 0 AND dv < 0 THEN 'long_liquidation' ELSE 'flat' END AS quadrant
FROM (SELECT *, close - lag(close) {over()} AS dp, volume - lag(volume) {over()} AS dv FROM q_daily) x"""))
def oi_quadrant(spark, d):
    return X.oi_quadrant(I.daily(spark, d), oi="volume").select(*AT, "quadrant")


@query("leverage_ratio", sql(f"""
SELECT series_id, open_time_ms, {r('oi_mcap_pct', 'ratio_pct')}, CASE WHEN oi_mcap_pct > 3 THEN 'extreme' WHEN oi_mcap_pct >= 2 THEN 'elevated' WHEN oi_mcap_pct >= 1 THEN 'moderate' ELSE 'low' END AS leverage,
       {r('dvol / sqrt(365.0)', 'daily_move')}, {r('high / close - low / close', 'risk_reversal')} FROM q_dm"""))
def leverage_ratio(spark, d):
    m = daily_metrics(spark, d)
    return report(m.select(*AT, _c("oi_mcap_pct").alias("ratio_pct"), X.leverage_class(_c("oi_mcap_pct")).alias("leverage"), X.dvol_move(_c("dvol")).alias("daily_move"),
                           (_c("high") / _c("close") - _c("low") / _c("close")).alias("risk_reversal")))


@query("funding_annual", sql(f"SELECT series_id, open_time_ms, {r('funding * 3 * 365', 'funding_annual')} FROM q_dm"))
def funding_annual(spark, d):
    return report(daily_metrics(spark, d).select(*AT, X.funding_annual(_c("funding")).alias("funding_annual")))


@query("dvol_move", sql(f"SELECT series_id, open_time_ms, {r('dvol / sqrt(365.0)', 'daily_move')} FROM q_dm"))
def dvol_move(spark, d):
    return report(daily_metrics(spark, d).select(*AT, X.dvol_move(_c("dvol")).alias("daily_move")))


@query("risk_reversal", sql(f"SELECT series_id, open_time_ms, {r('high / close - low / close', 'risk_reversal')} FROM q_dm"))
def risk_reversal(spark, d):
    m = daily_metrics(spark, d)
    return report(m.select(*AT, X.risk_reversal(_c("high") / _c("close"), _c("low") / _c("close")).alias("risk_reversal")))


# ── trend systems on daily bars ──────────────────────────────────────────────
def strict(n):
    return f"CASE WHEN row_idx >= {n} THEN avg(close) {over(f'{n - 1} PRECEDING')} END"


@query("ma_cross", sql(f"""
SELECT series_id, open_time_ms, up AS fast_above, CASE WHEN up AND NOT was THEN 'golden' WHEN NOT up AND was THEN 'death' END AS cross
FROM (SELECT *, lag(up) {over()} AS was FROM (SELECT *, {strict(50)} > {strict(200)} AS up FROM q_daily) x) y"""))
def ma_cross(spark, d):
    return X.ma_cross(I.daily(spark, d)).select(*AT, "fast_above", "cross")


def ema_cte(name, source, col, n):
    cte(name, f"""
SELECT series_id, row_idx, CAST({col} AS DOUBLE) AS e FROM {source} WHERE row_idx = 1
UNION ALL SELECT b.series_id, b.row_idx, b.{col} * (2.0::DOUBLE / {n + 1}) + p.e * (1 - 2.0::DOUBLE / {n + 1}) FROM {name} p JOIN {source} b ON b.series_id = p.series_id AND b.row_idx = p.row_idx + 1""")


for _n in (9, 12, 21, 26, 50, 200):
    ema_cte(f"q_d_ema{_n}", "q_daily", "close", _n)
cte("q_macd", "SELECT a.series_id, a.row_idx, a.e - b.e AS macd FROM q_d_ema12 a JOIN q_d_ema26 b ON a.series_id = b.series_id AND a.row_idx = b.row_idx")
ema_cte("q_macd9", "q_macd", "macd", 9)


@query("ema_stack", sql(f"""
SELECT b.series_id, b.open_time_ms, {', '.join(r(f'e{n}.e', f'ema_{n}', 4) for n in (9, 21, 50, 200))},
 CASE WHEN e9.e > e21.e AND e21.e > e50.e AND e50.e > e200.e THEN 'bullish' WHEN e9.e < e21.e AND e21.e < e50.e AND e50.e < e200.e THEN 'bearish' ELSE 'mixed' END AS stack
FROM q_daily b {' '.join(f'JOIN q_d_ema{n} e{n} ON e{n}.series_id = b.series_id AND e{n}.row_idx = b.row_idx' for n in (9, 21, 50, 200))}"""))
def ema_stack(spark, d):
    return report(X.ema_stack(I.daily(spark, d)).select(*AT, "ema_9", "ema_21", "ema_50", "ema_200", "stack"), 4)


@query("macd_hist", sql(f"""
SELECT m.series_id, b.open_time_ms, {r('macd', 'macd', 4)}, {r('macd - s.e', 'histogram', 4)} FROM q_macd m JOIN q_macd9 s ON s.series_id = m.series_id AND s.row_idx = m.row_idx JOIN q_daily b ON b.series_id = m.series_id AND b.row_idx = m.row_idx"""))
def macd_hist(spark, d):
    return report(X.macd_hist(I.daily(spark, d)).select(*AT, "macd", "histogram"), 4)


@query("rsi_momentum", sql(f"""
SELECT series_id, open_time_ms, CASE WHEN rsi > 50 AND was <= 50 THEN 'enter' WHEN rsi < 50 AND was >= 50 THEN 'exit' END AS action
FROM (SELECT series_id, open_time_ms, rsi, lag(rsi) {over()} AS was FROM q_rsi JOIN q_bars USING (series_id, row_idx)) x"""))
def rsi_momentum(spark, d):
    return X.rsi_momentum(I.hourly(spark, d)).select(*AT, "action")


@query("atr_regime", sql(f"""
SELECT series_id, open_time_ms, {r('a', 'atr_pct')}, CASE WHEN a < 2 THEN 'quiet' WHEN a <= 4 THEN 'normal' WHEN a <= 8 THEN 'volatile' ELSE 'extreme' END AS atr_regime FROM (
SELECT *, avg(tr) {over('13 PRECEDING')} / close * 100 AS a FROM (SELECT *, greatest(high - low, abs(high - lag(close) {over()}), abs(low - lag(close) {over()})) AS tr FROM q_bars) x) y"""))
def atr_regime(spark, d):
    return report(X.atr_regime(I.hourly(spark, d)).select(*AT, "atr_pct", "atr_regime"))


cte("q_bb", f"""
SELECT *, mid + 2 * sd AS bb_upper, mid - 2 * sd AS bb_lower, sd * 4 / mid AS bb_width FROM (
SELECT *, avg(close) {over('19 PRECEDING')} AS mid, coalesce(stddev_samp(close) {over('19 PRECEDING')}, 0.0) AS sd, avg(volume) {over('BETWEEN 20 PRECEDING AND 1 PRECEDING')} AS mv FROM q_bars) x
""")
cte("q_bb2", f"SELECT *, avg(bb_width) {over('179 PRECEDING')} AS wm, min(bb_width) {over('179 PRECEDING')} AS wl, lag(bb_width) {over()} AS wp FROM q_bb")


@query("bb_squeeze", sql(f"SELECT series_id, open_time_ms, {r('bb_width', 'bb_width')}, row_idx >= 180 AND (bb_width < wm * 0.4 OR bb_width <= wl) AS squeeze FROM q_bb2"))
def bb_squeeze(spark, d):
    return report(X.bollinger(I.hourly(spark, d)).select(*AT, "bb_width", "squeeze"))


@query("breakout_volume", sql("""
SELECT series_id, open_time_ms, CASE WHEN row_idx > 20 AND bb_width > wp AND volume >= mv * 1.5 THEN CASE WHEN close > bb_upper THEN 'up' WHEN close < bb_lower THEN 'down' END END AS breakout FROM q_bb2"""))
def breakout_volume(spark, d):
    return X.bollinger(I.hourly(spark, d)).select(*AT, "breakout")


@query("donchian", sql(f"""
SELECT series_id, open_time_ms, CAST(coalesce(last_value(act IGNORE NULLS) {over('UNBOUNDED PRECEDING')}, 0) AS INTEGER) AS position FROM (
SELECT *, CASE WHEN row_idx > 20 THEN CASE WHEN close > max(high) {over('BETWEEN 20 PRECEDING AND 1 PRECEDING')} THEN 1 WHEN close < min(low) {over('BETWEEN 10 PRECEDING AND 1 PRECEDING')} THEN 0 END END AS act FROM q_bars) x"""))
def donchian(spark, d):
    return X.donchian(I.hourly(spark, d)).select(*AT, "position")


_CUM_SV = f"sum(sv) {over('UNBOUNDED PRECEDING')}"


@query("obv", sql(f"SELECT series_id, open_time_ms, {r(_CUM_SV, 'obv')} FROM (SELECT *, coalesce(sign(close - lag(close) {over()}), 0) * volume AS sv FROM q_bars) x"))
def obv(spark, d):
    return report(X.obv(I.hourly(spark, d)).select(*AT, "obv"))


PAIRS = (("A", "N"), ("A", "R"), ("N", "R"))


@query("rolling_corr", sql(f"""
SELECT pair, open_time_ms, CASE WHEN n = 30 THEN round(c, 6) + 0.0 END AS corr FROM (
SELECT *, corr(a, b) OVER (PARTITION BY pair ORDER BY open_time_ms ROWS 29 PRECEDING) AS c, count(*) OVER (PARTITION BY pair ORDER BY open_time_ms ROWS 29 PRECEDING) AS n
FROM (SELECT x.series_id || '-' || y.series_id AS pair, x.open_time_ms, x.close AS a, y.close AS b FROM q_daily x JOIN q_daily y ON x.open_time_ms = y.open_time_ms AND x.series_id < y.series_id) z) w"""))
def rolling_corr(spark, d):
    pairs = with_row_index(X.paired(I.daily(spark, d), PAIRS), ("pair",), ("open_time_ms",), span=4096 * 86_400_000)
    return report(X.rolling_corr(pairs, "a", "b", keys=("pair",)).select("pair", "open_time_ms", "corr"))


# ── schedules, sizing, cycles ────────────────────────────────────────────────
cte("q_weeks", """
SELECT series_id, (open_time_ms // 86400000 + 3) // 7 AS week, first(close ORDER BY open_time_ms) AS price, first(low / high * 100 ORDER BY open_time_ms) AS fg FROM q_daily GROUP BY 1, 2
""")
_DCA = """
SELECT series_id, count(*) AS weeks, sum(a) AS invested, {units}, {value}, {ret} FROM (SELECT *, {amount} AS a FROM q_weeks) x GROUP BY 1"""


def _dca_sql(amount):
    last = "last(price ORDER BY week)"
    return sql(_DCA.format(amount=amount, units=r("sum(a / price)", "units"), value=r(f"sum(a / price) * {last}", "value", 4), ret=r(f"(sum(a / price) * {last} / sum(a) - 1) * 100", "return_pct", 4)))


def _weeks(spark, d):
    return X.weekly_first(I.daily(spark, d), [(_c("low") / _c("high") * 100).alias("fg")])


def _dca_report(df):
    return df.select("series_id", "weeks", "invested", (F.round("units", 6) + 0.0).alias("units"), (F.round("value", 4) + 0.0).alias("value"), (F.round("return_pct", 4) + 0.0).alias("return_pct"))


@query("dca_flat", _dca_sql("100.0::DOUBLE"))
def dca_flat(spark, d):
    return _dca_report(X.dca(_weeks(spark, d), X.FLAT_BUY))


@query("dca_fg_weighted", _dca_sql("(CASE WHEN fg < 25 THEN 150 WHEN fg < 45 THEN 100 WHEN fg < 55 THEN 75 WHEN fg < 75 THEN 50 ELSE 25 END)::DOUBLE"))
def dca_fg_weighted(spark, d):
    return _dca_report(X.dca(_weeks(spark, d), X.fg_amount(_c("fg"))))


@query("value_averaging", sql(f"""
SELECT series_id, week, k, {r('k * 500.0 - coalesce((k - 1) * 500.0 * price / prev, 0)', 'trade', 4)} FROM (
SELECT *, row_number() OVER w AS k, lag(price) OVER w AS prev FROM q_weeks WINDOW w AS (PARTITION BY series_id ORDER BY week)) x"""))
def value_averaging(spark, d):
    return report(X.value_averaging(_weeks(spark, d)).select("series_id", "week", "k", "trade"), 4)


@query("kelly", sql(f"""
SELECT model_version, horizon, {r('w', 'win_rate')}, {r('a / l', 'win_loss_ratio')}, {r('w - (1 - w) / (a / l)', 'kelly')}, {r('(w - (1 - w) / (a / l)) / 2', 'half_kelly')}, {r('(w - (1 - w) / (a / l)) / 4', 'quarter_kelly')}
FROM (SELECT model_version, horizon, avg(CAST(signed > 0 AS INTEGER)) AS w, avg(signed) FILTER (signed > 0) AS a, avg(-signed) FILTER (signed < 0) AS l FROM q_resolved GROUP BY 1, 2) x"""))
def kelly(spark, d):
    return report(X.kelly(D.scored(spark, d), ("model_version", "horizon")))


@query("position_size", sql(f"SELECT series_id, open_time_ms, {r('10000 * 0.01 / nullif((close - low) / close, 0)', 'size', 4)} FROM q_daily"))
def position_size(spark, d):
    size = X.position_size(10000.0, 0.01, (_c("close") - _c("low")) / _c("close"))
    return report(I.daily(spark, d).select(*AT, size.alias("size")), 4)


@query("rebalance_drift", sql(f"""
SELECT series_id, open_time_ms, {r('g / (g + 0.8)', 'share')}, abs(g / (g + 0.8) - 0.2) > 0.05 AS rebalance FROM (SELECT *, 0.2 * close / first_value(close) {over('UNBOUNDED PRECEDING')} AS g FROM q_daily) x"""))
def rebalance_drift(spark, d):
    return report(X.rebalance_drift(I.daily(spark, d)).select(*AT, "share", "rebalance"))


cte("q_cycle", f"SELECT *, {strict(111)} AS m111, {strict(200)} AS m200, {strict(350)} AS m350, {strict(730)} AS m730, {strict(1400)} AS m1400 FROM q_daily")


def _cycle(name, cols, body):
    def run(spark, d):
        return report(X.cycle_indicators(I.daily(spark, d)).select(*AT, *cols))

    query(name, sql(f"SELECT series_id, open_time_ms, {body} FROM (SELECT *, (m1400 / lag(m1400, 28) {over()} - 1) * 100 AS gr FROM q_cycle) x"))(run)


_cycle("pi_cycle", ["pi_top"], "m111 > m350 * 2 AS pi_top")
_cycle("mayer", ["mayer", "mayer_zone"], r("close / m200", "mayer") + """, CASE WHEN m200 IS NOT NULL THEN CASE WHEN close / m200 < 0.8 THEN 'extreme_low' WHEN close / m200 < 1 THEN 'low' WHEN close / m200 < 1.5 THEN 'fair'
  WHEN close / m200 < 2 THEN 'elevated' WHEN close / m200 <= 2.4 THEN 'high' WHEN close / m200 <= 3 THEN 'bubble' ELSE 'extreme_high' END END AS mayer_zone""")
_cycle("ma200w_growth", ["ma200w_growth_pct"], r("gr", "ma200w_growth_pct"))
_cycle("ma2y_bands", ["ma2y_band"], "CASE WHEN close < m730 THEN 'below' WHEN close > m730 * 5 THEN 'above_5x' WHEN m730 IS NOT NULL THEN 'between' END AS ma2y_band")


@query("rainbow_fit", sql(f"""
SELECT series_id, open_time_ms, {r('res', 'residual')}, CAST(least(floor((res - lo) / (hi - lo) * 9), 8) AS INTEGER) AS band FROM (
SELECT *, min(res) OVER (PARTITION BY series_id) AS lo, max(res) OVER (PARTITION BY series_id) AS hi FROM (
SELECT b.*, ln(close) - (slope * ln(row_idx) + icept) AS res FROM q_daily b JOIN (SELECT series_id, regr_slope(ln(close), ln(row_idx)) AS slope, regr_intercept(ln(close), ln(row_idx)) AS icept FROM q_daily GROUP BY 1) f USING (series_id)) x) y"""))
def rainbow_fit(spark, d):
    return report(X.rainbow_fit(I.daily(spark, d)).select(*AT, "residual", "band"))


TIMING = {
    "nupl": "(close - open) / close",
    "mvrv_z": "high / close",
    "pi_ratio": "close / open / 2",
    "ma200w_ratio": "low / open",
    "rhodl": "volume * close / 100",
    "ma2y_ratio": "close / high * 2",
    "fear_greed": "low / high * 100",
}
_BUYS = "(nupl < 0)::INT + (mvrv_z < 1)::INT + (ma200w_ratio <= 1)::INT + (rhodl < 10)::INT + (ma2y_ratio < 1)::INT + (fear_greed < 20)::INT"
_SELLS = "(nupl > 0.75)::INT + (mvrv_z > 6)::INT + (pi_ratio > 1)::INT + (rhodl > 50000)::INT + (ma2y_ratio > 5)::INT + (fear_greed > 80)::INT"


@query("composite_timing", sql(f"""
SELECT series_id, open_time_ms, {_BUYS} AS buys, {_SELLS} AS sells, CASE WHEN {_BUYS} >= 4 THEN 'buy' WHEN {_SELLS} >= 4 THEN 'sell' ELSE 'none' END AS timing
FROM (SELECT series_id, open_time_ms, {', '.join(f'{v} AS {k}' for k, v in TIMING.items())} FROM q_daily) x"""))
def composite_timing(spark, d):
    rows = I.daily(spark, d).selectExpr(*AT, *[f"{v} AS {k}" for k, v in TIMING.items()])
    return X.composite_timing(rows).select(*AT, "buys", "sells", "timing")


@query("onchain_ratios", sql(f"""
SELECT series_id, open_time_ms, {r('close / open', 'mvrv')}, {r('high / low', 'sopr')}, {r('(close - open) / close', 'nupl')}, {r(f"volume / avg(volume) {over('364 PRECEDING')}", 'puell')} FROM q_daily"""))
def onchain_ratios(spark, d):
    rows = I.daily(spark, d).selectExpr("series_id", "open_time_ms", "row_idx", "close AS market_cap", "open AS realized_cap", "high AS spent_value", "low AS created_value", "volume AS issuance")
    return report(X.onchain_ratios(rows).select(*AT, "mvrv", "sopr", "nupl", "puell"))


@query("confidence_buckets", sql(f"""
SELECT CASE WHEN q >= 0.6 THEN '60%+' WHEN q >= 0.4 THEN '40-59%' WHEN q >= 0.3 THEN '30-39%' ELSE '<30%' END AS band, year(t)::VARCHAR || 'Q' || quarter(t)::VARCHAR AS quarter, count(*) AS n, {r('avg(o)', 'resolve_rate')}, {r('avg((q - o) * (q - o))', 'brier')}
FROM (SELECT *, make_timestamp(issued_ms * 1000) AS t, (p - 0.5) * 20 AS q FROM q_resolved) x GROUP BY 1, 2"""))
def confidence_buckets(spark, d):
    stated = D.scored(spark, d).withColumn("p", (_c("p") - 0.5) * 20)
    return report(X.confidence_buckets(stated))
