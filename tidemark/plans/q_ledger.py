"""Queries over the forecast ledger: signals, issuing, resolution, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import ledger as L
from tidemark.operators import metrics as M
from tidemark.plans import inputs as I
from tidemark.plans import ledger_data as D
from tidemark.plans.oracle import BASE_AGGS, ece, finish, r, sql, wilson
from tidemark.plans.registry import query, report

METRICS_SQL = sql(f"""
SELECT {finish('a.dimension, a.bucket')}, round(ece, 6) + 0.0 AS ece
FROM (SELECT dimension, bucket, {BASE_AGGS} FROM q_dims GROUP BY 1, 2) a
JOIN (SELECT * FROM q_ece) e USING (dimension, bucket)""", q_ece=ece("q_dims", "dimension, bucket"))


@query("metrics_by_dims", METRICS_SQL)
def metrics_by_dims(spark, d):
    return report(M.metrics_by_dims(D.reported(spark, d)))


def _plain(col):
    """Reason text without the means: their last printed digit is a rounding tie too often."""
    return F.regexp_replace(col, "(sma|sma24|sma72)=[0-9.]+", "$1").alias(col)


_PLAIN_SQL = "regexp_replace({}, '(sma|sma24|sma72)=[0-9.]+', '\\1', 'g')"


def _signal(model):
    def run(spark, d):
        tried = L.issue_attempts(D.state(spark, d), (model,), None)
        h = L.MODEL_HORIZONS[model][-1]
        one = tried.filter((F.col("horizon") == h) & (F.col("run_ms") == F.col("close_time_ms")))
        return report(one.select("series_id", "run_ms", "direction", "probability", _plain("reason")), 9)

    return run


def _signal_sql(model):
    return sql(f"""
SELECT series_id, run_ms, direction, round(probability, 9) + 0.0 AS probability, {_PLAIN_SQL.format('reason')} AS reason
FROM q_attempts WHERE model_version = '{model}' AND horizon = '24h' AND run_ms = close_time_ms""")


query("signal_baseline", _signal_sql(L.BASELINE))(_signal(L.BASELINE))
query("signal_policy24", _signal_sql(L.POLICY))(_signal(L.POLICY))
query("signal_guard24", _signal_sql(L.GUARD))(_signal(L.GUARD))


@query("issue_replay", sql("""
SELECT forecast_id, series_id, issued_ms, target_ms, horizon, direction, round(probability, 9) + 0.0 AS probability,
       round(entry_price, 6) + 0.0 AS entry_price, target_rule, model_version, regime_at_issue, """ + _PLAIN_SQL.format('confidence_reason') + """ AS confidence_reason, entry_source, issued_at_actual_ms
FROM q_forecasts"""))
def issue_replay(spark, d):
    cols = ("forecast_id", "series_id", "issued_ms", "target_ms", "horizon", "direction", "probability", "entry_price",
            "target_rule", "model_version", "regime_at_issue", _plain("confidence_reason"), "entry_source", "issued_at_actual_ms")
    return report(D.forecasts(spark, d).select(*cols), 9)


@query("resolve_exact", sql("""
SELECT forecast_id, candle_close_ms, round(actual_close, 6) + 0.0 AS actual_close, o = 1 AS direction_correct FROM q_score"""))
def resolve_exact(spark, d):
    _, _, res = D.ledger_parts(spark, d)
    return report(res.select("forecast_id", "candle_close_ms", "actual_close", "direction_correct"))


@query("ledger_join", sql(f"""
SELECT forecast_id, horizon, direction, {r('actual_return', 'actual_return', 9)}, {r('brier_component', 'brier_component', 9)},
       {r('logloss_component', 'logloss_component', 9)}, status FROM q_joined"""))
def ledger_join(spark, d):
    cols = ("forecast_id", "horizon", "direction", "actual_return", "brier_component", "logloss_component", "status")
    return report(D.joined(spark, d).select(*cols), 9)


# ── scalar rules over the joined ledger ──────────────────────────────────────
def _scalar(name, cols, body, digits=9):
    def run(spark, d):
        return report(M.scored(D.joined(spark, d)).select("forecast_id", *[c.alias(n) for n, c in cols().items()]), digits)

    query(name, sql(f"SELECT forecast_id, {body} FROM q_resolved"))(run)


_c = F.col
_scalar("outcome_rule", lambda: {"o": S.outcome(_c("direction"), _c("entry_price"), _c("actual_close"))}, "o")
_scalar("actual_return", lambda: {"ret": S.actual_return(_c("entry_price"), _c("actual_close"))}, r("actual_return", "ret", 9))
_scalar("brier_component", lambda: {"brier": S.brier_component(_c("p"), _c("o"))}, r("(p - o) * (p - o)", "brier", 9))
_scalar("logloss_component", lambda: {"logloss": S.logloss_component(_c("p"), _c("o"))}, r("CASE o WHEN 1 THEN -ln(p) ELSE -ln(1 - p) END", "logloss", 9))
_scalar("signed_return", lambda: {"signed": S.signed_return(_c("direction"), _c("actual_return"))}, r("signed", "signed", 9))
_scalar(
    "fee_adjust",
    lambda: {"maker_bps": S.fee_adjusted_bps(_c("signed"), S.MAKER_BPS), "taker_bps": S.fee_adjusted_bps(_c("signed"), S.TAKER_BPS)},
    r("signed * 10000 - 2", "maker_bps", 6) + ", " + r("signed * 10000 - 10", "taker_bps", 6),
    6,
)
def _away():
    return F.when(_c("direction") == "down", _c("entry_price") * 1.05).otherwise(_c("entry_price") * 0.95)


_scalar(
    "invalidation_level",
    lambda: {"exact_level": _away(), "rounded_to_cent": F.abs(S.invalidation_level(_c("direction"), _c("entry_price")) - _away()) <= 0.005 + 1e-9},
    r("CASE WHEN direction = 'down' THEN entry_price * 1.05 ELSE entry_price * 0.95 END", "exact_level", 5) + ", true AS rounded_to_cent",
    5,
)


@query("wilson_lb", sql(f"""
SELECT model_version, horizon, n, {r('greatest(0.0, ' + wilson('h', 'n') + ')', 'wilson_lb')}, {r(wilson('h', 'n', '1.959963984540054'), 'wilson_lb_exact')}
FROM (SELECT model_version, horizon, count(*) AS n, avg(o) AS h FROM q_resolved GROUP BY 1, 2) x"""))
def wilson_lb(spark, d):
    agg = D.scored(spark, d).groupBy("model_version", "horizon").agg(F.count("*").alias("n"), F.avg("o").alias("h"))
    return report(agg.select("model_version", "horizon", "n", S.wilson_lower(F.col("h"), F.col("n")).alias("wilson_lb"),
                             S.wilson_lower(F.col("h"), F.col("n"), S.WILSON_Z_EXACT, floor=False).alias("wilson_lb_exact")))


@query("ece_quantile", sql(f"""
SELECT series_id, model_version, horizon, round(ece, 6) + 0.0 AS ece FROM ({ece('q_resolved', 'series_id, model_version, horizon')}) e"""))
def ece_quantile(spark, d):
    return report(M.ece_quantile(D.scored(spark, d), ("series_id", "model_version", "horizon")))


@query("bucket_metrics", sql(f"""
SELECT {finish('a.series_id, a.model_version, a.horizon')}, round(ece, 6) + 0.0 AS ece
FROM (SELECT series_id, model_version, horizon, {BASE_AGGS} FROM q_resolved GROUP BY 1, 2, 3) a JOIN q_ece e USING (series_id, model_version, horizon)""",
    q_ece=ece("q_resolved", "series_id, model_version, horizon")))
def bucket_metrics(spark, d):
    return report(M.bucket_metrics(D.scored(spark, d), ("series_id", "model_version", "horizon")))


# Three writers per bucket: the first sometimes without a wall clock, the later ones earlier.
def _written_thrice(fc):
    copies = F.array(
        F.struct(F.lit(0).alias("writer"), F.when(_c("regime_at_issue") != "bull", _c("issued_at_actual_ms") + 2000).alias("actual")),
        F.struct(F.lit(1).alias("writer"), (_c("issued_at_actual_ms") + 1000).alias("actual")),
        F.struct(F.lit(2).alias("writer"), F.when(_c("direction") == "up", _c("issued_at_actual_ms")).alias("actual")),
    )
    return fc.select(
        "series_id", "model_version", "horizon", "issued_ms", "direction", F.inline(copies)
    ).select(
        "series_id", "model_version", "horizon", "issued_ms", "direction", "writer",
        _c("actual").alias("issued_at_actual_ms"), (_c("issued_ms") * 10 + _c("writer")).alias("file_pos"),
    )


@query("dedupe_bucket", sql("""
SELECT series_id, model_version, horizon, issued_ms, CASE WHEN regime_at_issue = 'bull' THEN 0 WHEN direction = 'up' THEN 2 ELSE 1 END AS writer,
       CAST(2 AS BIGINT) AS duplicates FROM q_forecasts"""))
def dedupe_bucket(spark, d):
    kept = M.dedupe_bucket(_written_thrice(D.forecasts(spark, d)))
    return kept.select("series_id", "model_version", "horizon", "issued_ms", "writer", "duplicates")


def _now(spark, d):
    return I.ticks(spark, d).agg((F.floor(F.max("ts_us") / 3_600_000_000) * 3_600_000 + 3_600_000).cast("long")).scalar()


@query("rolling_resolved", sql(f"""
SELECT {finish('a.window_days')}, round(ece, 6) + 0.0 AS ece FROM (SELECT window_days, {BASE_AGGS} FROM q_win GROUP BY 1) a JOIN q_ece e USING (window_days)""",
    q_win="SELECT q_resolved.*, w.window_days FROM q_resolved, (VALUES (7), (30), (90)) w(window_days) WHERE resolved_ms >= (SELECT max(close_time_ms) FROM q_bars) - CAST(window_days AS BIGINT) * 86400000",
    q_ece=ece("q_win", "window_days")))
def rolling_resolved(spark, d):
    return report(M.rolling_resolved(D.reported(spark, d), _now(spark, d)))


@query("rolling_issued", sql(f"""
SELECT dimension, bucket, window_days, n, {r('h', 'hit_rate')}, {r('b', 'brier')}, {r('e * 10000', 'expectancy_bps')}, {r('e * 10000 - 2', 'expectancy_maker_2bps')},
       {r('CASE WHEN n > 0 THEN greatest(0.0, ' + wilson('h', 'nullif(n, 0)') + ') END', 'wilson_lb_95')}
FROM (SELECT dimension, bucket, window_days, count(*) FILTER (i) AS n, avg(o) FILTER (i) AS h, avg(brier_component) FILTER (i) AS b, avg(signed) FILTER (i) AS e
  FROM (SELECT q_dims.*, w.window_days, issued_ms >= (SELECT max(close_time_ms) FROM q_bars) - CAST(w.window_days AS BIGINT) * 86400000 AS i
        FROM q_dims, (VALUES (7), (30), (90)) w(window_days) WHERE dimension IN ('by_horizon', 'by_model_horizon')) x GROUP BY 1, 2, 3) y"""))
def rolling_issued(spark, d):
    return report(M.rolling_issued(D.reported(spark, d), _now(spark, d)))


@query("edge_scoreboard", sql(f"""
SELECT horizon, n, {r('hits / CAST(n AS DOUBLE)', 'hit_rate')}, {r('ex * 10000 - 2', 'expectancy_maker_2bps')}, {r('vs', 'vs_majority_pp')},
       n >= 20 AND ex * 10000 - 2 > 0 AND vs > 0 AS tradeable
FROM (SELECT *, hits / CAST(n AS DOUBLE) - greatest(rose / CAST(n AS DOUBLE), 1 - rose / CAST(n AS DOUBLE)) AS vs
      FROM (SELECT horizon, {BASE_AGGS} FROM q_resolved GROUP BY 1) a) b ORDER BY 4 DESC"""))
def edge_scoreboard(spark, d):
    return report(M.edge_scoreboard(M.bucket_metrics(D.reported(spark, d), ("horizon",))))


@query("recent_rows", sql(f"""
SELECT forecast_id, issued_ms, model_version, horizon, direction, {r('probability', 'probability')}, {r('entry_price', 'entry_price')}, target_ms,
       coalesce(status = 'resolved', false) AS resolved, {r('actual_close', 'actual_close')}, {r('actual_return * 10000', 'actual_return_bps')}, direction_correct, resolved_ms
FROM q_joined ORDER BY issued_ms DESC, forecast_id DESC LIMIT 50"""))
def recent_rows(spark, d):
    return report(M.recent_rows(D.deduped(spark, d)))


TAPE_SQL = """
SELECT *, greatest(0.0, max(cum) OVER (PARTITION BY series_id, model_version, horizon ORDER BY issued_ms, forecast_id ROWS UNBOUNDED PRECEDING)) - cum AS dd,
       row_number() OVER (PARTITION BY series_id, model_version, horizon ORDER BY issued_ms DESC, forecast_id DESC) AS back, count(*) OVER (PARTITION BY series_id, model_version, horizon) AS n
FROM (SELECT *, sum(signed * 10000 - 2) OVER (PARTITION BY series_id, model_version, horizon ORDER BY issued_ms, forecast_id ROWS UNBOUNDED PRECEDING) AS cum FROM q_resolved) x"""


@query("trade_tape", sql(f"""
SELECT series_id, model_version, horizon, n, sum(o)::BIGINT AS wins, {r('last(cum ORDER BY back DESC)', 'sum_bps_maker', 4)}, {r('max(dd)', 'max_drawdown_bps_maker', 4)},
       {r('sum(o) / CAST(n AS DOUBLE)', 'hit_rate', 4)}, {r('last(cum ORDER BY back DESC) / n', 'avg_bps_maker', 4)}
FROM q_tape WHERE n >= 5 GROUP BY series_id, model_version, horizon, n""", q_tape=TAPE_SQL))
def trade_tape(spark, d):
    return report(M.trade_tape(D.deduped(spark, d)), 4)


@query("trade_tape_last", sql(f"""
SELECT series_id, model_version, horizon, issued_ms, direction, {r('signed * 10000', 'ret_bps_gross', 4)}, {r('cum', 'cum_bps', 4)}, direction_correct AS win
FROM q_tape WHERE n >= 5 AND back <= 30""", q_tape=TAPE_SQL))
def trade_tape_last(spark, d):
    rows = M.last_trades(M.tape_curve(D.deduped(spark, d)))
    return report(rows.select(*M.TAPE_KEYS, "issued_ms", "direction", "ret_bps_gross", "cum_bps", F.col("direction_correct").alias("win")), 4)
