"""Model validation queries: folds, baselines, fits, calibration, gates, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import drift as DR
from tidemark.operators import features as X
from tidemark.operators import fits as FT
from tidemark.operators import gates as G
from tidemark.operators import modeling as M
from tidemark.operators import regime as R
from tidemark.plans import inputs as I
from tidemark.plans.oracle import cte, r, sql, wilson
from tidemark.plans.q_series import aux_series, over
from tidemark.plans.registry import query, report

_c = F.col
KEYS = ("series_id", "horizon")
N_FOLDS, EMBARGO, MIN_TRAIN = 5, 4, 60
ML_HORIZONS = ("12h", "24h")


def _purge():
    bars = F.lit(None).cast("long")
    for h, n in X.HORIZON_BARS.items():
        bars = F.when(_c("horizon") == h, n).otherwise(bars)
    return bars


def labelled(spark, d):
    bars = I.hourly(spark, d)
    return I.derived(spark, d, "labelled", lambda: M.labelled_rows(X.feature_frame(bars, aux_series(spark, d)), X.direction_target(bars)))


def folds(spark, d):
    sizes = labelled(spark, d).groupBy(*KEYS).agg(F.count("*").alias("n_rows"))
    return M.walk_forward(sizes, KEYS, N_FOLDS, _purge(), EMBARGO, MIN_TRAIN)


def placed(spark, d):
    return I.derived(spark, d, "placed", lambda: M.fold_join(labelled(spark, d), folds(spark, d), KEYS))


def rules(spark, d):
    return I.derived(spark, d, "rule_predictions", lambda: M.rule_predictions(placed(spark, d), KEYS))


cte("q_feat", f"""
SELECT series_id, row_idx, open_time_ms, close, lr, rsi / 100.0 AS rsi, (close - ema) / ema AS emad, coarse AS regime,
       (close - avg(close) {over('23 PRECEDING')}) / avg(close) {over('23 PRECEDING')} AS s24 FROM q_feature_base
""")
cte("q_lab", "SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY open_time_ms) - 1 AS i, count(*) OVER (PARTITION BY series_id, horizon) AS n_rows, CAST(exit > close AS INTEGER) AS y FROM ("
    + " UNION ALL ".join(f"SELECT *, '{h}' AS horizon, {n} AS h, lead(close, {n}) {over()} AS exit FROM q_feat" for h, n in X.HORIZON_BARS.items()) + ") x WHERE exit IS NOT NULL")
cte("q_folds", """
SELECT series_id, horizon, fold_id, greatest(0, st - h) AS train_end, st + 4 AS test_start, st + sz AS test_end FROM (
SELECT *, 60 + fold_id * sz AS st FROM (
SELECT DISTINCT series_id, horizon, h, n_rows, greatest(1, CAST(floor((n_rows - 60) / 5.0) AS BIGINT)) AS sz, f.fold_id FROM q_lab, (SELECT unnest([0, 1, 2, 3, 4]) AS fold_id) f) a) b
WHERE st + sz <= n_rows AND greatest(0, st - h) >= 60 AND st + 4 < st + sz
""")
cte("q_placed", """
SELECT l.*, f.fold_id, CASE WHEN i < train_end THEN 'train' WHEN i >= test_start AND i < test_end THEN 'test' END AS part
FROM q_lab l JOIN q_folds f ON l.series_id = f.series_id AND l.horizon = f.horizon WHERE i < train_end OR (i >= test_start AND i < test_end)
""")
cte("q_rates", "SELECT series_id, horizon, fold_id, avg(y) AS rate, count(*) AS n_train FROM q_placed WHERE part = 'train' GROUP BY 1, 2, 3")
P_SQL = {
    "majority": "greatest(0.05, least(0.95, rate))",
    "last_direction": "CASE WHEN lr > 0 THEN 0.55::DOUBLE WHEN lr < 0 THEN 0.45 ELSE 0.5 END",
    "momentum": "greatest(0.05, least(0.95, 1 / (1 + exp(-25 * lr))))",
    "mean_reversion": "greatest(0.05, least(0.95, 1 / (1 + exp(25 * lr))))",
    "siie_lite": """greatest(0.05, least(0.95, 0.5 + 0.5 * tanh(8 * emad) + CASE WHEN rsi > 0.4 AND rsi < 0.7 THEN 0.05 WHEN rsi > 0.3 AND rsi < 0.6 THEN -0.02 ELSE 0.0 END
      + CASE regime WHEN 'bull' THEN 0.03 WHEN 'bear' THEN -0.03 ELSE 0.0 END))""",
    "sma24_rule": "CASE WHEN s24 >= 0 THEN 0.55::DOUBLE ELSE 0.45 END",
    "random": "CAST('0x' || substr(md5(concat_ws('|', t.series_id, t.horizon, t.fold_id, t.i, 1337)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE",
}
cte("q_preds", " UNION ALL ".join(
    f"SELECT t.series_id, t.horizon, t.fold_id, t.i, t.open_time_ms, t.y, t.regime, t.close AS entry, t.exit, '{m}' AS model, {p} AS p, h FROM q_placed t JOIN q_rates g ON t.series_id = g.series_id AND t.horizon = g.horizon AND t.fold_id = g.fold_id WHERE part = 'test'"
    for m, p in P_SQL.items()))
EVAL_SQL = f"""count(*) AS n, {r('avg(CAST(CAST(p >= 0.5 AS INTEGER) = y AS INTEGER))', 'hit_rate')}, {r('avg((p - y) * (p - y))', 'brier')},
 {r('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))', 'log_loss')}, {r('avg(y)', 'base_rate')}"""


@query("walk_forward", sql("SELECT * FROM q_folds"))
def walk_forward(spark, d):
    return folds(spark, d)


@query("fold_join", sql("SELECT series_id, horizon, fold_id, part, count(*) AS n, min(i) AS first_i, max(i) AS last_i FROM q_placed GROUP BY 1, 2, 3, 4"))
def fold_join(spark, d):
    rows = M.fold_join(labelled(spark, d), folds(spark, d), KEYS)
    return rows.groupBy(*KEYS, "fold_id", "part").agg(F.count("*").alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


_SCALED = {"log_return_1": "lr", "rsi_14": "rsi", "ema_distance": "emad", "sma24_rel": "s24"}


@query("scaler_train_only", sql(" UNION ALL ".join(
    f"SELECT series_id, horizon, fold_id, '{f}' AS feature, {r(f'avg({c})', 'mean', 8)}, {r(f'CASE WHEN stddev_samp({c}) > 1e-9 THEN stddev_samp({c}) ELSE 1.0 END', 'std', 8)} FROM q_placed WHERE part = 'train' GROUP BY 1, 2, 3"
    for f, c in _SCALED.items())))
def scaler_train_only(spark, d):
    return report(M.scaler_train_only(placed(spark, d), KEYS, list(_SCALED)), 8)


def _baseline(model):
    def run(spark, d):
        return report(rules(spark, d).filter(_c("model") == model).select(*KEYS, "fold_id", "i", "p", "y"), 8)

    query(f"base_{model}", sql(f"SELECT series_id, horizon, fold_id, i, {r('p', 'p', 8)}, y FROM q_preds WHERE model = '{model}'"))(run)


for _m in P_SQL:
    _baseline(_m)


@query("oof_validation", sql(f"""
SELECT horizon, model, 'fold' AS level, CAST(fold_id AS VARCHAR) AS part, {EVAL_SQL} FROM q_preds GROUP BY horizon, model, fold_id
UNION ALL SELECT horizon, model, 'regime', regime, {EVAL_SQL} FROM q_preds GROUP BY horizon, model, regime
UNION ALL SELECT horizon, model, 'pooled', 'all', {EVAL_SQL} FROM q_preds GROUP BY horizon, model"""))
def oof_validation(spark, d):
    return report(M.oof_validation(rules(spark, d)))


def _diagram_sql(keys):
    return f"""
SELECT {keys}, b.bin, coalesce(c, 0) AS count, ap, ay FROM (SELECT DISTINCT {keys} FROM q_preds) k CROSS JOIN (SELECT unnest(range(10))::INTEGER AS bin) b
LEFT JOIN (SELECT {keys}, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS c, avg(p) AS ap, avg(y) AS ay FROM q_preds GROUP BY ALL) x USING ({keys}, bin)"""


cte("q_diagram", _diagram_sql("horizon, model"))
cte("q_ece_fixed", """
SELECT horizon, model, CASE WHEN sum(count) >= 20 AND count(*) >= 3 THEN sum(count * abs(ap - ay)) / sum(count) END AS ece, CAST(sum(count) AS BIGINT) AS n FROM q_diagram WHERE count > 0 GROUP BY 1, 2
""")
_HM = ("horizon", "model")


@query("reliability_diagram", sql(f"SELECT horizon, model, bin, bin / 10.0::DOUBLE AS lower, (bin + 1) / 10.0::DOUBLE AS upper, count, {r('ap', 'avg_prob')}, {r('ay', 'avg_outcome')} FROM q_diagram"))
def reliability_diagram(spark, d):
    return report(M.reliability_diagram(rules(spark, d), _HM))


@query("reliability_slim", sql(f"SELECT horizon, model, bin, count, {r('ap', 'avg_prob')}, {r('ay', 'avg_outcome')} FROM q_diagram WHERE count > 0"))
def reliability_slim(spark, d):
    return report(M.reliability_slim(M.reliability_diagram(rules(spark, d), _HM)).drop("lower", "upper"))


@query("ece_fixed", sql("SELECT horizon, model, n, round(ece, 6) + 0.0 AS ece FROM q_ece_fixed"))
def ece_fixed(spark, d):
    return report(M.ece_fixed(M.reliability_diagram(rules(spark, d), _HM), _HM))


@query("eval_pack", sql(f"""
SELECT a.*, round(e.ece, 6) + 0.0 AS ece FROM (SELECT horizon, model, {EVAL_SQL} FROM q_preds GROUP BY 1, 2) a JOIN (SELECT horizon, model, ece FROM q_ece_fixed) e USING (horizon, model)"""))
def eval_pack(spark, d):
    return report(M.eval_pack(rules(spark, d), _HM))


cte("q_brier", "SELECT horizon, model, avg((p - y) * (p - y)) AS brier, avg(CAST(CAST(p >= 0.5 AS INTEGER) = y AS INTEGER)) AS hit, avg(y) AS up FROM q_preds GROUP BY 1, 2")


@query("baseline_delta", sql(f"SELECT a.horizon, a.model, b.model AS baseline, {r('b.brier - a.brier', 'delta')} FROM q_brier a JOIN q_brier b USING (horizon)"))
def baseline_delta(spark, d):
    return report(M.baseline_delta(M.eval_pack(rules(spark, d), _HM), ["horizon"]))


@query("majority_rate", sql(f"SELECT horizon, {r('greatest(avg(y), 1 - avg(y))', 'majority_rate')} FROM q_preds GROUP BY 1"))
def majority_rate(spark, d):
    return report(M.majority_rate(rules(spark, d), ["horizon"]))


@query("economics", sql(f"""
SELECT horizon, model, n, {r('hit', 'hit_rate')}, {r(wilson('hit', 'n', '1.959963984540054'), 'wilson_lb_95')}, greatest(1, n // h) AS effective_n_approx, {r('e', 'expectancy_bps')}, {r('e - 2', 'expectancy_maker_2bps')}
FROM (SELECT horizon, model, max(h) AS h, count(*) AS n, avg(CAST(s > 0 AS INTEGER)) AS hit, avg(s) AS e FROM (
SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE -1 END * (exit - entry) / entry * 10000 AS s FROM q_preds) x GROUP BY 1, 2) y"""))
def economics(spark, d):
    return report(M.economics(rules(spark, d), _HM))


@query("candidate_decision", sql(f"""
SELECT horizon, {r('hit', 'hit')}, {r('brier', 'brier')}, {r('best', 'best_baseline_brier')}, {r('maj', 'majority_rate')}, hit > maj AND brier <= best AS selected,
  concat_ws(';', CASE WHEN NOT hit > maj THEN 'hit does not beat the pooled majority' END, CASE WHEN NOT brier <= best THEN 'brier above the best baseline' END,
            CASE WHEN hit > maj AND brier <= best THEN 'hit and brier both pass' END) AS reasons FROM (
SELECT horizon, max(hit) FILTER (model = 'mean_reversion') AS hit, max(brier) FILTER (model = 'mean_reversion') AS brier, min(brier) FILTER (model <> 'mean_reversion') AS best,
       max(greatest(up, 1 - up)) FILTER (model = 'mean_reversion') AS maj FROM q_brier GROUP BY 1) x"""))
def candidate_decision(spark, d):
    preds = rules(spark, d)
    pooled = M.oof_validation(preds).filter("level = 'pooled'")
    out = M.candidate_decision(pooled, M.majority_rate(preds, _HM), ["horizon"], "mean_reversion")
    return report(out.withColumn("reasons", F.concat_ws(";", "reasons")))


# ── fitted models ────────────────────────────────────────────────────────────
def _jobs(spark, d):
    """Folds present for the fitted horizons: at most horizons x N_FOLDS pairs."""
    found = folds(spark, d).filter(_c("horizon").isin(*ML_HORIZONS)).select("horizon", "fold_id").distinct().collect()
    return [(row.horizon, row.fold_id) for row in sorted(found)]


def _ml_rows(spark, d):
    return placed(spark, d).filter(_c("horizon").isin(*ML_HORIZONS))


def _logistic(spark, d):
    return I.derived(spark, d, "fit_logistic", lambda: M.logistic_predictions(_ml_rows(spark, d)))


def _tree(spark, d):
    return I.derived(spark, d, "fit_tree", lambda: M.fitted_predictions(_ml_rows(spark, d), _jobs(spark, d), M.tree, "tree"))


@query("logistic")
def logistic(spark, d):
    return report(M.oof_validation(_logistic(spark, d)))


@query("logistic_converged", sql("""
SELECT horizon, fold_id, count(*) AS n, true AS converged, true AS no_worse FROM q_placed WHERE part = 'train' AND horizon IN ('12h', '24h') GROUP BY 1, 2"""))
def logistic_converged(spark, d):
    """The fit is convex: its gradient vanishes, and its penalised loss on the train rows is not
    above that of the best constant, which is one of its choices."""
    keys = ["horizon", "fold_id"]
    train = FT.scaled_rows(_ml_rows(spark, d), keys, X.FEATURES).filter("part = 'train'")
    found = FT.logistic_fits(train, keys, len(X.FEATURES), M.L2)
    rate = train.groupBy(*keys).agg(F.avg("y").alias("q"))
    constant = S.logloss_component(F.col("q"), F.col("q"))
    return found.join(rate, keys).select(*keys, "n", (_c("gradient") < 1e-8).alias("converged"), (_c("loss") <= constant + 1e-9).alias("no_worse"))


@query("tree_optional")
def tree_optional(spark, d):
    return report(M.oof_validation(_tree(spark, d)))


def compared(spark, d):
    """Rule models and the fitted ones in one prediction table, on the fitted horizons."""
    ours = rules(spark, d).filter(_c("horizon").isin(*ML_HORIZONS))
    fitted = [_logistic(spark, d), _tree(spark, d)]
    cols = [*KEYS, "fold_id", "i", "y", "regime", "entry", "exit", "model", "p"]
    return ours.select(cols).unionByName(fitted[0].select(cols)).unionByName(fitted[1].select(cols))


@query("oof_validation_fitted")
def oof_validation_fitted(spark, d):
    return report(M.oof_validation(compared(spark, d)))


@query("candidate_fitted", sql(f"""
SELECT horizon, n, {r('best', 'best_baseline_brier')}, {r('maj', 'majority_rate')}, true AS decided_by_rule, true AS learned FROM (
SELECT horizon, max(n) AS n, min(brier) AS best, max(greatest(up, 1 - up)) AS maj FROM (
SELECT horizon, model, count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(y) AS up FROM q_preds WHERE horizon IN ('12h', '24h') GROUP BY 1, 2) a GROUP BY 1) x"""))
def candidate_fitted(spark, d):
    """The decision on the fitted candidate: what it is compared with is exact, what it scores is
    checked by the rule itself and by a loss near that of a coin at worst."""
    preds = compared(spark, d).filter("model <> 'tree'")
    pooled = M.oof_validation(preds).filter("level = 'pooled'")
    out = M.candidate_decision(pooled, M.majority_rate(preds, _HM), ["horizon"], "logistic")
    sizes = pooled.filter("model = 'logistic'").select("horizon", "n")
    rule = _c("selected") == ((_c("hit") > _c("majority_rate")) & (_c("brier") <= _c("best_baseline_brier")))
    return report(out.join(sizes, "horizon").select("horizon", "n", "best_baseline_brier", "majority_rate", rule.alias("decided_by_rule"), (_c("brier") < 0.35).alias("learned")))


def _streams(spark, d):
    """Out-of-sample streams of every rule model whose probability is not constant, per fitted horizon."""
    return rules(spark, d).filter((_c("model") != "majority") & _c("horizon").isin(*ML_HORIZONS))


@query("platt")
def platt(spark, d):
    rows = _streams(spark, d)
    return report(M.platt_by(rows, _HM)(rows).select(*_HM, "series_id", "fold_id", "i", "p", "y"))


@query("platt_converged", sql("SELECT horizon, model, count(*) AS n, true AS converged, true AS no_worse FROM q_preds WHERE model <> 'majority' AND horizon IN ('12h', '24h') GROUP BY 1, 2"))
def platt_converged(spark, d):
    """The fit is convex: its gradient vanishes, and its log loss is not above that of the raw p."""
    rows = I.settle(_streams(spark, d))
    fits = M.platt_fits(rows, _HM)
    loss = lambda df, name: df.groupBy(*_HM).agg(F.avg(S.logloss_component(_c("p"), _c("y"))).alias(name))
    both = loss(rows, "raw").join(loss(M.platt_by(rows, _HM)(rows), "fitted"), list(_HM))
    return fits.join(both, list(_HM)).select(*_HM, "n", (_c("gradient") < 1e-8).alias("converged"), (_c("fitted") <= _c("raw") + 1e-9).alias("no_worse"))


@query("isotonic", sql(f"""
SELECT horizon, model, round(p, 8) + 0.0 AS p_raw, {r('max(least_mean)', 'p_cal')}, any_value(n) AS n FROM (
SELECT a.horizon, a.model, a.i AS first, b.i, b.p, b.m AS n, min((b.s - a.s) / (b.n - a.n)::DOUBLE) OVER (PARTITION BY a.horizon, a.model, a.i ORDER BY b.i DESC) AS least_mean
FROM q_iso_sums a JOIN q_iso_sums b ON a.horizon = b.horizon AND a.model = b.model AND a.i < b.i) x GROUP BY horizon, model, i, p""",
    q_iso_g="SELECT horizon, model, p, sum(y) AS sy, count(*) AS m FROM q_preds WHERE model <> 'majority' AND horizon IN ('12h', '24h') GROUP BY 1, 2, 3",
    q_iso_sums="SELECT horizon, model, p, m, row_number() OVER w AS i, sum(sy) OVER w AS s, sum(m) OVER w AS n FROM q_iso_g WINDOW w AS (PARTITION BY horizon, model ORDER BY p) UNION ALL SELECT DISTINCT horizon, model, NULL, 0, 0, 0, 0 FROM q_iso_g"))
def isotonic(spark, d):
    """Every probability of every stream with its calibrated value; the SQL is the min-max formula."""
    rows = _streams(spark, d)
    out = FT.isotonic_by(rows, _HM)(rows.withColumn("p_raw", _c("p")))
    return report(out.groupBy(*_HM, "p_raw").agg(F.max("p").alias("p_cal"), F.count("*").alias("n")).withColumn("p_raw", S.rounded(_c("p_raw"), 8)), keep=("p_raw",))


@query("calib_in_sample")
def calib_in_sample(spark, d):
    return report(M.calib_in_sample(_streams(spark, d), _HM))


@query("calib_holdout")
def calib_holdout(spark, d):
    return report(M.calib_holdout(_streams(spark, d), ("i", "series_id"), _HM))


@query("freeze_candidate")
def freeze_candidate(spark, d):
    return M.freeze_candidate(labelled(spark, d).filter(_c("horizon").isin(*ML_HORIZONS)), _logistic(spark, d))


# ── registry and promotion ───────────────────────────────────────────────────
TRAINED_AT = "2024-02-01T00:00:00Z"


def entries(spark, d):
    return M.registry_build(M.oof_validation(rules(spark, d)).filter("level = 'pooled'"), TRAINED_AT)


cte("q_entries", "SELECT 'shadow-' || model || '-' || horizon || '-v0.4.0' AS model_id, horizon, model, n, hit, brier FROM (SELECT horizon, model, count(*) AS n, avg(CAST(CAST(p >= 0.5 AS INTEGER) = y AS INTEGER)) AS hit, avg((p - y) * (p - y)) AS brier FROM q_preds GROUP BY 1, 2) x")


@query("registry_build", sql(f"SELECT model_id, 'baseline' AS kind, horizon, n AS n_test_total, {r('hit', 'hit_rate')}, {r('brier', 'brier')}, 'active' AS shadow_status FROM q_entries"))
def registry_build(spark, d):
    return report(entries(spark, d).select("model_id", "kind", "horizon", "n_test_total", "hit_rate", "brier", "shadow_status"))


@query("validate_registry", sql("""
SELECT model_id, concat_ws(',', CASE WHEN horizon = '4h' THEN 'missing:kind' END, CASE WHEN horizon = '1h' THEN 'model_id' END, CASE WHEN horizon = '12h' THEN 'shadow_status' END,
  CASE WHEN model = 'momentum' THEN 'promoted_at' END) AS reasons FROM (SELECT CASE WHEN horizon = '1h' THEN replace(model_id, 'shadow-', 'live-') ELSE model_id END AS model_id, horizon, model FROM q_entries) x"""))
def validate_registry(spark, d):
    h = _c("horizon")
    e = entries(spark, d).withColumns({
        "promoted_at": F.when(_c("model_id").contains("momentum"), "2024-01-01"),
        "kind": F.when(h != "4h", _c("kind")),
        "shadow_status": F.when(h == "12h", "gone").otherwise(_c("shadow_status")),
        "model_id": F.when(h == "1h", F.replace("model_id", F.lit("shadow-"), F.lit("live-"))).otherwise(_c("model_id")),
    })
    return G.validate_registry(e).select("model_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("registry_upsert", sql(f"SELECT model_id, CASE WHEN horizon IN ('12h', '24h') THEN 'paused' ELSE 'active' END AS shadow_status, {r('brier', 'brier')} FROM q_entries"))
def registry_upsert(spark, d):
    e = entries(spark, d).select("model_id", "horizon", "shadow_status", "brier")
    old = e.filter(_c("horizon") != "24h").withColumn("arrival", F.lit(0))
    new = e.filter(_c("horizon").isin("12h", "24h")).withColumn("shadow_status", F.lit("paused")).withColumn("arrival", F.lit(1))
    return report(G.registry_upsert(old, new).select("model_id", "shadow_status", "brier"))


# Resolutions that the drift gate looks back on, and detectors sensitive enough for so few.
LOOK_BACK, DAY_MS = 100, 24 * 3_600_000
PH_LATE, EWMA_LATE = {"threshold": 3.0, "alpha": 1e-4}, {"k_sigma": 1.5}


def candidates(spark, d):
    """Each rule model and horizon with what its out-of-sample forecasts say: days from the first
    to the last, and the detectors' alarms on the newest of them."""
    preds = rules(spark, d)
    agg = preds.groupBy(*_HM).agg(
        F.count("*").alias("resolved_total"),
        F.countDistinct("fold_id").alias("n_folds"),
        F.countDistinct(F.when(_c("regime") != "unknown", _c("regime"))).alias("regimes_covered"),
        F.floor((F.max("open_time_ms") - F.min("open_time_ms")) / DAY_MS).alias("shadow_days"),
    )
    own = M.eval_pack(preds, _HM).select(*_HM, "brier", "log_loss", "ece")
    errors = preds.select(*_HM, "open_time_ms", "series_id", S.logloss_component(_c("p"), _c("y")).alias("x"))
    own = own.join(DR.recent_alarms(errors, _HM, ("open_time_ms", "series_id"), LOOK_BACK, PH_LATE, EWMA_LATE), list(_HM))
    best = own.filter("model = 'majority'").select("horizon", _c("brier").alias("best_baseline_brier"))
    return agg.join(own, list(_HM)).join(best, "horizon").select(
        F.concat_ws("-", F.lit("shadow"), "model", "horizon").alias("candidate_id"), "horizon", "resolved_total", _c("resolved_total").alias("resolved_horizon"),
        "shadow_days", "brier", "log_loss", "ece", "best_baseline_brier", "drift_alarms",
        "n_folds", "regimes_covered", F.when(_c("horizon") == "24h", "owner").alias("approved_by"), F.when(_c("horizon") == "24h", "2024-02-01").alias("approved_at"),
    )


_LATE = "PARTITION BY horizon, model ORDER BY row_idx"
cte("q_late", f"""
SELECT horizon, model, x, row_number() OVER (PARTITION BY horizon, model ORDER BY open_time_ms, series_id) AS row_idx FROM (
SELECT horizon, model, open_time_ms, series_id, -(y * ln(p) + (1 - y) * ln(1 - p)) AS x FROM q_preds
QUALIFY row_number() OVER (PARTITION BY horizon, model ORDER BY open_time_ms DESC, series_id DESC) <= {LOOK_BACK}) a
""")
cte("q_late_ph", f"""
SELECT horizon, model, row_idx >= 30 AND (cum - least(0.0, min(cum) OVER (w ROWS UNBOUNDED PRECEDING)) > {PH_LATE['threshold']}
       OR greatest(0.0, max(cum) OVER (w ROWS UNBOUNDED PRECEDING)) - cum > {PH_LATE['threshold']}) AS alarm FROM (
SELECT *, sum(x - mean - 1e-4) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM (
SELECT *, avg(x) OVER (w ROWS UNBOUNDED PRECEDING) AS mean FROM q_late WINDOW w AS ({_LATE})) a WINDOW w AS ({_LATE})) b WINDOW w AS ({_LATE})
""")
cte("q_late_ew", """
SELECT horizon, model, row_idx, x AS fast, x AS slow, CAST(0.0 AS DOUBLE) AS var FROM q_late WHERE row_idx = 1
UNION ALL
SELECT e.horizon, e.model, e.row_idx, 0.1 * e.x + 0.9 * p.fast, 0.005 * e.x + 0.995 * p.slow, 0.1 * (e.x - p.fast) * (e.x - p.fast) + 0.9 * p.var
FROM q_late_ew p JOIN q_late e ON e.horizon = p.horizon AND e.model = p.model AND e.row_idx = p.row_idx + 1
""")
cte("q_late_alarms", f"""
SELECT horizon, model, count(*) FILTER (alarm) AS alarms FROM (SELECT horizon, model, alarm FROM q_late_ph
UNION ALL SELECT horizon, model, row_idx >= 30 AND var > 0 AND abs(fast - slow) > {EWMA_LATE['k_sigma']} * sqrt(var) FROM q_late_ew) a GROUP BY 1, 2
""")
cte("q_cand", f"""
SELECT 'shadow-' || model || '-' || horizon AS candidate_id, horizon, model, n, brier, log_loss, ece, best, folds, regs, days, alarms FROM (
SELECT horizon, model, count(*) AS n, count(DISTINCT fold_id) AS folds, count(DISTINCT regime) FILTER (regime <> 'unknown') AS regs,
       (max(open_time_ms) - min(open_time_ms)) // {DAY_MS} AS days,
       avg((p - y) * (p - y)) AS brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss FROM q_preds GROUP BY 1, 2) a
JOIN (SELECT horizon, model, ece FROM q_ece_fixed) e USING (horizon, model) JOIN (SELECT horizon, brier AS best FROM q_brier WHERE model = 'majority') b USING (horizon)
JOIN q_late_alarms USING (horizon, model)
""")
cte("q_gates", """
SELECT candidate_id, horizon, unnest(['resolved_total', 'resolved_per_horizon', 'shadow_days', 'brier', 'log_loss', 'ece', 'beats_baseline_brier', 'no_severe_drift', 'out_of_sample', 'regime_coverage', 'manual_approval']) AS gate,
 unnest([n >= 30, n >= 30, days >= 14, brier <= 0.245, log_loss <= 0.68, coalesce(ece <= 0.08, false), best - brier >= 0.005, alarms = 0, folds >= 3, regs >= 2, horizon = '24h']) AS passed FROM q_cand
""")


@query("promotion_inputs", sql("SELECT candidate_id, horizon, n AS resolved_total, days AS shadow_days, alarms AS drift_alarms, folds AS n_folds, regs AS regimes_covered FROM q_cand"))
def promotion_inputs(spark, d):
    """What the gates of a candidate read from its forecasts and the detectors."""
    return candidates(spark, d).select("candidate_id", "horizon", "resolved_total", "shadow_days", "drift_alarms", "n_folds", "regimes_covered")


@query("promotion_gates", sql("SELECT candidate_id, horizon, gate, passed FROM q_gates"))
def promotion_gates(spark, d):
    return G.promotion_gates(candidates(spark, d)).drop("detail")


@query("promotion_decision", sql("""
SELECT candidate_id, horizon, bool_and(passed) AS ready_for_promotion, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (NOT passed), '') AS failing FROM q_gates GROUP BY 1, 2"""))
def promotion_decision(spark, d):
    return G.promotion_decision(G.promotion_gates(candidates(spark, d))).withColumn("failing", F.concat_ws(",", "failing"))


@query("regime_report", sql(f"""
SELECT s.horizon, s.model, s.regime, s.n, {r('s.brier', 'brier')}, {r('d.share', 'regime_share')}, g.ready AS ready_for_promotion FROM
(SELECT horizon, model, regime, count(*) AS n, avg((p - y) * (p - y)) AS brier FROM q_preds GROUP BY 1, 2, 3) s
LEFT JOIN (SELECT coarse AS regime, count(*) / (SELECT count(*) FROM q_regime)::DOUBLE AS share FROM q_regime GROUP BY 1) d USING (regime)
LEFT JOIN (SELECT c.horizon, c.model, bool_and(passed) AS ready FROM q_gates g JOIN q_cand c USING (candidate_id) GROUP BY 1, 2) g ON g.horizon = s.horizon AND g.model = s.model"""))
def regime_report(spark, d):
    oof = M.oof_validation(rules(spark, d))
    dist = R.regime_distribution(R.regime_labels(I.hourly(spark, d)))
    gates = G.promotion_decision(G.promotion_gates(candidates(spark, d)))
    model = F.regexp_extract("candidate_id", "^shadow-(.*)-[0-9]+h$", 1).alias("model")
    out = M.regime_report(oof, dist, gates.select("horizon", model, "ready_for_promotion"))
    return report(out.select("horizon", "model", "regime", "n", "brier", "regime_share", "ready_for_promotion"))
