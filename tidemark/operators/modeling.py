"""Walk-forward validation: folds, scaling, rule baselines, fitted models, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import fits
from tidemark.operators.blocks import SERIES, with_row_index
from tidemark.operators.features import FEATURES, HORIZON_BARS
from tidemark.sources.store import settle

# Fixed values.
CLIP = (0.05, 0.95)
MOMENTUM_SCALE = 25.0
L2 = 0.01
RELIABILITY_BINS = 10
ECE_MIN_N, ECE_MIN_BINS = 20, 3
RULES = ("majority", "last_direction", "momentum", "mean_reversion", "siie_lite", "sma24_rule", "random")


# ── folds ────────────────────────────────────────────────────────────────────
def walk_forward(sizes: DataFrame, keys: Sequence[str], n_folds: int, purge: Column | int, embargo: int, min_train: Column | int) -> DataFrame:
    """Index bounds of the expanding folds from (keys, n_rows); 0-based, ends exclusive.

    The last ``purge`` rows of train and the first ``embargo`` rows of test are left out;
    a fold whose train shrinks below ``min_train`` (or with no test row) vanishes.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    mt, n = lit(min_train), F.col("n_rows")
    size = F.greatest(F.lit(1), F.floor((n - mt) / n_folds))
    k = F.col("fold_id")
    start = mt + k * size
    folds = sizes.filter(n > 0).select(*keys, "n_rows", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold_id"))
    return (
        folds.select(
            *keys,
            "fold_id",
            "n_rows",
            F.greatest(F.lit(0), start - lit(purge)).cast("long").alias("train_end"),
            (start + embargo).cast("long").alias("test_start"),
            (start + size).cast("long").alias("test_end"),
            mt.alias("_mt"),
        )
        .filter((F.col("test_end") <= F.col("n_rows")) & (F.col("train_end") >= F.col("_mt")) & (F.col("test_start") < F.col("test_end")))
        .drop("_mt", "n_rows")
    )


def fold_join(rows: DataFrame, folds: DataFrame, keys: Sequence[str], idx: str = "i") -> DataFrame:
    """(row, fold, part) with part train/test: the handful of folds per key travels as an array."""
    packed = folds.groupBy(*keys).agg(F.collect_list(F.struct("fold_id", "train_end", "test_start", "test_end")).alias("_folds"))
    i = F.col(idx)

    def place(f):
        part = F.when(i < f["train_end"], "train").when((i >= f["test_start"]) & (i < f["test_end"]), "test")
        return F.struct(f["fold_id"].alias("fold_id"), part.alias("part"))

    placed = rows.join(packed, list(keys)).withColumn("_at", F.filter(F.transform("_folds", place), lambda a: a["part"].isNotNull()))
    return placed.select(*rows.columns, F.inline_outer("_at")).filter("part IS NOT NULL")


def labelled_rows(frame: DataFrame, targets: DataFrame) -> DataFrame:
    """Feature rows with their label per horizon, numbered from 0 in time order as ``i``."""
    labels = targets.select(*SERIES, "open_time_ms", "horizon", "y", "target_close")
    both = settle(frame.join(labels, [*SERIES, "open_time_ms"]))
    numbered = with_row_index(both, [*SERIES, "horizon"], ("open_time_ms",), name="_i")
    return numbered.withColumn("i", F.col("_i") - 1).drop("_i")


def scaler_train_only(placed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and deviation of each column over the train rows of each fold (long table)."""
    train = placed.filter("part = 'train'")
    agg = train.groupBy(*keys, "fold_id").agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    )
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in columns]
    long = agg.select(*keys, "fold_id", F.inline(F.array(*rows)))
    return long.withColumn("std", F.when(F.col("std") > 1e-9, F.col("std")).otherwise(1.0))


def scale(placed: DataFrame, params: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    wide = params.groupBy(*keys, "fold_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_p"))
    out = placed.join(wide, [*keys, "fold_id"])
    return out.withColumns({c: (F.col(c) - F.col("_p")[c]["mean"]) / F.col("_p")[c]["std"] for c in columns}).drop("_p")


# ── rule baselines ───────────────────────────────────────────────────────────
def clip_p(p: Column) -> Column:
    return S.clip(p, *CLIP)


def base_majority(train_rate: Column) -> Column:
    return clip_p(F.coalesce(train_rate, F.lit(0.5)))


def base_last_direction(ret: Column) -> Column:
    return F.when(ret > 0, 0.55).when(ret < 0, 0.45).otherwise(0.5)


def base_momentum(ret: Column) -> Column:
    return clip_p(S.sigmoid(ret * MOMENTUM_SCALE))


def base_mean_reversion(ret: Column) -> Column:
    return clip_p(S.sigmoid(ret * -MOMENTUM_SCALE))


def base_siie_lite(ema_distance: Column, rsi: Column, regime: Column) -> Column:
    """Trend from the EMA distance with small tilts by RSI band and regime."""
    tilt = F.when((rsi > 0.40) & (rsi < 0.70), 0.05).when((rsi > 0.30) & (rsi < 0.60), -0.02).otherwise(0.0)
    side = F.when(regime == "bull", 0.03).when(regime == "bear", -0.03).otherwise(0.0)
    return clip_p(F.lit(0.5) + 0.5 * F.tanh(8.0 * ema_distance) + tilt + side)


def base_sma24_rule(raw_sma24_rel: Column) -> Column:
    """Reads the raw column, never the scaled one."""
    return F.when(raw_sma24_rel >= 0, 0.55).otherwise(0.45)


def base_random(keys: Sequence[str], seed: int = 1337) -> Column:
    """A number in [0, 1) from a hash of the row's keys: the same wherever the row is computed."""
    row = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(row.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def rule_predictions(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Out-of-sample rows of every rule baseline in one projection: (.., model, p)."""
    rate = placed.filter("part = 'train'").groupBy(*keys, "fold_id").agg(F.avg("y").alias("_rate"), F.count("*").alias("n_train"))
    test = placed.filter("part = 'test'").join(rate, [*keys, "fold_id"])
    ret = F.col("log_return_1")
    made = {
        "majority": base_majority(F.col("_rate")),
        "last_direction": base_last_direction(ret),
        "momentum": base_momentum(ret),
        "mean_reversion": base_mean_reversion(ret),
        "siie_lite": base_siie_lite(F.col("ema_distance"), F.col("rsi_14"), F.col("regime")),
        "sma24_rule": base_sma24_rule(F.col("sma24_rel")),
        "random": base_random([*keys, "fold_id", "i"]),
    }
    rows = [F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in made.items()]
    return test.select(*keys, "fold_id", "i", "open_time_ms", "n_train", "y", "regime", F.col("close").alias("entry"), F.col("target_close").alias("exit"), F.inline(F.array(*rows)))


# ── fitted models ────────────────────────────────────────────────────────────
def logistic_predictions(placed: DataFrame, keys: Sequence[str] = ("horizon", "fold_id"), features: Sequence[str] = FEATURES, l2: float = L2) -> DataFrame:
    """L2 logistic regression of every (horizon, fold) over all series, and its test rows' ``p``."""
    rows = settle(fits.scaled_rows(placed, keys, features))
    found = fits.logistic_fits(rows.filter("part = 'train'"), keys, len(features), l2)
    scored = rows.filter("part = 'test'").join(found.select(*keys, "w"), list(keys)).withColumn("p", fits.logistic_p(F.col("z"), F.col("w")))
    return scored.select(*SERIES, "horizon", "fold_id", "i", "y", "regime", F.col("close").alias("entry"), F.col("target_close").alias("exit"), F.lit("logistic").alias("model"), "p")


def tree(features: Sequence[str] = FEATURES) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_raw"),
            GBTClassifier(featuresCol="_raw", labelCol="y", maxDepth=3, maxIter=5, seed=1337),
        ]
    )


def p_up(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p", vector_to_array("probability")[1])


def fitted_predictions(placed: DataFrame, jobs: Sequence[tuple[str, int]], make=tree, name: str = "tree", parallel: int = 4) -> DataFrame:
    """Fit ``make()`` per (horizon, fold) over all series and predict the test rows.

    The fits are independent Spark jobs; a small thread pool only submits them.
    """
    def one(job):
        horizon, fold = job
        part = placed.filter((F.col("horizon") == horizon) & (F.col("fold_id") == fold))
        train = part.filter("part = 'train'")
        model = make().fit(train)
        return p_up(model.transform(part.filter("part = 'test'"))).select(
            *SERIES, "horizon", "fold_id", "i", "y", "regime", F.col("close").alias("entry"), F.col("target_close").alias("exit"),
            F.lit(name).alias("model"), "p",
        )

    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(one, jobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ── metrics on (p, y) ────────────────────────────────────────────────────────
def eval_aggs() -> list[Column]:
    p, y = F.col("p"), F.col("y")
    return [
        F.count("*").alias("n"),
        F.avg(((p >= 0.5).cast("int") == y).cast("int")).alias("hit_rate"),
        F.avg(S.brier_component(p, y)).alias("brier"),
        F.avg(S.logloss_component(p, y)).alias("log_loss"),
        F.avg("y").alias("base_rate"),
    ]


def reliability_diagram(preds: DataFrame, keys: Sequence[str], bins: int = RELIABILITY_BINS) -> DataFrame:
    """Ten equal-width bins per key, empty ones included."""
    slot = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    agg = preds.groupBy(*keys, slot.alias("bin")).agg(F.count("*").alias("count"), F.avg("p").alias("avg_prob"), F.avg("y").alias("avg_outcome"))
    grid = agg.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(agg, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"), "avg_prob", "avg_outcome",
    )


def reliability_slim(diagram: DataFrame) -> DataFrame:
    return diagram.filter(F.col("count") > 0)


def ece_fixed(diagram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calibration error over the fixed bins; null below 20 rows or 3 filled bins."""
    used = reliability_slim(diagram).groupBy(*keys).agg(
        F.sum("count").alias("n"),
        F.count("*").alias("_bins"),
        F.sum(F.col("count") * F.abs(F.col("avg_prob") - F.col("avg_outcome"))).alias("_gap"),
    )
    ok = (F.col("n") >= ECE_MIN_N) & (F.col("_bins") >= ECE_MIN_BINS)
    return used.select(*keys, "n", F.when(ok, F.col("_gap") / F.col("n")).alias("ece"))


def eval_pack(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    base = preds.groupBy(*keys).agg(*eval_aggs())
    return base.join(ece_fixed(reliability_diagram(preds, keys), keys).drop("n"), list(keys), "left")


def oof_validation(preds: DataFrame, keys: Sequence[str] = ("horizon", "model")) -> DataFrame:
    """Fold, regime and pooled metrics of the prediction table in one GROUPING SETS pass."""
    k = [F.col(c) for c in keys]
    fold, regime = F.col("fold_id"), F.col("regime")
    agg = preds.groupingSets([[*k, fold], [*k, regime], k], *k, fold, regime).agg(F.grouping_id().alias("_g"), *eval_aggs())
    level = F.when(F.col("_g") == 1, "fold").when(F.col("_g") == 2, "regime").otherwise("pooled")
    part = F.when(F.col("_g") == 1, fold.cast("string")).when(F.col("_g") == 2, regime).otherwise("all")
    return agg.select(*keys, level.alias("level"), part.alias("part"), "n", "hit_rate", "brier", "log_loss", "base_rate")


def baseline_delta(pooled: DataFrame, by: Sequence[str], baselines: Sequence[str] = RULES) -> DataFrame:
    """Brier gain of every model over every baseline of the same group (few models each)."""
    packed = pooled.filter(F.col("model").isin(*baselines)).groupBy(*by).agg(F.collect_list(F.struct(F.col("model").alias("baseline"), F.col("brier").alias("b"))).alias("_b"))
    return pooled.join(packed, list(by)).select(*by, "model", "brier", F.inline("_b")).select(*by, "model", "baseline", (F.col("b") - F.col("brier")).alias("delta"))


def majority_rate(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    up = F.avg("y")
    return preds.groupBy(*keys).agg(F.greatest(up, 1 - up).alias("majority_rate"))


def economics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions as one-unit paper trades; a hit needs a strictly positive signed return."""
    raw = (F.col("exit") - F.col("entry")) / F.col("entry") * 10000.0
    signed = F.when(F.col("p") >= 0.5, raw).otherwise(-raw)
    bars = F.lit(1)
    for h, n in HORIZON_BARS.items():
        bars = F.when(F.col("horizon") == h, n).otherwise(bars)
    rows = preds.filter((F.col("entry") > 0) & (F.col("exit") > 0)).select(*keys, signed.alias("_s"), bars.alias("_h"))
    agg = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("_s") > 0).cast("int")).alias("hit_rate"), F.avg("_s").alias("expectancy_bps"), F.max("_h").alias("_h"))
    return agg.select(
        *keys,
        "n",
        "hit_rate",
        S.wilson_lower(F.col("hit_rate"), F.col("n"), S.WILSON_Z_EXACT, floor=False).alias("wilson_lb_95"),
        F.greatest(F.lit(1), F.floor(F.col("n") / F.col("_h"))).cast("long").alias("effective_n_approx"),
        "expectancy_bps",
        (F.col("expectancy_bps") - S.MAKER_BPS).alias("expectancy_maker_2bps"),
    )


def candidate_decision(pooled: DataFrame, majority: DataFrame, by: Sequence[str], candidate: str = "logistic") -> DataFrame:
    """Selected only if the candidate beats the majority rate and the best baseline Brier."""
    own = F.col("model") == candidate
    agg = pooled.groupBy(*by).agg(
        F.max(F.when(own, F.col("hit_rate"))).alias("hit"),
        F.max(F.when(own, F.col("brier"))).alias("brier"),
        F.min(F.when(~own, F.col("brier"))).alias("best_baseline_brier"),
    )
    j = agg.join(majority.filter(own).select(*by, "majority_rate"), list(by), "left")
    ok_hit = F.coalesce(F.col("hit") > F.col("majority_rate"), F.lit(False))
    ok_brier = F.coalesce(F.col("brier") <= F.col("best_baseline_brier"), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("hit").isNull(), "candidate did not run"),
            F.when(F.col("hit").isNotNull() & ~ok_hit, "hit does not beat the pooled majority"),
            F.when(F.col("hit").isNotNull() & ~ok_brier, "brier above the best baseline"),
            F.when(ok_hit & ok_brier, "hit and brier both pass"),
        )
    )
    return j.withColumn("selected", ok_hit & ok_brier).withColumn("reasons", reasons)


# ── calibration ──────────────────────────────────────────────────────────────
def platt_fits(fit_rows: DataFrame, keys: Sequence[str], steps: int = 12) -> DataFrame:
    """(keys, n, a, b, gradient) of the logistic fit of every prediction stream, all at once.

    Newton steps from a = b = 0, where every row has full weight: each is one map-side aggregation of five sums per stream.
    ``gradient`` is the mean gradient's length at the fitted values.
    """
    keys = list(keys)
    rows = settle(fit_rows.select(*keys, S.logit(F.col("p")).alias("_z"), "y"))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, "n", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    for step in range(steps + 1):
        found = settle(found)
        q = S.sigmoid(F.col("a") * F.col("_z") + F.col("b"))
        d, w, z = q - F.col("y"), q * (1 - q), F.col("_z")
        sums = rows.join(found, keys).groupBy(*keys, "n", "a", "b").agg(
            F.avg(d * z).alias("ga"), F.avg(d).alias("gb"), (F.avg(w * z * z) + 1e-12).alias("haa"), F.avg(w * z).alias("hab"), (F.avg(w) + 1e-12).alias("hbb")
        )
        if step == steps:
            return sums.select(*keys, "n", "a", "b", F.sqrt(F.col("ga") * F.col("ga") + F.col("gb") * F.col("gb")).alias("gradient"))
        det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        found = sums.select(
            *keys, "n",
            (F.col("a") - (F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb")) / det).alias("a"),
            (F.col("b") - (F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga")) / det).alias("b"),
        )


def platt_by(fit_rows: DataFrame, keys: Sequence[str]):
    """Fit a * logit(p) + b for every stream; returns ``apply(df) -> df`` with ``p`` replaced."""
    found = settle(platt_fits(fit_rows, keys).drop("n", "gradient"))
    return lambda df: df.join(found, list(keys)).withColumn("p", S.sigmoid(S.logit(F.col("p")) * F.col("a") + F.col("b"))).drop("a", "b")


def calib_in_sample(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw, Platt and isotonic metrics, fitted and read on all rows of one prediction stream."""
    return _calibrated(preds, preds, keys)


def holdout_split(preds: DataFrame, order: Sequence[str], keys: Sequence[str], share: float = 0.6, span: int = 64) -> tuple[DataFrame, DataFrame]:
    """First ``share`` of the rows of every stream, in order, against the rest.

    ``span`` is the width of ``order[0]`` numbered in one task (``with_row_index``).
    """
    keys = list(keys)
    numbered = settle(with_row_index(preds, keys, order, span=span, name="_r"))
    sizes = numbered.groupBy(*keys).agg(F.floor(F.max("_r") * share).alias("_cut"))
    cut = numbered.join(sizes, keys)
    first = F.col("_r") <= F.col("_cut")
    return cut.filter(first).select(*preds.columns), cut.filter(~first).select(*preds.columns)


def calib_holdout(preds: DataFrame, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return _calibrated(*holdout_split(preds, order, keys), keys)


def _calibrated(fit_rows: DataFrame, eval_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    parts = []
    for name, apply in (("raw", lambda df: df), ("platt", platt_by(fit_rows, keys)), ("isotonic", fits.isotonic_by(fit_rows, keys))):
        parts.append(eval_pack(apply(eval_rows), keys).withColumn("calibration", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def freeze_candidate(rows: DataFrame, oof: DataFrame, features: Sequence[str] = FEATURES, l2: float = L2) -> DataFrame:
    """What the issuer loads, per horizon, as (horizon, part, feature, value).

    Weights, intercept and scaler of the final fit on all labelled rows, the number of these rows,
    and the Platt calibrator of the out-of-sample stream ``oof`` of the same model.
    """
    keys = ["horizon"]
    scaled = settle(fits.scaled_rows(rows.withColumn("part", F.lit("train")), keys, features))
    found = fits.logistic_fits(scaled, keys, len(features), l2)
    names = F.array(*[F.lit(f) for f in features])
    moments = scaled.groupBy(*keys).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))

    def long(df: DataFrame, part: str, values: Column) -> DataFrame:
        at = df.select("horizon", F.posexplode(values).alias("_at", "value"))
        return at.select("horizon", F.lit(part).alias("part"), F.coalesce(F.get(names, F.col("_at")), F.lit("")).alias("feature"), "value")

    def one(df: DataFrame, part: str, feature: str, value: Column) -> DataFrame:
        return df.select("horizon", F.lit(part).alias("part"), F.lit(feature).alias("feature"), value.alias("value"))

    calibrator = settle(platt_fits(oof, keys))
    parts = [
        long(found, "weight", F.slice("w", 1, len(features))),
        one(found, "intercept", "", F.element_at("w", -1)),
        one(found, "n_train", "", F.col("n").cast("double")),
        long(moments, "mean", F.col("mean")),
        long(moments, "std", F.col("std")),
        one(calibrator, "platt", "a", F.col("a")),
        one(calibrator, "platt", "b", F.col("b")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def registry_build(pooled: DataFrame, trained_at: str, version: str = "v0.4.0", features_version: str = "phase3-features-v0.2.0") -> DataFrame:
    """One registry entry per model and horizon."""
    kind = F.when(F.col("model") == "logistic", "logistic").when(F.col("model") == "tree", "tree").otherwise("baseline")
    return pooled.select(
        F.concat(F.lit("shadow-"), "model", F.lit("-"), "horizon", F.lit("-" + version)).alias("model_id"),
        kind.alias("kind"),
        "horizon",
        F.lit(features_version).alias("features_version"),
        F.lit(trained_at).alias("trained_at"),
        F.col("n").alias("n_test_total"),
        "hit_rate",
        "brier",
        F.lit("active").alias("shadow_status"),
        F.lit(None).cast("string").alias("promoted_at"),
        F.lit(False).alias("fixture_only"),
    )


def regime_report(oof: DataFrame, distribution: DataFrame, gates: DataFrame, keys: Sequence[str] = ("horizon", "model")) -> DataFrame:
    """Regime slices of the validation joined with label shares and the promotion decision."""
    sliced = oof.filter("level = 'regime'").withColumnRenamed("part", "regime")
    share = distribution.filter("level = 'coarse'").groupBy(F.col("label").alias("regime")).agg((F.sum("n") / F.sum("total")).alias("regime_share"))
    return sliced.join(share, "regime", "left").join(gates, list(keys), "left")
