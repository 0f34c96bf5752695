"""Documented market rules: options, derivatives, trend systems, sizing and cycle indicators.

Bar inputs carry ``row_idx``; every bounded window runs through the halo blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators.blocks import SERIES, affine_scan, prefix_scan, windowed, with_row_index
from tidemark.sources.store import settle

# Alert thresholds, confluence limits, buy schedule by fear-and-greed band.
ALERTS = (
    ("FUNDING_HIGH", "funding", ">", 0.05),
    ("FUNDING_LOW", "funding", "<", -0.01),
    ("OI_COLLAPSED", "oi_change_4w", "<", -30.0),
    ("DVOL_HIGH", "dvol", ">", 80.0),
    ("DVOL_LOW", "dvol", "<", 45.0),
    ("PCR_EXTREME", "pcr", ">", 0.75),
    ("PCR_COMPLACENT", "pcr", "<", 0.45),
    ("BASIS_DANGER", "basis", "<", 4.5),
    ("BASIS_WARNING", "basis", "<", 5.0),
)
FG_SCHEDULE = ((25, 150.0), (45, 100.0), (55, 75.0), (75, 50.0), (None, 25.0))
FLAT_BUY = 100.0
COMPOSITE_NEED = 4


# ── options ──────────────────────────────────────────────────────────────────
def opt_oi_by_strike(book: DataFrame) -> DataFrame:
    """Call and put open interest per expiry and strike from ``NAME-EXPIRY-STRIKE-C|P``."""
    part = F.split("instrument", "-")
    kind = part[3]
    return book.groupBy(part[1].alias("expiry"), part[2].try_cast("long").alias("strike")).agg(
        F.sum(F.when(kind == "C", F.col("open_interest")).otherwise(0.0)).alias("call_oi"),
        F.sum(F.when(kind == "P", F.col("open_interest")).otherwise(0.0)).alias("put_oi"),
    )


def top_strikes(strikes: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("expiry").orderBy(F.desc(F.col("call_oi") + F.col("put_oi")), "strike")
    return strikes.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def opt_pcr(strikes: DataFrame) -> DataFrame:
    calls = F.sum("call_oi")
    return strikes.groupBy("expiry").agg(F.try_divide(F.sum("put_oi"), calls).alias("pcr"), calls.alias("call_oi"), F.sum("put_oi").alias("put_oi"))


def opt_max_pain(strikes: DataFrame) -> DataFrame:
    """Strike with the least total payout per expiry.

    Payout at P is P*C(below) - S_C(below) + S_P(above) - P*P(above): running sums over
    the sorted strikes replace the strikes-by-strikes product.
    """
    w = Window.partitionBy("expiry").orderBy("strike")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    above = w.rowsBetween(1, Window.unboundedFollowing)
    k = F.col("strike").cast("double")

    def total(col, frame):
        return F.coalesce(F.sum(col).over(frame), F.lit(0.0))

    pain = (
        k * total(F.col("call_oi"), below) - total(F.col("call_oi") * k, below)
        + total(F.col("put_oi") * k, above) - k * total(F.col("put_oi"), above)
    )
    return strikes.withColumn("pain", pain).groupBy("expiry").agg(
        F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), F.min("pain").alias("pain")
    )


# ── derivatives ──────────────────────────────────────────────────────────────
def funding_rate(premium: Column, interest: float = 0.0001, inner: float = 0.0005, cap: float = 0.003) -> Column:
    def clamp(v, lim):
        return F.least(F.greatest(v, F.lit(-lim)), F.lit(lim))

    return clamp(premium + clamp(F.lit(interest) - premium, inner), cap)


def premium_index(bid: Column, ask: Column, mark: Column, spot: Column) -> Column:
    zero = F.lit(0.0)
    return (F.greatest(zero, bid - mark) - F.greatest(zero, mark - ask)) / spot


def funding_annual(rate_8h: Column) -> Column:
    return rate_8h * 3 * 365


def basis_annual(futures: Column, spot: Column, days: Column | float) -> Column:
    return (futures - spot) / spot * (F.lit(365.0) / days) * 100


def curve_class(basis_pct: Column) -> Column:
    return (
        F.when(basis_pct < 0, "backwardation").when(basis_pct < 2, "at_or_below_bill").when(basis_pct < 5, "flat")
        .when(basis_pct <= 15, "normal_contango").otherwise("steep_contango")
    )


def oi_quadrant(bars: DataFrame, price: str = "close", oi: str = "open_interest") -> DataFrame:
    def build(f, w):
        dp, do = F.col(price) - F.lag(price).over(w), F.col(oi) - F.lag(oi).over(w)
        q = (
            F.when((dp > 0) & (do > 0), "long_build_up").when((dp > 0) & (do < 0), "short_covering")
            .when((dp < 0) & (do > 0), "short_build_up").when((dp < 0) & (do < 0), "long_liquidation").otherwise("flat")
        )
        return f.withColumn("quadrant", q)

    return windowed(bars, build, before=1)


def leverage_class(ratio_pct: Column) -> Column:
    return F.when(ratio_pct > 3, "extreme").when(ratio_pct >= 2, "elevated").when(ratio_pct >= 1, "moderate").otherwise("low")


def dvol_move(dvol: Column) -> Column:
    return dvol / math.sqrt(365.0)


def risk_reversal(call_iv: Column, put_iv: Column) -> Column:
    """25-delta call volatility minus put volatility."""
    return call_iv - put_iv


def deriv_alerts(metrics: DataFrame, keep) -> DataFrame:
    """One row per fired threshold."""
    fired = [
        F.when(F.col(c) > lim if op == ">" else F.col(c) < lim, F.struct(F.lit(n).alias("alert"), F.col(c).alias("value")))
        for n, c, op, lim in ALERTS
    ]
    return metrics.withColumn("_a", F.array_compact(F.array(*fired))).select(*keep, F.inline_outer("_a")).filter("alert IS NOT NULL")


def deriv_confluence(metrics: DataFrame) -> DataFrame:
    """Bullish and bearish condition counts of six each; four make a signal."""
    c = F.col
    bull = [c("funding") < -0.01, c("pcr") > 0.75, c("dvol") > 80, c("term_slope") < 0, c("oi_change_4w") <= -30, c("long_pct") < 42]
    bear = [c("funding") > 0.05, c("pcr") < 0.45, c("dvol") < 45, c("oi_mcap_pct") > 3, c("basis") > 15, c("long_pct") > 65]

    def total(rules):
        return sum((F.coalesce(x, F.lit(False)).cast("int") for x in rules), F.lit(0))

    out = metrics.withColumn("bullish", total(bull)).withColumn("bearish", total(bear))
    return out.withColumn("confluence", F.when(c("bullish") >= 4, "bottom").when(c("bearish") >= 4, "top").otherwise("none"))


# ── trend systems ────────────────────────────────────────────────────────────
def ma_cross(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """State and crossings of two strict means."""
    def build(f, w):
        up = ind.sma_strict("close", w, fast) > ind.sma_strict("close", w, slow)
        f = f.withColumn("fast_above", up)
        was = F.lag("fast_above").over(w)
        return f.withColumn("cross", F.when(up & ~was, "golden").when(~up & was, "death"))

    return windowed(bars, build, before=slow + 1)


def ema_stack(bars: DataFrame, spans=(9, 21, 50, 200)) -> DataFrame:
    out = affine_scan(bars, {f"ema_{n}": ind.ema_terms(F.col("close"), n) for n in spans})
    names = [F.col(f"ema_{n}") for n in spans]
    bull, bear = F.lit(True), F.lit(True)
    for a, b in zip(names, names[1:]):
        bull, bear = bull & (a > b), bear & (a < b)
    return out.withColumn("stack", F.when(bull, "bullish").when(bear, "bearish").otherwise("mixed"))


def macd_hist(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Long while the histogram is positive."""
    f = affine_scan(bars, {"_f": ind.ema_terms(F.col("close"), fast), "_s": ind.ema_terms(F.col("close"), slow)})
    f = settle(f.withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s"))
    f = affine_scan(f, {"macd_signal": ind.ema_terms(F.col("macd"), signal)})
    return f.withColumn("histogram", F.col("macd") - F.col("macd_signal")).withColumn("position", (F.col("histogram") > 0).cast("int"))


def rsi_momentum(bars: DataFrame, n: int = 14) -> DataFrame:
    """Enter when RSI crosses above 50, leave when it crosses below."""
    f = ind.rsi_wilder(bars, n=n)

    def build(g, w):
        was = F.lag("rsi").over(w)
        return g.withColumn("action", F.when((F.col("rsi") > 50) & (was <= 50), "enter").when((F.col("rsi") < 50) & (was >= 50), "exit"))

    return windowed(f, build, before=1)


def true_range(w) -> Column:
    prev = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr_regime(bars: DataFrame, n: int = 14) -> DataFrame:
    def build(f, w):
        f = f.withColumn("_tr", true_range(w))
        return f.withColumn("atr_pct", F.avg("_tr").over(w.rowsBetween(-(n - 1), 0)) / F.col("close") * 100)

    a = F.col("atr_pct")
    return windowed(bars, build, before=n + 1).drop("_tr").withColumn(
        "atr_regime", F.when(a < 2, "quiet").when(a <= 4, "normal").when(a <= 8, "volatile").otherwise("extreme")
    )


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, long_run: int = 180) -> DataFrame:
    """Bands, width, squeeze (width below 40 % of its long mean or at its long low), and
    breakouts with at least 150 % of the mean volume."""
    def build(f, w):
        frame = w.rowsBetween(-(n - 1), 0)
        mid, sd = F.avg("close").over(frame), F.coalesce(F.stddev_samp("close").over(frame), F.lit(0.0))
        f = f.withColumns({"bb_upper": mid + sd * k, "bb_lower": mid - sd * k, "bb_width": sd * (2 * k) / mid})
        far = w.rowsBetween(-(long_run - 1), 0)
        squeeze = (F.col("bb_width") < F.avg("bb_width").over(far) * 0.4) | (F.col("bb_width") <= F.min("bb_width").over(far))
        full = F.col("row_idx") >= long_run
        wide = F.col("bb_width") > F.lag("bb_width").over(w)
        loud = F.col("volume") >= F.avg("volume").over(w.rowsBetween(-n, -1)) * 1.5
        out = F.when(F.col("close") > F.col("bb_upper"), "up").when(F.col("close") < F.col("bb_lower"), "down")
        return f.withColumn("squeeze", full & squeeze).withColumn("breakout", F.when((F.col("row_idx") > n) & wide & loud, out))

    return windowed(bars, build, before=n + long_run)


def donchian(bars: DataFrame, entry: int = 20, leave: int = 10) -> DataFrame:
    """Breakouts of the prior channel; the position follows the last of entry and exit."""
    def build(f, w):
        top = F.max("high").over(w.rowsBetween(-entry, -1))
        floor = F.min("low").over(w.rowsBetween(-leave, -1))
        act = F.when(F.col("row_idx") > entry, F.when(F.col("close") > top, 1).when(F.col("close") < floor, 0))
        return f.withColumn("_act", act)

    f = windowed(bars, build, before=max(entry, leave))
    f = prefix_scan(f, {"_pos": ("last", F.col("_act"))})
    return f.withColumn("position", F.coalesce("_pos", F.lit(0))).drop("_act", "_pos")


def obv(bars: DataFrame) -> DataFrame:
    """Signed cumulative volume."""
    def build(f, w):
        return f.withColumn("_sv", F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume"))

    f = windowed(bars, build, before=1)
    return prefix_scan(f, {"obv": ("sum", F.col("_sv"))}).drop("_sv")


def paired(bars: DataFrame, pairs) -> DataFrame:
    """Closes of two series at the same open time, for every pair of an explicit list."""
    named = F.array(*[F.struct(F.lit(f"{x}-{y}").alias("pair"), F.lit(s).alias("_s"), F.lit(side).alias("_side")) for x, y in pairs for side, s in (("a", x), ("b", y))])
    rows = bars.select("series_id", "open_time_ms", "close", F.inline(named)).filter("series_id = _s")
    both = rows.groupBy("pair", "open_time_ms").agg(*[F.max(F.when(F.col("_side") == s, F.col("close"))).alias(s) for s in ("a", "b")])
    return both.filter("a IS NOT NULL AND b IS NOT NULL")


def rolling_corr(pairs: DataFrame, a: str, b: str, n: int = 30, keys=SERIES) -> DataFrame:
    def build(f, w):
        frame = w.rowsBetween(-(n - 1), 0)
        return f.withColumn("corr", F.when(F.count(F.lit(1)).over(frame) == n, F.corr(a, b).over(frame)))

    return windowed(pairs, build, before=n, keys=keys)


# ── schedules and sizing ─────────────────────────────────────────────────────
def weekly_first(bars: DataFrame, extra=()) -> DataFrame:
    """First bar of every week (Monday) per series."""
    week = F.floor((F.col("open_time_ms") / 86_400_000 + 3) / 7).cast("long")
    row = F.struct(F.col("close").alias("price"), *extra)
    return bars.groupBy(*SERIES, week.alias("week")).agg(F.min_by(row, "open_time_ms").alias("r")).select(*SERIES, "week", "r.*")


def fg_amount(fg: Column) -> Column:
    out = F.lit(FG_SCHEDULE[-1][1])
    for limit, amount in reversed(FG_SCHEDULE[:-1]):
        out = F.when(fg < limit, amount).otherwise(out)
    return out


def dca(weeks: DataFrame, amount: Column | float) -> DataFrame:
    """Result of buying for ``amount`` each week, valued at the last weekly price."""
    buy = amount if isinstance(amount, Column) else F.lit(float(amount))
    return (
        weeks.withColumn("_a", buy)
        .groupBy(*SERIES)
        .agg(F.count("*").alias("weeks"), F.sum("_a").alias("invested"), F.sum(F.col("_a") / F.col("price")).alias("units"), F.max_by("price", "week").alias("_last"))
        .withColumn("value", F.col("units") * F.col("_last"))
        .withColumn("return_pct", (F.col("value") / F.col("invested") - 1) * 100)
        .drop("_last")
    )


def value_averaging(weeks: DataFrame, step: float = 500.0) -> DataFrame:
    """Buy (or sell) so that the holding is worth ``step`` more each period.

    After every trade the holding is exactly on target, so the trade depends only on the
    two prices: k*step - (k-1)*step*price/previous price.
    """
    numbered = with_row_index(weeks, SERIES, ("week",), span=4096, name="k")

    def build(f, w):
        k, prev = F.col("k").cast("double"), F.lag("price").over(w)
        held = F.coalesce((k - 1) * step * F.col("price") / prev, F.lit(0.0))
        return f.withColumn("trade", k * step - held).withColumn("units", k * step / F.col("price"))

    return windowed(numbered, build, before=1, idx="k")


def kelly(rows: DataFrame, keys, ret: str = "signed") -> DataFrame:
    """W - (1-W)/R with half and quarter stakes; R is mean win over mean loss."""
    r = F.col(ret)
    agg = rows.groupBy(*keys).agg(
        F.avg((r > 0).cast("int")).alias("win_rate"), F.avg(F.when(r > 0, r)).alias("_win"), F.avg(F.when(r < 0, -r)).alias("_loss")
    )
    ratio = F.col("_win") / F.nullif(F.col("_loss"), F.lit(0.0))
    full = F.col("win_rate") - (1 - F.col("win_rate")) / ratio
    return agg.select(*keys, "win_rate", ratio.alias("win_loss_ratio"), full.alias("kelly"), (full / 2).alias("half_kelly"), (full / 4).alias("quarter_kelly"))


def position_size(account: Column | float, risk: Column | float, stop_distance: Column) -> Column:
    return F.try_divide(F.lit(account) * F.lit(risk), stop_distance)


def rebalance_drift(bars: DataFrame, weight: float = 0.2, limit: float = 0.05) -> DataFrame:
    """Share of a holding bought once at ``weight``; flagged when it drifts beyond ``limit``."""
    start = bars.groupBy(*SERIES).agg(F.min_by("close", "open_time_ms").alias("_p0"))
    grown = F.lit(weight) * F.col("close") / F.col("_p0")
    share = grown / (grown + (1 - weight))
    return bars.join(start, list(SERIES)).withColumn("share", share).withColumn("rebalance", F.abs(share - weight) > limit).drop("_p0")


# ── cycle indicators ─────────────────────────────────────────────────────────
def cycle_indicators(bars: DataFrame) -> DataFrame:
    """Pi cycle, Mayer multiple, growth of the 1400-bar mean, two-year bands; null while short."""
    def build(f, w):
        f = f.withColumns({f"_m{n}": ind.sma_strict("close", w, n) for n in (111, 200, 350, 730, 1400)})
        return f.withColumn("ma200w_growth_pct", (F.col("_m1400") / F.lag("_m1400", 28).over(w) - 1) * 100)

    f = windowed(bars, build, before=1430)
    c = F.col("close")
    mayer = c / F.col("_m200")
    zone = F.when(mayer < 0.8, "extreme_low").when(mayer < 1.0, "low").when(mayer < 1.5, "fair").when(mayer < 2.0, "elevated").when(mayer <= 2.4, "high").when(mayer <= 3.0, "bubble").otherwise("extreme_high")
    return f.select(
        *SERIES,
        "open_time_ms",
        (F.col("_m111") > F.col("_m350") * 2).alias("pi_top"),
        mayer.alias("mayer"),
        F.when(mayer.isNotNull(), zone).alias("mayer_zone"),
        "ma200w_growth_pct",
        F.when(c < F.col("_m730"), "below").when(c > F.col("_m730") * 5, "above_5x").when(F.col("_m730").isNotNull(), "between").alias("ma2y_band"),
    )


def rainbow_fit(bars: DataFrame, bands: int = 9) -> DataFrame:
    """Power-law fit ln(close) on ln(bar number) per series and the band of each bar's gap."""
    x, y = F.ln(F.col("row_idx").cast("double")), F.ln("close")
    ok = bars.filter(F.col("close") > 0)
    fit = ok.groupBy(*SERIES).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    gap = ok.join(fit, list(SERIES)).withColumn("residual", y - (F.col("slope") * x + F.col("intercept")))
    ends = gap.groupBy(*SERIES).agg(F.min("residual").alias("_lo"), F.max("residual").alias("_hi"))
    place = (F.col("residual") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bands
    return gap.join(ends, list(SERIES)).withColumn("band", F.least(F.floor(place), F.lit(bands - 1)).cast("int")).drop("_lo", "_hi")


# Weight, buy rule and sell rule of each indicator.
COMPOSITE = {
    "nupl": (0.20, lambda c: c < 0, lambda c: c > 0.75),
    "mvrv_z": (0.20, lambda c: c < 1, lambda c: c > 6),
    "pi_ratio": (0.15, None, lambda c: c > 1),
    "ma200w_ratio": (0.15, lambda c: c <= 1, None),
    "rhodl": (0.10, lambda c: c < 10, lambda c: c > 50_000),
    "ma2y_ratio": (0.10, lambda c: c < 1, lambda c: c > 5),
    "fear_greed": (0.10, lambda c: c < 20, lambda c: c > 80),
}


def composite_timing(rows: DataFrame) -> DataFrame:
    """Buys and sells of seven weighted indicators; four that agree make a signal."""
    def total(side, weighted):
        out = F.lit(0.0 if weighted else 0)
        for name, (weight, buy, sell) in COMPOSITE.items():
            rule = buy if side == "buy" else sell
            if rule is not None:
                hit = F.coalesce(rule(F.col(name)), F.lit(False))
                out = out + (F.when(hit, weight).otherwise(0.0) if weighted else hit.cast("int"))
        return out

    f = rows.withColumns({"buys": total("buy", False), "sells": total("sell", False), "score": total("buy", True) - total("sell", True)})
    return f.withColumn("timing", F.when(F.col("buys") >= COMPOSITE_NEED, "buy").when(F.col("sells") >= COMPOSITE_NEED, "sell").otherwise("none"))


def onchain_ratios(rows: DataFrame) -> DataFrame:
    """MVRV, SOPR, NUPL and the Puell multiple (365-row mean of the issuance)."""
    def build(f, w):
        return f.withColumn("puell", F.try_divide(F.col("issuance"), F.avg("issuance").over(w.rowsBetween(-364, 0))))

    f = windowed(rows, build, before=365)
    m, r = F.col("market_cap"), F.col("realized_cap")
    return f.withColumns({"mvrv": F.try_divide(m, r), "sopr": F.try_divide(F.col("spent_value"), F.col("created_value")), "nupl": F.try_divide(m - r, m)})


def confidence_buckets(rows: DataFrame, p: str = "p", o: str = "o", at_ms: str = "issued_ms") -> DataFrame:
    """Resolve rate and Brier by stated confidence and calendar quarter."""
    v = F.col(p)
    band = F.when(v >= 0.6, "60%+").when(v >= 0.4, "40-59%").when(v >= 0.3, "30-39%").otherwise("<30%")
    quarter = F.concat(F.year(F.timestamp_millis(at_ms)).cast("string"), F.lit("Q"), F.quarter(F.timestamp_millis(at_ms)).cast("string"))
    return rows.groupBy(band.alias("band"), quarter.alias("quarter")).agg(
        F.count("*").alias("n"), F.avg(o).alias("resolve_rate"), F.avg((v - F.col(o)) * (v - F.col(o))).alias("brier")
    )
