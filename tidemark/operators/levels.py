"""Key levels, session price and level events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import DAY_MS, floor_to
from tidemark.operators.blocks import SERIES, windowed


def newest(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each series by ``row_idx``."""
    sizes = df.groupBy(*SERIES).agg(F.max("row_idx").alias("_n"))
    return df.join(sizes, list(SERIES)).filter(F.col("row_idx") > F.col("_n") - n).drop("_n")


def recent_high_low(bars: DataFrame, n: int = 24) -> DataFrame:
    return newest(bars, n).groupBy(*SERIES).agg(F.max("high").alias("recent_high"), F.min("low").alias("recent_low"))


def vwap_session(bars: DataFrame, now_ms: Column) -> DataFrame:
    """Volume-weighted typical price of the current UTC day; null without volume."""
    today = (F.col("open_time_ms") >= floor_to(now_ms, DAY_MS)) & (F.col("volume") > 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    v = F.sum(F.when(today, F.col("volume")))
    return bars.groupBy(*SERIES).agg((F.sum(F.when(today, typical * F.col("volume"))) / v).alias("vwap_session"))


def pivot_columns(high="high", low="low", close="close") -> dict[str, Column]:
    h, l, c = F.col(high), F.col(low), F.col(close)
    p = (h + l + c) / 3.0
    return {"pivot_classic": p, "r1": 2 * p - l, "s1": 2 * p - h, "r2": p + (h - l), "s2": p - (h - l)}


def pivot_levels(daily: DataFrame) -> DataFrame:
    """Classic pivots of the newest closed daily bar."""
    last = daily.groupBy(*SERIES).agg(F.max_by(F.struct("high", "low", "close"), "open_time_ms").alias("d")).select(*SERIES, "d.*")
    return last.select(*SERIES, *[c.alias(n) for n, c in pivot_columns().items()])


def key_levels(hourly: DataFrame, daily: DataFrame, now_ms: Column) -> DataFrame:
    """One row per series: levels, daily means, status and notes (both inputs closed, with ``row_idx``)."""
    h = hourly.groupBy(*SERIES).agg(F.count("*").alias("closed_1h_count"))
    h = h.join(recent_high_low(hourly), list(SERIES), "left").join(vwap_session(hourly, now_ms), list(SERIES), "left")
    sizes = daily.groupBy(*SERIES).agg(F.max("row_idx").alias("closed_1d_count"))
    back = daily.join(sizes, list(SERIES)).withColumn("_back", F.col("closed_1d_count") - F.col("row_idx"))

    def mean(n):
        ok = (F.max("closed_1d_count") >= 20) & (F.max("closed_1d_count") >= n)
        return F.when(ok, F.avg(F.when(F.col("_back") < n, F.col("close")))).alias(f"sma_{n}")

    d = back.groupBy(*SERIES).agg(F.max("closed_1d_count").alias("closed_1d_count"), mean(20), mean(50), mean(200))
    d = d.join(pivot_levels(daily), list(SERIES))
    both = h.join(d, list(SERIES), "full")
    no_h, no_d = F.col("closed_1h_count").isNull(), F.col("closed_1d_count").isNull()
    few = F.coalesce(F.col("closed_1d_count") < 20, F.lit(True))
    notes = F.array_compact(
        F.array(
            F.when(no_h, "no closed 1h bars"),
            F.when(no_d, "no closed daily bar"),
            F.when(few, "insufficient daily bars for SMAs"),
            F.when(~few & F.col("sma_50").isNull(), "sma_50 needs 50+ daily closes"),
            F.when(~few & F.col("sma_200").isNull(), "sma_200 needs 200+ daily closes"),
        )
    )
    return both.withColumn("degraded", no_h | no_d).withColumn("notes", notes).withColumn(
        "status", F.when(no_h & no_d, "failed").when(no_h | no_d, "degraded").otherwise("ok")
    )


def daily_change(bars: DataFrame, n: int = 24) -> DataFrame:
    """Percent move of each close against the open of the n-th bar back (null while short)."""
    def build(f, w):
        ref = F.lag("open", n - 1).over(w)
        return f.withColumn("change_pct", F.when(ref > 0, (F.col("close") - ref) / ref * 100.0))

    return windowed(bars, build, before=n)


def trend_count(bars: DataFrame) -> DataFrame:
    """Two trend readings per bar: up-bars of the last 7, and rises over the last 5 closes.

    A bar without an open makes the first reading unknown.
    """
    def build(f, w):
        f = f.withColumn("_rise", (F.col("close") > F.lag("close").over(w)).cast("int"))
        seven = w.rowsBetween(-6, 0)
        return f.withColumns(
            {
                "up_7": F.sum((F.col("close") > F.col("open")).cast("int")).over(seven),
                "_opens": F.count("open").over(seven),
                "_seen": F.count("*").over(seven),
                "rises_5": F.coalesce(F.sum("_rise").over(w.rowsBetween(-3, 0)), F.lit(0)),
            }
        )

    f = windowed(bars, build, before=8)
    up, rises = F.col("up_7"), F.col("rises_5")
    return f.withColumn(
        "trend_7", F.when(F.col("_opens") < F.col("_seen"), "UNKNOWN").when(up >= 5, "BULLISH").when(up <= 2, "BEARISH").otherwise("NEUTRAL")
    ).withColumn(
        "trend_5", F.when(F.col("row_idx") < 3, "UNKNOWN").when(rises >= 4, "BULLISH").when(rises <= 1, "BEARISH").otherwise("NEUTRAL")
    ).drop("_rise", "_opens", "_seen")


def level_events(quotes: DataFrame, levels: DataFrame, move_pct: float = 3.0) -> DataFrame:
    """Long table of events per quote: large move, trend, and approach/break/test of levels.

    ``quotes``: series_id, open_time_ms, price, change_pct, trend. ``levels``: series_id,
    name, level, is_top (a handful per series, joined as one array per series).
    """
    packed = levels.groupBy(*SERIES).agg(F.collect_list(F.struct("name", "level", "is_top")).alias("_levels"))
    price, change = F.col("price"), F.col("change_pct")

    def event(kind, severity, name):
        return F.struct(F.lit(kind).alias("event"), F.lit(severity).alias("severity"), name.cast("string").alias("level_name"))

    def at_level(lv):
        away = (price - lv["level"]) / lv["level"] * 100
        top = F.when((away > 0) & (away < 2), event("APPROACHING", "MEDIUM", lv["name"])).when(
            (away >= 0) & (change > 2), event("BREAK_UP", "HIGH", lv["name"])
        )
        base = F.when((away > -2) & (away < 0) & (change < -1), event("TESTING_SUPPORT", "MEDIUM", lv["name"])).when(
            (away < -2) & (change < -2), event("BREAK_DOWN", "HIGH", lv["name"])
        )
        return F.when(lv["is_top"], top).otherwise(base)

    none = F.lit(None)
    own = F.array(
        F.when(F.abs(change) >= move_pct, event("LARGE_MOVE", "HIGH", none)),
        F.when(F.col("trend").isin("BULLISH", "BEARISH"), event("TREND", "LOW", none)),
    )
    found = F.array_compact(F.concat(own, F.transform("_levels", at_level)))
    return quotes.join(packed, list(SERIES)).select(*SERIES, "open_time_ms", F.inline_outer(found)).filter("event IS NOT NULL")


def level_events_strict(quotes: DataFrame, levels: DataFrame, move_pct: float = 3.0, funding_extreme: float = 0.05) -> DataFrame:
    """The narrower rule set, with funding extremes (``funding`` may be null)."""
    packed = levels.groupBy(*SERIES).agg(F.collect_list(F.struct("name", "level", "is_top")).alias("_levels"))
    price, change, funding = F.col("price"), F.col("change_pct"), F.col("funding")

    def event(kind, name):
        return F.struct(F.lit(kind).alias("event"), name.cast("string").alias("level_name"))

    def at_level(lv):
        level = lv["level"]
        top = F.when((price > level * 0.99) & (price < level * 1.01), event("APPROACHING", lv["name"])).when(
            (price > level) & (change > 0), event("BROKE_ABOVE", lv["name"])
        )
        base = F.when((price < level * 1.02) & (change < 0), event("TESTING_SUPPORT", lv["name"])).when(
            (price < level) & (change < -2), event("BROKE_BELOW", lv["name"])
        )
        return F.when(lv["is_top"], top).otherwise(base)

    none = F.lit(None)
    own = F.array(
        F.when(F.abs(change) >= move_pct, event("LARGE_MOVE", none)),
        F.when(funding > funding_extreme, event("FUNDING_HIGH", none)).when(funding < -funding_extreme, event("FUNDING_LOW", none)),
    )
    found = F.array_compact(F.concat(own, F.transform("_levels", at_level)))
    return quotes.join(packed, list(SERIES)).select(*SERIES, "open_time_ms", F.inline_outer(found)).filter("event IS NOT NULL")


def level_position(quotes: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels above and below each price, nearest resistance and support."""
    packed = levels.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("level", "name"))).alias("_levels"))
    below = F.filter("_levels", lambda lv: lv["level"] <= F.col("price"))
    above = F.filter("_levels", lambda lv: lv["level"] > F.col("price"))
    strictly = F.filter("_levels", lambda lv: lv["level"] < F.col("price"))
    over = F.filter("_levels", lambda lv: lv["level"] >= F.col("price"))
    return quotes.join(packed, list(SERIES)).select(
        *SERIES,
        "open_time_ms",
        F.transform(strictly, lambda lv: lv["name"]).alias("above_levels"),
        F.transform(over, lambda lv: lv["name"]).alias("below_levels"),
        F.array_min(F.transform(above, lambda lv: lv["level"])).alias("nearest_resist"),
        F.array_max(F.transform(below, lambda lv: lv["level"])).alias("nearest_support"),
    )
