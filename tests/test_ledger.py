import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import ledger as L
from tidemark.operators import metrics as M
from tidemark.sources.synthetic import synthetic_bars

H = 3_600_000


def one(df):
    return df.collect()[0]


def test_wilson(spark):
    row = one(spark.sql("SELECT 0.6D AS p, 105 AS n, 0 AS z").select(S.wilson_lower(F.col("p"), F.col("n")).alias("a"), S.wilson_lower(F.col("p"), F.col("z")).alias("b")))
    assert row.a == pytest.approx(0.5044, abs=1e-4) and row.b == 0.0


def test_tie_is_wrong_both_ways(spark):
    df = spark.createDataFrame([("up", 10.0, 10.0), ("down", 10.0, 10.0), ("up", 10.0, 11.0), ("down", 10.0, 9.0)], "d string, e double, c double")
    assert [r.o for r in df.select(S.outcome(F.col("d"), F.col("e"), F.col("c")).alias("o")).collect()] == [0, 0, 1, 1]


def pairs(spark, data):
    return spark.createDataFrame([("k", p, o) for p, o in data], "k string, p double, o int")


@pytest.mark.parametrize("data,want", [([(0.52, 1)] * 49, None), ([(0.52, 1)] * 50, 0.48)])
def test_ece_known_values(spark, data, want):
    got = one(M.ece_quantile(pairs(spark, data), ["k"])).ece
    assert got is None if want is None else got == pytest.approx(want)


def test_ece_calibrated_is_small(spark):
    data = [(0.5, i % 2) for i in range(100)] + [(0.55, int(i < 55)) for i in range(100)]
    assert one(M.ece_quantile(pairs(spark, data), ["k"])).ece < 0.03


def tape_rows(spark, returns):
    data = [("s", "m", "24h", i * H, f"f{i:02d}", "up", r, r > 0, 0.5, 0.25, 0.7, "resolved", "bull") for i, r in enumerate(returns)]
    return spark.createDataFrame(
        data,
        "series_id string, model_version string, horizon string, issued_ms long, forecast_id string, direction string, actual_return double, "
        "direction_correct boolean, probability double, brier_component double, logloss_component double, status string, regime_at_issue string",
    )


def test_tape_curve_and_drawdown(spark):
    rows = tape_rows(spark, [0.01, -0.02, 0.005, 0.01, -0.01, 0.02])
    cum = [r.cum_bps for r in M.tape_curve(rows).orderBy("trade_no").collect()]
    assert cum == pytest.approx([98, -104, -56, 42, -60, 138])
    t = one(M.trade_tape(rows))
    assert t.max_drawdown_bps_maker == pytest.approx(202) and t.wins == 4 and t.n == 6


def test_tape_needs_five_trades(spark):
    assert M.trade_tape(tape_rows(spark, [0.01] * 4)).count() == 0


def test_dedupe_keeps_first_unless_clock_says_earlier(spark):
    data = [
        ("a", 0, None, "x"), ("a", 1, 5, "y"),                  # first has no clock: stays
        ("b", 2, 9, "x"), ("b", 3, 4, "y"), ("b", 4, 4, "z"),   # earliest clock, first of equals
        ("c", 5, 3, "x"), ("c", 6, None, "y"),                  # a missing clock never replaces
    ]
    df = spark.createDataFrame(data, "k string, file_pos long, issued_at_actual_ms long, v string")
    got = {r.k: (r.v, r.duplicates) for r in M.dedupe_bucket(df, keys=("k",)).collect()}
    assert got == {"a": ("x", 1), "b": ("y", 2), "c": ("x", 1)}


def guard(spark, last, sma24, sma72, idx=100, run_ms=1_735_732_800_000):  # 2025-01-01, a Wednesday
    df = spark.createDataFrame([(last, sma24, sma72, idx, run_ms)], "close double, sma24 double, sma72 double, row_idx long, run_ms long")
    sig = L.signal_guard24(F.col("run_ms"))
    r = one(df.select(*[c.alias(n) for n, c in sig.items()]))
    return r.direction, r.probability, r.reason


SATURDAY = 1_735_992_000_000


def test_guard_rules(spark):
    assert guard(spark, 102.0, 100.0, 99.0)[0] == "abstain"
    assert guard(spark, 100.2, 100.0, 99.0)[:2] == ("up", 0.55)
    assert guard(spark, 100.7, 100.0, 99.0)[:2] == ("up", 0.52)
    assert guard(spark, 99.7, 100.0, 99.0)[0] == "abstain"
    assert guard(spark, 99.7, 100.0, 99.9)[:2] == ("down", 0.55)
    assert "weekend-down" in guard(spark, 99.7, 100.0, 99.9, run_ms=SATURDAY)[2]
    assert "insufficient-history|have=72|need=73" in guard(spark, 99.7, 100.0, 99.9, idx=72)[2]


def test_replay_respects_backdating_and_staleness(spark):
    bars = synthetic_bars(spark, n=60).filter("row_idx <= 20 OR row_idx > 40")
    bars = bars.withColumn("row_idx", F.when(F.col("row_idx") > 40, F.col("row_idx") - 20).otherwise(F.col("row_idx")))
    fc = L.issue_replay(bars, (L.BASELINE,))
    hours = [r.h for r in fc.filter("horizon = '4h'").select(S.hour_utc(F.col("issued_ms")).alias("h")).distinct().collect()]
    assert all(h % 4 == 0 for h in hours)
    late = fc.agg(F.max(F.col("issued_at_actual_ms") - F.col("issued_ms"))).first()[0]
    assert late == 0
    # The gap of 20 bars is bridged for six hours only.
    assert fc.filter("horizon = '1h'").count() == 20 + 6 + 20
    loose = L.issue_replay(bars, (L.BASELINE,), max_backdate_ms=None)
    assert loose.filter("horizon = '4h'").select("issued_ms").distinct().count() == loose.filter("horizon = '4h'").count()


def test_resolution_takes_the_bar_closing_at_the_target(spark):
    bars = spark.createDataFrame([("s", "b", 0, H, 10.0), ("s", "b", H, 2 * H, 20.0)], "series_id string, source string, open_time_ms long, close_time_ms long, close double")
    fc = spark.createDataFrame([("f", "s", H, "up", 9.0, 0.6)], "forecast_id string, series_id string, target_ms long, direction string, entry_price double, probability double")
    m = one(L.resolve_exact(fc, bars, F.lit(2 * H)))
    assert m.actual_close == 10.0
    assert L.resolve_exact(fc, bars, F.lit(H - 1)).count() == 0
    inclusive = bars.withColumn("close_time_ms", F.col("close_time_ms") - 1)
    assert one(L.resolve_exact(fc, inclusive, F.lit(2 * H))).actual_close == 10.0
    s = one(L.score(L.resolve_exact(fc, bars, F.lit(2 * H)), F.lit(0)))
    assert s.brier_component == pytest.approx(0.16) and s.logloss_component == pytest.approx(-math.log(0.6))


def test_last_resolution_wins(spark):
    fc = spark.createDataFrame([("f", "open")], "forecast_id string, status string")
    res = spark.createDataFrame([("f", 1.0, "resolved", 0), ("f", 2.0, "resolved", 1)], "forecast_id string, actual_close double, status string, arrival int")
    assert [r.actual_close for r in L.ledger_join(fc, res, arrival="arrival").collect()] == [2.0]
