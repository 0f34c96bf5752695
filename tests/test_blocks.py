import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import blocks as K
from tidemark.operators import regime as R
from tidemark.operators.indicators import ema, rsi_wilder


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    frames = []
    for name, n in (("a", 700), ("b", 311), ("c", 1)):
        hours = np.sort(rng.choice(3 * n, n, replace=False))
        frames.append(pd.DataFrame({"series_id": name, "open_time_ms": hours * 3_600_000, "close": 100 + rng.normal(size=n).cumsum(), "v": rng.integers(0, 5, n).astype(float)}))
    pdf = pd.concat(frames).sample(frac=1, random_state=1)
    df = K.with_row_index(spark.createDataFrame(pdf), span=64 * 3_600_000).cache()
    return df, pdf.sort_values(["series_id", "open_time_ms"]).reset_index(drop=True)


def rows(df, *cols):
    return df.select("series_id", "row_idx", *cols).toPandas().sort_values(["series_id", "row_idx"]).reset_index(drop=True)


def test_row_index_counts_across_spans(series):
    df, pdf = series
    want = pdf.groupby("series_id").cumcount() + 1
    got = df.toPandas().sort_values(["series_id", "open_time_ms"])
    assert (got["row_idx"].to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("size", [25, 100, 4096])
def test_windowed_does_not_depend_on_block_size(series, size):
    df, pdf = series

    def build(f, w):
        return f.withColumn("m", F.avg("close").over(w.rowsBetween(-19, 0))).withColumn("nxt", F.lead("close", 5).over(w))

    got = rows(K.windowed(df, build, before=19, after=5, rows=size), "m", "nxt")
    g = pdf.groupby("series_id")["close"]
    assert np.allclose(got["m"], g.transform(lambda s: s.rolling(20, min_periods=1).mean()))
    assert np.allclose(got["nxt"], g.shift(-5), equal_nan=True)


@pytest.mark.parametrize("size", [16, 4096])
def test_prefix_scan(series, size):
    df, pdf = series
    seen = F.when(F.col("v") > 3, F.col("v"))
    out = K.prefix_scan(df, {"s": ("sum", F.col("close")), "hi": ("max", F.col("close")), "lo": ("min", F.col("close")), "n": ("count", seen), "last": ("last", seen)}, rows=size)
    got = rows(out, "s", "hi", "lo", "n", "last")
    g = pdf.groupby("series_id")["close"]
    assert np.allclose(got["s"], g.cumsum())
    assert np.allclose(got["hi"], g.cummax())
    assert np.allclose(got["lo"], g.cummin())
    known = pdf["v"].where(pdf["v"] > 3)
    assert (got["n"] == known.notna().groupby(pdf["series_id"]).cumsum()).all()
    assert np.allclose(got["last"], known.groupby(pdf["series_id"]).ffill(), equal_nan=True)


@pytest.mark.parametrize("span", [2, 24, 500])
def test_ema_equals_serial(series, span):
    df, pdf = series
    got = rows(ema(df, "close", span, "e"), "e")
    want = pdf.groupby("series_id")["close"].transform(lambda s: s.ewm(span=span, adjust=False).mean())
    assert np.allclose(got["e"], want, rtol=1e-12)


def test_rsi_equals_serial(series):
    df, pdf = series

    def serial(c, n=14):
        out = np.full(len(c), 50.0)
        if len(c) <= n:
            return out
        d = np.diff(c)
        g, l = np.maximum(d, 0), np.maximum(-d, 0)
        ag, al = g[:n].mean(), l[:n].mean()
        for i in range(n, len(c)):
            if i > n:
                ag, al = (ag * (n - 1) + g[i - 1]) / n, (al * (n - 1) + l[i - 1]) / n
            out[i] = 100.0 if al == 0 else 100 - 100 / (1 + ag / al)
        return out

    got = rows(rsi_wilder(df), "rsi")
    want = np.concatenate([serial(g["close"].to_numpy()) for _, g in pdf.groupby("series_id")])
    assert np.allclose(got["rsi"], want, atol=1e-9)


@pytest.mark.parametrize("col", ["close", "v"])
def test_causal_median_is_exact_with_ties_and_many_blocks(series, col):
    df, pdf = series
    got = rows(R.causal_median(df, col, "m", rows=32, bands=16), "m")
    want = pdf.groupby("series_id")[col].transform(lambda s: s.expanding().median())
    assert np.allclose(got["m"], want)


def test_a_block_of_the_median_is_sent_a_few_times_its_rows(spark):
    n, rows_ = 1_000_000, 2048
    df = spark.range(n).select(F.lit("s").alias("series_id"), (F.col("id") + 1).alias("row_idx"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    feed = R.median_feed(df, "v", ["series_id"], "row_idx", rows_, 512)
    sent = feed.filter("_i IS NULL").groupBy("_blk").count()
    assert sent.agg(F.max("count")).first()[0] <= 6 * rows_


@pytest.mark.parametrize("before,after", [(19, 0), (7, 5)])
def test_a_block_holds_its_rows_and_the_halo_only(series, before, after):
    df, _ = series

    def build(f, w):
        return f.withColumn("held", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    out = K.windowed(df, build, before=before, after=after, rows=40)
    assert out.count() == df.count()
    assert out.agg(F.max("held")).first()[0] <= 40 + before + after


def test_ticks_are_aggregated_by_hash_before_the_shuffle(spark):
    from tidemark.operators.bars import tick_to_bar

    ticks = spark.range(1000).select(F.lit("hot").alias("series_id"), (F.col("id") * 60_000_000).alias("ts_us"), F.col("id").alias("event_id"), F.rand(1).alias("price"), F.lit(1.0).alias("size"))
    bars = tick_to_bar(ticks)
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2
    assert bars.count() == 17


def test_ticks_of_one_instant_are_ordered_by_id(spark):
    from tidemark.operators.bars import tick_to_bar

    rows = [("s", 5, i, float(i), 1.0) for i in (3, 1, 2)]
    bar = tick_to_bar(spark.createDataFrame(rows, "series_id string, ts_us long, event_id long, price double, size double")).first()
    assert (bar.open, bar.close, bar.high, bar.low) == (1.0, 3.0, 3.0, 1.0)
