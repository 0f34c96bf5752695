"""Trade tapes by blocks, drift in true order, rolling windows from days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators import metrics as M
from tidemark.streaming import bars as SB
from tidemark.streaming import drift as SD
from tidemark.streaming import run as R

HOUR = 3_600_000


def serial_tape(xs):
    cum = peak = fall = 0.0
    for x in xs:
        cum += x
        peak = max(peak, cum)
        fall = max(fall, peak - cum)
    return len(xs), cum, fall


@pytest.mark.parametrize("span, fan", [(HOUR, 2), (5 * HOUR, 3), (10**15, 512)])
def test_tape_blocks_change_nothing(spark, span, fan):
    rng = random.Random(2)
    streams = {"a": [rng.gauss(0, 9) for _ in range(60)], "b": [-5.0] * 12, "c": [5.0] * 12, "d": [1.0] * 4}
    rows = [(k, "m", "1h", i * HOUR // 2, f"{i:03d}", x) for k, v in streams.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "series_id string, model_version string, horizon string, issued_ms long, forecast_id string, bps double")
    # A forecast whose maker return is bps: entry 100, call up.
    df = df.withColumns({"status": F.lit("resolved"), "direction": F.lit("up"), "probability": F.lit(0.6), "entry_price": F.lit(100.0)})
    ret = (F.col("bps") + 2.0) / 10000.0
    df = df.withColumns({"actual_return": ret, "actual_close": 100.0 * (1 + ret), "direction_correct": ret > 0, "regime_at_issue": F.lit("bull")})
    got = {r.series_id: (r.n, r.sum_bps_maker, r.max_drawdown_bps_maker) for r in M.trade_tape(df, min_n=5, span=span, fan=fan).collect()}
    assert set(got) == {"a", "b", "c"}
    for k, v in got.items():
        assert v == pytest.approx(serial_tape(streams[k]), abs=1e-6)


def test_drift_takes_rows_in_order_whenever_they_arrive(spark, tmp_path):
    rng = random.Random(7)
    xs = [(k, i + 1, abs(rng.gauss(0.2 + 0.3 * (i > 60), 0.1))) for k in ("u", "v") for i in range(120)]
    schema = "k string, row_idx long, x double"
    want = spark.createDataFrame(xs, schema)
    ph, ew = {"threshold": 1.0}, {"k_sigma": 1.0}
    want = D.ewma_drift(D.page_hinkley(want, ["k"], **ph), ["k"], **ew)
    want = {(r.k, r.row_idx, r.ph_alarm, r.ewma_alarm) for r in want.collect()}
    shuffled = xs[:]
    rng.shuffle(shuffled)
    batches = [shuffled[i::5] for i in range(5)]
    batches[3] += batches[0][:10]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SD.ROCKSDB)
    try:
        for batch in batches:
            spark.createDataFrame(batch, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
            stream = SD.stream_drift(R.file_stream(spark, f"{tmp_path}/in", want_schema(spark, schema)), ["k"], ph, ew)
            out = R.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert len(got) == len(xs) and set(got) == want


def want_schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def test_recent_alarms_look_at_the_newest_values_only(spark):
    xs = [0.1 + 0.001 * (i % 7) for i in range(300)]
    xs[20:60] = [5.0] * 40
    late = xs[:250] + [3.0] * 50
    rows = [(k, i, float(x)) for k, v in (("old", xs), ("new", late)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, at long, x double")
    got = {r.k: r.drift_alarms for r in D.recent_alarms(df, ["k"], ("at",), 100, {"threshold": 3.0}).collect()}
    assert got["old"] == 0 and got["new"] > 0


def test_rolling_windows_from_days(spark):
    rng = random.Random(1)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    daily = [(day(n), "m", "1h", rng.randint(1, 9), 1, rng.random()) for n in range(12) if n != 4]
    df = spark.createDataFrame(daily, "day timestamp, model_version string, horizon string, n long, hits long, signed double")
    got = {(r.days, r.start_ms): (r.n, r.hits, r.expectancy_maker_2bps) for r in SB.rolling(df, (1, 5)).collect()}
    zero = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    want = {}
    for n in (1, 5):
        for s in range(-n + 1, 12 - n + 1):
            inside = [d for d in daily if s <= (d[0] - day(0)).days < s + n]
            if inside:
                want[n, zero + s * 86_400_000] = (sum(d[3] for d in inside), len(inside), pytest.approx(sum(d[5] for d in inside) / sum(d[3] for d in inside) * 10000 - 2))
    assert got == want
