"""Streaming queries, run to the end of the stored input; each has a batch answer in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators.metrics import TAPE_KEYS
from tidemark.plans import inputs as I
from tidemark.plans import ledger_data as D
from tidemark.plans.oracle import r, sql
from tidemark.plans.q_drift import EWMA_CONFIG, PH_CONFIG, errors
from tidemark.plans.registry import query, report
from tidemark.streaming import bars as SB
from tidemark.streaming import drift as SD
from tidemark.streaming import issue as SI
from tidemark.streaming import run as R

_c = F.col


def _events(spark, d):
    schema = I.table(spark, d, "events").schema
    ev = R.file_stream(spark, d, schema, "events.parquet")
    return ev.select(
        _c("event_type").alias("series_id"), _c("ts").cast("timestamp").alias("ts"), "event_id", (_c("value") + I.PRICE_BASE).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
    )


def _drain(spark, stream):
    base = I.scratch_dir(spark)
    return R.drain(stream, f"{base}/out", f"{base}/state")


ARRIVALS = 4


def _fed(spark, build, *sources):
    """Drain the stream that ``build`` makes of the sources (rows, number of their arrival).

    Arrivals come one after another, each written by as many tasks as its rows have partitions; the
    stream runs after each, from its checkpoint.
    """
    base = I.scratch_dir(spark)
    parts = [I.settle(rows.withColumn("_part", turn)) for rows, turn in sources]
    for k in range(ARRIVALS):
        for i, part in enumerate(parts):
            part.filter(_c("_part") == k).drop("_part").write.mode("append").parquet(f"{base}/in{i}")
        streams = [R.file_stream(spark, f"{base}/in{i}", rows.schema) for i, (rows, _) in enumerate(sources)]
        out = R.drain(build(*streams), f"{base}/out", f"{base}/state")
    return out


def _quarter(rows, column):
    """Which quarter of the time span a row lies in."""
    ms = F.unix_millis(column)
    lo, hi = (rows.agg(f(ms)).scalar() for f in (F.min, F.max))
    at = F.floor((ms - lo) * ARRIVALS / (hi - lo + 1))
    return F.least(at, F.lit(ARRIVALS - 1)).cast("int")


@query("s_bars", sql(f"""
SELECT series_id, open_time_ms, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')}
FROM q_bars WHERE close_time_ms <= (SELECT max(ts_us) // 1000 FROM q_ticks) - 900000"""))
def s_bars(spark, d):
    out = _drain(spark, SB.stream_bars(_events(spark, d)))
    return report(out.withColumn("open_time_ms", F.unix_millis("open_time")).drop("open_time", "close_time"))


@query("s_archive", sql(f"""
SELECT series_id, open_time_ms, source, {r('close', 'close')} FROM q_venue_bars
QUALIFY row_number() OVER (PARTITION BY series_id, open_time_ms ORDER BY source DESC) = 1"""))
def s_archive(spark, d):
    """Venues arrive one after another; the bar of the first one is kept."""
    bars = I.venue_bars(spark, d).select("series_id", F.timestamp_millis("open_time_ms").alias("open_time"), "source", "close")
    turn = F.when(_c("source") == "kraken", 0).when(_c("source") == "coinbase", 1).otherwise(2)
    out = _fed(spark, lambda s: SB.stream_archive(s, delay="60 days"), (bars, turn))
    return report(out.select("series_id", F.unix_millis("open_time").alias("open_time_ms"), "source", "close"))


_TWO_HOURS = 2 * 3_600_000


@query("s_resolve", sql(f"""
SELECT f.forecast_id, round(m.actual_close, 6) + 0.0 AS actual_close FROM q_forecasts f LEFT JOIN q_match m USING (forecast_id)
WHERE m.forecast_id IS NOT NULL OR f.target_ms < least((SELECT max(target_ms) FROM q_forecasts), (SELECT max(close_time_ms) FROM q_bars)) - {_TWO_HOURS}"""))
def s_resolve(spark, d):
    fc = D.forecasts(spark, d).select("forecast_id", "series_id", F.timestamp_millis("target_ms").alias("target_time"))
    bars = I.hourly(spark, d).select("series_id", F.timestamp_millis("close_time_ms").alias("close_time"), "close")
    out = _fed(spark, SB.stream_resolve, (fc, _quarter(fc, "target_time")), (bars, _quarter(bars, "close_time")))
    return report(out.select("forecast_id", _c("close").alias("actual_close")))


@query("s_drift", sql("""
SELECT series_id, model_version, horizon, row_idx, p.alarm AS ph_alarm, e.alarm AS ewma_alarm FROM q_ph_alarm p JOIN q_ew_alarm e USING (series_id, model_version, horizon, row_idx)"""))
def s_drift(spark, d):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SD.ROCKSDB)
    try:
        rows = errors(spark, d).select(*TAPE_KEYS, "row_idx", "x")
        # Every arrival holds rows from all over the streams: most come before their predecessors.
        turn = F.pmod(F.xxhash64("row_idx"), F.lit(ARRIVALS)).cast("int")
        return _fed(spark, lambda s: SD.stream_drift(s, list(TAPE_KEYS), PH_CONFIG, EWMA_CONFIG), (rows, turn))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@query("s_issue", sql(f"""
SELECT forecast_id, series_id, model_version, horizon, issued_ms, target_ms, direction, {r('probability', 'probability')}, {r('entry_price', 'entry_price')}, issued_at_actual_ms
FROM q_forecasts WHERE issued_at_actual_ms <= (SELECT max(close_time_ms) FROM q_bars) - 5400000"""))
def s_issue(spark, d):
    """Bars arrive shuffled within each quarter of the time span; the runs follow the watermark."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SD.ROCKSDB)
    try:
        bars = D.state(spark, d).select("series_id", F.timestamp_millis("close_time_ms").alias("close_time"), *SI.FIELDS)
        called = _fed(spark, lambda s: SI.stream_issue(s, "90 minutes", D.ALL_MODELS), (bars, _quarter(bars, "close_time")))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return report(L.forecast_rows(called).select("forecast_id", "series_id", "model_version", "horizon", "issued_ms", "target_ms", "direction", "probability", "entry_price", "issued_at_actual_ms"))


DAYS = (7, 30, 90)


@query("s_metrics", sql(" UNION ALL ".join(f"""
SELECT {n} AS days, model_version, horizon, start_ms, n, hits, {r('ex', 'expectancy_maker_2bps')} FROM (
SELECT model_version, horizon, (issued_ms // 86400000 - k) * 86400000 AS start_ms, count(*) AS n, CAST(sum(o) AS BIGINT) AS hits, avg(signed) * 10000 - 2 AS ex
FROM (SELECT *, unnest(range({n})) AS k FROM q_resolved) x GROUP BY 1, 2, 3) y
WHERE start_ms + {n}::BIGINT * 86400000 <= (SELECT max(issued_ms) FROM q_resolved) - 900000""" for n in DAYS)))
def s_metrics(spark, d):
    rows = D.scored(spark, d).select(F.timestamp_millis("issued_ms").alias("issued_at"), "model_version", "horizon", "o", "signed")
    daily = _fed(spark, SB.stream_daily, (rows, _quarter(rows, "issued_at")))
    return report(SB.rolling(daily, DAYS))


@query("s_late_rows", sql("""
SELECT event_id, size < 50 AND ts_us < (SELECT max(ts_us) FROM q_ticks WHERE size >= 50) - 900000000 AS late FROM q_ticks"""))
def s_late_rows(spark, d):
    """Two arrivals of the ticks; what the second brings behind the watermark is set aside."""
    path, base = I.scratch_dir(spark), I.scratch_dir(spark)
    ticks = I.ticks(spark, d).select("event_id", F.timestamp_micros("ts_us").alias("ts"), "size")
    ticks.filter("size >= 50").write.parquet(path)
    first = R.file_stream(spark, path, ticks.schema)
    R.split_late(first, f"{base}/ok", f"{base}/late", f"{base}/state")
    ticks.filter("size < 50").write.mode("append").parquet(path)
    R.split_late(R.file_stream(spark, path, ticks.schema), f"{base}/ok", f"{base}/late", f"{base}/state")
    parts = [spark.read.schema(ticks.schema).parquet(f"{base}/{n}").select("event_id", F.lit(v).alias("late")) for n, v in (("ok", False), ("late", True))]
    return parts[0].unionByName(parts[1])
