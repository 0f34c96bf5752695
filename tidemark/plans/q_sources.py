"""Queries over sources, archives, feeds and sinks. Raw forms are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators import bars as B
from tidemark.operators import health as H
from tidemark.plans import inputs as I
from tidemark.plans import ledger_data as D
from tidemark.plans.oracle import cte, r, sql
from tidemark.plans.registry import query, report
from tidemark.sources import jsonl, klines, payloads, snapshots

_c = F.col
LINE = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("series_id", T.StringType()), T.StructField("price", T.DoubleType())])


def _lines(spark, d, *spoil):
    """Every tick as a JSON line, followed by the given spoiled variants of it."""
    line = F.to_json(F.struct("event_id", "series_id", "price"))
    return I.ticks(spark, d).select(F.explode(F.array(line, *[s(line) for s in spoil])).alias("value"))


def _filed(spark, lines, *folders):
    """The lines as text files in the shared folder."""
    path = I.scratch_dir(spark)
    lines.write.partitionBy(*folders).text(path)
    return path


@query("scan_jsonl", sql("SELECT event_id, series_id, round(price, 6) + 0.0 AS price FROM q_ticks"))
def scan_jsonl(spark, d):
    return report(jsonl.scan_jsonl(spark, _filed(spark, _lines(spark, d, lambda x: F.lit("   "), lambda x: F.lit(""))), LINE))


@query("scan_jsonl_lenient", sql("SELECT count(*) AS n_rows, count(*) * 2 AS n_skipped, round(sum(price), 2) + 0.0 AS total FROM q_ticks"))
def scan_jsonl_lenient(spark, d):
    lines = _lines(spark, d, lambda x: F.lit(""), lambda x: F.concat(F.lit("{"), x), lambda x: F.lit("[1, 2]"))
    rows, bad = jsonl.scan_jsonl_lenient(spark, _filed(spark, lines), LINE)
    return rows.agg(F.count("*").alias("n_rows"), bad.scalar().alias("n_skipped"), (F.round(F.sum("price"), 2) + 0.0).alias("total"))


def _day():
    return F.floor(F.col("open_time_ms") / S.DAY_MS)


def _candles():
    """Candles of a group as they stand in a snapshot (at most 24 a day)."""
    fields = [F.when(_c("volume") > 0, _c(c)).alias(c) if c == "volume" else _c(c) for c in snapshots.BAR_FIELDS]
    return F.collect_list(F.struct(*fields))


def _payload(source, fetched_ms, candles="candles"):
    return F.to_json(
        F.struct(source.alias("source"), F.lit("ok").alias("status"), S.iso_utc(fetched_ms).alias("fetched_at"),
                 F.struct(F.lit("1h").alias("interval"), _c(candles).alias("candles")).alias("data"))
    )


def _docs(spark, d):
    per_day = I.hourly(spark, d).groupBy("series_id", _day().alias("day")).agg(_candles().alias("candles"))
    return per_day.select("series_id", _payload(F.lit("coinbase"), (_c("day") + 1) * S.DAY_MS).alias("payload"))


@query("scan_snapshot", sql(f"""
SELECT series_id, open_time_ms, close_time_ms, 'coinbase' AS source, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')} FROM q_bars WHERE volume > 0"""))
def scan_snapshot(spark, d):
    """One file per snapshot, below a folder per series and day."""
    docs = _docs(spark, d).select("series_id", F.sha1(_c("payload").cast("binary")).alias("snapshot"), _c("payload").alias("value"))
    files = snapshots.read_snapshots(spark, _filed(spark, docs, "series_id", "snapshot"))
    return report(snapshots.scan_snapshot(files).select("series_id", "source", *snapshots.BAR_FIELDS))


@query("scan_history", sql(f"""
SELECT series_id, open_time_ms, open_time_ms + 3599999 AS close_time_ms, source, {r('close', 'close')} FROM (
SELECT *, row_number() OVER (PARTITION BY series_id, open_time_ms ORDER BY source DESC) AS rk FROM q_venue_bars) x
WHERE rk = 1 AND open_time_ms < (SELECT max(ts_us) // 3600000000 * 3600000 FROM q_ticks)"""))
def scan_history(spark, d):
    place = F.when(_c("source") == "binance", 0).when(_c("source") == "coinbase", 1).otherwise(2)
    now = I.ticks(spark, d).agg(F.floor(F.max("ts_us") / 1000).cast("long")).scalar()
    rows = I.venue_bars(spark, d).drop("close_time_ms", "interval").withColumn("pos", place)
    return report(snapshots.scan_history(rows, now, min_bars=100).select("series_id", "open_time_ms", "close_time_ms", "source", "close"))


def _all_layouts(spark, d):
    venue = I.venue_bars(spark, d)
    out = klines.to_payload(I.hourly(spark, d), "coingecko")
    for source in I.VENUES:
        out = out.unionByName(klines.to_payload(venue.filter(_c("source") == source), source))
    return out


_FIELDS = ", ".join(r(c, c) for c in ("open", "high", "low", "close"))


@query("scan_kline_array", sql(f"""
SELECT series_id, source, open_time_ms, close_time_ms, {_FIELDS}, {r('volume', 'volume')} FROM q_venue_bars
UNION ALL SELECT series_id, 'coingecko', open_time_ms, close_time_ms, {_FIELDS}, NULL FROM q_bars"""))
def scan_kline_array(spark, d):
    return report(klines.scan_kline_array(_all_layouts(spark, d)))


@query("scan_price_bars", sql(f"""
SELECT series_id, source, close_time_ms // 1000 AS close_s, {r('close', 'close')} FROM q_venue_bars
UNION ALL SELECT series_id, 'coingecko', (half + 1) * 1800, {r('close', 'close')} FROM
 (SELECT series_id, ts_us // 1800000000 AS half, last(price ORDER BY ts_us, event_id) AS close FROM q_ticks GROUP BY 1, 2) x WHERE (half + 1) % 2 = 0"""))
def scan_price_bars(spark, d):
    half = B.tick_to_bar(I.ticks(spark, d).drop("venue"), width_ms=klines.HALF_HOUR_MS).withColumn("source", F.lit("coingecko"))
    cols = ("series_id", "source", "open_time_ms", "close_time_ms", "close")
    bars = I.venue_bars(spark, d).select(*cols).unionByName(half.select(*cols))
    return report(klines.scan_price_bars(bars).select("series_id", "source", "close_s", "close"))


# ── venue payloads: one answer per event, in the shape of one of four venues ─────
def _answers(spark, d):
    ev = I.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    funding, mark, oi = _c("value") / 100000, _c("value") + 10000, F.when(k > 5, k)
    buy, sell = k / 100, (99 - k) / 100
    when = F.unix_millis(_c("ts").cast("timestamp")).cast("string")
    venue = F.element_at(F.array(*[F.lit(v) for v in ("binance", "okx", "bybit", "deribit")]), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))

    def js(**cols):
        return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]))

    def boxed(**cols):
        return F.to_json(F.struct(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])).alias("data")))

    def listed(**cols):
        return F.to_json(F.struct(F.struct(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])).alias("list")).alias("result")))

    def by(**per):
        out = F.lit(None).cast("string")
        for v, c in per.items():
            out = F.when(venue == v, c).otherwise(out)
        return out

    text = lambda c: c.cast("string")
    return ev.select(
        "event_id",
        venue.alias("source"),
        by(binance=js(lastFundingRate=text(funding), nextFundingTime=when, markPrice=text(mark)),
           okx=boxed(fundingRate=text(funding), nextFundingTime=when)).alias("funding"),
        by(binance=js(openInterest=text(oi)), okx=boxed(oiCcy=text(oi))).alias("open_interest"),
        by(okx=boxed(markPx=text(mark))).alias("mark_price"),
        by(binance=F.to_json(F.array(F.struct(text(buy / F.nullif(sell, F.lit(0.0))).alias("longShortRatio"), text(buy).alias("longAccount"), text(sell).alias("shortAccount")))),
           okx=F.to_json(F.struct(F.array(F.array(F.lit("0"), F.lit("9.9")), F.array(when, text(buy))).alias("data"))),
           bybit=listed(buyRatio=text(buy), sellRatio=text(sell))).alias("long_short"),
        by(bybit=listed(fundingRate=text(funding), nextFundingTime=F.when(k > 50, "0").otherwise(when), markPrice=text(mark), openInterest=text(oi))).alias("tickers"),
        by(deribit=F.to_json(F.struct(F.array(F.struct(funding.alias("funding_8h"), mark.alias("mark_price"))).alias("result")))).alias("book_summary"),
    )


cte("q_answers", """
SELECT event_id, v, k, value / 100000 AS funding, value + 10000 AS mark, CASE WHEN k > 5 THEN k END AS oi, k / 100 AS buy, (99 - k) / 100 AS sell, epoch_us(ts) // 1000 AS at_ms
FROM (SELECT *, user_id % 4 AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) x
""")
cte("q_flat", """
SELECT event_id, CASE v WHEN 0 THEN 'binance' WHEN 1 THEN 'okx' WHEN 2 THEN 'bybit' ELSE 'deribit' END AS source, funding AS funding_rate, mark AS mark_price,
       CASE WHEN v < 2 OR (v = 2 AND k <= 50) THEN at_ms END AS next_funding_time_ms, CASE WHEN v < 3 THEN oi END AS open_interest_btc,
       CASE v WHEN 0 THEN buy / nullif(sell, 0) WHEN 1 THEN buy WHEN 2 THEN buy / nullif(sell, 0) END AS long_short_ratio,
       CASE WHEN v IN (0, 2) THEN buy END AS long_account_pct, CASE WHEN v IN (0, 2) THEN sell END AS short_account_pct FROM q_answers
""")
_STATUS = """CASE WHEN funding_rate IS NULL OR open_interest_btc IS NULL THEN 'degraded'
  WHEN mark_price IS NULL OR long_short_ratio IS NULL OR long_account_pct IS NULL OR short_account_pct IS NULL THEN 'partial_ok' ELSE 'ok' END"""


@query("scan_derivatives_payload", sql(f"""
SELECT event_id, source, next_funding_time_ms, {', '.join(r(c, c, 9) for c in H.CORE_FIELDS + H.RICH_FIELDS)} FROM q_flat"""))
def scan_derivatives_payload(spark, d):
    return report(payloads.scan_derivatives_payload(_answers(spark, d), keep=["event_id"]).drop("note", "status"), 9)


@query("classify_completeness", sql(f"""
SELECT event_id, {_STATUS} AS status, CASE WHEN note <> '' THEN 'missing:' || note END AS note FROM (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in H.DERIVATIVE_FIELDS)}) AS note FROM q_flat) x"""))
def classify_completeness(spark, d):
    return payloads.scan_derivatives_payload(_answers(spark, d), keep=["event_id"]).select("event_id", "status", "note")


def _moods(spark, d):
    ev = I.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    index = F.to_json(F.struct(F.array(F.struct(_c("k").cast("string").alias("value"), _c("event_type").alias("value_classification"), _c("event_id").cast("string").alias("timestamp"))).alias("data")))
    votes = F.to_json(F.struct((_c("value") / 5).alias("sentiment_votes_up_percentage"), F.when(_c("k") > 10, _c("k")).alias("sentiment_votes_down_percentage")))
    own = F.pmod("user_id", F.lit(2)) == 0
    return ev.select("event_id", F.when(own, "alternative.me").otherwise("coingecko").alias("source"), F.when(own, index).otherwise(votes).alias("payload"))


@query("scan_sentiment_payload", sql("""
SELECT event_id, CASE WHEN own THEN 'alternative.me' ELSE 'coingecko' END AS source, v AS fear_greed_value, CASE WHEN v IS NOT NULL THEN CASE WHEN own THEN event_type ELSE 'coingecko_up_pct_proxy' END END AS fear_greed_label,
       CASE WHEN own THEN CAST(event_id AS VARCHAR) END AS sample_timestamp, CASE WHEN v IS NOT NULL THEN CASE WHEN own THEN 'fear_greed_btc_crypto' ELSE 'coingecko_sentiment_up_pct' END END AS indicator,
       CASE WHEN v IS NULL THEN 'failed' ELSE 'ok' END AS status FROM (
SELECT *, CASE WHEN own THEN k WHEN k > 10 THEN CAST(round_even(value / 5, 0) AS INTEGER) END AS v FROM (
SELECT *, user_id % 2 = 0 AS own, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) x) y"""))
def scan_sentiment_payload(spark, d):
    return payloads.scan_sentiment_payload(_moods(spark, d), keep=["event_id"])


# ── archive ──────────────────────────────────────────────────────────────────
@query("snapshot_history_row", sql(f"""
SELECT event_id::VARCHAR AS snapshot_key, strftime(make_timestamp(ts_us // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS snapshot_at, venue AS source, 'ok' AS status,
       {r('price', 'funding_rate')}, CASE WHEN size > 50 THEN CAST(event_id AS VARCHAR) END AS mark_price FROM q_ticks WHERE size > 0"""))
def snapshot_history_row(spark, d):
    t = I.ticks(spark, d)
    payload = F.to_json(F.struct(
        _c("venue").alias("source"), F.lit("ok").alias("status"), F.when(_c("size") > 0, S.iso_utc(F.floor(_c("ts_us") / 1000).cast("long"))).alias("fetched_at"),
        F.struct(_c("price").alias("funding_rate"), F.when(_c("size") > 50, _c("event_id").cast("string")).alias("mark_price")).alias("data")))
    docs = t.select(_c("event_id").cast("string").alias("kind"), payload.alias("payload"))
    rows = snapshots.history_row(docs, snapshots.DERIVATIVE_HISTORY)
    return report(rows.select(_c("kind").alias("snapshot_key"), "snapshot_at", "source", "status", _c("funding_rate").cast("double").alias("funding_rate"), "mark_price"))


@query("sink_merge_idempotent", sql(f"""
SELECT series_id, open_time_ms, source, {r('close', 'close')} FROM (SELECT *, row_number() OVER (PARTITION BY series_id, open_time_ms ORDER BY source) AS rk FROM q_venue_bars) x WHERE rk = 1"""))
def sink_merge_idempotent(spark, d):
    """Two arrivals merged into a stored history, written and read back."""
    bars = I.venue_bars(spark, d).withColumn("arrival", F.when(_c("source") == "binance", 0).when(_c("source") == "coinbase", 1).otherwise(2))
    history, new = bars.filter("arrival = 0"), bars.filter("arrival > 0")
    once = I.settle(snapshots.merge_idempotent(history, new))
    return report(snapshots.merge_idempotent(once, new).select("series_id", "open_time_ms", "source", "close"))


@query("doc_history_rebuild", sql(f"""
SELECT series_id, open_time_ms, {r('close + CASE WHEN late THEN 1 ELSE 0 END', 'close')} FROM (
SELECT *, close_time_ms > (open_time_ms // 86400000 + 1) * 86400000 - 5400000 AS late FROM q_bars WHERE volume > 0) x"""))
def doc_history_rebuild(spark, d):
    """Each day's document repeats the day before with corrected closes; the first version counts."""
    bars = I.hourly(spark, d).withColumn("day", _day())
    seen = bars.select("*", F.inline(F.array(F.struct(_c("day").alias("version_id"), F.lit(0.0).alias("fix")), F.struct((_c("day") + 1).alias("version_id"), F.lit(1.0).alias("fix")))))
    seen = seen.withColumn("close", _c("close") + _c("fix")).withColumn("high", _c("high") + _c("fix"))
    docs = seen.groupBy("series_id", "version_id").agg(_candles().alias("candles"))
    versions = docs.select("series_id", "version_id", _payload(F.lit("kraken"), (_c("version_id") + 1) * S.DAY_MS - 5_400_000).alias("payload"))
    return report(snapshots.rebuild_history(versions).select("series_id", "open_time_ms", "close"))


@query("sink_append", sql("""
SELECT CAST(strftime(make_timestamp(issued_ms * 1000), '%Y-%m-%d') AS VARCHAR) AS issue_date, count(*) AS n, count(DISTINCT forecast_id) AS n_ids FROM q_forecasts GROUP BY 1"""))
def sink_append(spark, d):
    fc = D.forecasts(spark, d)
    path = I.scratch_dir(spark)
    jsonl.sink_append(fc.filter("horizon = '1h'"), path)
    jsonl.sink_append(fc.filter("horizon <> '1h'"), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(_c("issue_date").cast("string").alias("issue_date")).agg(F.count("*").alias("n"), F.countDistinct("forecast_id").alias("n_ids"))


@query("sink_report", sql("""
SELECT CAST(to_json({'horizon': horizon, 'model_version': model_version, 'n': n, 'wins': wins}) AS VARCHAR) AS document
FROM (SELECT horizon, model_version, count(*) AS n, CAST(sum(o) AS BIGINT) AS wins FROM q_resolved GROUP BY 1, 2) x"""))
def sink_report(spark, d):
    rows = D.scored(spark, d).groupBy("horizon", "model_version").agg(F.count("*").alias("n"), F.sum("o").alias("wins"))
    path = I.scratch_dir(spark)
    jsonl.sink_report(rows, path, pretty=False)
    return jsonl.read_lines(spark, path).withColumnRenamed("value", "document")


# ── feed attempts: every tick is one attempt of a provider in an hourly run ──────
def _attempts(spark, d):
    t, k = I.ticks(spark, d), _c("size")
    return t.select(
        _c("series_id").alias("kind"),
        F.floor(_c("ts_us") / 3_600_000_000).alias("run_id"),
        _c("venue").alias("source"),
        F.when(_c("venue") == "binance", 0).when(_c("venue") == "coinbase", 1).otherwise(2).alias("priority"),
        F.when(k < 30, "ok").when(k < 50, "partial_ok").when(k < 80, "degraded").otherwise("failed").alias("status"),
        F.when(_c("price") < 10060, _c("price").cast("string")).alias("data"),
        k.cast("int").alias("latency_ms"),
        _c("ts_us").alias("fetched_us"),
        _c("event_id").alias("attempt_id"),
    )


cte("q_att", """
SELECT kind, run_id, source, prio, status, CASE WHEN price < 10060 THEN price END AS dat, ts_us, latency_ms FROM (
SELECT series_id AS kind, ts_us // 3600000000 AS run_id, venue AS source, CASE venue WHEN 'binance' THEN 0 WHEN 'coinbase' THEN 1 ELSE 2 END AS prio,
  CASE WHEN size < 30 THEN 'ok' WHEN size < 50 THEN 'partial_ok' WHEN size < 80 THEN 'degraded' ELSE 'failed' END AS status, price, ts_us, CAST(size AS INTEGER) AS latency_ms,
  row_number() OVER (PARTITION BY series_id, ts_us // 3600000000, venue ORDER BY ts_us DESC, event_id DESC) AS rk FROM q_ticks) x WHERE rk = 1
""")
cte("q_tier", "SELECT *, CASE WHEN status = 'ok' THEN 0 WHEN status = 'partial_ok' THEN 1 WHEN status = 'degraded' AND dat IS NOT NULL THEN 2 ELSE 9 END AS tier FROM q_att")
cte("q_chosen", """
SELECT kind, run_id, CASE WHEN min(tier) < 9 THEN first(source ORDER BY tier, prio) ELSE last(source ORDER BY prio) END AS source,
       CASE WHEN min(tier) < 9 THEN first(status ORDER BY tier, prio) ELSE 'failed' END AS status, CASE WHEN min(tier) = 9 THEN 'all providers failed' END AS error,
       CASE WHEN min(tier) = 9 THEN string_agg(source || ':' || status, ',' ORDER BY prio) ELSE '' END AS notes, count(*) AS n_attempts,
       string_agg(source || ':' || latency_ms, ',' ORDER BY prio) AS attempts FROM q_tier GROUP BY 1, 2
""")


@query("provider_select", sql("SELECT kind, run_id, source, status, error, notes FROM q_chosen"))
def provider_select(spark, d):
    out = H.provider_select(H.latest_attempts(_attempts(spark, d)))
    return out.select("kind", "run_id", "source", "status", "error", F.concat_ws(",", "notes").alias("notes"))


@query("snapshot_envelope", sql("SELECT kind, run_id, source, status, 'phase2-data-v1' AS schema_version, attempts FROM q_chosen"))
def snapshot_envelope(spark, d):
    tried = H.latest_attempts(_attempts(spark, d))
    out = H.snapshot_envelope(H.provider_select(tried), tried)
    listed = F.transform("attempts", lambda a: F.concat_ws(":", a["source"], a["latency_ms"].cast("string")))
    return out.select("kind", "run_id", "source", "status", "schema_version", F.concat_ws(",", listed).alias("attempts"))


@query("source_health", sql("""
SELECT run_id, count(*) AS n_sources, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'degraded') THEN 'degraded' WHEN bool_or(status = 'partial_ok') THEN 'partial_ok' ELSE 'ok' END AS overall
FROM q_chosen GROUP BY 1"""))
def source_health(spark, d):
    return H.source_health(H.provider_select(H.latest_attempts(_attempts(spark, d))), ("run_id",))


KINDS = {"click": "candles_1m", "error": "candles_1h", "purchase": "derivatives", "signup": "sentiment", "view": "candles_4h"}
_KIND_SQL = "CASE series_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


@query("freshness_check", sql(f"""
SELECT kind, fetched_ms, budget_s, {r('(now_ms - fetched_ms) / 1000.0', 'age_s')}, (now_ms - fetched_ms) / 1000.0 > budget_s AS stale FROM (
SELECT {_KIND_SQL} AS kind, max(ts_us) // 1000 AS fetched_ms, (SELECT max(ts_us) // 1000 + 3600000 FROM q_ticks) AS now_ms,
 CAST(CASE {_KIND_SQL} WHEN 'candles_1m' THEN 2700 WHEN 'candles_1h' THEN 5400 WHEN 'derivatives' THEN 1800 WHEN 'sentiment' THEN 86400 ELSE 18000 END AS BIGINT) AS budget_s FROM q_ticks GROUP BY 1, 4) x"""))
def freshness_check(spark, d):
    t = I.ticks(spark, d)
    kind = F.lit(None).cast("string")
    for k, v in KINDS.items():
        kind = F.when(_c("series_id") == k, v).otherwise(kind)
    latest = t.groupBy(kind.alias("kind")).agg(F.floor(F.max("ts_us") / 1000).cast("long").alias("fetched_ms"))
    now = t.agg((F.floor(F.max("ts_us") / 1000) + 3_600_000).cast("long")).scalar()
    return report(H.freshness_check(latest, now))


@query("index_by_date", sql("""
SELECT date, coalesce(CASE WHEN n > 300 THEN 'day-' || date END, 'briefing-' || date) AS id, coalesce(CASE WHEN n > 320 THEN 'Ticks ' || n END, 'Daily briefing ' || date) AS title,
       'briefings/' || date || '.json' AS url, CAST(NULL AS VARCHAR) AS generated_at, 'briefing-v1' AS schema_version
FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1) x ORDER BY date DESC"""))
def index_by_date(spark, d):
    days = I.table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))
    payload = F.to_json(F.struct(F.when(_c("n") > 300, F.concat(F.lit("day-"), "date")).alias("id"), F.when(_c("n") > 320, F.concat(F.lit("Ticks "), _c("n").cast("string"))).alias("title")))
    files = days.withColumn("payload", payload).select("payload", F.explode(F.array(F.concat("date", F.lit(".json")), F.concat(F.lit("draft-"), "date", F.lit(".json")), F.lit("index.json"))).alias("name"))
    return snapshots.index_by_date(files)
