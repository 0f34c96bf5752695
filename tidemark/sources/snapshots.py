"""Nested provider snapshots, their history, and dated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import HOUR_MS, parse_iso_ms
from tidemark.operators.bars import archive_closed_filter

BAR_FIELDS = ("open_time_ms", "close_time_ms", "open", "high", "low", "close", "volume")
SNAPSHOT_DDL = (
    "source string, status string, fetched_at string, data struct<interval: string, candles: array<struct<"
    + ", ".join(f"{f}: string" for f in BAR_FIELDS)
    + ">>>"
)
DERIVATIVE_HISTORY = ("funding_rate", "open_interest_btc", "long_short_ratio", "mark_price", "next_funding_time_ms")
SENTIMENT_HISTORY = ("fear_greed_value", "fear_greed_label", "indicator", "sample_timestamp")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def scan_snapshot(docs: DataFrame, keep=("series_id",)) -> DataFrame:
    """Bars of snapshot payloads; the top-level source goes into every row.

    A bar with a field that does not cast is dropped; a missing close time is left null.
    """
    parsed = docs.select(*keep, F.from_json("payload", SNAPSHOT_DDL).alias("d"))
    bars = parsed.select(
        *keep,
        F.coalesce(F.nullif(F.col("d.source"), F.lit("")), F.lit("unknown")).alias("source"),
        parse_iso_ms(F.col("d.fetched_at")).alias("fetched_ms"),
        F.inline_outer("d.data.candles"),
    )
    typed = {f: F.col(f).try_cast("long" if f.endswith("_ms") else "double") for f in BAR_FIELDS}
    whole = F.lit(True)
    out = bars.withColumns(typed)
    for f in BAR_FIELDS:
        if f != "close_time_ms":
            whole = whole & F.col(f).isNotNull()
    return out.filter(whole)


def closed_snapshot_bars(docs: DataFrame, keep=("series_id",)) -> DataFrame:
    return archive_closed_filter(scan_snapshot(docs, keep), F.col("fetched_ms"))


def scan_history(rows: DataFrame, now_ms: Column, min_bars: int, position: str = "pos") -> DataFrame:
    """Closed history: last row per open time, current hour dropped, closes inclusive.

    Series below ``min_bars`` are left out (the floor for training).
    """
    hour = F.floor(now_ms / HOUR_MS) * HOUR_MS
    row = F.struct(*[c for c in rows.columns if c not in ("series_id", "open_time_ms")])
    one = (
        rows.filter(F.col("open_time_ms") < hour)
        .groupBy("series_id", "open_time_ms")
        .agg(F.max_by(row, position).alias("r"))
        .select("series_id", "open_time_ms", "r.*")
        .withColumn("close_time_ms", F.col("open_time_ms") + HOUR_MS - 1)
        .withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    )
    enough = one.groupBy("series_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_bars)
    return one.join(enough.select("series_id"), "series_id", "left_semi").drop(position)


def merge_idempotent(history: DataFrame, new: DataFrame, keys=("series_id", "open_time_ms"), order: str = "arrival") -> DataFrame:
    """History plus new rows, one per key: the last stored row stays, else the first new one."""
    names = [c for c in history.columns if c not in keys]
    stored = history.select(*keys, F.struct(*names).alias("r"), F.lit(0).alias("_new"), (-F.col(order)).alias("_o"))
    fresh = new.select(*keys, F.struct(*names).alias("r"), F.lit(1).alias("_new"), F.col(order).alias("_o"))
    both = stored.unionByName(fresh)
    return both.groupBy(*keys).agg(F.min_by("r", F.struct("_new", "_o")).alias("r")).select(*keys, "r.*")


def history_row(docs: DataFrame, fields) -> DataFrame:
    """One flat row per snapshot that names its fetch time."""
    ddl = "source string, status string, fetched_at string, data struct<" + ", ".join(f"{f}: string" for f in fields) + ">"
    parsed = docs.select("kind", F.from_json("payload", ddl).alias("d"))
    return parsed.filter(F.coalesce(F.col("d.fetched_at"), F.lit("")) != "").select(
        "kind", F.col("d.fetched_at").alias("snapshot_at"), F.col("d.source"), F.col("d.status"), *[F.col(f"d.data.{f}") for f in fields]
    )


def rebuild_history(versions: DataFrame) -> DataFrame:
    """All versions of a snapshot folded into one history, earliest version first."""
    bars = closed_snapshot_bars(versions, keep=("series_id", "version_id")).drop("fetched_ms", "close_time_ms", "interval")
    row = F.struct("source", "open", "high", "low", "close", "volume")
    return bars.groupBy("series_id", "open_time_ms").agg(F.min_by(row, "version_id").alias("r")).select("series_id", "open_time_ms", "r.*")


DATE_NAME = r"^(\d{4}-\d{2}-\d{2})\.json$"


def index_by_date(files: DataFrame, default_schema: str = "briefing-v1") -> DataFrame:
    """Dated documents newest first; other names are ignored, missing fields get defaults.

    ``files``: name, payload (null when unreadable).
    """
    date = F.regexp_extract("name", DATE_NAME, 1)
    doc = F.from_json("payload", "id string, title string, generated_at string, schema_version string")
    return (
        files.withColumn("date", date).filter(F.col("date") != "").withColumn("d", doc)
        .select(
            "date",
            F.coalesce(F.nullif("d.id", F.lit("")), F.concat(F.lit("briefing-"), "date")).alias("id"),
            F.coalesce(F.nullif("d.title", F.lit("")), F.concat(F.lit("Daily briefing "), "date")).alias("title"),
            F.concat(F.lit("briefings/"), "date", F.lit(".json")).alias("url"),
            F.col("d.generated_at").alias("generated_at"),
            F.coalesce("d.schema_version", F.lit(default_schema)).alias("schema_version"),
        )
        .orderBy(F.desc("date"))
    )


def read_dated(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder as (name, payload)."""
    return spark.read.text(folder, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("payload")
    )
