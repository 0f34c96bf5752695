"""How the parquet tables are read as ticks, bars and venue prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.sources.store import scratch_dir, settle

# Quoted level added to the small tick values, and the tick venues.
PRICE_BASE = 10000.0
VENUES = ("binance", "coinbase", "kraken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DERIVED: dict[tuple, str] = {}


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, times and sizes of the input tables, so that changed input is derived anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in found))


def derived(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stored table of this session (bars, forecasts, ledger), built on first use.

    The reports of one session read the same stored bars and ledger instead of deriving
    them again; ``forget`` drops them, as the benchmark does before every timing.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, _files(spark, sf_dir))
    if key not in _DERIVED:
        path = scratch_dir(spark)
        build().write.parquet(path)
        _DERIVED[key] = path
    return spark.read.parquet(_DERIVED[key])


def forget() -> None:
    _DERIVED.clear()


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    number = F.pmod("user_id", F.lit(len(VENUES))).cast("int")
    return ev.select(
        F.col("event_type").alias("series_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "event_id",
        (F.col("value") + PRICE_BASE).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        number.alias("venue_no"),
        venue_name(number).alias("venue"),
    )


def venue_name(number):
    return F.element_at(F.array(*[F.lit(v) for v in VENUES]), number + 1)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all ticks, with ``row_idx``."""
    table(spark, sf_dir, "events")
    return derived(spark, sf_dir, "hourly", lambda: B.indexed(settle(sourced_bars(spark, sf_dir))))


def sourced_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with the venue of their last tick as source."""
    bars = B.tick_to_bar(ticks(spark, sf_dir), carry={"venue_no": "venue_no"})
    return bars.withColumn("source", venue_name(F.col("venue_no"))).drop("venue_no")


def venue_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(
        spark,
        sf_dir,
        "venue_bars",
        lambda: B.tick_to_bar(ticks(spark, sf_dir), keys=("series_id", "venue")).withColumnRenamed("venue", "source"),
    )


def _line_order():
    """Order of the lines of one day: order, line, part and supplier number in one decimal."""
    def shift(digits):
        return F.lit(str(10**digits)).cast(f"decimal({digits + 1},0)")

    head = F.col("l_orderkey").cast("decimal(13,0)") * shift(2) + F.col("l_linenumber").cast("decimal(2,0)")
    tail = F.col("l_partkey").cast("decimal(11,0)") * shift(9) + F.col("l_suppkey").cast("decimal(9,0)")
    return (head.cast("decimal(16,0)") * shift(20) + tail.cast("decimal(20,0)")).cast("decimal(38,0)")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the line items, unit price as tick, with ``row_idx``."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"),
        _line_order().alias("_order"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
    )
    return derived(spark, sf_dir, "daily", lambda: B.indexed(settle(B.tick_to_bar(li, "1d", order=F.col("_order"))), interval="1d"))


def now_ms(bars: DataFrame):
    """Latest close as a scalar subquery, the default clock of a replay."""
    return bars.agg(F.max("close_time_ms")).scalar()
