"""Derivatives and sentiment payloads of the venues, in one flat shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.health import classify_completeness, missing_note

# Where each venue keeps each field. Parts are the endpoint answers.
PATHS = {
    "binance": {
        "funding_rate": ("funding", "$.lastFundingRate"),
        "next_funding_time_ms": ("funding", "$.nextFundingTime"),
        "mark_price": ("funding", "$.markPrice"),
        "open_interest_btc": ("open_interest", "$.openInterest"),
        "long_short_ratio": ("long_short", "$[0].longShortRatio"),
        "long_account_pct": ("long_short", "$[0].longAccount"),
        "short_account_pct": ("long_short", "$[0].shortAccount"),
    },
    "okx": {
        "funding_rate": ("funding", "$.data[0].fundingRate"),
        "next_funding_time_ms": ("funding", "$.data[0].nextFundingTime"),
        "mark_price": ("mark_price", "$.data[0].markPx"),
        "open_interest_btc": ("open_interest", "$.data[0].oiCcy"),
    },
    "bybit": {
        "funding_rate": ("tickers", "$.result.list[0].fundingRate"),
        "next_funding_time_ms": ("tickers", "$.result.list[0].nextFundingTime"),
        "mark_price": ("tickers", "$.result.list[0].markPrice"),
        "open_interest_btc": ("tickers", "$.result.list[0].openInterest"),
        "long_account_pct": ("long_short", "$.result.list[0].buyRatio"),
        "short_account_pct": ("long_short", "$.result.list[0].sellRatio"),
    },
    "deribit": {
        "funding_rate": ("book_summary", "$.result[0].funding_8h"),
        "mark_price": ("book_summary", "$.result[0].mark_price"),
    },
}
PARTS = ("funding", "open_interest", "mark_price", "long_short", "tickers", "book_summary")


def _field(name: str, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for source, paths in PATHS.items():
        if name in paths:
            part, path = paths[name]
            out = F.when(F.col("source") == source, F.get_json_object(part, path).try_cast(kind)).otherwise(out)
    return out


def scan_derivatives_payload(payloads: DataFrame, keep=()) -> DataFrame:
    """Flat row per payload: absent or unreadable values are null, never invented.

    ``payloads``: source and the endpoint answers as JSON text (``PARTS``).
    """
    okx_rows = F.from_json(F.get_json_object("long_short", "$.data"), "array<array<string>>")
    okx_ratio = F.get(F.try_element_at(okx_rows, F.lit(-1)), F.lit(1)).try_cast("double")
    data = payloads.select(
        *keep,
        "source",
        _field("funding_rate", "double").alias("funding_rate"),
        F.nullif(_field("next_funding_time_ms", "long"), F.lit(0)).alias("next_funding_time_ms"),
        _field("mark_price", "double").alias("mark_price"),
        _field("open_interest_btc", "double").alias("open_interest_btc"),
        F.when(F.col("source") == "okx", okx_ratio)
        .when(F.col("source") == "bybit", F.try_divide(_field("long_account_pct", "double"), _field("short_account_pct", "double")))
        .otherwise(_field("long_short_ratio", "double"))
        .alias("long_short_ratio"),
        _field("long_account_pct", "double").alias("long_account_pct"),
        _field("short_account_pct", "double").alias("short_account_pct"),
    )
    return data.withColumn("note", missing_note()).withColumn("status", classify_completeness())


def scan_sentiment_payload(payloads: DataFrame, keep=()) -> DataFrame:
    """Index row, or up-votes on the same 0..100 scale (half-even); no number means failed."""
    own = F.get_json_object("payload", "$.data[0].value").try_cast("int")
    up = F.get_json_object("payload", "$.sentiment_votes_up_percentage").try_cast("double")
    down = F.get_json_object("payload", "$.sentiment_votes_down_percentage")
    votes = F.when(down.isNotNull(), F.bround(up).cast("int"))
    index = F.col("source") == "alternative.me"
    value = F.when(index, own).otherwise(votes)
    return payloads.select(
        *keep,
        "source",
        value.alias("fear_greed_value"),
        F.when(value.isNotNull(), F.when(index, F.get_json_object("payload", "$.data[0].value_classification")).otherwise("coingecko_up_pct_proxy")).alias("fear_greed_label"),
        F.when(value.isNotNull() & index, F.get_json_object("payload", "$.data[0].timestamp")).alias("sample_timestamp"),
        F.when(value.isNotNull(), F.when(index, "fear_greed_btc_crypto").otherwise("coingecko_sentiment_up_pct")).alias("indicator"),
        F.when(value.isNotNull(), "ok").otherwise("failed").alias("status"),
    )
