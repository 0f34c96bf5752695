"""Daily briefing rows, catalog checks and the work-log rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import SERIES

ACCURACY_FIELDS = ("hit_rate", "brier", "logloss", "ece", "baseline_hit_rate", "baseline_brier", "base_rate")
LEVEL_FIELDS = ("pivot_classic", "r1", "r2", "s1", "s2", "recent_high", "recent_low", "sma_20", "sma_50", "sma_200", "vwap_session")


def briefing_passthrough(
    series: DataFrame, date: str, health: DataFrame, levels: DataFrame, sentiment: DataFrame, derivatives: DataFrame, accuracy: DataFrame
) -> DataFrame:
    """One nested document per series from one-row-per-series inputs.

    A missing input is ``available = false``. Accuracy numbers appear only when the
    ledger calls them display-ready; otherwise a note stands in their place.
    """
    def section(df, name, cols):
        return df.select(*SERIES, F.struct(F.lit(True).alias("available"), *cols).alias(name))

    ready = F.col("display_ready")
    acc = [ready.alias("display_ready"), F.col("n"), *[F.when(ready, F.col(f)).alias(f) for f in ACCURACY_FIELDS],
           F.when(~ready, F.format_string("accuracy withheld: only %d forecasts resolved", F.col("n"))).alias("note")]
    parts = [
        section(health, "source_health", [F.col("overall")]),
        section(levels, "key_levels", [F.col("status"), F.col("degraded"), F.struct(*LEVEL_FIELDS).alias("values"), F.col("notes")]),
        section(sentiment, "sentiment", [F.col("source"), F.col("fear_greed_value"), F.col("fear_greed_label")]),
        section(derivatives, "derivatives", [F.col("source"), F.col("funding_rate"), F.col("open_interest_btc"), F.col("mark_price")]),
        section(accuracy, "accuracy", acc),
    ]
    out = series.select(*SERIES).distinct()
    for p in parts:
        out = out.join(p, list(SERIES), "left")
    names = ("source_health", "key_levels", "sentiment", "derivatives", "accuracy")
    return out.select(
        F.concat(F.lit("briefing-"), "series_id", F.lit("-" + date)).alias("id"),
        *SERIES,
        F.lit(date).alias("date"),
        F.lit(True).alias("not_financial_advice"),
        F.struct(*[F.col(n) for n in names]).alias("summary"),
        F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names])).alias("unavailable"),
    )


def catalog_integrity(catalog: DataFrame, entries: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Long table of faults: (fault, id).

    ``catalog``: slug, works array<struct<id, sources array<struct<url>>>>; ``entries``: work_id.
    """
    works = catalog.select("slug", F.explode_outer("works").alias("w"))
    none = works.filter(F.col("w").isNull()).select(F.lit("no_works").alias("fault"), F.col("slug").alias("id"))
    real = works.filter(F.col("w").isNotNull()).select("slug", "w.id", "w.sources")
    bare = real.filter(F.size(F.coalesce("sources", F.array())) == 0).select(F.lit("no_source").alias("fault"), "id")
    urls = real.select("id", F.explode("sources").alias("s"))
    odd = urls.filter(~F.coalesce(F.col("s.url"), F.lit("")).rlike("^https?://")).select(F.lit("source_not_http").alias("fault"), "id")
    orphans = entries.join(real.select(F.col("id").alias("work_id")), "work_id", "left_anti").select(F.lit("unknown_work").alias("fault"), F.col("work_id").alias("id"))
    have = catalog.filter(F.col("slug").isin(*required)).agg(F.collect_set("slug").alias("_have"))
    lacking = have.select(F.lit("missing_slug").alias("fault"), F.explode(F.array_except(F.array(*[F.lit(x) for x in required]), "_have")).alias("id"))
    return none.unionByName(bare).unionByName(odd).unionByName(orphans).unionByName(lacking)


def worklog_rollup(log: DataFrame, rate: float) -> DataFrame:
    """Hours, counts and value by type and tool with subtotals."""
    return (
        log.rollup("type", "tool")
        .agg(F.grouping_id().alias("_g"), F.count("*").alias("entries"), F.sum("hours").alias("hours"))
        .select(
            F.when(F.col("_g") == 3, "all").otherwise(F.col("type")).alias("type"),
            F.when(F.col("_g") >= 1, "all").otherwise(F.col("tool")).alias("tool"),
            "entries",
            "hours",
            (F.col("hours") * rate).alias("value"),
        )
    )
