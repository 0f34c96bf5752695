"""Slice hunt: every resolved forecast fans out to named slices, which are ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S

# Fixed values.
MIN_N, MIN_N_EXPLORE = 20, 12
TOP_TRADEABLE, TOP_EXPLORATORY, TOP_EXPERIMENTS = 25, 40, 8
REL_BANDS = ((0.001, "rel<0.1%"), (0.003, "rel_0.1-0.3%"), (0.005, "rel_0.3-0.5%"), (0.01, "rel_0.5-1%"))
REL_LAST = "rel>=1%"


def rel_parse(reason: Column) -> Column:
    """The number after ``rel=``; a signed one does not match, junk digits give null."""
    return F.nullif(F.regexp_extract(reason, r"rel=([0-9.]+)", 1), F.lit("")).try_cast("double")


def rel_band(rel: Column) -> Column:
    out = F.when(rel.isNull(), F.lit(None).cast("string"))
    for limit, name in REL_BANDS:
        out = out.when(rel < limit, name)
    return out.otherwise(REL_LAST)


def slice_names() -> Column:
    """All slice names one row belongs to; inputs horizon, direction, regime, model, time, reason."""
    h, d, reg, mv = (F.col(c) for c in ("horizon", "direction", "regime", "model_version"))
    hour = F.lpad(S.hour_utc(F.col("issued_ms")).cast("string"), 2, "0")
    dow = S.weekday_mon0(F.col("issued_ms")).cast("string")
    rel = rel_parse(F.col("confidence_reason"))
    band = rel_band(rel)
    long_run = h.isin("12h", "24h")

    def name(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    names = [
        name("horizon=", h),
        name("horizon=", h, "|dir=", d),
        name("horizon=", h, "|regime=", reg),
        name("model=", mv, "|horizon=", h),
        name("dir=", d),
        name("regime=", reg),
        name("hour_utc=", hour),
        name("dow=", dow),
        name("horizon=", h, "|hour_utc=", hour),
        name("horizon=", h, "|dow=", dow),
        name("sma_", band),
        name("horizon=", h, "|sma_", band),
        F.when(long_run, "policy:h12_24_only"),
        F.when(long_run & (S.hour_utc(F.col("issued_ms")) != 20), "policy:h12_24_skip_hour20"),
        F.when(long_run & (rel < 0.005), "policy:h12_24_mild_rel"),
    ]
    return F.array_compact(F.array(*names))


def slice_hunt(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics and score per slice (and ``keys``) with enough rows and a positive sign of an edge.

    ``rows`` is ``metrics.scored``; duplicates of a bucket are kept on purpose.
    """
    agg = (
        rows.select(*keys, F.explode_outer(slice_names()).alias("slice"), "o", "signed", "actual_return")
        .groupBy(*keys, "slice")
        .agg(
            F.count("*").alias("n"),
            F.avg("o").alias("hit_rate"),
            F.avg("signed").alias("_exp"),
            F.avg((F.col("actual_return") > 0).cast("int")).alias("_up"),
        )
    )
    majority = F.greatest(F.col("_up"), 1 - F.col("_up"))
    maker = S.fee_adjusted_bps(F.col("_exp"), S.MAKER_BPS)
    thin = F.col("slice").contains("hour_utc=") | F.col("slice").contains("dow=")
    lower = S.wilson_lower(F.col("hit_rate"), F.col("n"))
    lift = F.col("hit_rate") - majority
    return agg.filter(F.col("n") >= F.when(thin, MIN_N_EXPLORE).otherwise(MIN_N)).select(
        *keys,
        "slice",
        "n",
        "hit_rate",
        lower.alias("wilson_lb_95"),
        lift.alias("vs_majority_pp"),
        (F.col("_exp") * 10000.0).alias("expectancy_bps"),
        maker.alias("expectancy_maker_2bps"),
        majority.alias("majority_rate"),
        (maker + 50.0 * lift + 10.0 * lower).alias("score"),
    ).filter((F.col("expectancy_maker_2bps") > 0) | (F.col("vs_majority_pp") > 0))


def tradeable(ranked: DataFrame) -> DataFrame:
    return ranked.filter(
        (F.col("n") >= MIN_N) & (F.col("expectancy_maker_2bps") > 0) & (F.col("vs_majority_pp") > 0)
    )


def top(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.orderBy(F.desc("score"), "slice").limit(k)


def experiment_id(name: Column) -> Column:
    return F.format_string("auto-%07d", F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(10_000_000)))


def experiments(ranked: DataFrame) -> DataFrame:
    """Follow-up experiments for the best tradeable slices beyond a plain horizon."""
    plain = F.col("slice").startswith("horizon=") & ~F.col("slice").contains("|")
    return top(tradeable(ranked), TOP_EXPERIMENTS).filter(~plain).withColumns({"experiment_id": experiment_id(F.col("slice")), "hypothesis": hypothesis()})


def hypothesis() -> Column:
    """What a follow-up on the slice would have to show, with the numbers it starts from."""
    return F.concat(F.lit("slice "), F.col("slice"), F.lit(" keeps a positive expectancy beyond n="), F.col("n").cast("string"))


def hunt_report(ranked: DataFrame) -> DataFrame:
    """Long report: section, slice and its numbers; experiments carry their id and hypothesis."""
    cols = ("slice", "n", "hit_rate", "expectancy_maker_2bps", "vs_majority_pp", "score")
    def section(name, df):
        more = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("experiment_id", "hypothesis")]
        return df.select(F.lit(name).alias("section"), *cols, *more)

    parts = [
        section("best", best_slice(ranked)),
        section("top_tradeable", top(tradeable(ranked), TOP_TRADEABLE)),
        section("top_exploratory", top(ranked, TOP_EXPLORATORY)),
        section("improvement_target", ranked.filter("slice = 'horizon=24h'")),
        section("next_experiments", experiments(ranked)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_slice(ranked: DataFrame) -> DataFrame:
    """Best tradeable slice, or the best of all when none is tradeable."""
    ok = (F.col("n") >= MIN_N) & (F.col("expectancy_maker_2bps") > 0) & (F.col("vs_majority_pp") > 0)
    return ranked.withColumn("tradeable", ok).orderBy(F.desc("tradeable"), F.desc("score"), "slice").limit(1)
