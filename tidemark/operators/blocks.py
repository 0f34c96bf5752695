"""Windows and recurrences over one ordered series, cut into bounded blocks.

A plain ``Window.partitionBy(series)`` puts a whole series into one task. Every
operator here instead works on blocks of consecutive rows, so no task holds more
than one block of a series plus its halo, however long or hot the series is:

* ``with_row_index``  numbers the rows of each series (two-level count);
* ``windowed``        bounded frames: each block also receives copies of the
                      neighbouring rows its frames reach (the halo);
* ``prefix_scan``     cumulative aggregates: block totals are scanned first, then
                      every block adds the total of the blocks before it;
* ``affine_scan``     y[i] = a*y[i-1] + b[i] (EMA, Wilder smoothing, EWMA): each
                      block is solved alone and the carry of earlier blocks,
                      which decays as a**distance, is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalar import HOUR_MS

SERIES = ("series_id",)
INDEX_SPAN_MS = 4096 * HOUR_MS
BLOCK_ROWS = 4096


def with_row_index(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ("open_time_ms",),
    span: int = INDEX_SPAN_MS,
    name: str = "row_idx",
) -> DataFrame:
    """Add a 1-based row number per key.

    ``order[0]`` is a BIGINT and is cut into spans; rows are numbered inside a span
    and shifted by the row count of the earlier spans. Only the span counts of a key
    meet in one task.
    """
    keys = list(keys)
    spanned = df.withColumn("_span", F.floor(F.col(order[0]) / F.lit(span)))
    counts = spanned.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_span").orderBy(*order)
    return (
        spanned.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_span"])
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_span", "_rn", "_off")
    )


def _block(idx: str, rows: int) -> Column:
    return F.floor((F.col(idx) - 1) / F.lit(rows))


def windowed(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int,
    after: int = 0,
    keys: Sequence[str] = SERIES,
    idx: str = "row_idx",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``build(frame, w)`` on blocks of ``rows`` rows with a halo.

    ``before`` / ``after`` is how many rows back / ahead the columns of ``build``
    reach in total. A row within reach of the next (previous) block is copied there;
    copies are dropped again after ``build``.
    """
    rows = max(rows, before, after, 1)
    pos = F.pmod(F.col(idx) - 1, F.lit(rows))
    own = _block(idx, rows)
    homes = [own]
    if before:
        homes.append(F.when(pos >= rows - before, own + 1))
    if after:
        homes.append(F.when((pos < after) & (own > 0), own - 1))
    placed = df.withColumn("_win", F.explode_outer(F.array_compact(F.array(*homes))))
    w = Window.partitionBy(*keys, "_win").orderBy(idx)
    return build(placed, w).filter(F.col("_win") == own).drop("_win")


_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": None}


def prefix_scan(
    df: DataFrame,
    aggs: dict[str, tuple[str, Column]],
    keys: Sequence[str] = SERIES,
    idx: str = "row_idx",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add inclusive cumulative ``sum``/``count``/``min``/``max``/``last`` (last non-null)."""
    keys = list(keys)
    blocked = df.withColumn("_blk", _block(idx, rows))
    for name, (_, col) in aggs.items():
        blocked = blocked.withColumn(f"_in_{name}", col)

    def run(kind, c):
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](c)

    totals = blocked.groupBy(*keys, "_blk").agg(
        *[
            (
                F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(idx)))
                if kind == "last"
                else run(kind, F.col(f"_in_{n}"))
            ).alias(f"_t_{n}")
            for n, (kind, _) in aggs.items()
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_blk",
        *[
            (
                F.last(f"_t_{n}", ignorenulls=True) if kind == "last" else _MERGE[kind](f"_t_{n}")
            ).over(earlier).alias(f"_c_{n}")
            for n, (kind, _) in aggs.items()
        ],
    )
    local = Window.partitionBy(*keys, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.select(
        *df.columns,
        "_blk",
        *[
            (
                F.last(f"_in_{n}", ignorenulls=True) if kind == "last" else run(kind, F.col(f"_in_{n}"))
            ).over(local).alias(f"_l_{n}")
            for n, (kind, _) in aggs.items()
        ],
    ).join(carried, [*keys, "_blk"])

    def merge(n, kind):
        here, carry = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind in ("sum", "count"):
            return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(here + carry)
        if kind == "min":
            return F.least(here, carry)
        if kind == "max":
            return F.greatest(here, carry)
        return F.coalesce(here, carry)

    return out.select(*df.columns, *[merge(n, kind).alias(n) for n, (kind, _) in aggs.items()])


def _fold(values: Column, step: float) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, e: acc * F.lit(step) + e)


def affine_scan(
    df: DataFrame,
    outputs: dict[str, tuple[float, Column]],
    keys: Sequence[str] = SERIES,
    idx: str = "row_idx",
    rows: int = 128,
) -> DataFrame:
    """Add y[i] = a*y[i-1] + b[i], y[0] = 0, for each ``{name: (a, b)}`` with 0 < a < 1.

    Inside a block y = a**p * sum(b * a**-p) is one running window sum, p being the
    row position. The carry into a block is the sum of earlier block ends weighted by
    a**distance; weights below 1e-35 cannot change a double and are left out, so the
    look-back over block ends is bounded and runs through ``windowed`` as well.
    """
    keys = list(keys)
    steepest = min(a for a, _ in outputs.values())
    rows = max(2, min(rows, int(230.0 / -math.log(steepest))))
    pos = F.pmod(F.col(idx) - 1, F.lit(rows)).cast("double")
    blocked = df.withColumn("_blk", _block(idx, rows) + 1).withColumn("_pos", pos)
    for name, (_, b) in outputs.items():
        blocked = blocked.withColumn(f"_b_{name}", b)
    local = Window.partitionBy(*keys, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    solved = blocked.select(
        *df.columns,
        "_blk",
        "_pos",
        *[
            (F.pow(F.lit(a), F.col("_pos")) * F.sum(F.col(f"_b_{n}") * F.pow(F.lit(a), -F.col("_pos"))).over(local)).alias(f"_y_{n}")
            for n, (a, _) in outputs.items()
        ],
    )
    ends = solved.groupBy(*keys, "_blk").agg(
        *[F.max_by(f"_y_{n}", F.col(idx)).alias(f"_e_{n}") for n in outputs]
    )
    reach = {n: max(1, math.ceil(81.0 / (-math.log(a) * rows))) for n, (a, _) in outputs.items()}

    def carry(frame: DataFrame, w: WindowSpec) -> DataFrame:
        for n, (a, _) in outputs.items():
            step = a**rows
            past = F.collect_list(f"_e_{n}").over(w.rowsBetween(-reach[n], -1))
            frame = frame.withColumn(f"_c_{n}", _fold(past, step))
        return frame

    carried = windowed(ends, carry, before=max(reach.values()), keys=keys, idx="_blk").select(
        *keys, "_blk", *[f"_c_{n}" for n in outputs]
    )
    return solved.join(carried, [*keys, "_blk"]).select(
        *df.columns,
        *[
            (F.col(f"_y_{n}") + F.pow(F.lit(a), F.col("_pos") + 1) * F.col(f"_c_{n}")).alias(n)
            for n, (a, _) in outputs.items()
        ],
    )
