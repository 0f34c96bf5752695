"""Fits of many groups at once: isotonic regression by merged blocks, logistic regression by Newton steps.

Neither runs a job per group, and no rows meet on the driver: every (horizon, model) stream or
(horizon, fold) is a group of the same aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.blocks import with_row_index
from tidemark.sources.store import settle

POOLS = "array<struct<lo:double,hi:double,s:double,n:double>>"
#: Distinct probabilities of one block, and lists of pools that are merged at once.
BLOCK, FAN = 256, 32
#: Probabilities are numbered in spans of 2 ** -16.
_SCALE, _SPAN = 1 << 40, 1 << 24


# ── isotonic ─────────────────────────────────────────────────────────────────
def merged_pools(pools: Column) -> Column:
    """Adjacent pools (lo, hi, s, n), in order, joined until their means s / n increase.

    The merge is associative: blocks may be pooled alone and their lists then merged, since
    pooling adjacent violators gives the same pools in whatever order it is done.
    """

    def push(stack: Column, x: Column) -> Column:
        """``stack`` has the last pool first; it swallows what does not lie below ``x``."""

        def fold(acc: Column, top: Column) -> Column:
            cur, kept = acc["cur"], acc["kept"]
            stays = (F.size(kept) > 0) | (top["s"] * cur["n"] < cur["s"] * top["n"])
            joined = F.struct(top["lo"].alias("lo"), cur["hi"].alias("hi"), (top["s"] + cur["s"]).alias("s"), (top["n"] + cur["n"]).alias("n"))
            return F.when(stays, F.struct(cur.alias("cur"), F.array_append(kept, top).alias("kept"))).otherwise(F.struct(joined.alias("cur"), kept.alias("kept")))

        start = F.struct(x.alias("cur"), F.expr(f"cast(array() as {POOLS})").alias("kept"))
        return F.aggregate(stack, start, fold, lambda r: F.concat(F.array(r["cur"]), r["kept"]))

    return F.aggregate(pools, F.expr(f"cast(array() as {POOLS})"), push, lambda stack: F.reverse(stack))


def isotonic_pools(fit_rows: DataFrame, keys: Sequence[str], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(keys, pools): the non-decreasing fit of y on p for every stream.

    Equal probabilities are summed first. Blocks of ``block`` neighbours are reduced to their pools,
    then ``fan`` neighbouring lists at a time, until one list is left. The labels of k pools with
    different means number about k ** 1.5 at least, so lists stay far shorter than the streams.
    """
    keys = list(keys)
    sums = fit_rows.groupBy(*keys, "p").agg(F.sum("y").cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    cells = settle(sums.withColumn("_cell", F.floor(F.col("p") * _SCALE).cast("long")))
    lists = with_row_index(cells, keys, ("_cell", "p"), span=_SPAN, name="_i")
    lists = lists.select(*keys, F.floor((F.col("_i") - 1) / block).alias("_b"), F.array(F.struct(F.col("p").alias("lo"), F.col("p").alias("hi"), "s", "n")).alias("pools"))
    while True:
        joined = lists.groupBy(*keys, "_b").agg(F.flatten(F.array_sort(F.collect_list("pools"))).alias("pools"))
        lists = settle(joined.select(*keys, "_b", merged_pools(F.col("pools")).alias("pools")))
        if lists.agg(F.max("_b")).first()[0] in (0, None):
            return lists.drop("_b")
        lists = lists.withColumn("_b", F.floor(F.col("_b") / fan))


def isotonic_value(p: Column, pools: Column) -> Column:
    """The fitted value: a pool's mean inside it, linear between pools, clamped at the ends."""
    mean = lambda x: S.clip(x["s"] / x["n"], 0.0, 1.0)
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    at = F.aggregate(steps, F.lit(-1), lambda i, s: F.when(F.coalesce(F.get(pools, i + s)["lo"] <= p, F.lit(False)), i + s).otherwise(i))

    def value(i: Column) -> Column:
        here, after = F.get(pools, i), F.get(pools, i + 1)
        slope = (p - here["hi"]) / (after["lo"] - here["hi"])
        between = mean(here) + slope * (mean(after) - mean(here))
        return F.when(i < 0, mean(F.get(pools, F.lit(0)))).when((p <= here["hi"]) | after.isNull(), mean(here)).otherwise(between)

    return F.aggregate(F.array(at), F.lit(None).cast("double"), lambda _, i: value(i))


def isotonic_by(fit_rows: DataFrame, keys: Sequence[str]):
    """Fit every stream; returns ``apply(df) -> df`` with ``p`` replaced."""
    fits = isotonic_pools(fit_rows, keys).withColumnRenamed("pools", "_pools")
    return lambda df: df.join(fits, list(keys)).withColumn("p", isotonic_value(F.col("p"), F.col("_pools"))).drop("_pools")


# ── logistic ─────────────────────────────────────────────────────────────────
def scaled_rows(placed: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``placed`` with ``z``, the features scaled by mean and deviation of the group's train rows."""
    train = placed.filter("part = 'train'").groupBy(*keys)
    moments = train.agg(F.array(*[F.avg(c) for c in features]).alias("mean"), F.array(*[F.stddev_samp(c) for c in features]).alias("std"))
    moments = moments.withColumn("std", F.transform("std", lambda s: F.when(s > 1e-9, s).otherwise(1.0)))
    z = F.transform(F.array(*features), lambda x, i: (x.cast("double") - F.get("mean", i)) / F.get("std", i))
    return placed.join(settle(moments), list(keys)).withColumn("z", z)


def logistic_fits(train: DataFrame, keys: Sequence[str], size: int, l2: float, steps: int = 25) -> DataFrame:
    """(keys, n, w, loss, gradient) of the ridge-penalised logistic fit of every group.

    ``train`` has the keys, y and the scaled features ``z`` (``size`` numbers). A Newton step is one
    pass for all groups: each task adds up gradient and curvature of its rows, a few rows per group
    are shuffled, and each group solves its own equations. The last weight is the intercept, which
    has no penalty. ``loss`` is the penalised mean loss, ``gradient`` the length of its gradient.
    """
    keys = list(keys)
    rows = settle(train.select(*keys, "z", F.col("y").cast("double").alias("y")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    part_type = f"{kinds}, n long, loss double, grad array<double>, curve array<double>, w array<double>"
    ridge = np.append(np.full(size, l2), 0.0)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for key, part in batch.groupby(keys):
                x = np.column_stack([np.stack(part["z"].to_numpy()), np.ones(len(part))])
                w, y = np.asarray(part["w"].iloc[0], dtype=float), part["y"].to_numpy()
                t = x @ w
                q = 0.5 * (1 + np.tanh(t / 2))
                got = [len(part), float((np.logaddexp(0, t) - y * t).sum()), x.T @ (q - y), (x.T * (q * (1 - q))) @ x]
                held = sums.setdefault(key, [0, 0.0, 0.0, 0.0, w])
                sums[key] = [a + b for a, b in zip(held, got, strict=False)] + [w]
        yield pd.DataFrame([(*k, n, loss, g, h.ravel(), w) for k, (n, loss, g, h, w) in sums.items()], columns=[*keys, "n", "loss", "grad", "curve", "w"])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        n, w = int(frame["n"].sum()), np.asarray(frame["w"].iloc[0], dtype=float)
        g = np.sum(np.stack(frame["grad"].to_numpy()), axis=0) / n + ridge * w
        h = np.sum(np.stack(frame["curve"].to_numpy()), axis=0).reshape(size + 1, size + 1) / n + np.diag(ridge)
        loss = float(frame["loss"].sum()) / n + 0.5 * float(ridge @ (w * w))
        step = np.linalg.solve(h + 1e-12 * np.eye(size + 1), g)
        # A long step is shortened: the first ones may overshoot.
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        out = frame[keys].iloc[:1].copy()
        return out.assign(n=n, loss=loss, gradient=float(np.sqrt(g @ g)), w=[list(w)], ahead=[list(w - step)])

    fits = rows.select(*keys).distinct().withColumn("w", F.array_repeat(F.lit(0.0), size + 1))
    for _ in range(steps):
        parts = rows.join(fits.select(*keys, "w"), keys).mapInPandas(partial, part_type)
        found = settle(parts.groupBy(*keys).applyInPandas(solve, f"{kinds}, n long, loss double, gradient double, w array<double>, ahead array<double>"))
        worst = found.agg(F.max("gradient")).first()[0]
        if worst is None or worst < 1e-10:
            break
        fits = found.select(*keys, F.col("ahead").alias("w"))
    return found.drop("ahead")


def logistic_p(z: Column, w: Column) -> Column:
    """Probability of scaled features under weights that end with the intercept."""
    dot = F.aggregate(F.zip_with(z, F.slice(w, 1, F.size(w) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return S.sigmoid(dot + F.element_at(w, -1))
