"""Helpers of the corpus operators: vectors summed in tasks, components of links, ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.store import settle

#: Word separators of the contracts: space and the five controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


#: Rows of texts in one Arrow batch, at most: a text may be long, and a worker holds a batch twice.
TEXT_ROWS = 512


def short_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; a smaller bound that is already set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of the largest filter, as a power of two: 32 MB on every task.
MOST_BITS = 28
PIECE = 8192
PIECES = "part int, vec binary"


def pieces(v: np.ndarray) -> pd.DataFrame:
    """A vector as rows of at most ``PIECE`` bytes, without those that are zero."""
    raw = v.tobytes()
    cut = [(k // PIECE, raw[k : k + PIECE]) for k in range(0, len(raw), PIECE)]
    return pd.DataFrame([(k, b) for k, b in cut if any(b)], columns=["part", "vec"])


def sum_vectors(parts: DataFrame, size: int, dtype: str = "int64", fan: int = 32, join=np.add) -> np.ndarray:
    """Sum (or other ``join``) of the vectors of ``size`` numbers that tasks gave as ``pieces``.

    The pieces of one place meet in one task, which keeps one sum for each place and reads small
    rows in small batches: its memory does not grow with the number of vectors. The driver gets
    one vector.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch["part"], batch["vec"], strict=True):
                v = np.frombuffer(raw, dtype=dtype)
                total[part] = join(total[part], v) if part in total else v.copy()
        yield pd.DataFrame({"part": list(total), "vec": [v.tobytes() for v in total.values()]}, columns=["part", "vec"])

    out = np.zeros(size, dtype=dtype)
    step = PIECE // out.itemsize
    for row in parts.repartition(fan, "part").mapInPandas(add, PIECES).collect():
        v = np.frombuffer(row["vec"], dtype=dtype)
        out[row["part"] * step : row["part"] * step + len(v)] = v
    return out


def _places(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    v = v.astype(np.int64).view(np.uint64)
    shift = np.uint64(64 - bits)
    return (v * np.uint64(0x9E3779B97F4A7C15)) >> shift, ((v ^ (v >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift


def bloom(values: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the numbers in column ``v``: always 2 ** bits bits, however many there are."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for b in batches:
            for at in _places(b["v"].to_numpy(), bits):
                np.bitwise_or.at(field, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        yield pieces(field)

    return sum_vectors(values.select("v").mapInPandas(pack, PIECES), (1 << bits) // 8, "uint8", 32, np.bitwise_or)


def in_bloom(field: np.ndarray, v: np.ndarray, bits: int) -> np.ndarray:
    """True for every number of the filter, and for few others."""
    hit = [(field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) for at in _places(v, bits)]
    return (hit[0] & hit[1]).astype(bool)


class Filter:
    """A Bloom filter on the tasks, sized from the number of values (column ``v``).

    Beyond ``MOST_BITS`` more values pass that are not in it: it spares work, and never decides alone.
    """

    def __init__(self, values: DataFrame) -> None:
        self.size = values.count()
        self.bits = min(MOST_BITS, max(12, (16 * max(1, self.size)).bit_length()))
        self.field = values.sparkSession.sparkContext.broadcast(bloom(values, self.bits)) if self.size else None

    def has(self, v: np.ndarray) -> np.ndarray:
        return in_bloom(self.field.value, v, self.bits) if self.field else np.zeros(len(v), dtype=bool)


def components(nodes_edges: DataFrame) -> DataFrame:
    """Components of the links (``a``, ``b``): one row (``id``, ``component_id``) per linked id.

    Alternating large and small stars: each round replaces links by links to the smallest
    known neighbour, until nothing changes. Every round is two shuffles of the remaining
    links and is written to the shared folder; a long chain halves with every round.
    """
    edges = settle(nodes_edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = settle(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now[0] == now[3] and before == now:
            break
        before = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return roots.unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: list[Column]) -> DataFrame:
    """Add ``rank`` (from 0, gapless) within ``keys`` without putting a key into one task.

    ``spread`` are columns that part the rows of a key into blocks of bounded size (see
    ``block_of``). Each block is numbered on its own and starts where the blocks before it end.
    The blocks are few (rows / rows per block), so one window over their counts is small.
    """
    parts = [f"_b{i}" for i in range(len(spread))]
    placed = df.withColumns(dict(zip(parts, spread, strict=True)))
    counts = placed.groupBy(*keys, *parts).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(W.partitionBy(*keys, *parts).orderBy(*order)) - 1
    both = placed.withColumn("_in", inner).join(starts, [*keys, *parts])
    return both.withColumn("rank", (F.col("_from") + F.col("_in")).cast("long")).drop("_from", "_in", *parts)


def block_of(column: Column, rows: int, rows_per_block: int = 50_000) -> Column:
    """The hash block of a row, for ``ranked``; never null."""
    return F.pmod(F.xxhash64(column), F.lit(max(1, -(-rows // rows_per_block)))).cast("int")
