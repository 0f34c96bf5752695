"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to integers. A task holds a block of rows as bitmaps: for every attribute
the ``KEPT`` most significant bits of its values in the block, one bitmap over the rows for each
bit. A query is answered block by block:

1. Every attribute is multiplied by the query's weight by taking its slices once for each set bit
   of the weight; slices of equal place value are added with carry-save adders on whole bitmaps,
   which leaves one bitmap per bit of the sum. Negative weights take the complement of the slices.
2. From the most significant slice of the sums downward, bitmap counts find the sum of the
   ``k``-th row.
3. Bits that the index leaves out move a score by a known amount at most. Rows above the
   boundary by that margin are compared by their exact integer products, ties by smaller id.

Queries are stored once, dealt by hash into blocks of about half of ``QUERIES`` and broadcast block
by block; every block is one pass over all rows. A task gives ``k`` rows for each query and block of rows; these are merged.

Cases: vectors that are null, or hold null or non-finite components or such of ``2 ** 18`` and more,
take no part; a query meets the rows of its own length only; rows without an id are candidates
after all others of equal score, and no queries; equal rows are rows of their own, and a query
leaves out one row, its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.store import settle

SCALE, TOP = 1024, 10
#: Rows of a block, slices of an attribute, queries of a pass.
BLOCK, KEPT, QUERIES = 1 << 15, 7, 2048
#: Components must be smaller, so that the sum of 64 products fits into 64 bits.
LARGEST = 1 << 18
Piles = dict[int, list[np.ndarray]]


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, null for a vector that takes no part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST))
    return F.when(fit, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int")))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps over the last axis, in words of 64 rows."""
    raw = np.packbits(bits, axis=-1, bitorder="little")
    pad = -raw.shape[-1] % 8
    return np.ascontiguousarray(np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, pad)])).view(np.uint64)


def add_piles(piles: Piles) -> list[np.ndarray]:
    """The bits of a sum, least first: three bitmaps of one place make one there and one above."""
    out = []
    place = 0
    while piles:
        here = piles.pop(place, [])
        pile = np.concatenate(here) if here else None
        while pile is not None and len(pile) > 1:
            m = len(pile) // 3
            if m:
                a, b, c, rest = pile[:m], pile[m : 2 * m], pile[2 * m : 3 * m], pile[3 * m :]
                either = a ^ b
                carry = (a & b) | (either & c)
                pile = np.concatenate([either ^ c, rest])
            else:
                carry = pile[:1] & pile[1:2]
                pile = pile[:1] ^ pile[1:2]
            piles.setdefault(place + 1, []).append(carry)
        out.append(pile[0] if pile is not None else None)
        place += 1
    width = next((x.shape for x in out if x is not None), (0,))
    return [np.zeros(width, dtype=np.uint64) if x is None else x for x in out]


def kth_largest(sums: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The ``k``-th largest sum of the marked rows, from the most significant slice downward."""
    value = 0
    for place in range(len(sums) - 1, -1, -1):
        ones = rows & sums[place]
        n = int(np.bitwise_count(ones).sum())
        if n >= k:
            rows, value = ones, value | (1 << place)
        else:
            rows, k = rows & ~sums[place], k - n
    return value


def at_least(sums: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
    """The marked rows whose sum is ``bound`` or more."""
    if bound <= 0:
        return rows
    if bound.bit_length() > len(sums):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for place in range(len(sums) - 1, -1, -1):
        if bound >> place & 1:
            equal = equal & sums[place]
        else:
            above |= equal & sums[place]
            equal = equal & ~sums[place]
    return above | equal


class SlicedBlock:
    """The bit-sliced index of a block of integer vectors, and the vectors for the boundary."""

    def __init__(self, vectors: np.ndarray, kept: int = KEPT) -> None:
        self.vectors = vectors
        n, d = vectors.shape
        self.low = vectors.min(axis=0) if n and d else np.zeros(d, dtype=np.int64)
        values = (vectors - self.low).T
        self.width = int(values.max(initial=0)).bit_length()
        self.shift = max(0, self.width - kept)
        self.slices = np.stack([_packed((values >> b) & 1 > 0) for b in range(self.shift, max(self.width, self.shift + 1))], axis=1) if d else np.zeros((0, 1, -(-n // 64)), dtype=np.uint64)
        self.every = _packed(np.ones((1, n), dtype=bool))[0]

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Weighted sums of the kept parts, up to a constant of the query."""
        piles: Piles = {}
        size = np.abs(weights)
        for t in range(int(size.max(initial=0)).bit_length()):
            for negative in (False, True):
                chosen = (size >> t & 1 > 0) & ((weights < 0) == negative)
                if chosen.any():
                    part = self.slices[chosen]
                    part = ~part & self.every if negative else part
                    for b in range(part.shape[1]):
                        piles.setdefault(t + b, []).append(part[:, b])
        return add_piles(piles)

    def top(self, weights: np.ndarray, k: int) -> np.ndarray:
        """Rows that hold the ``k`` largest products, with all that the left-out bits leave open."""
        sums = self.sums(weights)
        if len(self.vectors) <= k or not sums:
            return np.arange(len(self.vectors))
        # A left-out part adds less than |weight| to the sum of an attribute.
        margin = int(np.abs(weights).sum()) if self.shift else 0
        rows = at_least(sums, self.every, kth_largest(sums, self.every, k) - margin)
        return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little")[: len(self.vectors)])


def _best(block: SlicedBlock, ids: np.ndarray, missing: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and exact products of the first ``k`` rows of a block."""
    rows = block.top(query, k)
    score = block.vectors[rows] @ query
    order = np.lexsort((ids[rows], missing[rows], -score))[:k]
    return rows[order], score[order]


def _vectors(column: pd.Series) -> np.ndarray:
    return np.concatenate(column.to_list()).reshape(len(column), -1).astype(np.int64)


def _partial(rows: DataFrame, queries: list, k: int, rows_per_block: int, kept: int) -> DataFrame:
    """The first ``k`` rows of every block for every query of a pass."""
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for number, v in queries:
        by_size.setdefault(len(v), []).append((number, np.array(v, dtype=np.int64)))
    held = rows.sparkSession.sparkContext.broadcast(by_size)

    def answer(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = pd.concat(frames, ignore_index=True)
        for size, part in all_.groupby("size"):
            ids, missing = part["vec_id"].fillna(0).to_numpy(dtype=np.int64), part["vec_id"].isna().to_numpy()
            block = SlicedBlock(_vectors(part["v"]) if size else np.zeros((len(part), 0), dtype=np.int64), kept)
            out = []
            for number, query in held.value[size]:
                at, score = _best(block, ids, missing, query, k)
                out.append(pd.DataFrame({"query": number, "vec_id": pd.array(ids[at], dtype="Int64"), "score": score, "missing": missing[at]}))
            found = pd.concat(out, ignore_index=True)
            found.loc[found["missing"], "vec_id"] = pd.NA
            yield found[["query", "vec_id", "score"]]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames, n = [], 0
        for batch in batches:
            batch = batch[batch["size"].isin(list(held.value))].astype({"vec_id": "Int64"})
            while len(batch):
                take, batch = batch[: rows_per_block - n], batch[rows_per_block - n :]
                frames.append(take)
                n += len(take)
                if n == rows_per_block:
                    yield from answer(frames)
                    frames, n = [], 0
        if n:
            yield from answer(frames)

    return rows.mapInPandas(search, "query long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, rows_per_block: int = BLOCK, per_pass: int = QUERIES, kept: int = KEPT) -> DataFrame:
    """query_id, rank, vec_id and score of each query row's ``k`` best other rows.

    ``vectors`` and ``queries`` have ``vec_id`` and integer vectors ``v``; every query is a row of
    ``vectors``.
    """
    spark = vectors.sparkSession
    rows = settle(vectors.filter("v IS NOT NULL").select("vec_id", "v", F.size("v").alias("size")))
    asked = queries.filter("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    # Equal queries are answered once; the number is a hash of both columns, told apart by a rank.
    asked = settle(asked.withColumn("h", F.xxhash64("vec_id", "v")))
    passes = max(1, -(-2 * asked.count() // per_pass))
    asked = settle(asked.withColumn("query", F.monotonically_increasing_id()).withColumn("pass", F.pmod("h", F.lit(passes))))
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // rows_per_block))
    parts = []
    for p in range(passes):
        block = [(r["query"], r["v"]) for r in asked.filter(F.col("pass") == p).select("query", "v").collect()]
        if block:
            # One more than asked for: the query's own row may be among them.
            parts.append(settle(_partial(rows.repartition(tasks), block, k + 1, rows_per_block, kept)))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    merged = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    named = asked.select("query", F.col("vec_id").alias("query_id"), "times", own.alias("own"))
    merged = merged.join(named, "query")
    # The own row, or one that cannot be told from it in the result.
    itself = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.lit(False))
    first = F.min(F.when(itself, F.col("at"))).over(W.partitionBy("query"))
    rest = merged.withColumn("gone", F.coalesce(first, F.lit(k + 1))).filter(F.col("at") != F.col("gone"))
    rank = (F.col("at") - F.when(F.col("at") > F.col("gone"), 1).otherwise(0)).cast("int")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return rest.select("query_id", rank.alias("rank"), "vec_id", "score", times.alias("time")).drop("time")


def digest(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """The contract: rows whose id is divisible by ``every`` against all others."""
    rows = embeddings.select("vec_id", quantised(F.col("embedding")).alias("v"))
    return search(rows, rows.filter(F.col("vec_id") % every == 0))
