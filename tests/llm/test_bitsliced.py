"""Exact top-k by bit slices against plain products, and its defined results for odd input."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bitsliced

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASH = ["v", "size", "query", "times", "score", "rank", "own", "at", "h", "pass", "time"]


def rows():
    rng = random.Random(3)
    out = [(i, [rng.gauss(0, 0.13) for _ in range(16)], 0) for i in range(700)]
    out += [(700 + i, [0.25] * 16, 1) for i in range(40)]
    out += [(100, out[100][1], 0), (200, [0.5] * 16, 0), (300, out[5][1], 0), (None, out[7][1], 0), (None, [0.25] * 16, 0)]
    out += [(800, None, 0), (900, [float("nan")] * 16, 0), (1000, [math.inf] + [0.0] * 15, 0), (1100, [None] + [0.1] * 15, 0)]
    out += [(1200, [0.3, -0.4], 0), (1201, [0.1, 0.1], 0), (1300, [], 0), (1301, [], 0), (1400, [0.0] * 16, 0), (1500, [-200000.0] + [1.0] * 15, 0), (1501, [200000.0] * 16, 0)]
    return out


def brute(rows, k):
    f32 = lambda x: float(np.float32(x))
    ok = [(i, [math.floor(1024 * f32(x)) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is None or i % 100:
            continue
        found = [(-sum(x * y for x, y in zip(q, v, strict=True)), j is None, j) for b, (j, v) in enumerate(ok) if a != b and len(v) == len(q)]
        out += [(i, r, j, -s) for r, (s, _, j) in enumerate(sorted(found, key=lambda t: (t[0], t[1], t[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASH})


def test_matches_brute_force(vectors):
    got = sorted((tuple(r) for r in bitsliced.digest(vectors).collect()), key=repr)
    assert got == brute(rows(), 10)


@pytest.mark.parametrize("kept, block, per_pass, k", [(1, 64, 4, 3), (3, 100, 2048, 25), (40, 2048, 6, 1)])
def test_slices_blocks_and_passes_change_nothing(vectors, kept, block, per_pass, k):
    r = vectors.select("vec_id", bitsliced.quantised(F.col("embedding")).alias("v"))
    got = bitsliced.search(r, r.filter("vec_id % 100 = 0"), k, block, per_pass, kept)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows(), k)


def test_bitmap_sums_and_selection():
    rng = np.random.default_rng(1)
    v = rng.integers(-300, 300, (200, 5))
    q = np.array([3, -7, 0, 12, -1])
    block = bitsliced.SlicedBlock(v, kept=20)
    sums = block.sums(q)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:200].astype(np.int64) for s in sums]
    total = sum(b << i for i, b in enumerate(bits))
    exact = v @ q
    assert len(set(total - exact)) == 1
    for k in (1, 2, 77, 200):
        value = bitsliced.kth_largest(sums, block.every, k)
        assert value == sorted(total, reverse=True)[k - 1]
        marked = np.unpackbits(bitsliced.at_least(sums, block.every, value).view(np.uint8), bitorder="little")[:200]
        assert (marked == (total >= value)).all()


def test_no_rows_and_no_queries(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bitsliced.digest(empty).count() == 0
    assert bitsliced.digest(spark.createDataFrame([(1, [0.5], 0), (2, [0.1], 0)], SCHEMA)).count() == 0
    assert bitsliced.digest(spark.createDataFrame([(100, [0.5], 0)], SCHEMA)).count() == 0
    assert bitsliced.digest(empty).columns == ["query_id", "rank", "vec_id", "score"]
