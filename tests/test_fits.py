"""Isotonic and logistic fits of many groups against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fits
from tidemark.operators import modeling as M


def serial_pools(rows):
    """Pool adjacent violators, one distinct probability at a time."""
    sums = {}
    for p, y in rows:
        s = sums.setdefault(p, [0, 0])
        s[0] += y
        s[1] += 1
    pools = []
    for p in sorted(sums):
        pools.append([p, p, *sums[p]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, s, n = pools.pop()
            pools[-1][1:] = [hi, pools[-1][2] + s, pools[-1][3] + n]
    return [tuple(p) for p in pools]


@pytest.mark.parametrize("block, fan", [(1, 2), (3, 2), (7, 5), (256, 32)])
def test_isotonic_blocks_change_nothing(spark, block, fan):
    rng = random.Random(9)
    streams = {
        "rising": [(x, int(rng.random() < x)) for x in (rng.random() for _ in range(300))],
        "falling": [(k / 50, int(k < 25)) for k in range(50)],
        "coarse": [(rng.choice([0.2, 0.5, 0.8]), rng.randint(0, 1)) for _ in range(90)],
        "cascade": [(k / 60, int(k % 5 < k // 12)) for k in range(60)] + [(0.999, 0)] * 400,
        "one": [(0.5, 1)],
        "ends": [(0.0, 0), (1.0, 1), (1.0, 0)],
    }
    rows = spark.createDataFrame([(k, p, y) for k, v in streams.items() for p, y in v], "k string, p double, y int").repartition(3)
    got = {r.k: [tuple(x) for x in r.pools] for r in fits.isotonic_pools(rows, ["k"], block, fan).collect()}
    assert got == {k: serial_pools(v) for k, v in streams.items()}


def test_isotonic_values_between_and_beyond_pools(spark):
    rows = spark.createDataFrame([("a", p, y) for p, y in [(0.2, 0), (0.3, 0), (0.4, 1), (0.5, 0), (0.7, 1)]], "k string, p double, y int")
    ask = spark.createDataFrame([("a", p) for p in (0.1, 0.2, 0.25, 0.35, 0.45, 0.6, 0.7, 0.9)], "k string, p double")
    got = [r.p for r in fits.isotonic_by(rows, ["k"])(ask.withColumn("raw", F.col("p"))).orderBy("raw").collect()]
    assert got == pytest.approx([0.0, 0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0])


def test_calibrators_do_not_worsen_their_own_stream(spark):
    rows = spark.range(800).select(F.lit("s").alias("k"), F.rand(4).alias("q"), F.rand(5).alias("u"))
    rows = rows.select("k", (0.5 + (F.col("q") - 0.5) * 0.2).alias("p"), (F.col("u") < F.col("q")).cast("int").alias("y")).cache()

    def brier(df):
        return df.agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0]

    assert brier(M.platt_by(rows, ["k"])(rows)) < brier(rows)
    iso = fits.isotonic_by(rows, ["k"])(rows.withColumn("raw", F.col("p"))).orderBy("raw").select("p").toPandas()["p"]
    assert iso.is_monotonic_increasing and brier(fits.isotonic_by(rows, ["k"])(rows)) < brier(rows)


def test_logistic_fits_equal_plain_newton(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, (n, slope) in enumerate([(400, 2.0), (150, -1.0), (30, 8.0)]):
        x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + [0.0, 3.0, 1.0]
        y = (rng.random(n) < 1 / (1 + np.exp(-slope * x[:, 0] - 0.3))).astype(float)
        test = rng.normal(size=(5, 3))
        rows += [(g, "train", float(v), *map(float, r)) for v, r in zip(y, x)] + [(g, "test", 0.0, *map(float, r)) for r in test]
        z = np.column_stack([(x - x.mean(0)) / x.std(0, ddof=1), np.ones(n)])
        w, ridge = np.zeros(4), np.array([0.01, 0.01, 0.01, 0.0])
        for _ in range(60):
            q = 1 / (1 + np.exp(-z @ w))
            w = w - 0.5 * np.linalg.solve((z.T * (q * (1 - q))) @ z / n + np.diag(ridge), z.T @ (q - y) / n + ridge * w)
        want[g] = (w, 1 / (1 + np.exp(-(np.column_stack([(test - x.mean(0)) / x.std(0, ddof=1), np.ones(5)]) @ w))))
    placed = spark.createDataFrame(rows, "g int, part string, y double, a double, b double, c double").repartition(4)
    scaled = fits.scaled_rows(placed, ["g"], ["a", "b", "c"])
    found = fits.logistic_fits(scaled.filter("part = 'train'"), ["g"], 3, 0.01, steps=60)
    for r in found.collect():
        assert r.gradient < 1e-9 and r.w == pytest.approx(list(want[r.g][0]), abs=1e-5)
    p = scaled.filter("part = 'test'").join(found.select("g", "w"), "g").select("g", fits.logistic_p(F.col("z"), F.col("w")).alias("p"))
    for g, (_, q) in want.items():
        assert sorted(x.p for x in p.filter(F.col("g") == g).collect()) == pytest.approx(sorted(q), abs=1e-5)


def test_exact_targets_do_not_reach_over_gaps(spark):
    from tidemark.operators import features as X

    hour = 3_600_000
    rows = [("s", h * hour, k + 1, float(100 + (k * 7) % 5)) for k, h in enumerate([0, 1, 2, 5, 6, 7, 8])] + [("s", 9 * hour, 8, 0.0)]
    bars = spark.createDataFrame(rows, "series_id string, open_time_ms long, row_idx long, close double")
    got = {(r.open_time_ms // hour, r.horizon, r.target_open_ms // hour, r.y) for r in X.direction_target_exact(bars, {"1h": 1, "3h": 3}).collect()}
    price = {h: c for (_, t, _, c) in rows for h in [t // hour]}
    want = {(h, name, h + n, int(price[h + n] > price[h])) for h in price for name, n in (("1h", 1), ("3h", 3)) if price[h] > 0 and price.get(h + n, 0) > 0}
    assert got == want and (2, "1h", 5, 0) not in got
