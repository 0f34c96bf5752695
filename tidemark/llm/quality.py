"""Quality rules with robust multivariate outliers; DataFrame and SQL functions only.

Fixed base rules reject short and repetitive texts. The others are described by transformed
statistics; per language and source the minimum covariance determinant gives a centre and a
scatter that outliers cannot pull: starting from medians and absolute deviations, concentration
steps fit mean and covariance to the half of the rows that lie nearest, until five steps are
done. A row is rejected when its Mahalanobis distance, scaled by the median distance of its
group, exceeds the ``CUTOFF`` of a chi-square.

Groups below ``LEAST`` rows use the fit of their language, and below that the fit of all rows.
Quantiles come from histograms of fixed width with at most ``BINS`` bins a group, so each step is
one map-side aggregation and a hot source costs no more than others.

Cases: null text has no words and fails the base; null lang or source is a group of its own;
every statistic has a floor of variance; an empty table gives an empty result; repeated rows
are judged alike. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES
from tidemark.sources.store import settle

FEATURES = ("x0", "x1", "x2", "x3")
STEPS, LEAST, BINS = 5, 200, 2048
#: Quantiles of the chi-square distribution with four degrees of freedom: 0.5 and 1 - 1e-9.
MEDIAN, CUTOFF = 3.356694, 48.29
#: Spread of each statistic that is ordinary in any corpus; added to every covariance, so that a
#: statistic that is zero in most texts does not make the first exception an outlier.
FLOORS = (0.08, 0.5, 0.4, 0.12)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counted statistics of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: x)
    worded = F.filter(lines, lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    d = docs.select(
        "doc_id",
        "lang",
        "source",
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("_w"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    # 3-word windows as numbers; the low bits of the packed copy are the position, so that one
    # sort of plain numbers brings equal windows together in order.
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    d = d.withColumn("_s", windows).drop("_w")
    d = d.withColumn("_bits", F.greatest(F.ceil(F.log2(F.size("_s") + 1)), F.lit(1)).cast("int"))
    packed = F.sort_array(F.transform("_s", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long"))))
    d = d.withColumn("_p", packed).drop("_s")

    def head(v: Column) -> Column:
        return F.call_function("shiftright", v, F.col("_bits"))

    def same(i: Column) -> Column:
        return head(F.get("_p", i)) == head(F.get("_p", i + 1))

    last = F.size("_p") - 1
    at = F.filter("_p", lambda v, i: ((i < last) & same(i)) | ((i > 0) & same(i - 1)))
    starts = F.sort_array(F.transform(at, lambda v: v.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)))
    d = d.withColumn("_r", starts).drop("_p", "_bits")
    covered = F.aggregate(
        F.transform("_r", lambda v, i: F.when(i == F.size("_r") - 1, 3).otherwise(F.least(F.lit(3).cast("long"), F.get("_r", i + 1) - v)).cast("long")),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return d.withColumn("n_repeat_words", covered).drop("_r")


def vector(d: DataFrame) -> DataFrame:
    """Transformed statistics: word length, symbols, repeated lines, repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return d.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "x0": F.log(chars / n),
            "x1": F.log1p(100 * F.col("n_symbols") / chars),
            "x2": F.log1p(F.col("n_dup_lines").cast("double")),
            "x3": F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
        }
    )


def _levels(rows: DataFrame) -> DataFrame:
    """Each row once for its group, once for its language and once for all."""
    keys = F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, a, b in ((0, F.col("lang"), F.col("source")), (1, F.col("lang"), F.lit(None).cast("string")), (2, F.lit(None).cast("string"), F.lit(None).cast("string")))])
    return rows.withColumn("_k", F.explode(keys)).select(F.to_json("_k").alias("g"), *FEATURES)


def _quantile(rows: DataFrame, value: str, share: float, width: float) -> DataFrame:
    """Upper bin edge below which at least ``share`` of each group's values lie."""
    cell = F.least(F.greatest(F.floor(F.col(value) / width), F.lit(-BINS // 2)), F.lit(BINS // 2))
    counts = rows.groupBy("g", cell.alias("_bin")).agg(F.count("*").alias("_n"))
    upto = W.partitionBy("g").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_n").over(W.partitionBy("g"))
    reached = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", total)
    return reached.filter(F.col("_upto") >= F.col("_all") * share).groupBy("g").agg(((F.min("_bin") + 1) * width).alias("q"))


def _fit(rows: DataFrame) -> DataFrame:
    """Mean and lower Cholesky factor of the covariance of each group's rows."""
    d = len(FEATURES)
    moments = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(FEATURES)]
    moments += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c_{i}{j}") for i in range(d) for j in range(i + 1)]
    fit = rows.groupBy("g").agg(*moments, F.count("*").alias("n"))
    for i in range(d):
        for j in range(i + 1):
            dot = reduce(lambda a, b: a + b, [F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)], F.lit(0.0))
            rest = F.col(f"c_{i}{j}") - dot
            fit = fit.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(0.0)) + FLOORS[i] ** 2) if i == j else rest / F.col(f"l_{j}{j}"))
    return fit.select("g", "n", *[f"m_{i}" for i in range(d)], *[f"l_{i}{j}" for i in range(d) for j in range(i + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution with the Cholesky factor."""
    z: list[Column] = []
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}{j}") * z[j]
        z.append(rest / F.col(f"l_{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in z])


def covariances(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Minimum covariance determinant fit of every group: mean, factor, rows, distance scale."""
    d = len(FEATURES)
    start = None
    for i, x in enumerate(FEATURES):
        middle = _quantile(rows, x, 0.5, 0.01).withColumnRenamed("q", f"m_{i}")
        spread = rows.join(middle, "g").withColumn("_a", F.abs(F.col(x) - F.col(f"m_{i}")))
        wide = _quantile(spread, "_a", 0.5, 0.01).withColumn(f"l_{i}{i}", F.greatest(1.4826 * F.col("q"), F.lit(FLOORS[i]))).drop("q")
        both = middle.join(wide, "g")
        start = both if start is None else start.join(both, "g")
    fit = settle(start.select("g", *[f"m_{i}" for i in range(d)], *[(F.col(f"l_{i}{i}") if i == j else F.lit(0.0)).alias(f"l_{i}{j}") for i in range(d) for j in range(i + 1)]))
    for _ in range(steps):
        far = rows.join(fit.drop("n"), "g").withColumn("_d", F.log(_distance() + 1e-9)).select("g", *FEATURES, "_d")
        near = far.join(_quantile(far, "_d", 0.5, 0.02), "g").filter("_d < q")
        fit = settle(_fit(near))
    far = rows.join(fit.drop("n"), "g").withColumn("_d", F.log(_distance() + 1e-9)).select("g", "_d")
    size = rows.groupBy("g").agg(F.count("*").alias("rows"))
    return settle(fit.drop("n").join(_quantile(far, "_d", 0.5, 0.02), "g").join(size, "g").withColumn("scale", F.greatest(F.exp("q") / MEDIAN, F.lit(1.0))).drop("q"))


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics, base verdict, squared distance and ``kept`` of every document row."""
    d = settle(vector(base_statistics(docs)))
    good = d.filter(~F.col("base_failed"))
    fits = covariances(settle(_levels(good)))
    params = [c for c in fits.columns if c not in ("g", "rows")]

    def key(level: int, lang: Column, source: Column) -> Column:
        return F.to_json(F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source")))

    none = F.lit(None).cast("string")
    known = fits.filter((F.col("rows") >= LEAST) | F.col("g").startswith('{"level":2'))
    # The finest fit that stands on enough rows; the table of groups is joined, not the rows.
    pairs = d.select("lang", "source").distinct()
    pairs = pairs.withColumn("g", F.explode(F.array(key(0, F.col("lang"), F.col("source")), key(1, F.col("lang"), none), key(2, none, none))))
    chosen = pairs.join(known, "g").groupBy("lang", "source").agg(F.min_by(F.struct(*params), "g").alias("_f")).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_f.*")
    joined = d.join(chosen, d["lang"].eqNullSafe(chosen["_lang"]) & d["source"].eqNullSafe(chosen["_source"]), "left")
    far = joined.withColumn("distance", _distance() / F.col("scale"))
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))
