"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its shingles (three words unless a caller asks for another width). Under any total order of all shingles, two sets of
Jaccard similarity t or more share a shingle among the first n - ceil(t n) + 1 of each (the
prefix). Several orders are used, each putting shingles first that its own count sketch over all
documents calls rare: the first order finds candidates by a join on prefix shingles, with size
and position bounds; a candidate survives only if the prefixes of the other orders meet as well;
survivors are verified on whole sets. A sketch is a table of ``WIDTH`` counters, however large the
corpus; its collisions change the order, never the result.

Components without all pairs. Equal sets are one class. Every posting list first meets its pivot
(the member that has the shingle earliest), one pair per member. What these links do not join is
then compared pair by pair, leaving out members that already are in one component.

Cases: null text, or text without words, has the empty set and is linked with nothing; fewer
words than a shingle are one shingle; rows with a null doc_id are linked with nothing and get a null
component; rows that share a doc_id are one document with several texts, linked if any of them
is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PIECES, Filter, components, pieces, short_batches, sum_vectors
from tidemark.sources.store import settle

SHINGLE = 3
ORDERS = 3
WIDTH = 1 << 18
# Odd multipliers that mix 64-bit words (fixed values).
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_SEEN: dict[bytes, int] = {}


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A 64-bit number for each word; known words are kept between documents."""
    if len(_SEEN) > 150_000:
        _SEEN.clear()
    out = []
    for w in words:
        n = _SEEN.get(w)
        if n is None:
            n = _SEEN[w] = xxhash.xxh3_64_intdigest(w)
        out.append(n)
    return np.array(out, dtype=np.uint64)


def shingles(raw: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle numbers of a UTF-8 text."""
    words = [] if raw is None else raw.lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], dtype=np.uint64)
    n = word_numbers(words)
    h = np.zeros(len(n) - width + 1, dtype=np.uint64)
    for k in range(width):
        h = (h + n[k : len(n) - width + 1 + k]) * _MIX[k % len(_MIX)]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _slots(h: np.ndarray, order: int) -> np.ndarray:
    return ((h * _MIX[order]) >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64)


def count_sketch(docs: DataFrame, width: int = SHINGLE) -> np.ndarray:
    """Occurrences of all shingles by slot, one row per order; ``docs`` has ``raw``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((ORDERS, WIDTH), dtype=np.int64)
        for batch in batches:
            sets = [shingles(raw, width) for raw in batch["raw"]]
            if sets:
                h = np.concatenate(sets)
                for o in range(ORDERS):
                    total[o] += np.bincount(_slots(h, o), minlength=WIDTH)
        yield pieces(total)

    return sum_vectors(docs.select("raw").mapInPandas(count, PIECES), ORDERS * WIDTH).reshape(ORDERS, WIDTH)


def prefix(h: np.ndarray, order: int, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set under one order, rare ones first."""
    need = -(-percent * len(h) // 100)
    rank = np.lexsort((h * _MIX[order], counts[order][_slots(h, order)]))
    return h[rank[: len(h) - need + 1]] if len(h) else h


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _within(n1: Column, n2: Column, percent: int) -> Column:
    """Neither set is too small for the other."""
    return (n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent)


def _reachable(n1: Column, at1: Column, n2: Column, at2: Column, percent: int) -> Column:
    """The overlap still possible if this shingle is the first that both share."""
    most = F.least(n1 - at1, n2 - at2)
    return most * (100 + percent) >= (n1 + n2) * percent


def _sets_of(ids: DataFrame, docs: DataFrame, build, schema: str) -> DataFrame:
    """Rows that ``build`` makes from the texts of the wanted ids (column ``v``), stored.

    No text moves: every task works on its own wanted documents, and on the few others that the
    filter lets through, which no pair asks for.
    """
    wanted = Filter(settle(ids.distinct()))

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return build(b[wanted.has(b["doc_id"].to_numpy())] for b in batches)

    return settle(docs.mapInPandas(few, schema))


def _verify(pairs: DataFrame, docs: DataFrame, counts, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) whose prefixes meet under all other orders and whose sets are similar.

    Prefixes must not only meet: of the set whose prefix ends earlier, every shared shingle lies
    in both prefixes or among the shingles after its own, so that the overlap is at most the
    shared part of the prefixes and the longer of the two rests. Prefixes hold distinct 32-bit
    parts of shingle numbers; where two fall together, the rest counts one of them.
    """
    pres = [f"pre{o}" for o in range(1, ORDERS)]

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counts.value
        for batch in batches:
            out = []
            for i, raw in zip(batch["doc_id"], batch["raw"], strict=True):
                h = shingles(raw, width)
                out.append((i, len(h), *[np.unique(prefix(h, o, table, percent).astype(np.uint32)).view(np.int32) for o in range(1, ORDERS)]))
            yield pd.DataFrame(out, columns=["id", "n", *pres])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, _signed(shingles(raw, width))) for i, raw in zip(batch["doc_id"], batch["raw"], strict=True)], columns=["id", "set"])

    def both(rows: DataFrame, table: DataFrame) -> DataFrame:
        for s in ("a", "b"):
            rows = rows.join(table.select([F.col(c).alias(s if c == "id" else f"{s}_{c}") for c in table.columns]), s)
        return rows

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array("a", "b")).alias("v"))

    heads = _sets_of(named(pairs), docs, prefixes, "id long, n int, " + ", ".join(f"{p} array<int>" for p in pres))
    met = both(pairs, heads)
    need = F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100.0 + percent) - 1e-9)
    for p in pres:
        rest = F.greatest(F.col("a_n") - F.size(f"a_{p}"), F.col("b_n") - F.size(f"b_{p}"))
        met = met.filter(F.arrays_overlap(f"a_{p}", f"b_{p}")).filter(F.size(F.array_intersect(f"a_{p}", f"b_{p}")) + rest >= need)
    left = settle(met.select("a", "b", "a_n", "b_n").distinct())
    sets = _sets_of(named(left), docs, whole, "id long, set array<long>")
    common = F.size(F.array_intersect("a_set", "b_set"))
    alike = both(left, sets).filter((F.size("a_set") == F.col("a_n")) & (F.size("b_set") == F.col("b_n")))
    return settle(alike.filter(common * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent).select("a", "b").distinct())


def link(docs: DataFrame, percent: int = 90, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and number of equal sets (``copies``) of every document row."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    counts = spark.sparkContext.broadcast(count_sketch(rows, width))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counts.value
        for batch in batches:
            out = []
            for i, raw in zip(batch["doc_id"].astype("Int64"), batch["raw"], strict=True):
                h = shingles(raw, width)
                digest = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                out.append((i, len(h), digest, _signed(prefix(h, 0, table, percent))))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "digest", "pre"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    all_ = settle(rows.mapInPandas(first, "doc_id long, n int, digest binary, pre array<long>"))
    real = all_.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = settle(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))

    # The first document of a class stands for it. Documents that are alone in their class, which
    # are most, keep their prefixes where they are; only what a filter of the others lets through
    # is looked up.
    others = Filter(classes.filter("members > 1").select(F.xxhash64("digest").alias("v")))

    @F.pandas_udf("boolean")
    def maybe(v: pd.Series) -> pd.Series:
        return pd.Series(others.has(v.to_numpy()))

    marked = real.select("digest", F.col("doc_id").alias("rep"), "n", "pre", maybe(F.xxhash64("digest")).alias("maybe"))
    doubtful = marked.filter("maybe").join(classes.select("digest", "rep"), ["digest", "rep"], "left_semi").dropDuplicates(["digest", "rep"])
    reps = marked.filter("NOT maybe").select("rep", "n", "pre").unionAll(doubtful.select("rep", "n", "pre"))

    # Most shingles of a prefix are in no other: they are counted alone, and stay where they are.
    counts_of = reps.select(F.explode("pre").alias("tok")).groupBy("tok").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = settle(counts_of)
    common_ = Filter(sizes.select(F.col("tok").alias("v")))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rep, n, pre in zip(batch["rep"], batch["n"], batch["pre"], strict=True):
                at = np.flatnonzero(common_.has(pre))
                out.append(pd.DataFrame({"rep": rep, "n": n, "at": at, "tok": pre[at]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    post = reps.mapInPandas(kept, "rep long, n int, at int, tok long")
    shared = settle(post.join(sizes, "tok"))
    lists = shared.groupBy("tok").agg(F.min(F.struct("at", "rep", "n")).alias("pivot"))
    lists = lists.select("tok", F.col("pivot.rep").alias("p"), F.col("pivot.n").alias("p_n"), F.col("pivot.at").alias("p_at"))
    texts = rows.filter("doc_id IS NOT NULL AND raw IS NOT NULL")
    n, at = F.col("n"), F.col("at")
    star = shared.join(lists, "tok")
    star = star.filter((F.col("rep") != F.col("p")) & _within(n, F.col("p_n"), percent) & _reachable(n, at, F.col("p_n"), F.col("p_at"), percent))
    star = settle(star.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct())
    links = _verify(star, texts, counts, percent, width)

    # Lists of three and more may hold links that no pivot has seen.
    joined = components(links).withColumnRenamed("id", "rep")
    rest = shared.filter("size > 2").drop("size").join(joined, "rep", "left").withColumn("comp", F.coalesce("component_id", "rep")).drop("component_id")
    rest = settle(rest)
    mixed = rest.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("tok")
    rest = rest.join(mixed, "tok", "left_semi")
    x, y = rest.alias("x"), rest.alias("y")
    near = (
        (F.col("x.tok") == F.col("y.tok"))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.col("x.comp") != F.col("y.comp"))
        & _within(F.col("x.n"), F.col("y.n"), percent)
        & _reachable(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), percent)
    )
    more = x.join(y, near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    links = links.unionAll(_verify(settle(more), texts, counts, percent, width))

    # Rows that share an id tie the classes of their texts together.
    named = real.join(classes, "digest").select("doc_id", "rep", "members", "digest")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("doc_id")
    ties = named.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    comps = components(links.unionAll(ties)).withColumnRenamed("id", "rep")
    found = named.join(comps, "rep", "left").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.coalesce("component_id", "rep").alias("component_id"), "members").distinct()
    met = all_.join(found, (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return met.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("members", F.lit(1)).alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the number of documents with an equal set."""
    return link(docs.select("doc_id", "text"))
