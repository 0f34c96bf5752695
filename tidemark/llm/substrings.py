"""Substring deduplication with prefix-partitioned suffix trees.

Suffixes are cut at ``window`` words, which is the depth that matters: a node of the suffix tree
at that depth with several leaves is a repeated passage, and its leaf that starts first (smallest
document, earliest word) is the one to keep. The tree is never built as a whole. Every suffix
belongs to the subtree of a prefix: the ``ANCHOR`` words with the smallest hash among those inside
its window, so that neighbouring suffixes mostly travel as one row. A first pass counts the
prefixes of the whole corpus; prefixes that occur once have no deep node and their suffixes never
leave their task. Prefixes that occur more than ``MOST`` times are lengthened to the whole window,
so that every subtree fits into memory whatever is frequent.

Each task first settles repeats among its own suffixes and sends only the first leaf of each
node, so that a passage in all documents costs one row per task. Suffixes of one subtree are
sorted by the code of their edge; equal neighbours are one deep node. Consecutive suffixes that
repeat join to maximal repeats (``start``, ``len`` suffixes).

Edges are compared by 64-bit codes of words next to the 64-bit code of the prefix. What tasks
share are two Bloom filters of fixed size; if the corpus outgrows them, more suffixes travel and
the result stays.

Cases: null text has no words; texts below a window repeat nothing; rows that share a doc_id are
ordered by a hash of the text, and identical rows are judged alike; a null doc_id comes first; an
empty table gives an empty result; columns of the input keep their names and values.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PIECES, pieces, short_batches, sum_vectors
from tidemark.llm.jaccard import word_numbers

WINDOW, ANCHOR, MOST = 20, 8, 2000
BLOCK_WORDS = 250_000
BITS, HOT_BITS = 26, 20
_FIELDS = ((1 << BITS) + (1 << HOT_BITS)) // 8
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, size=(2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SUFFIXES = "key long, doc long, h long, start int, len int, codes binary"
REPEATS = "doc long, h long, start int, len int"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _codes(n: np.ndarray, width: int, row: int) -> np.ndarray:
    """Code of every ``width`` consecutive words."""
    out = np.zeros(len(n) - width + 1, dtype=np.uint64)
    for k in range(width):
        out += n[k : k + len(out)] * _FACTORS[row, k]
    return _mixed(out)


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :])


class Suffixes:
    """The suffixes of a block of documents: document, start, prefix and edge code."""

    def __init__(self, docs: list[tuple[int, int, list[bytes]]]) -> None:
        self.ids = np.array([d[0] for d in docs], dtype=np.int64)
        self.hashes = np.array([d[1] for d in docs], dtype=np.int64)
        sizes = np.array([len(d[2]) for d in docs])
        n = np.concatenate([word_numbers(d[2]) for d in docs])
        first = np.cumsum(sizes) - sizes
        self.anchors = _codes(n, ANCHOR, 0)
        prefix = _lowest(self.anchors, WINDOW - ANCHOR + 1)
        doc = np.repeat(np.arange(len(docs)), sizes)[: len(prefix)]
        start = np.arange(len(prefix)) - first[doc]
        whole = start <= sizes[doc] - WINDOW
        self.doc, self.start, self.prefix = doc[whole], start[whole].astype(np.int32), prefix[whole]
        self.code = _codes(n, WINDOW, 1)[whole]
        self.doc_of_anchor = np.repeat(np.arange(len(docs)), sizes)[: len(self.anchors)]
        self.start_of_anchor = np.arange(len(self.anchors)) - first[self.doc_of_anchor]
        self.anchors_whole = self.start_of_anchor <= sizes[self.doc_of_anchor] - ANCHOR


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[Suffixes]:
    held: list[tuple[int, int, list[bytes]]] = []
    words = 0
    for batch in batches:
        for i, h, raw in zip(batch["doc"], batch["h"], batch["raw"], strict=True):
            w = raw.split()
            if len(w) >= WINDOW:
                held.append((i, h, w))
                words += len(w)
            if words >= BLOCK_WORDS:
                yield Suffixes(held)
                held, words = [], 0
    if held:
        yield Suffixes(held)


def _count_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences of every anchor that is the prefix of some suffix."""
    for s in _blocks(batches):
        used = np.unique(s.prefix)
        found = s.anchors[s.anchors_whole]
        found = found[np.isin(found, used)]
        at, n = np.unique(found, return_counts=True)
        yield pd.DataFrame({"prefix": at.view(np.int64), "n": n})


def _bits(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return (values * _M1) >> shift, (values * _M2) >> shift


class Filters:
    """Bloom filters of the prefixes that repeat and of those that are frequent."""

    def __init__(self, packed: np.ndarray) -> None:
        size = (1 << BITS) // 8
        self.repeated, self.frequent = packed[:size], packed[size:]

    @staticmethod
    def of(repeated: np.ndarray, frequent: np.ndarray) -> bytes:
        out = []
        for values, bits in ((repeated, BITS), (frequent, HOT_BITS)):
            field = np.zeros((1 << bits) // 8, dtype=np.uint8)
            for at in _bits(values, bits):
                np.bitwise_or.at(field, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            out.append(field.tobytes())
        return b"".join(out)

    @staticmethod
    def holds(field: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
        one, two = _bits(values, bits)
        return ((field[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & (field[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _filters(prefixes: DataFrame) -> Filters:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_FIELDS, dtype=np.uint8)
        for b in batches:
            v = b["prefix"].to_numpy().view(np.uint64)
            total |= np.frombuffer(Filters.of(v, v[b["n"].to_numpy() > MOST]), dtype=np.uint8)
        yield pieces(total)

    return Filters(sum_vectors(prefixes.mapInPandas(pack, PIECES), _FIELDS, "uint8", 32, np.bitwise_or))


def _runs(*columns: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First index of every stretch of consecutive starts with equal columns."""
    new = np.ones(len(start), dtype=bool)
    if len(start) > 1:
        new[1:] = start[1:] != start[:-1] + 1
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _stretches(*columns: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches that ``_runs`` finds."""
    first = _runs(*columns, start=start).tolist() if len(start) else []
    return zip(first, [*first[1:], len(start)][: len(first)], strict=True)


def _send(filters) -> object:
    """Repeats settled inside the block, and the suffixes that other tasks must see."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = filters.value
        for s in _blocks(batches):
            keep = Filters.holds(f.repeated, s.prefix, BITS)
            doc, start, prefix, code = s.doc[keep], s.start[keep], s.prefix[keep], s.code[keep]
            ids, hs = s.ids[doc], s.hashes[doc]
            order = np.lexsort((hs, start, ids, code, prefix))
            p, c, d, b, h = prefix[order], code[order], ids[order], start[order], hs[order]
            # Every leaf against the first of its node: equal rows of that document are first as well.
            node = np.ones(len(order), dtype=bool)
            node[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
            lead = np.maximum.accumulate(np.where(node, np.arange(len(order)), 0))
            later = np.zeros(len(order), dtype=bool)
            later[order] = (d != d[lead]) | (b != b[lead]) | (h != h[lead])
            frequent = Filters.holds(f.frequent, prefix, HOT_BITS)
            out = []
            at = np.flatnonzero(later)
            for lo, hi in _stretches(doc[at], start=start[at]):
                i = at[lo]
                out.append((int(ids[i]) * 31 + int(start[i]) // 64, ids[i], hs[i], start[i], hi - lo, None))
            at = np.flatnonzero(~later & ~frequent)
            for lo, hi in _stretches(doc[at], prefix[at].view(np.int64), start=start[at]):
                i = at[lo]
                out.append((prefix[i].view(np.int64), ids[i], hs[i], start[i], hi - lo, code[at[lo:hi]].tobytes()))
            for i in np.flatnonzero(~later & frequent):
                out.append((code[i].view(np.int64), ids[i], hs[i], start[i], 1, code[i].tobytes()))
            if out:
                frame = pd.DataFrame(out, columns=["key", "doc", "h", "start", "len", "codes"])
                frame["key"] = (frame["key"].astype(object).map(lambda k: ((int(k) + (1 << 63)) % (1 << 64)) - (1 << 63))).astype(np.int64)
                yield frame

    return send


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaves after the first of every deep node; rows arrive sorted by subtree."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        settled = batch["codes"].isna()
        if settled.any():
            yield batch.loc[settled, ["doc", "h", "start", "len"]]
        rows = batch[~settled]
        if not len(rows):
            continue
        last = rows["key"].iloc[-1]
        open_ = rows["key"] == last
        if held and held[0]["key"].iloc[0] != rows["key"].iloc[0]:
            yield from _deep(pd.concat(held))
            held = []
        if not open_.all():
            yield from _deep(pd.concat([*held, rows[~open_]]))
            held = []
        held.append(rows[open_])
    if held:
        yield from _deep(pd.concat(held))


def _deep(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    n = rows["len"].to_numpy()
    at = np.repeat(np.arange(len(rows)), n)
    key, doc, h = (rows[c].to_numpy()[at] for c in ("key", "doc", "h"))
    start = rows["start"].to_numpy()[at] + (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    code = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint64)
    order = np.lexsort((h, start, doc, code, key))
    key, doc, h, start, code = key[order], doc[order], h[order], start[order], code[order]
    node = np.ones(len(order), dtype=bool)
    node[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1])
    lead = np.maximum.accumulate(np.where(node, np.arange(len(order)), 0))
    later = (doc != doc[lead]) | (h != h[lead]) | (start != start[lead])
    doc, h, start = doc[later], h[later], start[later]
    order = np.lexsort((start, h, doc))
    doc, h, start = doc[order], h[order], start[order]
    if len(start):
        first = _runs(doc, h, start=start)
        yield pd.DataFrame({"doc": doc[first], "h": h[first], "start": start[first], "len": np.diff([*first, len(doc)]).astype(np.int32)})


def _identity() -> list[Column]:
    low = F.lit(-(1 << 63)).cast("long")
    return [F.coalesce(F.col("doc_id").cast("long"), low).alias("doc"), F.xxhash64("text").alias("h")]


def repeats(docs: DataFrame) -> DataFrame:
    """Repeats (doc, h, start, len): ``len`` consecutive suffixes from word ``start`` on whose
    first ``WINDOW`` words also start earlier."""
    short_batches(docs.sparkSession)
    rows = docs.filter("text IS NOT NULL").select(*_identity(), F.col("text").cast("binary").alias("raw"))
    prefixes = rows.mapInPandas(_count_prefixes, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).filter("n > 1")
    filters = docs.sparkSession.sparkContext.broadcast(_filters(prefixes))
    sent = rows.mapInPandas(_send(filters), SUFFIXES)
    return sent.repartition("key").sortWithinPartitions("key").mapInPandas(_subtrees, REPEATS)


def _cutter() -> Column:
    """Column function that removes the words of repeats from a text."""

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for raw, runs in zip(texts, starts, strict=True):
            words = [] if raw is None else raw.split()
            if runs is None or not len(runs):
                out.append((len(words), 0, b" ".join(words).decode("utf-8", "replace")))
                continue
            stay = np.ones(len(words), dtype=bool)
            for r in runs:
                stay[r["start"] : r["start"] + r["len"] + WINDOW - 1] = False
            out.append((len(words), int(len(words) - stay.sum()), b" ".join(compress(words, stay.tolist())).decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return cut


def deduplicate(docs: DataFrame, into: str = "_cut") -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_removed, and the ``kept`` text."""
    runs = repeats(docs).groupBy("doc", "h").agg(F.collect_list(F.struct("start", "len")).alias("_runs"))
    keyed = docs.select(*docs.columns, *[c.alias(f"_{n}") for c, n in zip(_identity(), ("doc", "hash"), strict=True)])
    both = keyed.join(runs.withColumnsRenamed({"doc": "_d", "h": "_h"}), (F.col("_doc") == F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
    return both.withColumn(into, _cutter()(F.col("text").cast("binary"), F.col("_runs"))).drop("_doc", "_hash", "_d", "_h", "_runs")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document row."""
    d = deduplicate(docs.select("doc_id", "text"))
    return d.select("doc_id", "_cut.n_words", "_cut.n_removed", F.sha2(F.col("_cut.kept").cast("binary"), 256).alias("kept_sha256"))
