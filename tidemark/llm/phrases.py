"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at sentence marks and line ends, and pieces into
words at spaces and tabs. Numpy prefix polynomials modulo 2 ** 64 give every word, and from the
words' numbers every n-gram, a fingerprint in one subtraction and one product, wherever it stands.

1. Three scans count fingerprints: words, pairs of frequent words, then longer phrases made of
   frequent pairs only. A task adds up its own occurrences; the shuffle holds a row
   (fingerprint, occurrences, pointer) per task and fingerprint. A pointer is 15 bits of a second,
   independent polynomial and 16 bits of the hash of a document that holds the phrase; the least
   pointer is kept, so that few documents are pointed to.
2. A fingerprint whose first and last pointer disagree in the second polynomial stands for several
   phrases: its occurrences are counted again by their words.
3. One more scan opens the pointed documents and cuts out the words of frequent phrases only.

Frequent fingerprints and pointers reach the tasks as Bloom filters sized from their number, up to
``common.MOST_BITS``; beyond it more occurrences pass a filter, and results stay the same, since counts and
pointers decide.

Cases: null text is empty, null lang is ``und``; texts without words count for nothing; a long text
is cut at piece ends, so that memory follows the longest piece; repeated rows count as often as
they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Filter, short_batches
from tidemark.sources.store import settle

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text hashed at once, and occurrences that a task adds up before it hands them on.
CHUNK, HELD = 1 << 20, 1 << 21
# What parts pieces and what parts words (fixed values of the contract).
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
# Odd bases of the polynomials over bytes and over words, and odd multipliers (fixed values).
BYTE_BASES, WORD_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: The pointer of a language's total, above all others that are used.
TOTAL = 0x7FFFFFFF
_BREAK = re.compile(b"[" + BREAKS + b"]")
_KIND = np.zeros(256, dtype=np.int8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of an odd base and of its inverse, modulo 2 ** 64."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n + 1, CHUNK + 2)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


class Polynomial:
    """Prefix polynomials of a sequence of numbers; any stretch of it has its fingerprint at once."""

    def __init__(self, numbers: np.ndarray, base: int) -> None:
        self.up, down = powers(base, len(numbers))
        self.sums = np.zeros(len(numbers) + 1, dtype=np.uint64)
        np.cumsum(numbers * down[: len(numbers)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[end]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: where they stand, their piece, their document and polynomials."""

    def __init__(self, parts: list[tuple[bytes, int, int]]) -> None:
        self.buf = b"\n".join(p[0] for p in parts).lower()
        raw = np.frombuffer(self.buf, dtype=np.uint8)
        kind = _KIND[raw]
        edge = np.diff(np.concatenate([[False], kind == 0, [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2)[self.start] if len(self.start) else self.start
        at = np.cumsum([0, *[len(p[0]) + 1 for p in parts]])
        doc = np.searchsorted(at, self.start, "right") - 1
        self.lang = np.array([p[1] for p in parts], dtype=np.uint64)[doc]
        self.doc = np.array([p[2] for p in parts], dtype=np.uint64)[doc]
        numbers = raw.astype(np.uint64) + np.uint64(1)
        self.poly = [Polynomial(mixed(Polynomial(numbers, b).of(self.start, self.end)), w) for b, w in zip(BYTE_BASES, WORD_BASES, strict=True)]

    def grams(self, n: int, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the n-grams of a piece begin, and their keys: fingerprint with language and length."""
        at = np.arange(max(0, len(self.start) - n + 1))
        at = at[self.piece[at] == self.piece[at + n - 1]]
        key = mixed(self.poly[0].of(at, at + n) + self.lang[at] * _M1 + np.uint64(n * int(_M2) % (1 << 64)))
        return at, key >> np.uint64(64 - key_bits)

    def pointers(self, at: np.ndarray, n: int) -> np.ndarray:
        """15 bits of the second polynomial above the 16 bits of the document's number; not ``TOTAL``."""
        mark = (mixed(self.poly[1].of(at, at + n)) >> np.uint64(49) << np.uint64(16)) | self.doc[at]
        return np.minimum(mark, np.uint64(TOTAL - 1))

    def phrase(self, at: int, n: int) -> str:
        return " ".join(self.buf[self.start[at + k] : self.end[at + k]].decode("utf-8", "replace") for k in range(n))


def _chunks(batches: Iterator[pd.DataFrame], only: Filter | None = None) -> Iterator[tuple[Words, dict[str, int]]]:
    """Texts in chunks of about ``CHUNK`` bytes, those whose number passes ``only``.

    A longer text is cut at ends of pieces.
    """
    held, size, langs = [], 0, {}
    for batch in batches:
        docs = np.array([0 if raw is None else xxhash.xxh3_64_intdigest(raw) >> 48 for raw in batch["raw"]], dtype=np.int64)
        wanted = np.ones(len(docs), dtype=bool) if only is None else only.has(docs)
        for raw, lang, doc, ok in zip(batch["raw"], batch["lang"], docs.tolist(), wanted, strict=True):
            if not ok or raw is None or not len(raw):
                continue
            number = langs.setdefault(lang, _number(lang))
            at = 0
            while at < len(raw):
                to = at + CHUNK
                if to < len(raw):
                    end = _BREAK.search(raw, to)
                    to = end.start() if end else len(raw)
                held.append((raw[at:to], number, doc))
                size += to - at
                at = to
                if size >= CHUNK:
                    yield Words(held), langs
                    held, size = [], 0
    if held:
        yield Words(held), langs


def _signed(v: np.ndarray) -> np.ndarray:
    return v.view(np.int64)


def _added(keys: list[np.ndarray], marks: list[np.ndarray]) -> pd.DataFrame:
    """One row per key: occurrences and least pointer; one more where the pointers disagree.

    Pointer and occurrences share a number, the pointer in its upper half.
    """
    key, mark = np.concatenate(keys), np.concatenate(marks)
    order = np.argsort(key)
    key, mark = key[order], mark[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], dtype=np.int64)
    n = np.diff(np.append(first, len(key))).astype(np.uint64)
    lo, hi = (np.minimum.reduceat(mark, first), np.maximum.reduceat(mark, first)) if len(key) else (mark, mark)
    odd = (lo >> np.uint64(16)) != (hi >> np.uint64(16))
    key = key[first]
    high = np.uint64(32)
    return pd.DataFrame({"key": _signed(np.concatenate([key, key[odd]])), "found": _signed(np.concatenate([lo << high | n, hi[odd] << high]))})


def _total_key(lang: int) -> int:
    """The key of a language's words: that of a phrase without words."""
    return int(_signed(mixed(np.array([lang], dtype=np.uint64) * _M1))[0])


def _number(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("raw"))


def _count(texts: DataFrame, orders: tuple[int, ...], parts: Filter | None, part: int, least: int, key_bits: int) -> DataFrame:
    """Keys of the given orders with ``least`` occurrences or more; all their ``part``-grams pass ``parts``.

    Without ``parts`` there is also a key for each language that counts its words.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, marks, size = [], [], 0
        total: Counter = Counter()
        for w, _ in _chunks(batches):
            good = None
            if parts is not None:
                good = np.zeros(len(w.start) + 1, dtype=np.int64)
                at, key = w.grams(part, key_bits)
                good[1:][at[parts.has(_signed(key))]] = 1
                good = np.cumsum(good)
            else:
                total.update(dict(zip(*(x.tolist() for x in np.unique(w.lang, return_counts=True)), strict=True)))
            for n in orders:
                at, key = w.grams(n, key_bits)
                if good is not None:
                    run = n - part + 1
                    ok = good[at + run] - good[at] == run
                    at, key = at[ok], key[ok]
                keys.append(key)
                marks.append(w.pointers(at, n))
                size += len(at)
            if size >= HELD:
                yield _added(keys, marks)
                keys, marks, size = [], [], 0
        if size:
            yield _added(keys, marks)
        if total:
            yield pd.DataFrame({"key": [_total_key(k) for k in total], "found": [TOTAL << 32 | c for c in total.values()]})

    # Tasks have added up their own rows: what is shuffled holds one pointer, and is added up once.
    rows = texts.mapInPandas(scan, "key long, found long").repartition("key")
    mark = F.shiftrightunsigned("found", 32)
    found = rows.groupBy("key").agg(F.sum(F.col("found").bitwiseAND(F.lit(0xFFFFFFFF))).alias("n"), F.min(mark).alias("lo"), F.max(mark).alias("hi"))
    return settle(found.filter((F.col("n") >= least) | (F.col("hi") == TOTAL)))


def _pair(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for a key and a document."""
    return _signed(mixed(key + doc * _M2))


def _cut_out(texts: DataFrame, found: DataFrame, key_bits: int) -> DataFrame:
    """Phrases (lang, phrase, words, a) of the counted keys.

    Only pointed documents are opened, and all if a key stands for several phrases.
    """
    alike = F.shiftright("lo", 16) == F.shiftright("hi", 16)
    single, several = found.filter(alike), found.filter(~alike)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"v": _pair(b["key"].to_numpy().view(np.uint64), b["doc"].to_numpy().view(np.uint64))})

    doc = F.col("lo").bitwiseAND(F.lit(0xFFFF)).alias("doc")
    opened = Filter(single.select(doc.alias("v")).distinct())
    pointed = Filter(single.select("key", doc).mapInPandas(pairs, "v long"))
    shared = Filter(several.select(F.col("key").alias("v")))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for w, langs in _chunks(batches, None if shared.size else opened):
            names = {v: k for k, v in langs.items()}
            out, counted = [], Counter()
            for n in range(1, LONGEST + 1):
                at, key = w.grams(n, key_bits)
                hit = np.flatnonzero(pointed.has(_pair(key, w.doc[at])))
                mark = _signed(w.pointers(at[hit], n)) >> 16
                for (k, m), j in {(k, m): j for j, (k, m) in enumerate(zip(_signed(key[hit]).tolist(), mark.tolist(), strict=True))}.items():
                    i = at[hit[j]]
                    out.append((k, m, names[int(w.lang[i])], w.phrase(i, n), n, 0))
                for i in np.flatnonzero(shared.has(_signed(key))) if shared.size else ():
                    counted[int(_signed(key)[i]), names[int(w.lang[at[i]])], w.phrase(at[i], n), n] += 1
            out += [(k, None, lang, p, n, c) for (k, lang, p, n), c in counted.items()]
            yield pd.DataFrame(out, columns=columns).astype({"mark": "Int64"})

    columns = ["key", "mark", "lang", "phrase", "words", "c"]
    rows = settle(texts.mapInPandas(scan, "key long, mark long, lang string, phrase string, words int, c long"))
    cut = rows.filter("mark IS NOT NULL").select("key", "mark", "lang", "phrase", "words").distinct()
    known = single.select("key", F.col("n").alias("a"), F.shiftright("lo", 16).alias("mark"))
    a = cut.join(known, ["key", "mark"]).select("lang", "phrase", "words", "a")
    again = rows.filter("mark IS NULL").join(several.select("key"), "key", "left_semi")
    b = again.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("a"))
    return a.unionAll(b)


def frequent(docs: DataFrame, least: int = LEAST, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of one to five words found ``least`` times or more,
    and (lang, n), the words of each language.

    ``key_bits`` below 64 makes collisions frequent, for tests.
    """
    short_batches(docs.sparkSession)
    texts = _texts(docs)
    words = _count(texts, (1,), None, 1, least, key_bits)
    one = words.filter(F.col("hi") != TOTAL)
    two = _count(texts, (2,), Filter(one.select(F.col("key").alias("v"))), 1, least, key_bits)
    more = _count(texts, tuple(range(3, LONGEST + 1)), Filter(two.select(F.col("key").alias("v"))), 2, least, key_bits)
    # With few key bits one key may stand for phrases of several lengths.
    found = one.unionAll(two).unionAll(more).groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    phrases = _cut_out(texts, settle(found), key_bits)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(key=[_total_key(_number(x)) for x in b["lang"]])

    langs = texts.select("lang").distinct().mapInPandas(named, "lang string, key long")
    totals = langs.join(words.filter(F.col("hi") == TOTAL).select("key", "n"), "key").select("lang", "n")
    return settle(phrases.filter(F.col("a") >= least)), settle(totals)


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, key_bits: int = 64) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score and cut."""
    phrases, totals = frequent(docs, least, key_bits)
    cand = phrases.filter("words >= 2").withColumn("ws", F.split("phrase", " "))
    size = phrases.select("lang", "phrase", "a")

    def named(part: str, count: str) -> DataFrame:
        return size.select("lang", F.col("phrase").alias(part), F.col("a").alias(count))

    cuts = cand.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("head", _joined(F.slice("ws", 1, F.col("k")))).withColumn("rest", _joined(F.slice("ws", F.col("k") + 1, F.col("words"))))
    cuts = cuts.join(named("head", "l"), ["lang", "head"]).join(named("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = "cast({} as decimal(19, 0))"
    score = F.expr(f"(({wide.format('a')} * {wide.format('n')}) * 1000) div ({wide.format('l')} * {wide.format('r')})").cast("long")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")

    # The most frequent longer candidate that holds a phrase.
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(ws, i, m), ' '))))")
    inner = cand.filter("words >= 3").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 100 * a")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("cut"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the cut that gives the score."""
    return collocations(docs.select("lang", "text"))
