"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are normalised to lower-case words and put into one suffix automaton. Each document
streams its words through it; the automaton state gives the longest piece of any item that ends
at the current word. A match of ``window`` words, or of a whole shorter item, marks its words.

Cases: null text has no words; an item without words has no window; a null item_id counts as
the empty string; equal item ids are one item; repeated document rows are judged alike; an empty
benchmark marks nothing. Columns of the input keep their names and values.

The automaton holds at most about ``block_bytes`` of item text, which bounds what is broadcast.
A larger benchmark is split into blocks (long items into pieces that overlap by a window less
one word); every block scans all documents and the marked spans are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches
from tidemark.sources.store import settle

#: Fixed by the contract: bytes that are no part of a word become spaces, A-Z lower case.
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))
RESULT = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(raw: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text; bytes above 0x7F belong to letters and stay."""
    return [] if raw is None else raw.translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton over the words of several items.

    ``step[s]`` maps a word to the next state, ``link[s]`` is the state of the longest proper
    suffix in another class, ``size[s]`` the longest string of the class. ``found[s]`` lists,
    for the strings that end here, pairs (length, item ids) of windows and short items.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._append(last, w)
        self.found: dict[int, dict[int, set[str]]] = {}
        for item, words in items:
            self._register(item, words)
        self.reach = self._inherit()

    def _state(self, size: int, step: dict[bytes, int], link: int) -> int:
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        return len(self.size) - 1

    def _append(self, last: int, w: bytes) -> int:
        known = self.step[last].get(w)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, w, known)
        new = self._state(self.size[last] + 1, {}, 0)
        at = last
        while at >= 0 and w not in self.step[at]:
            self.step[at][w] = new
            at = self.link[at]
        if at >= 0:
            target = self.step[at][w]
            self.link[new] = target if self.size[target] == self.size[at] + 1 else self._split(at, w, target)
        return new

    def _split(self, at: int, w: bytes, target: int) -> int:
        """Part the class of ``target`` so that the string through ``at`` has its own state."""
        copy = self._state(self.size[at] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.step[at].get(w) == target:
            self.step[at][w] = copy
            at = self.link[at]
        return copy

    def _register(self, item: str, words: list[bytes]) -> None:
        need = min(self.window, len(words))
        state = length = 0
        for w in words:
            state, length = self.advance(state, length, w)
            if length >= need:
                top = state
                while self.size[self.link[top]] >= need:
                    top = self.link[top]
                self.found.setdefault(top, {}).setdefault(need, set()).add(item)

    def _inherit(self) -> dict[int, list[tuple[int, frozenset[str]]]]:
        """For every state, the windows that are suffixes of its strings."""
        reach: dict[int, list[tuple[int, frozenset[str]]]] = {}
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            own = [(n, frozenset(ids)) for n, ids in sorted(self.found.get(s, {}).items())]
            if all_ := reach.get(self.link[s], []) + own:
                reach[s] = all_
        return reach

    def advance(self, state: int, length: int, w: bytes) -> tuple[int, int]:
        step, link = self.step, self.link
        while state and w not in step[state]:
            state = link[state]
            length = self.size[state]
        to = step[state].get(w)
        return (0, 0) if to is None else (to, length + 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Marked word spans (disjoint, in order, end exclusive) and the items found."""
        step, link, size, reach = self.step, self.link, self.size, self.reach
        spans: list[list[int]] = []
        items: set[str] = set()
        state = length = 0
        root = step[0]
        for i, w in enumerate(words):
            if state:
                to = step[state].get(w)
                while to is None and state:
                    state = link[state]
                    length = size[state]
                    to = step[state].get(w)
            else:
                to = root.get(w)
            if to is None:
                state = length = 0
                continue
            state = to
            length += 1
            if state in reach:
                most = 0
                for n, ids in reach[state]:
                    if n <= length:
                        items |= ids
                        most = max(most, n)
                if most:
                    start = i + 1 - most
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([start, i + 1])
        return [(a, b) for a, b in spans], items


def _pieces(items: DataFrame, window: int, piece_words: int) -> DataFrame:
    """Items as (item_id string, words binary), long ones cut with an overlap of window - 1."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, raw in zip(batch["item_id"], batch["text"], strict=True):
                words = words_of(raw)
                step = piece_words - window + 1
                starts = range(0, max(1, len(words) - window + 1), step) if words else ()
                out += [(item, b" ".join(words[s : s + piece_words])) for s in starts]
            yield pd.DataFrame(out, columns=["item_id", "words"])

    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")).mapInPandas(cut, "item_id string, words binary")


def _scanner(items: list, window: int, spark) -> Column:
    automaton = ItemAutomaton([(r["item_id"], bytes(r["words"]).split()) for r in items], window)
    shared = spark.sparkContext.broadcast(automaton)

    @F.pandas_udf(RESULT)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = shared.value
        for batch in texts:
            out = []
            for raw in batch:
                words = words_of(raw)
                spans, found = one.scan(words)
                out.append((len(words), [{"start": a, "end": b} for a, b in spans], sorted(found)))
            yield pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return scan


def mark(docs: DataFrame, items: DataFrame, window: int = 13, block_bytes: int = 2_000_000, into: str = "_marked") -> DataFrame:
    """``docs`` with a struct ``into``: n_words, marked ``spans`` of words, ``items`` found."""
    short_batches(docs.sparkSession)
    pieces = settle(_pieces(items, window, max(2 * window, block_bytes // 64)))
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    text = F.col("text").cast("binary")
    if blocks == 1:
        return docs.withColumn(into, _scanner(pieces.collect(), window, docs.sparkSession)(text))
    row = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text")]
    found = None
    for b in range(blocks):
        part = pieces.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).collect()
        hits = docs.select(*row, _scanner(part, window, docs.sparkSession)(text).alias("_m")).filter(F.size("_m.spans") > 0)
        found = settle(hits) if found is None else found.unionAll(settle(hits))
    united = found.groupBy("_id", "_text").agg(F.flatten(F.collect_set("_m.spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_m.items")))).alias("_items"))
    merged = united.select(F.col("_id").alias("_mid"), F.col("_text").alias("_mtext"), _union_spans()(F.col("_spans")).alias("_spans"), "_items")
    none = _scanner([], window, docs.sparkSession)(text)
    with_words = docs.withColumn("_none", none).withColumn("_key", F.xxhash64("text"))
    joined = with_words.join(merged, with_words["doc_id"].eqNullSafe(merged["_mid"]) & (with_words["_key"] == merged["_mtext"]), "left")
    kept = F.struct(F.col("_none.n_words").alias("n_words"), F.coalesce("_spans", "_none.spans").alias("spans"), F.coalesce("_items", "_none.items").alias("items"))
    return joined.withColumn(into, kept).drop("_none", "_key", "_mid", "_mtext", "_spans", "_items")


def _union_spans() -> Column:
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def unite(batch: pd.Series) -> pd.Series:
        out = []
        for spans in batch:
            row: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in spans):
                if row and a <= row[-1][1]:
                    row[-1][1] = max(b, row[-1][1])
                else:
                    row.append([a, b])
            out.append([{"start": a, "end": b} for a, b in row])
        return pd.Series(out)

    return unite


def n_hit(marked: str = "_marked") -> Column:
    """Number of words inside the spans of a marked column."""
    return F.aggregate(F.col(f"{marked}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(marked: str = "_marked", share: int = 20) -> Column:
    """True where the marked words are at least one in ``share`` of the document's words."""
    return (n_hit(marked) > 0) & (n_hit(marked) * share >= F.col(f"{marked}.n_words"))


def digest(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """The contract's columns, one row per document row."""
    m = mark(docs.select("doc_id", "text"), items, window)
    return m.select(
        "doc_id",
        F.col("_marked.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("_marked.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_marked.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
