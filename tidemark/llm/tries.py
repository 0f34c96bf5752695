"""Conversation prefix trie with double arrays.

Conversations are sequences of turns; every distinct beginning of a sequence is a node. Turns are
numbered and carried as 128-bit digests, texts are not moved. Sequences are cut into bands of
``BAND`` turns, so that no row and no task holds a whole long conversation; a band is known by the
digest of all turns before it. Equal stretches of a band are counted together first.

1. Sequences of a band are parted into shards by their first turn; shards of more than ``SHARD``
   distinct sequences are parted by the first 2, 4, 8 ... turns instead. Small shards share a task.
2. A task gives the turns of its shards dense ids and packs the sequences into one double array:
   child = BASE[node] + id, valid if CHECK[child] = node. It then walks all sequences through the
   arrays for the members of each node, and back up for sums over subtrees.
3. Nodes above a shard's prefix may be in several tasks. Their members are added up globally; then
   their own share is added to the nodes above them, whose digests they carry.
4. Bands hang below the last nodes of the bands before. Their sums move up by pointer doubling, in
   as many rounds as the logarithm of the number of bands.

Cases: null turns come first, equal turns are ordered by the MD5 digest of role and text; null role
or text is empty; rows without conv_id are no conversation; repeated rows are turns of their own;
an empty table has no root and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import ranked
from tidemark.sources.store import settle

BAND, SHARD = 64, 20_000
#: Turns of one block when a conversation is numbered, and ids of one block when ends are hashed.
TURNS, IDS = 1024, 4096
# Odd multipliers that mix 64-bit words (fixed values).
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
NODES = (
    "bucket int, upper boolean, level int, ka long, kb long, pa long, pb long, depth long, conv_id long, parent long, "
    "n long, bytes long, children long, leaves long, saved long, open boolean, ea long, eb long, path array<struct<a:long,b:long>>"
)


# ── the double array ─────────────────────────────────────────────────────────
class DoubleArray:
    """BASE and CHECK over dense ids; slot 0 is the root."""

    def __init__(self) -> None:
        self.base, self.check = np.zeros(1024, dtype=np.int64), np.full(1024, -1, dtype=np.int64)
        self.check[0] = 0
        #: No slot below ``low`` is free, and none from ``end`` on is used.
        self.low = self.end = 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, dtype=np.int64))
            self.check = np.append(self.check, np.full(more, -1, dtype=np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free slots."""
        width = 4 * n + 1024
        while True:
            self._grow(self.low + width)
            free = np.flatnonzero(self.check[self.low : self.low + width] < 0)[:n] + self.low
            if len(free) == n:
                self.low = int(free[0]) if n else self.low
                return free
            width *= 2

    def add(self, parents: np.ndarray, ids: np.ndarray) -> None:
        """Children (parent slot, dense id): distinct, sorted, of parents that have none yet."""
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if len(parents) else np.array([], dtype=np.int64)
        size = np.diff(np.append(first, len(parents)))
        for at, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            codes = ids[at : at + n]
            span = codes - codes[0]
            # Any free slot may take the least id; a family that fits nowhere near goes to the end.
            start = self.end
            if n <= 1024:
                slots = self._free(64)
                self._grow(int(slots[-1] + span[-1]) + 1)
                fits = (self.check[slots[:, None] + span] < 0).all(axis=1)
                start = int(slots[fits.argmax()]) if fits.any() else start
            self._grow(start + int(span[-1]) + 1)
            self.base[parents[at]] = start - int(codes[0])
            self.check[start + span] = parents[at]
            self.end = max(self.end, start + int(span[-1]) + 1)
        alone = first[size == 1]
        if len(alone):
            slots = self._free(len(alone))
            self.base[parents[alone]] = slots - ids[alone]
            self.check[slots] = parents[alone]
            self.end = max(self.end, int(slots[-1]) + 1)

    def step(self, slots: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of nodes by dense id, -1 where there is none."""
        to = self.base[slots] + ids
        ok = (to >= 0) & (to < len(self.check))
        ok &= self.check[np.where(ok, to, 0)] == slots
        return np.where(ok & (to > 0), to, -1)


def pack(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of sequences (stretches of ``codes``), and the dense id of every code.

    Ids are dealt level by level in the order of the nodes, so that siblings lie close together.
    """
    trie = DoubleArray()
    dense = np.full(int(codes.max(initial=-1)) + 1, -1, dtype=np.int64)
    slot = np.zeros(len(start), dtype=np.int64)
    known = 0
    for level in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > level)
        here = codes[start[rows] + level]
        order = np.lexsort((here, slot[rows]))
        p, c = slot[rows][order], here[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (c[1:] != c[:-1])])
        p, c = p[new], c[new]
        unseen, first = np.unique(c[dense[c] < 0], return_index=True)
        unseen = unseen[np.argsort(first)]
        dense[unseen] = known + np.arange(len(unseen))
        known += len(unseen)
        ids = dense[c]
        order = np.lexsort((ids, p))
        trie.add(p[order], ids[order])
        slot[rows] = trie.step(slot[rows], dense[here])
    return trie, dense


def _pair_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    pairs = np.stack([a, b], axis=1).astype(np.int64).view([("a", np.int64), ("b", np.int64)])[:, 0]
    return np.unique(pairs, return_inverse=True)[1].reshape(-1)


def shard_nodes(frame: pd.DataFrame, turns: int = BAND) -> pd.DataFrame:
    """All nodes of the sequences of one task, by walking them through their double array."""
    frame = frame.reset_index(drop=True)
    size = frame["size"].to_numpy(dtype=np.int64)
    n_rows = len(frame)
    begin = np.cumsum(size) - size

    def flat(column: str) -> np.ndarray:
        return np.concatenate([np.asarray(x, dtype=np.int64) for x in frame[column]] or [np.array([], dtype=np.int64)])

    a, b, length = flat("a"), flat("b"), flat("bytes")
    ka, kb = frame["ka"].to_numpy(dtype=np.int64), frame["kb"].to_numpy(dtype=np.int64)
    # Every sequence begins with a code for its band, so that one array holds several bands.
    band_code, turn_code = _pair_ids(ka, kb), _pair_ids(a, b)
    start = np.cumsum(size + 1) - (size + 1)
    codes = np.empty(int((size + 1).sum()), dtype=np.int64)
    turn = np.ones(len(codes), dtype=bool)
    turn[start] = False
    codes[start] = band_code
    codes[turn] = turn_code + (int(band_code.max(initial=-1)) + 1)
    trie, dense = pack(codes, start, size + 1)

    top = len(trie.check)
    n, conv, nbytes = np.zeros(top, dtype=np.int64), np.full(top, np.iinfo(np.int64).max), np.zeros(top, dtype=np.int64)
    level, band, upper, is_open = np.full(top, -1), np.zeros(top, dtype=np.int64), np.zeros(top, dtype=bool), np.zeros(top, dtype=bool)
    key = np.zeros((top, 2), dtype=np.int64)
    end, ends_here = np.zeros((top, 2), dtype=np.int64), np.zeros(top, dtype=bool)
    members, least, shared = frame["n"].to_numpy(), frame["conv_id"].to_numpy(), frame["p"].to_numpy()
    more, bands, out = frame["more"].to_numpy(dtype=bool), frame["band"].to_numpy(), frame[["oa", "ob"]].to_numpy(dtype=np.int64)
    chain = np.stack([ka, kb], axis=1).view(np.uint64)
    slot = np.zeros(n_rows, dtype=np.int64)
    for j in range(int(size.max(initial=0)) + 1):
        rows = np.flatnonzero(size >= j)
        slot[rows] = trie.step(slot[rows], dense[codes[start[rows] + j]])
        s = slot[rows]
        if (s < 0).any():
            raise AssertionError("a sequence left its double array")
        np.add.at(n, s, members[rows])
        np.minimum.at(conv, s, least[rows])
        level[s], band[s], upper[s] = j, bands[rows], (j < shared[rows]) | (j == 0)
        if j:
            at = begin[rows] + j - 1
            nbytes[s] = length[at]
            for side, code in enumerate((a, b)):
                h = (chain[rows, side] + code[at].view(np.uint64)) * _MIX[side]
                chain[rows, side] = h ^ (h >> np.uint64(29))
        last = rows[size[rows] == j]
        ends_here[slot[last]], end[slot[last]] = True, out[last]
        is_open[slot[last]] |= more[last]
        key[s] = chain[rows].view(np.int64)
        if j == turns:
            key[s] = out[rows]

    nodes = np.flatnonzero(level >= 0)
    parent = trie.check[nodes]
    inner = level[nodes] > 0
    kids = np.zeros(top, dtype=np.int64)
    np.add.at(kids, parent[inner], 1)
    leaves = np.where(upper | is_open | (kids > 0), 0, 1)
    saved = np.where(upper, 0, (n - 1) * nbytes)
    for j in range(int(level.max(initial=0)), 0, -1):
        here = nodes[level[nodes] == j]
        np.add.at(leaves, trie.check[here], leaves[here])
        np.add.at(saved, trie.check[here], saved[here])
    own_kids = np.zeros(top, dtype=np.int64)
    np.add.at(own_kids, parent[inner & ~upper[nodes]], 1)

    def path(s: int) -> list[tuple[int, int]]:
        found = []
        while level[s] > 0:
            s = int(trie.check[s])
            found.append((int(key[s, 0]), int(key[s, 1])))
        return found[::-1]

    def known(values: np.ndarray, ok: np.ndarray) -> pd.api.extensions.ExtensionArray:
        return pd.arrays.IntegerArray(values.astype(np.int64), ~ok)

    inside = inner & ~upper[parent]
    keyed = np.where(inner, parent, nodes)
    return pd.DataFrame(
        {
            "bucket": int(frame["bucket"].iloc[0]),
            "upper": upper[nodes],
            "level": level[nodes],
            "ka": key[nodes, 0],
            "kb": key[nodes, 1],
            "pa": key[keyed, 0],
            "pb": key[keyed, 1],
            "depth": band[nodes] * turns + level[nodes],
            "conv_id": conv[nodes],
            "parent": known(conv[parent], inside),
            "n": n[nodes],
            "bytes": nbytes[nodes],
            "children": np.where(upper[nodes], own_kids[nodes], kids[nodes]),
            "leaves": leaves[nodes],
            "saved": saved[nodes],
            "open": is_open[nodes],
            "ea": known(end[nodes, 0], ends_here[nodes]),
            "eb": known(end[nodes, 1], ends_here[nodes]),
            "path": [path(s) if upper[s] or is_open[s] else None for s in nodes.tolist()],
        }
    )


# ── sequences ────────────────────────────────────────────────────────────────
def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), the turn's digest (``a``, ``b``) and bytes of its text; no texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("code"), F.octet_length(text).cast("long").alias("bytes")
    )
    block = F.coalesce(F.floor(F.col("turn") / TURNS).cast("long"), F.lit(-(1 << 63)))
    placed = ranked(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.col("code")], [block])

    def half(at: int) -> Column:
        return F.conv(F.substring("code", at, 16), 16, -10).cast("long")

    return placed.select("conv_id", F.col("rank").alias("pos"), half(1).alias("a"), half(17).alias("b"), "bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, pos, a, b, bytes), and (conv_id, total) of every conversation.

    A conversation begins with the first h = crc32(id) mod ``most`` turns of the first of its
    group of ``group`` ids, and goes on with its own turns after the first h.
    """
    info = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    info = info.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))).withColumn("lead", F.col("conv_id") - F.col("conv_id") % group)
    leads = info.select(F.col("conv_id").alias("lead"), F.col("own").alias("led"))
    info = info.join(leads, "lead", "left").withColumn("taken", F.least("h", F.coalesce("led", F.lit(0))))
    info = settle(info.select("conv_id", "lead", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")))
    rest = turns.join(info.drop("lead"), "conv_id").filter("pos >= h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "bytes")
    heads = turns.filter((F.col("pos") < most - 1) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "lead")
    heads = heads.join(info.select("conv_id", "lead", "h"), "lead").filter("pos < h").select("conv_id", "pos", "a", "b", "bytes")
    return heads.unionAll(rest), info.select("conv_id", "total")


def segments(turns: DataFrame, convs: DataFrame, size: int = BAND) -> DataFrame:
    """One row per conversation and band: turns in order, digests before (k) and after (o) the band."""
    rows = turns.groupBy("conv_id", F.floor(F.col("pos") / size).cast("long").alias("band")).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "bytes"))).alias("t"))
    none = convs.filter("total = 0").select("conv_id", F.lit(0).cast("long").alias("band"), F.expr("cast(array() as array<struct<pos:bigint,a:bigint,b:bigint,bytes:bigint>>)").alias("t"), "total")
    s = rows.join(convs, "conv_id").select("conv_id", "band", "t", "total").unionAll(none)
    s = s.select("conv_id", "band", "total", *[F.col(f"t.{c}").alias(c) for c in ("a", "b", "bytes")])
    s = settle(s.withColumn("sa", F.xxhash64("band", "a", "b")).withColumn("sb", F.xxhash64("b", "a", "band")))
    zero = F.lit(0).cast("long")
    short = s.filter(F.col("total") <= size).withColumn("ka", zero).withColumn("kb", zero)
    before = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    long = s.filter(F.col("total") > size)
    long = long.withColumn("ka", F.coalesce(F.bit_xor("sa").over(before), zero)).withColumn("kb", F.coalesce(F.bit_xor("sb").over(before), zero))
    both = short.unionAll(long)
    return both.withColumn("oa", F.col("ka").bitwiseXOR(F.col("sa"))).withColumn("ob", F.col("kb").bitwiseXOR(F.col("sb"))).withColumn("more", (F.col("band") + 1) * size < F.col("total"))


def _head(p: Column) -> Column:
    """The digest of the first ``p`` turns of a band."""
    return F.xxhash64("ka", "kb", F.slice("a", F.lit(1), p), F.slice("b", F.lit(1), p))


def shards(seq: DataFrame, limit: int = SHARD, size: int = BAND) -> DataFrame:
    """Distinct sequences with the length ``p`` of their shard's prefix and the task ``bucket``."""
    key = ["ka", "kb", "oa", "ob", "band"]
    first = [F.first(c).alias(c) for c in ("a", "b", "bytes")]
    distinct = seq.groupBy(*key).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("more").alias("more"), *first)
    distinct = settle(distinct.withColumn("size", F.size("a")).withColumn("p", F.lit(1)))
    p = 1
    while p < size:
        hot = settle(distinct.filter(F.col("p") == p).groupBy(_head(F.lit(p)).alias("head")).agg(F.count("*").alias("c")).filter(F.col("c") > limit).select("head", F.lit(True).alias("hot")))
        if hot.isEmpty():
            break
        marked = distinct.withColumn("head", F.when(F.col("p") == p, _head(F.lit(p)))).join(hot, "head", "left")
        distinct = settle(marked.withColumn("p", F.when(F.col("hot"), 2 * p).otherwise(F.col("p"))).drop("head", "hot"))
        p *= 2
    tasks = max(seq.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // limit))
    return distinct.withColumn("bucket", F.pmod(_head(F.col("p")), F.lit(tasks)).cast("int"))


def end_hashes(seq: DataFrame) -> DataFrame:
    """(ea, eb, sha): SHA-256 of the ids of the conversations that end at a node, in order.

    Ids are joined in blocks of a range, and a node's blocks stream through one hash in order.
    """
    last = seq.filter("NOT more").select("conv_id", F.col("oa").alias("ea"), F.col("ob").alias("eb"), F.floor(F.col("conv_id") / IDS).alias("block"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = last.groupBy("ea", "eb", "block").agg(ids.alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch["ea"].tolist(), batch["eb"].tolist(), batch["ids"], strict=True):
                if (a, b) == at:
                    h.update(b"," + ids.encode())
                    continue
                if at:
                    out.append((*at, h.hexdigest()))
                at, h = (a, b), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["ea", "eb", "sha"])
        if at:
            yield pd.DataFrame([(*at, h.hexdigest())], columns=["ea", "eb", "sha"])

    return blocks.repartition("ea", "eb").sortWithinPartitions("ea", "eb", "block").mapInPandas(run, "ea long, eb long, sha string")


# ── nodes ────────────────────────────────────────────────────────────────────
def _merge(up: DataFrame) -> DataFrame:
    """Upper nodes over all tasks; children, leaves and saved are those of single tasks below them."""
    total = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    same = [F.first(c).alias(c) for c in ("pa", "pb", "depth", "path")]
    most = [F.max(c).alias(c) for c in ("bytes", "open", "ea", "eb")]
    return settle(up.groupBy("ka", "kb", "level").agg(F.min("conv_id").alias("conv_id"), *total, *same, *most))


def _band_totals(below: DataFrame, links: DataFrame) -> DataFrame:
    """Leaves and savings below every band's first node, those of all later bands included.

    ``below`` has them within the band, ``links`` the band (``ua``, ``ub``) before each band. After
    round i a band holds what is fewer than 2 ** i bands below it.
    """
    at = settle(below.join(links, ["ka", "kb"], "left"))
    while not at.filter("ua IS NOT NULL").isEmpty():
        up = at.filter("ua IS NOT NULL").groupBy(F.col("ua").alias("ka"), F.col("ub").alias("kb")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = at.select(F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("ua").alias("va"), F.col("ub").alias("vb"))
        on = at.join(up, ["ka", "kb"], "left").join(jump, ["ua", "ub"], "left")
        at = settle(on.select("ka", "kb", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("va").alias("ua"), F.col("vb").alias("ub")))
    return at.select("ka", "kb", "leaves", "saved")


def _spread(rows: DataFrame) -> DataFrame:
    """Leaves (``l``) and savings (``s``) of rows, added up for each node of their ``path`` and themselves."""
    steps = F.concat("path", F.array(F.struct(F.col("ka").alias("a"), F.col("kb").alias("b"))))
    at = rows.select(F.posexplode(steps).alias("level", "k"), "l", "s")
    return at.groupBy(F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), "level").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))


def _plus(rows: DataFrame, more: DataFrame) -> DataFrame:
    both = rows.join(more, ["ka", "kb", "level"], "left")
    return both.withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).drop("l", "s")


def trie(turns: DataFrame, convs: DataFrame, limit: int = SHARD, size: int = BAND) -> DataFrame:
    """All nodes of the sequences: one row per node with the sums over its subtree."""
    seq = settle(segments(turns, convs, size))
    dealt = shards(seq, limit, size).select("bucket", "ka", "kb", "oa", "ob", "band", "n", "conv_id", "more", "size", "p", "a", "b", "bytes")
    nodes = settle(dealt.groupBy("bucket").applyInPandas(lambda frame: shard_nodes(frame, size), NODES))
    up, owned = nodes.filter("upper"), nodes.filter("NOT upper")

    # Upper nodes: members of all tasks, then their own share for themselves and those above.
    merged = _merge(up)
    kids = merged.filter("level > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb"), (F.col("level") - 1).alias("level")).agg(F.count("*").alias("upper_kids"))
    merged = settle(merged.join(kids, ["ka", "kb", "level"], "left").withColumn("children", F.col("children") + F.coalesce("upper_kids", F.lit(0))).drop("upper_kids"))
    leaf = ((F.col("children") == 0) & ~F.col("open")).cast("long")
    share = merged.filter("level > 0").withColumn("l", leaf).withColumn("s", (F.col("n") - 1) * F.col("bytes"))
    merged = settle(_plus(merged, _spread(share)))

    # Bands below bands: a band's first node is the last node of the band before.
    tops = merged.filter("level = 0")
    ends = nodes.filter("open").select("ka", "kb", "path").distinct()
    links = ends.select("ka", "kb", F.col("path")[0]["a"].alias("ua"), F.col("path")[0]["b"].alias("ub"))
    totals = _band_totals(tops.select("ka", "kb", "leaves", "saved"), links)
    hung = _spread(ends.join(totals, ["ka", "kb"]).withColumnRenamed("leaves", "l").withColumnRenamed("saved", "s"))
    first = tops.select("ka", "kb", F.col("children").alias("band_children"))

    def whole(rows: DataFrame) -> DataFrame:
        rows = _plus(rows, hung).join(first.withColumn("open", F.lit(True)), ["ka", "kb", "open"], "left")
        return rows.withColumn("children", F.coalesce("band_children", "children"))

    # The smallest member of a parent that a task does not know alone.
    heads = merged.filter("level > 0 OR depth = 0").select("ka", "kb", "conv_id").unionAll(owned.filter("open").select("ka", "kb", "conv_id"))
    heads = up.select("bucket", "ka", "kb").distinct().join(heads.withColumnRenamed("conv_id", "head"), ["ka", "kb"])
    heads = settle(heads.withColumnRenamed("ka", "pa").withColumnRenamed("kb", "pb"))
    found = up.filter("level > 0").join(heads, ["bucket", "pa", "pb"]).groupBy("ka", "kb", "level").agg(F.first("head").alias("parent"))
    high = whole(merged.filter("level > 0").join(found, ["ka", "kb", "level"]))
    low = whole(owned.join(heads, ["bucket", "pa", "pb"], "left").withColumn("parent", F.coalesce("parent", "head")))
    root = merged.filter("depth = 0").drop("leaves", "saved").join(totals, ["ka", "kb"]).withColumn("parent", F.lit(None).cast("long"))
    root = root.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long"))
    columns = ["conv_id", "depth", "parent", "n", "children", "leaves", "saved", "ea", "eb"]
    all_ = high.select(columns).unionAll(low.select(columns)).unionAll(root.select(columns))
    hashed = all_.join(end_hashes(seq), ["ea", "eb"], "left")
    return hashed.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def digest(conversations: DataFrame) -> DataFrame:
    """The contract: the trie of the rebuilt conversations."""
    turns = settle(numbered(conversations))
    return trie(*rebuilt(turns))
