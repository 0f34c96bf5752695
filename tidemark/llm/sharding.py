"""Sharding by balanced label propagation; DataFrame operations only.

Documents of equal text are linked (null text: with none). Linked documents start evenly spread
and move, round by round, towards the shard that holds most of their group and has room; shards
that tie are told apart by a hash of group, shard and round, so that as many rows want to go one
way as the other. The quotas of the moves from shard i to j come from the table of wanted moves
(shards x shards numbers): moves go along chains that end in room, and round cycles of shards,
which need no room, so no shard ever holds more than its share. Every other round any shard that
holds part of a group may be its target, whichever holds most: that frees moves which all want
the same way. A group never reaches a shard it was not in, so the number of shards a group is in
never grows. Documents without links fill what is left, so that counts differ by at most one (law
``rows``). A group larger than a shard fills several.

Cases: repeated rows are rows of their own; null doc_id sorts first; an empty table gives an
empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import block_of, ranked
from tidemark.sources.store import settle

SHARDS = 24
#: Rounds at most; earlier end after ``STILL`` rounds in a row that did not make any group whole.
ROUNDS, STILL = 48, 6


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, checksum and group key of the text (null: not linked)."""
    text = F.col("text").cast("binary")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("_h"),
    )


def _cycles(want: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Accepted moves by (shard, to): no shard gains more than its room.

    Wanted moves are taken along the shortest chain from a move's target to room or back to its
    start, until no chain is left. Every step uses up a move or a room.
    """
    left = {pair: n for pair, n in want.items() if n > 0}
    out: dict[int, set[int]] = {}
    for i, j in left:
        out.setdefault(i, set()).add(j)
    room, quota = list(room), {}
    for first in sorted(left):
        while left.get(first):
            start, at = first
            came, queue, end = {at: None}, deque([at]), None
            while queue and end is None:
                s = queue.popleft()
                if s == start or room[s] > 0:
                    end = s
                    break
                for t in sorted(out.get(s, ())):
                    if t not in came:
                        came[t] = s
                        queue.append(t)
            if end is None:
                break
            path, s = [first], end
            while came[s] is not None:
                path.append((came[s], s))
                s = came[s]
            n = min(left[p] for p in path)
            if end != start:
                n = min(n, room[end])
                room[end] -= n
                room[start] += n
            for p in path:
                quota[p] = quota.get(p, 0) + n
                left[p] -= n
                if not left[p]:
                    del left[p]
                    out[p[0]].discard(p[1])
    return quota


def _wanted(linked: DataFrame, cap: int, shards: int, turn: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Documents with a better shard (``_to``), the accepted moves by (shard, _to) if there are any, and the parts of groups."""
    spark = linked.sparkSession
    here = settle(linked.groupBy("_g", "shard").agg(F.count("*").alias("_c"), F.first("_members").alias("_members")))
    load = {r["shard"]: r["n"] for r in here.groupBy("shard").agg(F.sum("_c").alias("n")).collect()}
    room = [max(cap - load.get(s, 0), 0) for s in range(shards)]
    free = F.array(*[F.lit(s) for s in range(shards) if room[s] > 0]).cast("array<int>")
    chance = F.xxhash64("_g", "shard", F.lit(turn))
    # In odd rounds a group that fits into a shard may go to any shard it is in.
    loose = F.lit(turn % 2 == 1) & (F.col("_members") <= cap)
    rank = F.struct(
        F.when(loose, False).otherwise(F.array_contains(free, F.col("shard"))).alias("free"), F.when(loose, F.lit(0)).otherwise(F.col("_c")).alias("c"), chance.alias("h"), F.col("shard").alias("s")
    )
    best = here.withColumn("_loose", loose).groupBy("_g").agg(F.max(rank).alias("_best"), F.count("*").alias("_shards"), F.first("_loose").alias("_loose"))
    best = best.filter("_shards > 1").select("_g", F.col("_best.s").alias("_to"), F.col("_best.c").alias("_most"), "_loose")
    going = here.drop("_members").join(best, "_g").filter((F.col("shard") != F.col("_to")) & (F.col("_loose") | (F.col("_c") <= F.col("_most"))))
    want = {(r["shard"], r["_to"]): r["n"] for r in going.groupBy("shard", "_to").agg(F.sum("_c").alias("n")).collect()}
    quota = _cycles(want, room)
    rows = [(i, j, n) for (i, j), n in quota.items()]
    table = spark.createDataFrame(rows, "shard int, _to int, _quota long") if rows else None
    return linked.join(going.select("_g", "shard", "_to"), ["_g", "shard"]), table, here.count()


def propagate(linked: DataFrame, cap: int, shards: int, n: int, rounds: int = ROUNDS) -> DataFrame:
    """Move linked documents (with ``_g`` and ``shard``) until rounds no longer bring groups together."""
    state, least, still = settle(linked), None, 0
    for turn in range(rounds):
        moves, quota, parts = _wanted(state, cap, shards, turn)
        still = 0 if least is None or parts < least else still + 1
        least = parts if least is None else min(least, parts)
        if still >= STILL:
            break
        if quota is None:
            continue
        order: list[Column] = [F.xxhash64("_g"), F.col("doc_id"), F.col("_row")]
        # Whole groups stay together in a block; one above the block size is parted by its ids.
        part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_members") / 50_000)).cast("int")
        chosen = ranked(moves, ["shard", "_to"], order, [block_of(F.col("_g"), n), part]).join(quota, ["shard", "_to"]).filter("rank < _quota")
        moved = state.join(chosen.select("_row", F.col("_to").alias("_new")), "_row", "left")
        state = settle(moved.select(*[c for c in state.columns if c != "shard"], F.coalesce("_new", "shard").alias("shard")))
    return state


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, group size, shard."""
    base = sized(docs)
    groups = base.filter("_h IS NOT NULL").groupBy("_h", "size", "text_crc32").agg(F.count("*").alias("_members"))
    joined = base.join(groups.filter("_members > 1"), ["_h", "size", "text_crc32"], "left")
    kept = settle(joined.withColumn("_row", F.monotonically_increasing_id()).withColumn("_g", F.when(F.col("_members").isNotNull(), F.xxhash64("_h", "size", "text_crc32"))))
    n = kept.count()
    cap = n // shards
    linked = kept.filter("_g IS NOT NULL").select("_row", "doc_id", "_g", "_members")
    members = linked.count()
    by_id = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_row")]
    start = ranked(linked, [], by_id, [block_of(F.col("doc_id"), members)]).withColumn("shard", F.pmod("rank", F.lit(shards)).cast("int")).drop("rank")
    placed = propagate(start, cap, shards, members, rounds) if members else start
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    single = ranked(kept.filter("_g IS NULL"), [], by_id, [block_of(F.col("doc_id"), n - members)])
    # The shards with the most linked documents take the one extra row.
    full = sorted(range(shards), key=lambda s: (-held.get(s, 0), s))
    target = {s: cap + (i < n % shards) for i, s in enumerate(full)}
    upto, chain = 0, None
    for s in range(shards):
        upto += target[s] - held.get(s, 0)
        chain = F.when(F.col("rank") < upto, s) if chain is None else chain.when(F.col("rank") < upto, s)
    rest = single.select("doc_id", "size", "text_crc32", "_members", "_row", chain.cast("int").alias("shard"))
    grouped = kept.join(placed.select("_row", "shard"), "_row").select(*rest.columns)
    return grouped.unionAll(rest)


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's columns; slots are gapless from 0 in every shard."""
    placed = settle(shard(docs, shards))
    return ranked(placed, ["shard"], [F.col("doc_id"), F.col("_row")], [block_of(F.col("doc_id"), placed.count() // shards)]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.coalesce("_members", F.lit(1)).alias("group_size")
    )
