"""The conversation trie against plain dictionaries, and its defined results for odd input."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"
CLASH = ["pos", "a", "b", "bytes", "band", "n", "ka", "level", "total", "h", "own", "lead", "rank", "_n", "bucket", "code"]


def rows():
    rng = random.Random(11)
    out = []
    for c in [*range(60), 105, 107, 333]:
        for t in range(rng.choice([1, 2, 3, 4, 5, 9, 12])):
            out.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "ok", "é", "", "go on"])))
    for c in range(200, 240):
        out += [(c, t, "user", f"same {t}") for t in range(6)]
    for c in (260, 261, 262, 263):
        out += [(c, t, "user", f"long {t % 7}") for t in range(70 + c % 3)]
    out += [(300, None, "user", "first"), (300, 0, None, None), (300, 0, "user", "x"), (300, 0, "user", "x"), (300, -5, "a", "b"), (301, 3, "user", "y")]
    out += [(None, 0, "user", "nobody"), (-10, 0, "u", "t"), (-7, 0, "u", "t"), (-7, 1, "u", "s")]
    return out


def rebuilt(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            by[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [x for _, _, x in sorted(v)] for c, v in by.items()}
    out = {}
    for c in own:
        h, lead = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        out[c] = own.get(lead, [])[:h] + own[c][h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (min(m), len(x), min(members[x[:-1]]) if x else None, len(m), kids[x], leaves[x], saved[x], hashlib.sha256(",".join(map(str, sorted(ends.get(x, [])))).encode()).hexdigest())
        for x, m in members.items()
    )


@pytest.fixture(scope="module")
def turns(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def test_digest_matches_brute_force(turns):
    got = sorted(tuple(r) for r in tries.digest(turns).collect())
    assert got == brute(rebuilt(rows()))


@pytest.mark.parametrize("limit, size", [(1, 64), (3, 4), (20_000, 1), (2, 8)])
def test_shards_and_bands_change_nothing(turns, limit, size):
    t = tries.settle(tries.numbered(turns))
    got = sorted(tuple(r) for r in tries.trie(*tries.rebuilt(t), limit, size).collect())
    assert got == brute(rebuilt(rows()))


def test_blocks_of_turns_and_ids(turns, monkeypatch):
    monkeypatch.setattr(tries, "TURNS", 2)
    monkeypatch.setattr(tries, "IDS", 3)
    assert sorted(tuple(r) for r in tries.digest(turns).collect()) == brute(rebuilt(rows()))


def test_double_array_holds_all_sequences_and_no_other():
    rng = random.Random(4)
    seqs = [[rng.randrange(50) for _ in range(rng.randrange(8))] for _ in range(3000)] + [[7, k] for k in range(3000)]
    size = np.array([len(s) for s in seqs])
    start = np.cumsum(size) - size
    trie, dense = tries.pack(np.array([c for s in seqs for c in s]), start, size)
    nodes = {tuple(s[:d]) for s in seqs for d in range(len(s) + 1)}
    slots = {}
    for s in seqs:
        at = np.zeros(1, dtype=np.int64)
        for d, c in enumerate(s):
            at = trie.step(at, dense[[c]])
            assert slots.setdefault(tuple(s[: d + 1]), int(at[0])) == at[0] >= 1
    assert len(set(slots.values())) == len(nodes) - 1 == (trie.check >= 0).sum() - 1
    assert len(trie.check) < 8 * len(nodes)
    for s in seqs[:200]:
        at = np.array([slots.get(tuple(s), 0)])
        for c in set(range(50)) & {x for x in range(50) if dense[x] >= 0}:
            assert (trie.step(at, dense[[c]])[0] >= 0) == ((*s, c) in nodes)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.digest(empty).count() == 0
    # Conversation 1 loses its only turn where h > 0 and its lead is absent.
    assert zlib.crc32(b"1") % 9 > 0
    one = spark.createDataFrame([(1, 0, "user", "gone")], SCHEMA)
    assert [tuple(r) for r in tries.digest(one).collect()] == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
