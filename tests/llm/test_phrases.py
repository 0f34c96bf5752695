"""Phrase mining against plain counting, and its defined results for odd input."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["key", "n", "mark", "lo", "hi", "raw", "phrase", "words", "a", "l", "r", "rank", "score", "k", "ws", "v", "c", "_t"]
UP = {c: c + 32 for c in range(65, 91)}


def rows():
    rng = random.Random(5)
    out = []
    for i in range(80):
        words = [rng.choice(["alpha", "Beta", "gamma", "delta", "É", "été", "x1"]) for _ in range(60)]
        words[20:25] = "to be or not to".split()
        words[40:43] = "New York City".split()
        text = "".join(w + rng.choice([" "] * 9 + ["\t", ", ", ".", "\n", "\x0b", "; ", "  "]) for w in words)
        out.append((i, text, ("en", "fr", None, "und")[i % 4], "s", 1))
    out += [(1, out[1][1], "fr", "s", 1)] * 3 + [(None, out[2][1], None, None, None)]
    out += [(90, None, "en", "s", 0), (91, "", None, "s", 0), (92, " .\n\t ,", "en", "s", 1), (93, "one", "zz", "s", 1), (94, "no pause " * 5000, "de", "s", 1), (95, "a b. " * 3000, "de", "s", 1)]
    return out


def brute(rows, least, top):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UP)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [v for (g, q), v in f.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if max(longer, default=0) < a:
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], k))
    return {(lang, r, p.decode(), -a, x, y, total[lang], -s, k) for lang, v in found.items() for r, (s, a, p, x, y, k) in enumerate(sorted(v)[:top], 1)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.mark.parametrize("key_bits", [64, 6])
@pytest.mark.parametrize("least, top", [(20, 2000), (40, 5)])
def test_phrases_match_brute_force(docs, key_bits, least, top):
    """With six key bits every fingerprint stands for many phrases, which the texts tell apart."""
    got = {tuple(r) for r in phrases.collocations(docs, least, top, key_bits).collect()}
    assert got == brute(rows(), least, top) and got


def test_small_chunks_and_filters_change_nothing(docs, monkeypatch):
    want = brute(rows(), 20, 2000)
    monkeypatch.setattr(phrases, "HELD", 500)
    monkeypatch.setattr(common, "MOST_BITS", 6)
    assert {tuple(r) for r in phrases.collocations(docs, 20).collect()} == want


def test_long_texts_are_cut_at_ends_of_pieces(monkeypatch):
    frame = pd.DataFrame({"raw": [r[1].encode() if r[1] is not None else None for r in rows()], "lang": "en"})

    def keys(size):
        monkeypatch.setattr(phrases, "CHUNK", size)
        chunks = [w for w, _ in phrases._chunks(iter([frame]))]
        return len(chunks), [Counter(k for w in chunks for k in w.grams(n, 64)[1].tolist()) for n in (1, 3, 5)]

    many, one = keys(100), keys(1 << 20)
    assert many[0] > 100 > one[0] and many[1] == one[1]


def test_prefix_polynomials_give_equal_stretches_equal_numbers():
    v = np.array([5, 6, 7, 1, 5, 6, 7, 2], dtype=np.uint64)
    p = phrases.Polynomial(v, phrases.BYTE_BASES[0])
    at = np.array([0, 4, 1])
    a, b, c = p.of(at, at + 3)
    assert a == b != c
    base = phrases.BYTE_BASES[0]
    assert int(a) == sum(int(x) * base ** (3 - k) for k, x in enumerate(v[:3])) % (1 << 64)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.digest(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert phrases.digest(nulls).count() == 0
    assert phrases.digest(empty).columns[:8] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
