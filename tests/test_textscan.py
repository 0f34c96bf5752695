"""Phrase catalogue: comments, disclaimers and long lines."""

import hashlib
import random
import time

from tidemark.operators import textscan as T


def found(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.phrase, r.kind) for r in T.phrase_scan(docs, "doc_id", T.catalogue(spark, **more)).collect()}


def test_kinds_case_and_disclaimers(spark):
    texts = [
        "BUY now",
        "we buy. This is not financial advice\nand leverage",
        "Goldman accumulation seen",
        "goldman ACCUMULATION",
        "Powered by live market data. Bull continuation 72%",
        None,
        "",
    ]
    assert found(spark, texts) == {
        (0, "buy", "term"),
        (1, "leverage", "term"),
        (2, "Goldman accumulation", "narrative"),
        (4, "Powered by live market data.", "narrative"),
        (4, "Bull continuation 72%", "narrative"),
    }


def test_comments_are_no_claims(spark):
    texts = ["/* buy */ x", "a\n  // buy\nb", "x // buy", "/* buy", "/* a */ buy /* sell */", "/* a /* buy */ sell", "*/ /* buy"]
    assert found(spark, texts) == {(2, "buy", "term"), (3, "buy", "term"), (4, "buy", "term"), (5, "sell", "term"), (6, "buy", "term")}


def test_long_lines_take_linear_time(spark):
    filler = "abcdefgh " * 120_000
    texts = [filler + "\nleverage\nNot financial advice", filler + " not financial advice", "/* " * 300_000, "\n" * 500_000 + "// buy", "//" + " \n" * 300_000]
    began = time.time()
    assert found(spark, texts) == {(0, "leverage", "term")}
    assert time.time() - began < 20


def test_digest_windows_equal_brute_force(spark):
    rng = random.Random(5)
    signs = "ab" * 20 + "é€😀\n\r\0"
    texts = ["".join(rng.choice(signs) for _ in range(rng.choice((0, 6, 7, 40, 300, 700)))) for _ in range(40)]
    texts += ["ab" * 400, "a€" * 200, "\n" * 50 + "abababa", "abababa\r", None, "ababab"]
    digest = lambda w: hashlib.sha256(w.encode()).hexdigest()
    windows = {(i, digest(t[k:k + 7])) for i, t in enumerate(texts) if t for k in range(len(t) - 6) if not set("\n\r\0") & set(t[k:k + 7])}
    split = {digest(t[k:k + 7]) for t in texts if t for k in range(len(t) - 6)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    secrets = spark.createDataFrame([(d,) for d in (*sorted(split), *sorted(split)[:9], None, "")], "digest string")
    for chunk in (7, 33, 256):
        got = [(r.doc_id, r.digest) for r in T.digest_window_scan(docs, "doc_id", secrets, 7, chunk=chunk).collect()]
        assert len(got) == len(windows) and set(got) == windows
    half = secrets.filter("digest < '8'")
    assert {(r.doc_id, r.digest) for r in T.digest_window_scan(docs, "doc_id", half, 7).collect()} == {w for w in windows if w[1] < "8"}


def test_each_digest_window_is_cut_and_hashed_once(spark):
    docs = spark.createDataFrame([(1, "x" * 99)], "doc_id long, text string")
    secrets = spark.createDataFrame([("0" * 64,)], "digest string")
    plan = T.digest_window_scan(docs, "doc_id", secrets, 12)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "Contains(" not in plan
