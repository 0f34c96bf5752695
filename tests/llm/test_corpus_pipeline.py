"""The pipeline's stages against plain rules on a small corpus."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_corpus_ops import SCHEMA, brute_components, brute_marks, corpus, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = corpus() + [(300, prose(31, 40) + " " + prose(77, 20), "en", "src0", 1), (None, prose(55, 90), "en", "src0", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, prose(77, 20)), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 1 if i % 3 == 1 else 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_take_effect_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["language", "near_copies", "benchmark", "mixture", "shards"]

    one = corpus_pipeline.settle(named["language"](spark, docs, folder))
    ids = {r.doc_id for r in one.select("doc_id").collect()}
    assert one.columns == docs.columns and not ids & {92, 93, 94, 98} and set(range(90)) <= ids

    two = corpus_pipeline.settle(named["near_copies"](spark, one, folder))
    rows = [tuple(r) for r in one.collect() if r.doc_id is not None]
    want = {i for i, (_, root) in brute_components(rows).items() if i == root}
    got = Counter(r.doc_id for r in two.select("doc_id").collect())
    assert two.columns == docs.columns and got == Counter([*want, None])

    three = corpus_pipeline.settle(named["benchmark"](spark, two, folder))
    items = [(1, prose(77, 20)), (2, None)]
    kept = {r.doc_id for r in two.collect() if not (lambda n, h, *_: h and 20 * h >= n)(*brute_marks(r.text, items))}
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == kept and 300 not in kept

    four = corpus_pipeline.settle(named["mixture"](spark, three, folder))
    toxic = {i for i in range(60) if i % 3 == 1}
    left = {r.doc_id for r in four.collect()}
    assert four.columns == docs.columns and left <= kept and len(left & toxic) < len(kept & toxic) / 2
    assert {i for i in range(60) if i % 3 != 1} & kept <= left

    five = named["shards"](spark, four, folder)
    size = Counter(r.shard for r in five.collect())
    assert sum(size.values()) == four.count() and max(size.values()) - min(size.values() if len(size) == 24 else [0]) <= 1


def test_near_copies_by_five_words_at_080(spark, folder):
    """Copies at a 5-word similarity of 0.80 to 0.90 go, also where 3-word sets are below 0.9; at 0.78 they stay."""
    rows, kept = [], {2000, 2001}
    for k, (n, edit) in enumerate([(200, 12), (200, 17), (204, 18), (150, 8)]):
        text = prose(6000 + k, n, vocabulary=3000).split()
        copy = [*text[:60], *[f"new{k}x{j}" for j in range(edit)], *text[60 + edit :]]
        a, b = (set(zip(*[t[i:] for i in range(5)], strict=False)) for t in (text, copy))
        assert 0.80 <= len(a & b) / len(a | b) < 0.90
        rows += [(1000 + 2 * k, " ".join(text), "en", "s", 1), (1001 + 2 * k, " ".join(copy), "en", "s", 1)]
        kept.add(1000 + 2 * k)
    text = prose(6100, 200, vocabulary=3000).split()
    copy = [*text[:60], *[f"far{j}" for j in range(21)], *text[81:]]
    a, b = (set(zip(*[t[i:] for i in range(5)], strict=False)) for t in (text, copy))
    assert 0.75 < len(a & b) / len(a | b) < 0.80
    rows += [(2000, " ".join(text), "en", "s", 1), (2001, " ".join(copy), "en", "s", 1)]
    left = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder)
    assert {r.doc_id for r in left.collect()} == kept


def test_run_and_registration(spark, folder):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_on_empty_tables_and_clashing_names(spark, folder):
    """Every stage keeps the columns, whatever they are called, and an empty table stays empty."""
    names = ["_maybe", "_key", "_stays", "_order", "_mix0", "_posterior", "_tokens", "_times", "_copy"]
    rows = [(i, prose(900 + i, 70), "en", "s", 1) for i in range(6)] + [(7, prose(900, 70), "en", "s", 1), (None, prose(950, 60), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.select("*", *[F.lit(n).alias(n) for n in names])
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.settle(stage(spark, clash, folder))
        assert out.columns == clash.columns, name
        assert all(r[n] == n for r in out.collect() for n in names), name
        assert stage(spark, empty, folder).count() == 0, name
    left = corpus_pipeline.near_copies(spark, clash, folder)
    assert sorted((r.doc_id for r in left.collect()), key=str) == [0, 1, 2, 3, 4, 5, None]


def test_tables_of_a_stage_go_with_the_next_unless_they_are_read(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one = corpus_pipeline.near_copies(spark, docs, folder)
    held = list(corpus_pipeline._STORED)
    assert held
    # ``one`` was not written: what it reads must stay.
    two = corpus_pipeline.benchmark(spark, one, folder)
    assert two.count() > 0
    corpus_pipeline.language(spark, docs, folder)
    assert not set(held) & set(corpus_pipeline._STORED)
