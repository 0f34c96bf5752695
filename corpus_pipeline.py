"""From raw documents to shards: language, near copies, contamination, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's documents. All but the last return the columns of ``documents``. When a
stage begins, the tables that the stage before stored for itself are deleted, unless its result was
not written and ``docs`` still reads them.

Cases: a null text has no language and goes in the first stage, as do texts without a letter; rows
without doc_id are linked with no copy and stay; rows that share an id are one document of the
second stage, of which the text that hashes lowest stays; null benchmark texts and labels without
a document count for nothing; long texts are read whole; an empty table gives an empty result; other
columns keep their names and values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, langid, mixing, sharding
from tidemark.llm.common import Filter, fresh
from tidemark.sources.store import drop, noted, settle

#: Probability below which a language is not trusted.
LEAST_SCORE = 0.5
#: Near copies: words of a shingle, and the least Jaccard similarity in percent.
COPY_WIDTH, COPY_PERCENT = 5, 80


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_STORED: list[str] = []


def stage(f: Stage) -> Stage:
    """A stage that first deletes what the stage before has stored for itself."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _STORED, docs)
        with noted() as paths:
            out = f(spark, docs, sf_dir)
        _STORED[:] = paths
        return out

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters or a clear language go."""
    known = langid.identify(docs).filter((F.col("_lang.lang") != langid.UNKNOWN) & (F.col("_lang.score") >= LEAST_SCORE))
    return known.drop("_lang")


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies (5-word Jaccard similarity of 0.8 or more).

    Texts are not moved, but for those whose id a filter of the dropped and the repeated ids lets
    through: these are looked up. Only rows that share an id are sorted.
    """
    found = jaccard.link(docs, COPY_PERCENT, COPY_WIDTH).filter("doc_id IS NOT NULL")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("first"))
    ids = settle(ids.filter("n > 1 OR first <> doc_id").select("doc_id", (F.col("first") == F.col("doc_id")).alias("stays")))
    known = Filter(ids.select(F.col("doc_id").alias("v")))

    @F.pandas_udf("boolean")
    def maybe(v: pd.Series) -> pd.Series:
        return pd.Series(known.has(v.fillna(0).astype("int64").to_numpy()))

    mark, key, stays, order = (fresh(docs, f"_{x}") for x in ("maybe", "key", "stays", "order"))
    marked = docs.withColumn(mark, F.col("doc_id").isNotNull() & maybe("doc_id"))
    looked = marked.filter(F.col(mark)).join(ids.select(F.col("doc_id").alias(key), F.col("stays").alias(stays)), F.col("doc_id") == F.col(key), "left")
    plain = looked.filter(F.col(stays).isNull())
    same = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    several = looked.filter(F.col(stays)).withColumn(order, F.row_number().over(same)).filter(F.col(order) == 1)
    parts = [marked.filter(~F.col(mark)), plain, several]
    one, *more = [p.select(docs.columns) for p in parts]
    for p in more:
        one = one.unionAll(p)
    return one


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a contaminating share of benchmark passages."""
    marked = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.filter(~decontaminate.contaminated()).drop("_marked")


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domains ask for."""
    return mixing.realise(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return sharding.digest(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]

#: Language, mixture and label propagation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
