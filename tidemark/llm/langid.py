"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are 1-, 2- and 3-grams of the lower-cased text (digits, marks and spaces count as one
boundary sign), hashed to ``DIMS`` slots. Document frequencies cover all training documents.
The weights are fitted by follow-the-regularised-leader with an elastic net, in one streaming
pass over a bounded labelled sample: at most about ``SAMPLE`` documents, spread evenly over the
languages by a hash of the id. A tenth of the sample is kept out of the fit and sets the
temperature of the softmax.

Cases: null text or text without a letter is ``und`` with score 0; null ``lang`` is never
learned; without any labelled row everything is ``und``; a null doc_id hashes as empty text;
ties go to the language that sorts first; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PIECES, pieces, short_batches, sum_vectors

DIMS = 1 << 15
SAMPLE = 8000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
# FTRL: step, smoothing, L1 and L2 weight.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def slots(text: str) -> np.ndarray:
    """Hashed n-grams of a whole text, one entry per occurrence."""
    c = np.frombuffer(f" {_OTHER.sub(' ', text.lower())} ".encode("utf-32-le"), dtype=np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    return np.concatenate([one, two, three]) >> np.uint32(32 - 15)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(slots(text), minlength=DIMS)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS x languages
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at, n = counted(text)
        x = np.log1p(n) * self.idf[at]
        x /= np.sqrt(x @ x) or 1.0
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, per coordinate, for a softmax over ``k`` classes."""

    def __init__(self, dims: int, k: int) -> None:
        self.z = np.zeros((dims, k))
        self.n = np.zeros((dims, k))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The softmax temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df = np.zeros(DIMS, dtype=np.int64)
    for batch in batches:
        for text in batch["text"]:
            df[counted(text)[0]] += 1
    yield pieces(df)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on (doc_id, text, lang) rows; every row counts in the document frequencies."""
    short_batches(labelled.sparkSession)
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(DIMS), np.zeros((DIMS, 0)), np.zeros(0), 1.0)
    n = sum(counts.values())
    idf = np.log((1 + n) / (1 + sum_vectors(rows.select("text").mapInPandas(_frequencies, PIECES), DIMS))) + 1
    each = max(1, sample // len(langs))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, each / counts[k])))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = rows.filter(draw < F.element_at(share, F.col("lang")) * (1 << 20)).withColumn("_draw", F.xxhash64("doc_id", F.lit(1)))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, kept = Ftrl(DIMS + 1, len(langs)), []
        for batch in batches:
            for text, lang, h in zip(batch["text"], batch["lang"], batch["_draw"], strict=True):
                at, c = counted(text)
                x = np.log1p(c) * idf[at]
                x = np.append(x / (np.sqrt(x @ x) or 1.0), 0.1)
                at, y = np.append(at, DIMS), langs.index(lang)
                if h % 10 == 0:
                    kept.append((at, x, y))
                else:
                    model.learn(at, x, y)
        w = model.weights()
        t = temperature(np.array([x @ w[at] for at, x, _ in kept]).reshape(len(kept), len(langs)), np.array([y for *_, y in kept], dtype=int))
        yield pd.DataFrame({"w": [w.astype(np.float64).tobytes()], "t": [t]})

    row = chosen.repartition(1).sortWithinPartitions("_draw", "doc_id").mapInPandas(train, "w binary, t double").first()
    w = np.frombuffer(row["w"], dtype=np.float64).reshape(DIMS + 1, len(langs))
    return Model(langs, idf, w[:DIMS], 0.1 * w[DIMS], row["t"])


def predictor(model: Model, spark) -> Column:
    """A column function from text to struct(lang, score); the model is DIMS x languages."""
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = shared.value
        for batch in batches:
            yield pd.DataFrame([one.predict(t) for t in batch], columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, into: str = "_lang", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with a struct ``into`` (lang, score), learned from the rows outside fold 0."""
    model = fit(docs.filter(fold(F.col("doc_id")) != 0), sample)
    return docs.withColumn(into, predictor(model, docs.sparkSession)(F.col("text").cast("string")))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document row."""
    d = identify(docs.select("doc_id", "text", "lang"))
    return d.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"))
