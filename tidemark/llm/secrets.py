"""Secret scans: fixed patterns plus character Markov models; DataFrame functions only.

Fixed patterns find assignments, access keys and long hexadecimal runs. Two first-order Markov
models over characters are trained from labelled samples: random strings are the values that the
fixed patterns found, ordinary identifiers are the tokens of 12 to 19 characters. A token of at
least 20 characters whose log-likelihood ratio per character step exceeds ``CUTOFF`` is an
additional span (kind ``markov``), unless it overlaps a span of a fixed pattern.

Training counts all documents, in map-side aggregations to at most 66 x 66 cells;
only these cells reach the driver. Characters outside the token alphabet never occur in tokens.

Positions are code points. They come from splitting a text at the matches of its pattern: the
pieces and the matches alternate, so running lengths give every start.

Cases: null text is empty; a text without matches has empty spans; without any found random
string the random model is uniform; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.store import settle

# Fixed values of the contract: the patterns, and the length that a match or its value needs.
ASSIGN = (
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
BASE = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))
#: Tokens that the models judge, and the shorter ones that they learn ordinary identifiers from.
TOKEN = r"([A-Za-z0-9+/_-]{20,})"
ORDINARY = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{12,19})(?![A-Za-z0-9+/_-])"
#: Log-likelihood ratio per step, in nats, from which a token counts as random.
CUTOFF = 0.7
KINDS = ("assign", "access", "hex", "markov")
_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"
_WIDTH = 128  # cells are from * 128 + to, over ASCII codes
_SIGNS = 66
_BACK = 10.0  # weight of the single characters behind the pairs


def _prefix(a: Column) -> Column:
    """0 and the running sums of a short array of numbers."""
    return F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running(a: Column, block: int = 256) -> Column:
    """Running sums of an array: inside blocks, plus what the blocks before sum up to."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest((F.size(a) - 1) / block, F.lit(0)).cast("int")), lambda b: F.slice(a, b * block + 1, F.lit(block)))
    inner = F.transform(blocks, lambda b: F.slice(_prefix(b), F.lit(2), F.size(b)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(inner, F.slice(_prefix(sums), F.lit(1), F.size(sums)), lambda p, o: F.transform(p, lambda x: x + o)))


def spans(text: Column, pattern: str, kind: str, least: int) -> Column:
    """Spans of all leftmost, non-overlapping matches whose first group has ``least`` characters."""
    whole = F.lit(f"({pattern})")
    found = F.regexp_extract_all(text, whole, F.lit(1))
    values = F.regexp_extract_all(text, whole, F.lit(2))
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    ends = running(F.zip_with(before, found, lambda p, m: F.length(p) + F.length(m)))
    sized = F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("n"), v.alias("v")))
    all_ = F.zip_with(ends, sized, lambda e, x: F.struct((e - x["n"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), e.alias("end"), x["v"].alias("value")))
    kept = F.filter(all_, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), kept).otherwise(F.expr(f"cast(array() as {_SPAN})")).cast(_SPAN)


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans of the fixed patterns (``base``) and long tokens apart from them (``tokens``)."""
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    t = F.col("_t")
    d = d.select("doc_id", *[spans(t, p, k, n).alias(f"_{k}") for k, p, n in BASE], spans(t, TOKEN, "markov", 20).alias("_all"))
    d = d.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    apart = F.filter("_all", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return d.withColumn("tokens", F.when(F.size("_all") > 0, apart).otherwise(F.col("_all"))).drop("_all")


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.ascii(c))


def _cells(token: Column) -> Column:
    """Cells of the character pairs of a token."""
    codes = _codes(token)
    n = F.size(codes)
    return F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: a * _WIDTH + b)


def _counts(tokens: DataFrame) -> dict[int, int]:
    """Occurrences of every character pair in column ``v``; at most 66 x 66 cells."""
    good = tokens.filter(F.length("v") > 1).select(F.explode(_cells(F.col("v"))).alias("cell"))
    return {r["cell"]: r["n"] for r in good.groupBy("cell").agg(F.count("*").alias("n")).collect()}


def train(found: DataFrame, docs: DataFrame, samples: DataFrame | None = None) -> list[float]:
    """Log-likelihood ratio of random to ordinary for every pair of characters.

    ``samples`` (value string, random boolean) adds labelled samples of the caller's own.
    """
    signs = r"[^A-Za-z0-9+/_-]"
    random = _counts(found.select(F.explode("base").alias("s")).select(F.regexp_replace("s.value", signs, "").alias("v")))
    plain = _counts(docs.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(1))).alias("v")))
    both = []
    for counts, label in ((random, True), (plain, False)):
        if samples is not None:
            own = _counts(samples.filter(F.col("random") == label).select(F.regexp_replace("value", signs, "").alias("v")))
            counts = {c: counts.get(c, 0) + own.get(c, 0) for c in {*counts, *own}}
        rows: dict[int, int] = {}
        ends: dict[int, int] = {}
        for cell, n in counts.items():
            rows[cell // _WIDTH] = rows.get(cell // _WIDTH, 0) + n
            ends[cell % _WIDTH] = ends.get(cell % _WIDTH, 0) + n
        total = sum(counts.values())
        alone = [(ends.get(c, 0) + 0.5) / (total + 0.5 * _SIGNS) for c in range(_WIDTH)]
        # A pair that was never seen falls back on how common its second character is.
        both.append([math.log((counts.get(c, 0) + _BACK * alone[c % _WIDTH]) / (rows.get(c // _WIDTH, 0) + _BACK)) for c in range(_WIDTH * _WIDTH)])
    return [round(a - b, 6) for a, b in zip(*both, strict=True)]


def scan(docs: DataFrame, cutoff: float = CUTOFF, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, the spans of each fixed pattern and the random tokens (``markov``) of every text."""
    found = settle(found_spans(docs))
    ratio = F.from_json(F.lit(str(train(found, docs, samples))), "array<double>")
    score = lambda s: F.aggregate(_cells(s["value"]), F.lit(0.0), lambda acc, c: acc + F.get(ratio, c)) / (F.length(s["value"]) - 1)
    return found.withColumn("markov", F.filter("tokens", lambda s: score(s) > cutoff)).drop("tokens")


def written(found: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document row."""
    return scan(docs).select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "markov"))).alias("spans"),
    )
