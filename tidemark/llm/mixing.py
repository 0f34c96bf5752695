"""Mixing sources to target weights with soft membership; DataFrame and SQL functions only.

A multinomial naive Bayes classifier learns the domains from a labelled table (a bounded sample of
its rows). A text is the set of its words, with marks for its share of symbols, of capitals and of
repeated words. A mark's likelihood in a domain is its share in all labelled texts times
(count + m) / (expected count + m), so that a rare word says little; only the ``MARKED`` marks
whose counts lie furthest beyond chance have a say. One fifth of the sample is held out of the
counts; on it the temperature and its growth with the length of a text are chosen by log loss,
since the words of a text are not independent.

Document rates r >= 0 then minimise the squared gaps between the expected tokens of each domain,
sum(r * tokens * posterior), and its target, each in relation to the domain's tokens, by accelerated
projected gradient from r = 1. In the metric of the token counts the gradient of a document is a
combination of its posterior, so a rate is a fold of its posterior over the gaps of all steps, with
the projection to r >= 0 in each step. A step aggregates cells of documents with nearly equal
posterior (at most ``GRID`` squared) to one sum per domain; only these sums reach the driver.

``realise`` turns a rate into whole copies: floor(rate + u) with u in [0, 1) from a hash of the
id, so that the expected number of copies is the rate. Texts are not moved for it.

Domains are the quality and toxicity labels: ``clean``, ``low`` and ``toxic``.

Cases: null text has no words, no tokens and the prior as posterior; labels without a document,
or with null labels, count for nothing, repeated ones as often as they occur; without labels all
documents are of the first domain; targets of zero and targets that cannot be met are allowed (the
sums reached are returned); repeated rows are judged alike; an empty table gives an empty result.
Columns of the input keep their names and values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.common import fresh
from tidemark.sources.store import settle

DOMAINS = ("clean", "low", "toxic")
#: What parts words: spaces and the marks of a sentence.
MARKS = r"[\x20\x09-\x0D.,;:!?]+"
# Signs that ordinary prose has few of, and capitals.
SIGNS, CAPITALS = "[#*$%&|<>!]", "[A-Z]"
#: Marks of the classifier, at most; deviations from chance that a mark needs, of which the best are
#: taken; places of the table in which marks are looked up, where of two the stronger stays.
MARKED, CHANCES, TABLE = 4096, (4.0, 2.0, 1.0), 1 << 14
STEPS, GRID = 60, 256
#: Labelled rows that the classifier is fitted on, at most, and the share held out for calibration.
SAMPLE, HELD_OUT = 20_000, 5
#: Occurrences added to the counted and to the expected ones.
PSEUDO = 3.0
#: Temperatures, and powers of the length (in hundreds of words) by which they grow.
HEATS, POWERS = (1.0, 1.5, 2.0, 3.0, 4.5, 7.0, 10.0, 15.0), (0.0, 0.25, 0.5)
#: What is added to the log prior of a domain.
SHIFTS = (-3.0, -2.0, -1.5, -1.0, -0.5, 0.0, 0.5)
#: Weight of each domain in the mix, and the tokens to make per token of the clean domain.
WEIGHTS = {"clean": 0.95, "low": 0.02, "toxic": 0.03}


def domain(quality: Column, toxic: Column) -> Column:
    """Number of the domain of a label, null where a label is missing."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 0)


def words(text: Column) -> Column:
    """The words of a text, without case; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), MARKS), lambda w: w != "")


def marks(found: Column, text: Column) -> Column:
    """The distinct marks of a text as numbers: its words (``found``) and three shares.

    ``found`` should be a column of its own, so that a text is cut into words once.
    """
    size, n = F.greatest(F.length(text), F.lit(1)), F.size(found)

    def share(signs: str, cells: int) -> Column:
        return F.floor(cells * F.regexp_count(text, F.lit(signs)) / size)

    numbers = F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))

    def own(distinct: Column) -> Column:
        return F.array(
            F.xxhash64(F.lit("signs"), share(SIGNS, 20)),
            F.xxhash64(F.lit("capitals"), share(CAPITALS, 10)),
            F.xxhash64(F.lit("distinct"), F.least(F.floor(F.log2(n + 1.0)), F.lit(12)), F.floor(10 * F.size(distinct) / n)),
        )

    with_shares = F.aggregate(F.array(numbers), F.expr("cast(array() as array<bigint>)"), lambda _, d: F.concat(d, own(d)))
    return F.when(n > 0, with_shares).otherwise(F.expr("cast(array() as array<bigint>)"))


class Posterior:
    """Log prior, log-likelihood ratios of marks to the first domain, and calibration."""

    def __init__(self, prior: list[float], ratio: dict[int, list[float]], heat: float = 1.0, power: float = 0.0) -> None:
        self.prior, self.ratio, self.heat, self.power = prior, ratio, heat, power

    def evidence(self, found: Column) -> Column:
        """Summed ratios of a text's marks for each domain but the first, as an array."""
        place: dict[int, int] = {}
        for mark in self.ratio:  # the strongest first
            place.setdefault(mark % TABLE, mark)
        table = [place.get(i, 0) for i in range(TABLE)]
        names = F.from_json(F.lit(str(table)), "array<bigint>")
        n = range(len(self.prior) - 1)
        values = [F.from_json(F.lit(str([self.ratio[m][k] if m in self.ratio else 0.0 for m in table])), "array<double>") for k in n]

        def at(h: Column) -> Column:
            return F.pmod(h, F.lit(TABLE)).cast("int")

        hits = F.transform(F.filter(found, lambda h: F.get(names, at(h)) == h), at)
        return F.aggregate(hits, F.array(*[F.lit(0.0)] * len(n)), lambda acc, i: F.array(*[F.get(acc, k) + F.get(values[k], i) for k in n]))

    def logs(self, evidence: Column, words: Column) -> list[Column]:
        """Log odds of each domain, up to a constant of the text."""
        cold = F.lit(self.heat) * F.pow(F.greatest(words / 100.0, F.lit(1.0)), F.lit(self.power))
        return [F.lit(self.prior[0]), *[F.lit(p) + F.get(evidence, k) / cold for k, p in enumerate(self.prior[1:])]]

    def calibrated(self, held: DataFrame) -> tuple[float, Posterior]:
        """With the temperature and the priors that suit (k, s) rows best, and its log loss there.

        Words that are absent are no evidence, so a text without telling marks has a prior of its
        own. Each pass works out the log loss of all choices at once; temperature and priors are
        chosen in turn.
        """
        scored = settle(held.select("k", F.size("s").cast("double").alias("n"), self.evidence(F.col("s")).alias("e")))
        heat, power, *prior = [F.get("c", i) for i in range(2 + len(self.prior))]
        cold = heat * F.pow(F.greatest(F.col("n") / 100.0, F.lit(1.0)), power)
        logs = F.array(prior[0], *[p + F.get("e", i) / cold for i, p in enumerate(prior[1:])])
        top = F.array_max("l")
        loss = F.log(F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top - F.get("l", F.col("k"))

        def losses(tried: list[Posterior]) -> list[float]:
            table = F.from_json(F.lit(str([[m.heat, m.power, *m.prior] for m in tried])), "array<array<double>>")
            each = scored.select("k", "n", "e", F.posexplode(table).alias("at", "c")).withColumn("l", logs)
            found = {r["at"]: r["s"] for r in each.groupBy("at").agg(F.sum(loss).alias("s")).collect()}
            return [found[i] for i in range(len(tried))] if found else []

        least, best = 0.0, self
        for turn in range(4):
            if turn % 2:
                tried = [Posterior([self.prior[0], self.prior[1] + a, self.prior[2] + b], self.ratio, best.heat, best.power) for a in SHIFTS for b in SHIFTS]
            else:
                tried = [Posterior(best.prior, self.ratio, h, p) for h in HEATS for p in POWERS]
            found = losses(tried)
            if not found:
                return least, self
            least, best = min(zip(found, tried, strict=True), key=lambda x: x[0])
        return least, best


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Posterior:
    """Fit on at most ``sample`` labelled documents, those whose ids hash lowest.

    The sample is broadcast, so that no text is shuffled for the training; at most ``MARKED``
    marks with their counts reach the driver.
    """
    known = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("k")).filter("k IS NOT NULL AND doc_id IS NOT NULL")
    share = 1.2 * sample / max(1, known.count())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    known = settle(known.withColumn("_at", F.xxhash64("doc_id")).filter(place < share * (1 << 20)).orderBy("_at", "doc_id", "k").limit(sample).drop("_at"))
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("w", words(F.col("text")))
    joined = joined.withColumn("s", marks(F.col("w"), F.col("text")))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    joined = settle(joined.select("k", "s", held.alias("held")))
    size = {r["k"]: r["n"] for r in joined.groupBy("k").agg(F.count("*").alias("n")).collect()}
    n = range(len(DOMAINS))
    # A domain without a labelled document has no members.
    prior = [math.log(size[k] / sum(size.values())) if size.get(k) else (0.0 if not size and k == 0 else -1e30) for k in n]
    seen = joined.filter("NOT held").select("k", F.explode("s").alias("s"))
    total = {r["k"]: r["n"] for r in seen.groupBy("k").agg(F.count("*").alias("n")).collect()}
    part = [total.get(k, 0) / max(1, sum(total.values())) for k in n]
    counts = seen.groupBy("s").agg(*[F.sum((F.col("k") == k).cast("int")).alias(f"c{k}") for k in n], F.count("*").alias("n"))
    beyond = F.greatest(*[F.abs(F.col(f"c{k}") - part[k] * F.col("n")) / F.sqrt(part[k] * F.col("n") + 1) for k in n])
    chosen = counts.withColumn("z", beyond).filter(F.col("z") > min(CHANCES)).orderBy(F.desc("z"), "s").limit(MARKED).collect()

    def lift(r: Row, k: int) -> float:
        return math.log((r[f"c{k}"] + PSEUDO) / (r["n"] * part[k] + PSEUDO))

    held = settle(joined.filter("held"))
    tried = [Posterior(prior, {r["s"]: [round(lift(r, k) - lift(r, 0), 5) for k in n[1:]] for r in chosen if r["z"] > z}).calibrated(held) for z in CHANCES]
    return min(tried, key=lambda x: x[0])[1]


def _posterior(logs: Column) -> Column:
    """Probabilities from log odds, both as arrays; ``logs`` should be a column of its own."""
    top = F.array_max(logs)
    whole = F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logs, lambda x: F.exp(x - top) / whole)


def scored(docs: DataFrame, model: Posterior, name: str, tokens: str) -> DataFrame:
    """``docs`` with the posterior of each row's text as the array ``name`` and its number of words;
    nothing is worked out twice."""
    cut, found, evidence, logs = (fresh(docs, f"_mix{i}") for i in range(4))
    d = docs.withColumn(cut, words(F.col("text"))).withColumn(found, marks(F.col(cut), F.col("text")))
    d = d.withColumn(evidence, model.evidence(F.col(found)))
    d = d.withColumn(logs, F.array(*model.logs(F.col(evidence), F.size(found).cast("double"))))
    return d.withColumn(name, _posterior(F.col(logs))).withColumn(tokens, F.size(cut).cast("long")).drop(cut, found, evidence, logs)


def memberships(docs: DataFrame, model: Posterior) -> DataFrame:
    """doc_id, tokens, and the posterior ``p0`` to ``p2``."""
    d = scored(docs.select("doc_id", "text"), model, "p", "tokens")
    return d.select("doc_id", "tokens", *[F.get("p", k).alias(f"p{k}") for k in range(len(DOMAINS))])


def _pace(i: int) -> float:
    """How far step i looks ahead along the step before it."""
    return (i - 1) / (i + 2) if i else 0.0


def rate_after(gaps: list[list[float]], posterior: Sequence[Column], ahead: bool = False) -> Column:
    """The rate after the projected steps of the given gaps, from 1; ``ahead``: where the next step looks."""
    now = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before"))

    def look(s: Column, pace: Column) -> Column:
        return s["r"] + pace * (s["r"] - s["before"])

    def step(s: Column, g: Column) -> Column:
        pull = sum((F.get(g, k) * p for k, p in enumerate(posterior)), F.lit(0.0))
        return F.struct(F.greatest(F.lit(0.0), look(s, F.get(g, len(posterior))) - pull).alias("r"), s["r"].alias("before"))

    if gaps:
        steps = F.from_json(F.lit(str([[*g, _pace(i)] for i, g in enumerate(gaps)])), "array<array<double>>")
        now = F.aggregate(steps, now, step)
    return look(now, F.lit(_pace(len(gaps)))) if ahead else now["r"]


def solve(members: DataFrame, weights: dict[str, float] = WEIGHTS, steps: int = STEPS) -> tuple[list[list[float]], dict]:
    """The gaps of all steps, and (target, reached) of every domain's expected tokens."""
    n = len(DOMAINS)
    grid = members.groupBy(*[F.round(F.col(f"p{k}") * GRID).cast("int").alias(f"g{k}") for k in range(n)]).agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * F.col(f"p{k}")).alias(f"s{k}") for k in range(n)])
    cells = settle(grid.filter("t > 0").select("t", *[(F.col(f"s{k}") / F.col("t")).alias(f"p{k}") for k in range(n)]).coalesce(1))
    at = [F.col(f"p{k}") for k in range(n)]

    def sums(rows: DataFrame, tokens: str, rate: Column) -> list[float]:
        rated = rows.withColumn("_rate", rate)
        return list(rated.agg(*[F.coalesce(F.sum(F.col(tokens) * p * F.col("_rate")), F.lit(0.0)) for p in at]).first())

    start = sums(cells, "t", F.lit(1.0))
    # The clean domain keeps its tokens; the others get their weights beside it.
    target = [start[0] * weights[d] / weights[DOMAINS[0]] for d in DOMAINS]
    gaps: list[list[float]] = []
    last = None
    for _ in range(steps):
        now = sums(cells, "t", rate_after(gaps, at, ahead=True))
        gaps.append([(a - b) / c if c > 0 else 0.0 for a, b, c in zip(now, target, start, strict=True)])
        if last and max(abs(a - b) / c if c > 0 else 0.0 for a, b, c in zip(now, last, start, strict=True)) < 1e-6:
            break
        last = now
    reached = sums(members, "tokens", rate_after(gaps, at))
    return gaps, {d: (target[k], reached[k]) for k, d in enumerate(DOMAINS)}


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies of a document: the rate, rounded up or down by a hash of the id."""
    u = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("long")


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> tuple[DataFrame, dict]:
    """doc_id, tokens, posterior, rate and copies of every document row; target and sum of every domain."""
    members = settle(memberships(docs, train(docs, labels)))
    gaps, reached = solve(members, weights)
    rate = rate_after(gaps, [F.col(f"p{k}") for k in range(len(DOMAINS))])
    return members.withColumn("rate", rate).withColumn("copies", copies(F.col("rate"), F.col("doc_id"))), reached


def realise(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The mixed documents: every row as often as its copies say, columns as they were.

    A row's posterior is worked out again from its text, so that nothing is joined to the texts.
    """
    model = train(docs, labels)
    gaps, _ = solve(settle(memberships(docs, model)), weights)
    p, n, times, copy = (fresh(docs, f"_{x}") for x in ("posterior", "tokens", "times", "copy"))
    rate = rate_after(gaps, [F.get(F.col(p), k) for k in range(len(DOMAINS))])
    counted = scored(docs, model, p, n).withColumn(times, copies(rate, F.col("doc_id")))
    each = F.expr(f"CASE WHEN `{times}` > 0 THEN sequence(1L, `{times}`) ELSE cast(array() as array<bigint>) END")
    return counted.withColumn(copy, F.explode(each)).select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: tokens, posterior of each domain, rate and copies."""
    r, _ = rates(docs, labels)
    return r.select("doc_id", "tokens", *[F.round(f"p{k}", 6).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], F.round("rate", 6).alias("rate"), "copies")
