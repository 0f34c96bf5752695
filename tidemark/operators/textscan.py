"""Text and page checks: phrase catalogue, digest windows, page metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Trading-advice terms and claim patterns that may not appear in published text.
FORBIDDEN_TERMS = (
    "buy",
    "sell",
    "long ",
    "short ",
    "leverage",
    "stop-loss",
    "stop loss",
    "take profit",
    "take-profit",
    "entry at",
    "exit at",
    "target price",
    "price target",
    "should buy",
    "should sell",
    "we recommend",
    "you should",
    "guaranteed",
    "risk-free",
    "trading signal",
)
# Claims about earnings, savings and value rank (regular expressions, any case).
CLAIM_PATTERNS = (
    r"uncapped|no cap\b|no ceiling|sin tope",
    r"savings vs\.? *(aws|gcp|azure)|% (projected )?savings vs|fraction of hyperscaler",
    r"ordered by value|ranked by value|value-ranked",
)
# Outdated statements (literal, with case).
STALE_PHRASES = (
    "Goldman accumulation signal",
    "Goldman Sachs institutional accumulation",
    "Goldman accumulation signals",
    "ETF inflow April week 1",
    "Clarity Act regulatory catalyst",
    "April 2026 ETF flow reversal",
    "MVRV Z-Score: 0.41",
    "$69.6M inflows first week April",
    "+0.024% — elevated but not extreme",
    "Lightning Network: capacity 5,637 BTC",
    "780 EH/s — record high",
    "Cycle day 730 post-halving",
    "F&G 38 — Fear. Retail exited positions",
    "$70K psychological resistance",
    "200 MA distance: 28%",
)
# Stories about the market that may not stand in a page as text (literal, with case).
NARRATIVES = (
    "Goldman accumulation",
    "Bull continuation 72%",
    "+8.3 pts / upgrade",
    "MVRV Z-Score 0.41",
    "ETF inflows $69.6M",
    "Powered by live market data.",
)
EXEMPT = "not financial advice"
KINDS = ("term", "pattern", "stale", "narrative")


def catalogue(spark: SparkSession, terms: Sequence[str] = (), patterns: Sequence[str] = (), stale: Sequence[str] = (), narratives: Sequence[str] = ()) -> DataFrame:
    """The built-in catalogue and more entries as a table (id, kind, phrase)."""
    own = ((*FORBIDDEN_TERMS, *terms), (*CLAIM_PATTERNS, *patterns), (*STALE_PHRASES, *stale), (*NARRATIVES, *narratives))
    rows = [(kind, phrase) for kind, phrases in zip(KINDS, own, strict=True) for phrase in phrases]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, kind string, phrase string")


def strip_comments(text: Column) -> Column:
    """Block comments and full-line ``//`` comments are not claims.

    Only what stands before the last end mark of a block is searched for blocks, so that an open
    mark without an end is never followed to the end of the text again and again.
    """
    tail = F.substring_index(text, "*/", -1)
    head = F.left(text, F.length(text) - F.length(tail))
    return F.regexp_replace(F.concat(F.regexp_replace(head, r"(?s)/\*.*?\*/", ""), tail), r"(?m)^[^\S\n]*+//.*$", "")


def without_lines(text: Column, phrase: str) -> Column:
    """The text without the lines that hold the phrase, in time linear in its length."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.contains(line, F.lit(phrase))), "\n")


def phrase_scan(docs: DataFrame, key: str, phrases: DataFrame, text: str = "text") -> DataFrame:
    """(key, phrase, kind) for every entry of the catalogue a document holds.

    The catalogue (id, kind, phrase) is a small table of rules; its entries become expressions of
    one pass over the documents, without a join. Terms and patterns ignore case, stale phrases and
    narratives do not. A line that holds the disclaimer is left out for terms, which it negates;
    the other lines of the document are still scanned.
    """
    raw = F.col(text)
    marked = F.contains(raw, F.lit("//")) | F.contains(raw, F.lit("/*"))
    body = docs.select(key, F.when(marked, strip_comments(raw)).otherwise(raw).alias("_b")).withColumn("_t", F.lower("_b"))
    exempt = F.contains("_t", F.lit(EXEMPT))
    body = body.withColumn("_x", F.when(exempt, without_lines(F.col("_t"), EXEMPT)).otherwise(F.col("_t")))
    as_written = lambda p: F.contains("_b", F.lit(p))
    tests = {"term": lambda p: F.contains("_x", F.lit(p)), "pattern": lambda p: F.col("_t").rlike(p), "stale": as_written, "narrative": as_written}
    rules = phrases.orderBy("id").collect()
    hits = [F.when(tests[r["kind"]](r["phrase"]), F.struct(F.lit(r["phrase"]).alias("phrase"), F.lit(r["kind"]).alias("kind"))) for r in rules]
    # The outer generator keeps the optimizer from repeating all tests in a filter below it.
    return body.withColumn("_h", F.array_compact(F.array(*hits))).select(key, F.inline_outer("_h")).filter("phrase IS NOT NULL")


STRIP = 32  # windows that begin in one strip


def stretches(text: str, n: int, size: int) -> Column:
    """The text in stretches of ``size`` window starts, each followed by the n - 1 characters its last window needs.

    Every n-character window without NUL, CR and LF lies in exactly one stretch, and no other window
    lies in any. One regular expression finds them, in time linear in the text's length.
    """
    sign = r"[^\x00\r\n]"
    return F.regexp_extract_all(text, F.lit(f"(?=({sign}{{{n},{size + n - 1}}})){sign}{{1,{size}}}"), F.lit(1))


def digest_window_scan(docs: DataFrame, key: str, digests: DataFrame, n: int, text: str = "text", chunk: int = 256) -> DataFrame:
    """(key, digest) where some n-character window hashes to a wanted SHA-256.

    Texts are cut into stretches of ``chunk`` window starts, which move once and are then cut into
    short strips, so that no window is searched for from far away. Windows with NUL, CR or LF lie in
    no stretch; every other window is hashed once. A 64-bit hash of its digest meets those of the
    wanted ones first, which is far cheaper than comparing digests; what agrees is then compared in
    full. Nothing is grouped before a hit. Characters count as code points (the secrets are ASCII);
    where a strip has one byte for each, its windows are cut by bytes.
    """
    pieces = docs.select(key, F.posexplode_outer(stretches(text, n, max(chunk, n))).alias("_from", "_p")).filter("_p IS NOT NULL")
    # Hashing costs far more than moving the text once: spread long documents evenly.
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(spread, key, "_from")
    strips = pieces.select(key, F.explode_outer(stretches("_p", n, max(STRIP, n))).alias("_s")).filter("_s IS NOT NULL")
    size = F.length("_s")
    strips = strips.select(key, "_s", size.alias("_n"), (F.octet_length("_s") == size).alias("_narrow"))
    windows = strips.select(key, "_s", "_narrow", F.explode_outer(F.sequence(F.lit(1), F.col("_n") - n + 1)).alias("_i")).filter("_i IS NOT NULL")
    by_bytes = F.substring(F.col("_s").cast("binary"), F.col("_i"), F.lit(n))
    by_signs = F.substring("_s", F.col("_i"), F.lit(n)).cast("binary")
    digest = F.sha2(F.when(F.col("_narrow"), by_bytes).otherwise(by_signs), 256)
    # A key that cannot be null: the join would else hash each window a second time to test for null.
    hashed = windows.select(key, F.coalesce(digest, F.lit("")).alias("digest")).withColumn("_h", F.xxhash64("digest"))
    wanted = digests.select("digest").distinct()
    near = hashed.join(wanted.select(F.xxhash64("digest").alias("_h")).distinct(), "_h", "left_semi").select(key, "digest")
    return near.join(wanted, "digest", "left_semi").distinct()


CANONICAL = r'<link rel="canonical" href="([^"]*)"'
JSON_LD = r'(?s)<script type="application/ld\+json">(.*?)</script>'
ENTITY = r'"@id": "(https?://[^"]*#[a-z]+)"'


def page_audit(pages: DataFrame, html: str = "html") -> DataFrame:
    """Metadata per page: canonical, noindex, refresh, JSON-LD blocks and how many parse."""
    h = F.col(html)
    blocks = F.regexp_extract_all(h, F.lit(JSON_LD), F.lit(1))
    broken = F.filter(blocks, lambda b: F.try_parse_json(b).isNull())
    return pages.select(
        "page_id",
        "url",
        F.nullif(F.regexp_extract(h, CANONICAL, 1), F.lit("")).alias("canonical"),
        F.contains(h, F.lit('name="robots" content="noindex')).alias("noindex"),
        F.contains(h, F.lit('http-equiv="refresh"')).alias("refresh"),
        F.size(blocks).cast("long").alias("ld_blocks"),
        F.size(broken).cast("long").alias("ld_broken"),
        F.array_distinct(F.regexp_extract_all(h, F.lit(ENTITY), F.lit(1))).alias("entities"),
    ).withColumn("self_canonical", F.coalesce(F.col("canonical") == F.col("url"), F.lit(False)))


def sitemap_check(audit: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Indexable pages missing from the sitemap, and noindex pages leaked into it."""
    listed = sitemap.select("url").distinct()
    missing = audit.filter(~F.col("noindex")).join(listed, "url", "left_anti").select(F.lit("missing").alias("fault"), "url")
    leaked = audit.filter("noindex").join(listed, "url", "left_semi").select(F.lit("leak").alias("fault"), "url")
    return missing.unionByName(leaked)


def entity_split(audit: DataFrame) -> DataFrame:
    """Entity ids with the number of pages naming them; more than one row is a split."""
    return audit.select(F.explode_outer("entities").alias("entity")).filter("entity IS NOT NULL").groupBy("entity").agg(F.count("*").alias("pages"))
