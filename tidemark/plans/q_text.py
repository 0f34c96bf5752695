"""Queries over documents, pages, nested catalogs and work logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import bars as B
from tidemark.operators import briefing as N
from tidemark.operators import levels as V
from tidemark.operators import metrics as M
from tidemark.operators import textscan as T
from tidemark.plans import inputs as I
from tidemark.plans import ledger_data as D
from tidemark.plans.oracle import BASE_AGGS, cte, ece, finish, r, sql
from tidemark.plans.q_series import PIVOT_SQL, _closed
from tidemark.plans.registry import query, report

_c = F.col
# Words of the test languages are added so that the catalogue finds something.
TERMS = ("licen", "copyright", "http", "password", "the ", "que ")
PATTERNS = (r"[a-z0-9]+@[a-z0-9]+\.[a-z]+", r"\+?[0-9]{3}[- ][0-9]{3}")
STALE = ("The ", "Que ", "token = ")
NARRATIVES = ("Der ", "Goldman")


def _quoted(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# The last line of every seventh document gets a disclaimer that names a term.
_DISCLAIMED = " The licence is not financial advice."
cte("q_body", rf"""
SELECT doc_id, b, lower(b) AS t, regexp_replace(lower(b), '[^\n]*not financial advice[^\n]*', '', 'g') AS x FROM (
SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN text || '{_DISCLAIMED}' ELSE text END, '/\*.*?\*/', '', 'gs'), '^\s*//.*$', '', 'gm') AS b FROM documents) d
""")


def _found(kind, phrases, test):
    return f"SELECT doc_id, phrase, '{kind}' AS kind FROM (SELECT *, unnest({_quoted(phrases)}) AS phrase FROM q_body) x WHERE {test}"


@query("phrase_scan", sql(" UNION ALL ".join((
    _found("term", (*T.FORBIDDEN_TERMS, *TERMS), "contains(x, phrase)"),
    _found("pattern", (*T.CLAIM_PATTERNS, *PATTERNS), "regexp_matches(t, phrase)"),
    _found("stale", (*T.STALE_PHRASES, *STALE), "contains(b, phrase)"),
    _found("narrative", (*T.NARRATIVES, *NARRATIVES), "contains(b, phrase)")))))
def phrase_scan(spark, d):
    docs = I.table(spark, d, "documents")
    docs = docs.withColumn("text", F.when(_c("doc_id") % 7 == 0, F.concat("text", F.lit(_DISCLAIMED))).otherwise(_c("text")))
    return T.phrase_scan(docs, "doc_id", T.catalogue(spark, TERMS, PATTERNS, STALE, NARRATIVES))


WINDOW = 24


@query("digest_window_scan", sql(f"""
SELECT DISTINCT doc_id, digest FROM (SELECT doc_id, w, sha256(w) AS digest FROM (SELECT doc_id, substr(c, i, {WINDOW}) AS w FROM (
SELECT doc_id, c, unnest(generate_series(1, length(c) - {WINDOW - 1})) AS i FROM (SELECT doc_id, substr(text, f, {255 + WINDOW}) AS c FROM (
SELECT doc_id, text, unnest(generate_series(1, length(text) - {WINDOW - 1}, 256)) AS f FROM documents WHERE length(text) >= {WINDOW}) x) x2) x3) y
WHERE NOT contains(w, chr(10)) AND NOT contains(w, chr(13))) z WHERE digest IN (SELECT sha256(substr(text, 1, {WINDOW})) FROM benchmark)"""))
def digest_window_scan(spark, d):
    secrets = I.table(spark, d, "benchmark").select(F.sha2(F.substring("text", 1, WINDOW), 256).alias("digest"))
    return T.digest_window_scan(I.table(spark, d, "documents"), "doc_id", secrets, WINDOW)


# Metadata is added to the raw pages by their language path, so that each rule is met and broken.
_GOOD, _BAD = '{"@id": "https://example.com/#person"}', '{"@id": "https://example.org/#person"'


def _marked(spark, d):
    p, u = I.table(spark, d, "pages"), _c("url")
    q = '"'
    head = F.concat(
        F.when(u.contains("/fr/"), F.lit("")).otherwise(F.concat(F.lit('<link rel="canonical" href="'), F.when(u.contains("?"), F.substring_index(u, "?", 1)).otherwise(u), F.lit(q + ">"))),
        F.when(u.contains("/de/"), F.lit('<meta name="robots" content="noindex,follow"><meta http-equiv="refresh">')).otherwise(""),
        F.lit('<script type="application/ld+json">' + _GOOD + "</script>"),
        F.when(u.contains("/es/"), F.lit('<script type="application/ld+json">' + _BAD + "</script>")).otherwise(""),
        F.lit("</head>"),
    )
    return p.withColumn("html", F.replace("html", F.lit("</head>"), head))


cte("q_marks", """
SELECT page_id, url, contains(url, '/fr/') AS fr, contains(url, '/de/') AS de, contains(url, '/es/') AS es,
       CASE WHEN contains(url, '/fr/') THEN NULL ELSE split_part(url, '?', 1) END AS canonical FROM pages
""")


@query("page_audit", sql("""
SELECT page_id, url, canonical, de AS noindex, de AS refresh, CAST(CASE WHEN es THEN 2 ELSE 1 END AS BIGINT) AS ld_blocks, CAST(CASE WHEN es THEN 1 ELSE 0 END AS BIGINT) AS ld_broken,
       coalesce(canonical = url, false) AS self_canonical, CASE WHEN es THEN 'https://example.com/#person,https://example.org/#person' ELSE 'https://example.com/#person' END AS entities FROM q_marks"""))
def page_audit(spark, d):
    return T.page_audit(_marked(spark, d)).withColumn("entities", F.concat_ws(",", F.array_sort("entities")))


@query("sitemap_check", sql("""
SELECT CASE WHEN de THEN 'leak' ELSE 'missing' END AS fault, url FROM q_marks m
WHERE (de AND url IN (SELECT url FROM q_marks WHERE NOT contains(url, '?'))) OR (NOT de AND url NOT IN (SELECT url FROM q_marks WHERE NOT contains(url, '?')))"""))
def sitemap_check(spark, d):
    audit = I.settle(T.page_audit(_marked(spark, d)))
    return T.sitemap_check(audit, audit.filter(~_c("url").contains("?")))


@query("entity_split", sql("""
SELECT 'https://example.com/#person' AS entity, count(*) AS pages FROM q_marks UNION ALL SELECT 'https://example.org/#person', count(*) FROM q_marks WHERE es"""))
def entity_split(spark, d):
    return T.entity_split(T.page_audit(_marked(spark, d)))


# ── nested catalog: orders as authors; every line is a record with its work ─────
REQUIRED = ("1", "2", "3", "-1")


def _catalog(spark, d):
    li = I.table(spark, d, "lineitem")
    url = F.when(_c("l_linestatus") == "F", "https://example.com/x").otherwise("ftp://example.com/x")
    sources = F.when(_c("l_quantity") < 3, F.array().cast("array<struct<url:string>>")).otherwise(F.array(F.struct(url.alias("url"))))
    work = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), sources.alias("sources"))
    authors = I.table(spark, d, "orders").select(_c("o_orderkey").alias("l_orderkey"))
    own = li.join(authors, "l_orderkey", "left_semi").select(_c("l_orderkey").cast("string").alias("slug"), F.array(work).alias("works"))
    idle = authors.join(li, "l_orderkey", "left_anti").select(_c("l_orderkey").cast("string").alias("slug"), F.array().cast(dict(own.dtypes)["works"]).alias("works"))
    return own.unionByName(idle)


@query("catalog_integrity", sql("""
SELECT 'no_works' AS fault, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'no_source', l_orderkey || '-' || l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity < 3
UNION ALL SELECT 'source_not_http', l_orderkey || '-' || l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 3 AND l_linestatus <> 'F'
UNION ALL SELECT 'unknown_work', w FROM (SELECT l_orderkey || '-' || (l_linenumber + CASE l_returnflag WHEN 'R' THEN 10 ELSE 0 END) AS w FROM lineitem) x
  WHERE w NOT IN (SELECT l_orderkey || '-' || l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
UNION ALL SELECT 'missing_slug', s FROM (SELECT unnest(['1', '2', '3', '-1']) AS s) y WHERE s NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)"""))
def catalog_integrity(spark, d):
    shifted = _c("l_linenumber") + F.when(_c("l_returnflag") == "R", 10).otherwise(0)
    entries = I.table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", shifted).alias("work_id"))
    return N.catalog_integrity(I.settle(_catalog(spark, d)), entries, REQUIRED)


@query("worklog_rollup", sql(f"""
SELECT coalesce(o_orderstatus, 'all') AS type, coalesce(o_orderpriority, 'all') AS tool, count(*) AS entries, {r('sum(o_totalprice / 1000)', 'hours', 3)}, {r('sum(o_totalprice / 1000) * 150', 'value', 3)}
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"""))
def worklog_rollup(spark, d):
    log = I.table(spark, d, "orders").select(_c("o_orderstatus").alias("type"), _c("o_orderpriority").alias("tool"), (_c("o_totalprice") / 1000).alias("hours"))
    return report(N.worklog_rollup(log, 150.0), 3)


# ── briefing ─────────────────────────────────────────────────────────────────
DATE = "2024-01-31"


@query("briefing_passthrough", sql(f"""
SELECT 'briefing-' || s.series_id || '-2024-01-31' AS id, s.series_id, true AS levels_available, p.pivot_classic, a.n, a.n >= 20 AS display_ready, CASE WHEN a.n >= 20 THEN a.hit_rate END AS hit_rate,
       CASE WHEN a.n >= 20 THEN a.ece END AS ece, CASE WHEN a.n < 20 THEN 'accuracy withheld: only ' || a.n || ' forecasts resolved' END AS note, t.fear_greed_value, t.overall, '' AS unavailable
FROM (SELECT DISTINCT series_id FROM q_bars) s LEFT JOIN (SELECT series_id, {PIVOT_SQL} FROM q_d WHERE back = 1) p USING (series_id)
LEFT JOIN (SELECT x.*, round(e.ece, 6) + 0.0 AS ece FROM (SELECT {finish('series_id')} FROM (SELECT series_id, {BASE_AGGS} FROM q_resolved GROUP BY 1) b) x JOIN q_e e USING (series_id)) a USING (series_id)
LEFT JOIN (SELECT series_id, last(CAST(size AS INTEGER) ORDER BY ts_us, event_id) AS fear_greed_value, CASE WHEN bool_or(size > 90) THEN 'failed' ELSE 'ok' END AS overall FROM q_ticks GROUP BY 1) t USING (series_id)""",
    q_e=ece("q_resolved", "series_id")))
def briefing_passthrough(spark, d):
    t = I.ticks(spark, d)
    h, days, now = _closed(spark, d)
    last = F.struct("ts_us", "event_id")
    mood = t.groupBy("series_id").agg(F.max_by(_c("size").cast("int"), last).alias("fear_greed_value"), F.max_by("venue", last).alias("source"), F.lit("x").alias("fear_greed_label"))
    derivs = t.groupBy("series_id").agg(F.max_by("venue", last).alias("source"), F.max_by("size", last).alias("funding_rate"), F.lit(None).cast("double").alias("open_interest_btc"), F.max_by("price", last).alias("mark_price"))
    health = t.groupBy("series_id").agg(F.when(F.bool_or(_c("size") > 90), "failed").otherwise("ok").alias("overall"))
    acc = M.bucket_metrics(D.scored(spark, d), ("series_id",))
    out = N.briefing_passthrough(t.select("series_id"), DATE, health, V.key_levels(h, days, now), mood, derivs, acc)
    s = "summary."
    return report(out.select(
        "id", "series_id", _c(s + "key_levels.available").alias("levels_available"), _c(s + "key_levels.values.pivot_classic").alias("pivot_classic"), _c(s + "accuracy.n").alias("n"),
        _c(s + "accuracy.display_ready").alias("display_ready"), _c(s + "accuracy.hit_rate").alias("hit_rate"), _c(s + "accuracy.ece").alias("ece"), _c(s + "accuracy.note").alias("note"),
        _c(s + "sentiment.fear_greed_value").alias("fear_greed_value"), _c(s + "source_health.overall").alias("overall"), F.concat_ws(",", "unavailable").alias("unavailable"),
    ))
