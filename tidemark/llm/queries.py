"""Registered queries of the corpus operators over the whole given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bitsliced, chat, decontaminate, jaccard, langid, mixing, phrases, quality, secrets, sharding, substrings, tries, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Upper-case and lower-case letters of ASCII, which the contracts fold.
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7_SQL = rf"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, ws, least(len(ws), 13) AS m FROM bw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(ws[p:p + m - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS p FROM bi)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dp AS (SELECT doc_id, m, p, array_to_string(ws[p:p + m - 1], ' ') AS t FROM (SELECT doc_id, ws, m, unnest(range(1, CAST(greatest(len(ws) - m + 2, 1) AS BIGINT))) AS p FROM dw, lens)),
occ AS (SELECT d.doc_id, d.p, d.m, w.item_id FROM dp d JOIN win w ON w.m = d.m AND w.t = d.t),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""


@query("op7_decontaminate", OP7_SQL)
def op7(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_language_id")
def op8(spark, sf_dir):
    return langid.digest(table(spark, sf_dir, "documents"))


@query("op10_shard_by_propagation")
def op10(spark, sf_dir):
    return sharding.digest(table(spark, sf_dir, "documents"))


@query("op4_warc_derivatives")
def op4(spark, sf_dir):
    return warc.digest(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\[<|\\\\]', '', 'g')) AS body, length(role) + length(regexp_replace(role, '[^\\[<|\\\\]', '', 'g')) AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(body + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 17 ELSE 11 + head END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


@query("op6_chat_format", OP6_SQL)
def op6(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    return chat.read_back(chat.format_conversations(turns))


@query("op3_quality_mcd")
def op3(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def op5(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


@query("op1_mix_to_targets")
def op1(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_jaccard_join")
def op9(spark, sf_dir):
    return jaccard.digest(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, CAST(greatest(len(ws) - 18, 1) AS BIGINT))) AS p FROM w)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS k FROM p) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM dup) GROUP BY doc_id),
q AS (SELECT doc_id, q, ws[q] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS q FROM w)),
kept AS (SELECT q.doc_id, string_agg(word, ' ' ORDER BY q.q) AS t FROM q LEFT JOIN (SELECT doc_id, unnest(qs) AS q FROM gone) g ON g.doc_id = q.doc_id AND g.q = q.q WHERE g.q IS NULL GROUP BY q.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@query("op2_substring_dedup", OP2_SQL)
def op2(spark, sf_dir):
    return substrings.digest(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, t.n, cut,
             (CAST(1000 AS HUGEINT) * cuts.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.ws[1:cut], ' ')
                JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.ws[cut + 1:], ' ') JOIN t ON t.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
m AS (SELECT lang, a, ws, k, unnest(range(2, k)) AS m FROM c WHERE k >= 3),
i AS (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS st FROM m),
h AS (SELECT lang, array_to_string(ws[st:st + m - 1], ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR h.longer < a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, cut FROM o WHERE rank <= 2000
"""


@query("op13_phrase_collocations", OP13_SQL)
def op13(spark, sf_dir):
    return phrases.digest(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH e AS (SELECT row_number() OVER () AS row, vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score FROM e q JOIN e ON e.row <> q.row AND len(e.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op12_bitsliced_topk", OP12_SQL)
def op12(spark, sf_dir):
    return bitsliced.digest(table(spark, sf_dir, "embeddings"))


# crc32 bit by bit (fixed polynomial); a node's key is the chain of its turns' digests.
OP11_SQL = """
WITH t AS (SELECT conv_id, strlen(coalesce(text, '')) AS bytes, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS lead,
             list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
                         lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
      FROM t GROUP BY conv_id),
i AS (SELECT c.conv_id, c.lead, xor(c.crc, 4294967295) % 9 AS h, least(xor(c.crc, 4294967295) % 9, coalesce(l.own, 0)) AS taken, c.own FROM c LEFT JOIN c l ON l.conv_id = c.lead),
r AS (SELECT i.conv_id, t.pos, code, bytes FROM i JOIN t ON t.conv_id = i.lead AND t.pos < i.h
      UNION ALL SELECT i.conv_id, t.pos - i.h + i.taken, code, bytes FROM i JOIN t ON t.conv_id = i.conv_id AND t.pos >= i.h),
p AS (SELECT conv_id, pos + 1 AS depth, bytes, string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM i),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes FROM p GROUP BY depth, k),
u AS (SELECT n.*, up.k AS pk, v.conv_id AS parent FROM n LEFT JOIN p up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1 LEFT JOIN n v ON v.depth = up.depth AND v.k = up.k),
kids AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS kids FROM u WHERE depth > 0 GROUP BY ALL),
s AS (SELECT p.depth, p.k, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * n.bytes) AS saved
      FROM n LEFT JOIN kids ON kids.depth = n.depth AND kids.k = n.k JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.k),
e AS (SELECT depth, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY depth, k)
SELECT u.conv_id, u.depth, u.parent AS parent_conv_id, u.n AS n_convs, coalesce(kids, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u JOIN s ON s.depth = u.depth AND s.k = u.k LEFT JOIN kids ON kids.depth = u.depth AND kids.k = u.k LEFT JOIN e ON e.depth = u.depth AND e.k = u.k
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, sf_dir):
    return tries.digest(table(spark, sf_dir, "conversations"))
