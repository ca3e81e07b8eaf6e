"""Queries of the thirteen operators, and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finquarry.llm.collocations import collocation_query
from finquarry.llm.common import table
from finquarry.llm.conversation_repair import repair_query
from finquarry.llm.embedding_dedup import embedding_links
from finquarry.llm.hmm_lm import lm_scores
from finquarry.llm.html_extract import extract_text, fit_extractor
from finquarry.llm.mixing import mix_query
from finquarry.llm.ngram_join import ngram_join
from finquarry.llm.packing import pack_documents
from finquarry.llm.pii import pii_query
from finquarry.llm.quality import quality_rules
from finquarry.llm.sharding import shard_query
from finquarry.llm.toxicity import toxicity_query
from finquarry.llm.warc import warc_query


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_query(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_extractor(pages))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_query(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_query(table(spark, sf_dir, "pages"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation_query(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_query(table(spark, sf_dir, "conversations"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_query(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_best_fit_packing, op3_pii_surrogates, op4_ngram_jaccard_join, op5_html_extraction, op6_lm_scoring, op7_source_mixing, op8_toxicity, op9_quality_rules, op10_warc, op11_phrase_collocations, op12_conversation_repair, op13_sharding)}


_REACH = """
reach(a, b) AS (SELECT id, id FROM ids UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

#: All pairs of a label, by cosine in doubles; components by reachability.
OP1_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), ids AS (SELECT vec_id AS id FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.93::DOUBLE),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON id = vec_id
"""

#: Shared 3-word shingles counted by an inverted join; components by reachability.
OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id), ids AS (SELECT doc_id AS id FROM w),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
{_REACH}
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN comp ON id = doc_id
"""

#: DuckDB has SHA-1 as hexadecimal text; five of its digits are four base32 digits.
OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * k::INT + 1, 5))::INT >> s) & 31) + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM d
"""

#: The article element, cut at block tags; inline tags go, references are decoded, white space is one space.
OP5_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1|h2|h3|ul|ol|li|div|section|blockquote)(?:\s[^>]*)?>'), lambda x:
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
  '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;', chr(39), 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a)
SELECT page_id, url, coalesce(list_aggregate(list_filter(parts, lambda x: x <> ''), 'string_agg', chr(10)), '') AS text,
  length(coalesce(list_aggregate(list_filter(parts, lambda x: x <> ''), 'string_agg', chr(10)), ''))::BIGINT AS n_chars FROM b
"""


#: All contiguous phrases counted by joins of neighbours; parts and longer phrases looked up among the frequent ones.
OP11_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS r, lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, w1, lead(w1, 1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4 FROM (SELECT lang, r, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM w) WINDOW x AS (PARTITION BY r ORDER BY i)),
f AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM (SELECT lang, 1 AS m, w1 AS g FROM o UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM o UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM o UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM o) WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
x AS MATERIALIZED (SELECT lang, m, g, f, string_split(g, ' ') AS ws FROM f WHERE m > 1),
s AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS g, max(f) AS longer FROM x, (VALUES (2), (3)) AS a(k), (VALUES (1), (2), (3)) AS b(i) WHERE m > k AND i + k - 1 <= m GROUP BY ALL),
c AS (SELECT x.lang, x.g, x.f AS a, k, array_to_string(ws[1 : k], ' ') AS gl, array_to_string(ws[k + 1 : m], ' ') AS gr FROM x JOIN (VALUES (1), (2), (3)) AS a(k) ON k < m LEFT JOIN s ON s.lang = x.lang AND s.g = x.g WHERE longer IS NULL OR 100 * longer < 80 * x.f),
b AS (SELECT c.lang, c.g AS phrase, a, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score, row_number() OVER (PARTITION BY c.lang, c.g ORDER BY 2000000::HUGEINT * a // (l.f + r.f), k) AS cut FROM c JOIN f l ON l.lang = c.lang AND l.g = gl JOIN f r ON r.lang = c.lang AND r.g = gr),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""

#: The table of CRC-32, and the checksum of a text's bytes by it.
_CRC_TABLE = "bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _crc(text: str) -> str:
    return f"xor(list_reduce(regexp_extract_all(hex(encode({text})), '..'), lambda c, b: xor(c // 256, tab[(xor(c % 256, ('0x' || b)::BIGINT) + 1)::INT]), 4294967295), 4294967295)"


#: Row by row, from each state, the cheapest and then ASCII-least edits so far, with the texts they give.
OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations, bits),
a AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM r WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text), copy) AS i, rtrim(text, {_BLANKS}) AS t FROM a),
f AS (SELECT *, CASE WHEN t = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN t[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, role[1] AS ini, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
ids AS (SELECT DISTINCT conv_id FROM conversations),
ins(st, nst, who) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
pre AS (SELECT st, st AS pos, '' AS pre, 0 AS cost, []::VARCHAR[] AS made FROM ins UNION ALL SELECT st, nst, 'I', 5, [who || ':'] FROM ins),
edits AS (SELECT st, pre || 'D' AS e, cost + 2 AS cost, made, pos AS nst, NULL::VARCHAR AS ini, NULL::VARCHAR AS who FROM pre
  UNION ALL SELECT pre.st, pre || 'K', cost, made, k.nst, k.ini, NULL::VARCHAR FROM pre JOIN (SELECT st, nst, who[1] AS ini FROM ins UNION ALL SELECT 0, 1, 's') k ON k.st = pre.pos
  UNION ALL SELECT pre.st, pre || 'R', cost + 1, made, k.nst, NULL::VARCHAR, k.who FROM pre JOIN ins k ON k.st = pre.pos),
x AS (SELECT conv_id, 0::BIGINT AS i, 0 AS st, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS p FROM ids
  UNION ALL SELECT x.conv_id, f.i, e.nst, min({{'c': p.c + e.cost + CASE WHEN fault = 3 AND e.e NOT LIKE '%D' THEN 5 ELSE 0 END, 'a': p.a || e.e,
    'r': p.r || e.made || CASE WHEN e.e LIKE '%D' THEN []::VARCHAR[] ELSE [coalesce(e.who, f.role) || ':' || f.text] END}}) FROM x JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1
    JOIN edits e ON e.st = x.st AND (e.ini IS NULL OR e.ini = f.ini) AND (f.fault IN (0, 3) OR e.e LIKE '%D') GROUP BY ALL),
z AS (SELECT x.conv_id, min({{'c': p.c + 5 * len(made), 'a': p.a || repeat('I', len(made)), 'r': p.r || made}}) AS p FROM x JOIN (VALUES (0, []::VARCHAR[]), (1, ['user:', 'assistant:']), (2, ['assistant:']), (3, []::VARCHAR[])) AS e(st, made) USING (st)
  WHERE i = (SELECT count(*) FROM f WHERE f.conv_id IS NOT DISTINCT FROM x.conv_id) GROUP BY ALL),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
  count(*) FILTER (WHERE i > 1 AND (prev || ini) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, p.c::BIGINT AS cost, p.a AS audit,
  sha256(coalesce(array_to_string(p.r, chr(10)), '')) AS repaired_sha256 FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id
"""

#: The jumps of each key as a recursion; places by window.
OP13_SQL = f"""
WITH RECURSIVE
{_CRC_TABLE},
c AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc("coalesce(text, '')")} AS crc FROM documents, bits),
h AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UHUGEINT AS k, md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size, crc)) AS lies FROM c),
j AS (SELECT r, k, 0::BIGINT AS shard, 0::BIGINT AS nxt FROM h UNION ALL
  SELECT r, k2, nxt, floor((nxt + 1)::DOUBLE * (2147483648::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE))::BIGINT FROM (SELECT r, nxt, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k2 FROM j WHERE nxt < 17)),
s AS (SELECT r, max(shard) FILTER (WHERE shard < 16) AS shard, max(shard) AS grown FROM j GROUP BY r)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY substr(lies, 1, 15), doc_id NULLS FIRST, size, crc) - 1 AS slot, grown::INT AS grown_shard FROM h JOIN s USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op5_html_extraction": OP5_SQL, "op10_warc": OP10_SQL, "op11_phrase_collocations": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_sharding": OP13_SQL}
