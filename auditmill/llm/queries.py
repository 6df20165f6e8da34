"""Registered queries of this subpackage over the test tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from auditmill.llm import bpe, chat, decontaminate, langid, lexical, minhash, mixing, pivots, quality, repair, sharding, topk, warc
from auditmill.llm.common import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query
def op8_byte_bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, BYTE_BPE)


@query
def op7_minhash(spark, sf_dir):
    rows = minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op7_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id"""


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = langid.train(docs.filter(~F.coalesce(held_out, F.lit(False))).select("text", "lang"), PIECES)
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return langid.identify(rows, model, PIECES).select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_warc(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to FROM m"""


@query
def op6_sharding(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)


@query
def op4_topk_search(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op4_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op10_pivot_index(spark, sf_dir):
    return pivots.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


ORACLES["op10_pivot_index"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id"""


@query
def op3_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, max_repetition=2.0).select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "epoch", "position")


@query
def op5_chat(spark, sf_dir):
    return chat.maximal_conversations(read(spark, sf_dir, "conversations"))


ORACLES["op5_chat"] = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM d),
x AS (SELECT *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS piece FROM p),
c AS (SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY place) AS whole FROM x GROUP BY conv_id),
m AS (SELECT a.conv_id FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id <> a.conv_id AND b.n >= a.n AND (b.n > a.n OR b.conv_id < a.conv_id)
      AND list_slice(b.whole, 1, a.n) = a.whole))
SELECT conv_id, place // 1024 AS part, count(*) AS n_turns, string_agg(piece, '' ORDER BY place) AS rendered FROM x JOIN m USING (conv_id) GROUP BY conv_id, place // 1024"""


@query
def op9_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, read(spark, sf_dir, "labels")).select("doc_id", "weight", "key", "selected")


@query
def op11_decontaminate(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.digests(decontaminate.contamination(docs, items, window=10, percent=100)[0])


ORACLES["op11_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS l, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: array_to_string(w[p:p + 9], ' '))) AS said FROM b WHERE len(w) > 0),
p AS MATERIALIZED (SELECT k, l, unnest(list_transform(range(1, len(w) - l + 2), lambda p: struct_pack(p := p, said := array_to_string(w[p:p + l - 1], ' ')))) AS x FROM d, (SELECT DISTINCT l FROM i) WHERE len(w) >= l),
h AS MATERIALIZED (SELECT k, x.p AS p, p.l, item_id FROM p JOIN i ON p.l = i.l AND p.x.said = i.said),
c AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + l)) AS q FROM h) GROUP BY k),
m AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.k = d.k LEFT JOIN m ON m.k = d.k"""


@query
def op13_lexical_search(spark, sf_dir):
    return lexical.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"), k=50)


ORACLES["op13_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS MATERIALIZED (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS length FROM d),
t AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS wt FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
x AS (SELECT item_id, doc_id, k, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length)))))::BIGINT AS score FROM b JOIN p USING (term) JOIN t USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, k) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""


@query
def op12_repair(spark, sf_dir):
    return repair.damage_and_repair(read(spark, sf_dir, "conversations"))


ORACLES["op12_repair"] = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 20 AS code FROM c),
g AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
       CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
       unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS again FROM k WHERE code <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(1) || text), again) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS seen FROM g),
f AS MATERIALIZED (SELECT conv_id, turn, i, role, text, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair,
       CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
moves(r, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edit AS MATERIALIZED (SELECT conv_id, i, p, q, 0 AS cost, 'K' AS letter, fault FROM f JOIN moves USING (r) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, p, q, 1, 'R', fault FROM f, moves WHERE moves.r <> 's' AND fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, p, p, 2, 'D', '' FROM f, (SELECT unnest(range(4))::INTEGER AS p)),
dp(conv_id, i, q, best) AS (SELECT conv_id, 0::BIGINT, q, struct_pack(cost := cost, audit := audit) FROM (SELECT DISTINCT conv_id FROM f), ins WHERE p = 0
  UNION ALL SELECT d.conv_id, d.i + 1, n.q, min(struct_pack(cost := d.best.cost + e.cost + CASE WHEN e.fault = 'truncated' THEN 5 ELSE 0 END + n.cost, audit := d.best.audit || e.letter || n.audit))
  FROM dp d JOIN edit e ON e.conv_id IS NOT DISTINCT FROM d.conv_id AND e.i = d.i + 1 AND e.p = d.q JOIN ins n ON n.p = e.q GROUP BY d.conv_id, d.i, n.q),
best AS MATERIALIZED (SELECT d.conv_id, min(d.best) AS b FROM dp d JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = m.n WHERE d.q IN (0, 3) GROUP BY d.conv_id),
letters AS (SELECT conv_id, unnest(string_split(b.audit, '')) AS l, unnest(range(len(b.audit))) AS pos, len(replace(b.audit, 'D', '')) % 2 AS odd FROM best WHERE b.audit <> ''),
placed AS (SELECT *, count(*) FILTER (l <> 'I') OVER w AS i, count(*) FILTER (l <> 'D') OVER w - 1 AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
said AS (SELECT p.conv_id, string_agg(CASE WHEN l = 'K' THEN f.role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY pos) AS t
  FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE l <> 'D' GROUP BY p.conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(b.cost AS BIGINT), 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM a.conv_id"""
