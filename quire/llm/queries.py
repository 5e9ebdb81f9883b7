"""Registered queries of the subpackage, each over its whole table, with SQL where SQL can state it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, counts, exact, extract, lines, minhash, negatives, packing, positions, quality, repair, vectors, warc
from quire.llm.shared import ship, store


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_vectors(spark, folder):
    """Vectors linked by a cosine of 0.95, their components and the one of each that stays."""
    return vectors.near_vectors(_table(spark, folder, "embeddings"))


OP1_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id
  AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT t.vec_id, (SELECT count(*) FROM links WHERE links.a = t.vec_id) AS n_links, component_id,
  t.vec_id = component_id AS kept
FROM embeddings AS t JOIN least USING (vec_id)
"""


def op2_pack_documents(spark, folder):
    """All documents in sequences of 2,048 tokens."""
    return packing.packed(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_warc_revisits(spark, folder):
    """All pages written as archives with revisits, and the records read back."""
    return warc.round_trip(_table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to FROM q
"""


def op4_quality_scores(spark, folder):
    """All documents scored by the co-trained views, and whether they stay."""
    docs = _table(spark, folder, "documents")
    model = quality.train(docs, _table(spark, folder, "labels"))
    return quality.score(docs, model).withColumn("kept", F.col("score") >= F.lit(quality.REJECT))


def op5_bpe_round_trip(spark, folder):
    """All documents to ids of the multilingual byte-level vocabulary and back."""
    return bpe.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_exact_duplicates(spark, folder):
    """Documents equal but for white space, and the one of each group that stays."""
    return exact.mark(_table(spark, folder, "documents"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
"""


def op7_near_duplicates(spark, folder):
    """Documents whose five-word shingle sets overlap by 85 percent, and the one that stays."""
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op8_line_windows(spark, folder):
    """Documents without later occurrences of windows of three lines."""
    return lines.dedup_lines(_table(spark, folder, "documents")).select(
        "doc_id", "n_chars", F.md5("text").alias("text_md5")
    )


OP8_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS raw
  FROM documents),
s AS (SELECT doc_id, i, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l
  WHERE trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
w AS (SELECT doc_id, i, lead(i) OVER d AS i2, lead(i, 2) OVER d AS i3,
    line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS body
  FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS n FROM w WHERE i3 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM f WHERE n > 1),
t AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS text FROM l ANTI JOIN c USING (doc_id, i) GROUP BY doc_id),
r AS (SELECT d.doc_id, CASE WHEN d.doc_id NOT IN (SELECT doc_id FROM c) THEN d.text
    WHEN regexp_replace(coalesce(t.text, ''), '[ \t\r\n\x0B\f]', '', 'g') = '' THEN '' ELSE t.text END AS text,
    d.n_chars AS before, d.doc_id IN (SELECT doc_id FROM c) AS changed
  FROM documents AS d LEFT JOIN t USING (doc_id))
SELECT doc_id, CASE WHEN changed THEN length(text) ELSE before END AS n_chars, md5(text) AS text_md5 FROM r
"""


def op9_token_counts(spark, folder):
    """Token counts of all documents."""
    return counts.token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_main_text(spark, folder):
    """Main text of all pages."""
    pages = _table(spark, folder, "pages")
    return extract.extract(pages, extract.train(pages))


def op11_hard_negatives(spark, folder):
    """Hard negatives of every fiftieth vector, for each of its five nearest of the same label."""
    rows = store(negatives.prepared(negatives.relabelled(_table(spark, folder, "embeddings"))), "vectors")
    return negatives.hard_negatives(rows, rows.where("vec_id % 50 = 0"))


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""


def op12_conversation_repair(spark, folder):
    """All conversations damaged at fixed places, and the cheapest repair of each."""
    return repair.repair(repair.damage(_table(spark, folder, "conversations")))


# The checksum is worked out bit by bit; the cheapest edits row by row, the best of each state kept.
OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
c AS (SELECT *, xor(list_reduce(list_transform(string_split(place, ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda a, b: list_reduce([1, 1, 1, 1, 1, 1, 1, 1],
        lambda d, k: xor(d >> 1, CASE WHEN d % 2 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), 4294967295), 4294967295) % 20 AS f FROM t),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN f = 0 THEN 0 WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM c),
n AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS r, lag(left(role, 1)) OVER w AS p,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
k AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS kind
  FROM n),
moves AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS m(q, r, z)),
puts AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', 'user:' || chr(10)),
    (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 2, 5, 'I', 'user:' || chr(10)),
    (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 3, 5, 'I', 'assistant:' || chr(10)),
    (2, 2, 10, 'II', 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 2, 5, 'I', 'user:' || chr(10)),
    (3, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))) AS p(q, z, cost, audit, lines)),
s AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': '', 'done': ''} AS best FROM conversations
  UNION ALL
  SELECT conv_id, i, q, min(best) FROM (
    SELECT s.conv_id, k.i, s.q, {'cost': s.best.cost + 2, 'audit': s.best.audit || 'D', 'done': s.best.done} AS best
      FROM s JOIN k ON k.conv_id = s.conv_id AND k.i = s.i + 1
    UNION ALL
    SELECT s.conv_id, k.i, m.z, {'cost': s.best.cost + p.cost + CASE WHEN e.e = 'K' THEN 0 ELSE 1 END + CASE WHEN kind = 't' THEN 5 ELSE 0 END,
        'audit': s.best.audit || p.audit || e.e, 'done': s.best.done || p.lines || CASE WHEN e.e = 'K' THEN k.role WHEN m.r = 'u' THEN 'user'
        ELSE 'assistant' END || ':' || k.text || chr(10)}
      FROM s JOIN k ON k.conv_id = s.conv_id AND k.i = s.i + 1 AND k.kind IN ('k', 't') JOIN puts AS p ON p.q = s.q
      CROSS JOIN (VALUES ('K'), ('R')) AS e(e) JOIN moves AS m ON m.q = p.z AND ((e.e = 'K' AND m.r = k.r) OR (e.e = 'R' AND m.r <> 's'))
  ) AS x GROUP BY conv_id, i, q),
o AS (SELECT conv_id, min({'cost': best.cost + p.cost, 'audit': best.audit || p.audit, 'done': best.done || p.lines}) AS best
  FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS top FROM s) AS s JOIN puts AS p ON p.q = s.q AND p.z IN (0, 3)
  WHERE i = top GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'b') AS blank,
    count(*) FILTER (kind = 'd') AS duplicate, count(*) FILTER (kind = 't') AS truncated,
    count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
  sha256(CASE WHEN best.done = '' THEN '' ELSE left(best.done, -1) END) AS repaired_sha256
FROM o LEFT JOIN g USING (conv_id)
"""


def op13_benchmark_hits(spark, folder):
    """All documents against all windows of ten benchmark words."""
    return positions.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''), []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + 9) AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM g))),
m AS (SELECT doc_id, item, n, i FROM s JOIN g USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)
"""


QUERIES = {
    "op1_near_vectors": (op1_near_vectors, OP1_SQL),
    "op2_pack_documents": (op2_pack_documents, None),
    "op3_warc_revisits": (op3_warc_revisits, OP3_SQL),
    "op4_quality_scores": (op4_quality_scores, None),
    "op5_bpe_round_trip": (op5_bpe_round_trip, None),
    "op6_exact_duplicates": (op6_exact_duplicates, OP6_SQL),
    "op7_near_duplicates": (op7_near_duplicates, None),
    "op8_line_windows": (op8_line_windows, OP8_SQL),
    "op9_token_counts": (op9_token_counts, None),
    "op10_main_text": (op10_main_text, None),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_conversation_repair": (op12_conversation_repair, OP12_SQL),
    "op13_benchmark_hits": (op13_benchmark_hits, OP13_SQL),
}
