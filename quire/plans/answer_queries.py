"""Queries over tokens, features, retrieval and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import STOP_WORDS, dense_vector, hash_features, l2_normalize, tokens
from quire.operators import chunking, index, retrieval
from quire.plans.chunk_queries import chunks_sql
from quire.sources import fixtures as fx
from quire.sources.scratch import scratch_folder
from quire.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9'']+'), lambda w: w NOT IN (" + _STOP + "))"


def features_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs ending in ``name(key, b, w)``: normalised features of a text column."""
    return f"""{name}_tok AS (SELECT {key}, unnest({TOKENS.format(text)}) AS t FROM {source}),
{name}_cnt AS (SELECT {key}, t, count(*) AS n, ('0x' || substr(md5(t), 1, 8))::UBIGINT AS h FROM {name}_tok GROUP BY {key}, t),
{name}_raw AS (SELECT {key}, CAST(h % 512 AS INT) AS b,
    sum(CASE WHEN h >= 2147483648 THEN 1.0 ELSE -1.0 END * (1 + ln(n))) AS w FROM {name}_cnt GROUP BY {key}, h % 512),
{name} AS (SELECT {key}, b, w / CASE WHEN norm = 0 THEN 1 ELSE norm END AS w
  FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY {key})) AS norm FROM {name}_raw))"""


def questions(spark, folder):
    """Every benchmark text as a question; some empty of content, some unknown."""
    return table(spark, folder, "benchmark").selectExpr(
        "item_id AS query_id",
        "CASE WHEN item_id % 10 = 9 THEN 'What of the and?' "
        "WHEN item_id % 10 = 8 THEN concat('qqzx', item_id, ' vvkq') ELSE text END AS question",
    )


QUESTIONS = """questions AS (
  SELECT item_id AS query_id, CASE WHEN item_id % 10 = 9 THEN 'What of the and?'
    WHEN item_id % 10 = 8 THEN 'qqzx' || item_id || ' vvkq' ELSE text END AS question FROM benchmark)"""


def answers(spark, folder):
    """What a model might have said: some decline, some cite badly or nothing."""
    return table(spark, folder, "benchmark").where("item_id % 8 <> 7").selectExpr(
        "item_id AS query_id",
        "item_id % 3 <> 0 AS found",
        "CASE WHEN item_id % 4 = 0 THEN '' ELSE concat('reply ', item_id) END AS answer",
        "CASE WHEN item_id % 5 = 0 THEN cast(array() AS array<double>) "
        "WHEN item_id % 7 = 0 THEN array(99.0D, -1.0D, 0.5D) "
        "ELSE array(double(item_id % 4), 0.0D, double(item_id % 4), 1.5D, 99.0D, 1.0D) END AS citations",
    )


def _chunks(spark, folder):
    return chunking.chunk_documents(fx.corpus(spark, folder))


def token_rows(spark, folder):
    return retrieval.token_rows(table(spark, folder, "documents"), "doc_id", "text").selectExpr(
        "doc_id", "bigint(pos) AS pos", "token"
    )


def hash_features_q(spark, folder):
    f = hash_features(tokens(F.col("text")))
    return table(spark, folder, "documents").select("doc_id", F.inline(f)).select(
        "doc_id", "bucket", F.round("weight", 6).alias("weight")
    )


def l2_normalize_q(spark, folder):
    f = l2_normalize(hash_features(tokens(F.col("text"))))
    return _chunks(spark, folder).select("chunk_id", F.inline(f)).select(
        "chunk_id", "bucket", F.round("weight", 6).alias("weight")
    )


def dense_vectors(spark, folder):
    f = dense_vector(l2_normalize(hash_features(tokens(F.col("text")))))
    return table(spark, folder, "benchmark").select(
        "item_id", F.posexplode(f).alias("bucket", "weight")
    ).select("item_id", "bucket", F.round("weight", 6).alias("weight"))


def top_k(spark, folder):
    hits = retrieval.top_k(_chunks(spark, folder), questions(spark, folder))
    return hits.selectExpr("query_id", "chunk_id", "bigint(rank) AS rank", "round(score, 6) AS score")


def document_questions(spark, folder):
    """The whole text of every twentieth document as a question."""
    return table(spark, folder, "documents").where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "text AS question")


def index_top_k(spark, folder):
    built = index.build(_chunks(spark, folder), scratch_folder(spark))
    hits = index.index_top_k(built, document_questions(spark, folder))
    return hits.selectExpr("query_id", "chunk_id", "bigint(rank) AS rank", "round(score, 6) AS score")


def top_k_selected(spark, folder):
    picked = table(spark, folder, "labels").where("quality = 1")
    hits = retrieval.top_k(_chunks(spark, folder), questions(spark, folder), k=4, doc_ids=picked)
    return hits.selectExpr("query_id", "chunk_id", "bigint(rank) AS rank", "round(score, 6) AS score")


def dense_top_k(spark, folder):
    """Nearest vectors of every label's first vector."""
    vectors = table(spark, folder, "embeddings")
    firsts = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    hits = retrieval.dense_top_k(vectors, firsts.withColumnRenamed("label", "query_id"))
    return hits.selectExpr(
        "query_id", "vec_id", "bigint(rank) AS rank", "round(score, 5) AS score", "relevant"
    )


def _gated(spark, folder, k=retrieval.TOP_K):
    asked, pages = questions(spark, folder), fx.corpus(spark, folder)
    hits = retrieval.top_k(chunking.chunk_documents(pages), asked, k)
    return retrieval.relevance_gate(hits, asked, pages)


def relevance_gate(spark, folder):
    return _gated(spark, folder).selectExpr("query_id", "chunk_id", "bigint(rank) AS rank", "relevant")


def to_sources(spark, folder):
    gated = _gated(spark, folder).where("relevant")
    return retrieval.to_sources(gated).selectExpr(
        "query_id", "bigint(rank) AS rank", "chunk_id", "doc_name", "page", "start", "end",
        "md5(quote) AS digest", "score",
    )


def _answer_rows(answered):
    return answered.select(
        "query_id", "found", "mode", "answer",
        F.array_join(F.transform("sources", lambda s: s["chunk_id"]), ",").alias("cited"),
    )


def ask_extractive(spark, folder):
    return _answer_rows(retrieval.ask_batch(questions(spark, folder), _gated(spark, folder)))


def ask_judged(spark, folder):
    return _answer_rows(
        retrieval.ask_batch(questions(spark, folder), _gated(spark, folder), answers(spark, folder))
    )


def valid_citations(spark, folder):
    """Citations drawn from order keys against a pool of six."""
    cited = F.expr(
        "array(double(o_orderkey % 9 - 1), 0.5D, double(o_custkey % 9 - 1), double(o_orderkey % 9 - 1), 2.0D)"
    )
    kept = retrieval.valid_citations(cited, F.lit(6))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.array_join(kept.cast("array<string>"), ",").alias("kept")
    )


def build_prompts(spark, folder):
    asked = questions(spark, folder)
    return retrieval.build_prompts(asked, _gated(spark, folder)).select(
        "query_id", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("digest")
    )


def _replies(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS query_id",
        """CASE o_orderkey % 5
             WHEN 0 THEN concat('{"found": true, "answer": "order ', o_custkey, '", "citations": [', o_orderkey % 7, ', 1]}')
             WHEN 1 THEN '{"found": false, "answer": "", "citations": []}'
             WHEN 2 THEN concat('{"found": true, "answer": "cut ', o_custkey)
             WHEN 3 THEN '{"found": true, "citations": [0]}'
             ELSE '' END AS body""",
        "o_orderkey % 11 = 0 AS refused",
    )


def parse_answers(spark, folder):
    parsed = retrieval.parse_answers(_replies(spark, folder))
    return parsed.select(
        "query_id", "found", "answer",
        F.array_join(F.transform("citations", lambda c: c.cast("int").cast("string")), ",").alias("citations"),
        "reason",
    )


def parse_findings(spark, folder):
    raw = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS doc_id",
        """CASE o_orderkey % 4
             WHEN 0 THEN concat('{"flags": [{"category": "a', o_custkey % 3, '", "severity": "high", "explanation": "x", "citations": [', o_orderkey % 7, ']},',
                                ' {"category": "b", "severity": "odd", "explanation": "", "citations": []}]}')
             WHEN 1 THEN '{"flags": []}'
             WHEN 2 THEN '{"flags": [{"category"'
             ELSE '{}' END AS body""",
        "o_orderkey % 11 = 0 AS refused",
    )
    return retrieval.parse_findings(raw).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "category", "severity", "explanation",
        F.array_join(F.transform("citations", lambda c: c.cast("int").cast("string")), ",").alias("citations"),
        "reason",
    )


def _topk_sql(scope: str, k: int) -> str:
    """CTE ``hits``: every chunk of the scope ranked, zero scores included."""
    return f"""{features_sql('qf', 'questions', 'query_id', 'question')},
{features_sql('cf', scope, 'chunk_id', 'text')},
dots AS (SELECT q.query_id, c.chunk_id, sum(q.w * c.w) AS s FROM qf q JOIN cf c ON c.b = q.b GROUP BY ALL),
allpairs AS (
  SELECT q.query_id, c.chunk_id, c.doc_id, c.page, c.idx, c.s, c.e, c.text,
    round(least(1, greatest(0, coalesce(d.s, 0))), 12) AS score
  FROM questions q CROSS JOIN {scope} c LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page, idx) AS rank FROM allpairs
  QUALIFY rank <= {k})"""


_BASE = f"{fx.with_('corpus')}, {QUESTIONS}, {chunks_sql('corpus')}"
GATED = f"""{_BASE}, {_topk_sql('chunks', 6)},
gated AS (
  SELECT h.*, 'doc-' || doc_id AS doc_name, score >= 0.03 AND len(list_intersect({TOKENS.format('q.question')}, {TOKENS.format('h.text')})) > 0 AS relevant
  FROM hits h JOIN questions q ON q.query_id = h.query_id)"""

_ASKED = f"""{GATED}, good AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS g FROM gated WHERE relevant),
sums AS (
  SELECT q.query_id, count(g.query_id) AS n_good FROM questions q LEFT JOIN good g ON g.query_id = q.query_id GROUP BY q.query_id),
top3 AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS ids FROM gated WHERE rank <= 3 GROUP BY query_id),
good3 AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS ids FROM good WHERE g < 3 GROUP BY query_id),
allgood AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS ids FROM good GROUP BY query_id)"""

QUERIES = {
    "token_rows": (
        token_rows,
        f"""SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS token
FROM (SELECT doc_id, {TOKENS.format('text')} AS l FROM documents)""",
    ),
    "hash_features": (
        hash_features_q,
        f"""WITH {features_sql('f', 'documents', 'doc_id', 'text')}
SELECT doc_id, b AS bucket, round(w, 6) AS weight FROM f_raw""",
    ),
    "l2_normalize": (
        l2_normalize_q,
        f"""{fx.with_('corpus')}, {chunks_sql('corpus')}, {features_sql('f', 'chunks', 'chunk_id', 'text')}
SELECT chunk_id, b AS bucket, round(w, 6) AS weight FROM f""",
    ),
    "dense_vectors": (
        dense_vectors,
        f"""WITH {features_sql('f', 'benchmark', 'item_id', 'text')}
SELECT k.item_id, CAST(k.b AS INT) AS bucket, round(coalesce(f.w, 0), 6) AS weight
FROM (SELECT item_id, unnest(range(512)) AS b FROM benchmark) k LEFT JOIN f ON f.item_id = k.item_id AND f.b = k.b""",
    ),
    "top_k": (
        top_k,
        f"{_BASE}, {_topk_sql('chunks', 6)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hits",
    ),
    "index_top_k": (
        index_top_k,
        f"""{fx.with_('corpus')}, questions AS (SELECT doc_id AS query_id, text AS question FROM documents WHERE doc_id % 20 = 0),
{chunks_sql('corpus')}, {_topk_sql('chunks', 6)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hits""",
    ),
    "top_k_selected": (
        top_k_selected,
        f"""{_BASE}, picked AS (SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
{_topk_sql('picked', 4)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hits""",
    ),
    "dense_top_k": (
        dense_top_k,
        """WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
s AS (SELECT q.query_id, e.vec_id, round(greatest(0, least(1, list_cosine_similarity(q.v::DOUBLE[], e.embedding::DOUBLE[]))), 12) AS score
  FROM q CROSS JOIN embeddings e)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
  round(score, 5) AS score, score >= 0.25 AS relevant FROM s QUALIFY rank <= 6""",
    ),
    "relevance_gate": (
        relevance_gate,
        f"{GATED} SELECT query_id, chunk_id, rank, relevant FROM gated",
    ),
    "to_sources": (
        to_sources,
        f"""{GATED} SELECT query_id, rank, chunk_id, doc_name, page, CAST(s AS INT) AS start, CAST(e AS INT) AS "end",
  md5(text) AS digest, round(score, 4) AS score FROM gated WHERE relevant""",
    ),
    "ask_extractive": (
        ask_extractive,
        f"""{_ASKED} SELECT s.query_id, false AS found, CASE WHEN n_good > 0 THEN 'extractive' ELSE 'abstain' END AS mode,
  CASE WHEN n_good > 0 THEN '{retrieval.EXTRACT_TEXT}' ELSE '{retrieval.ABSTAIN_TEXT}' END AS answer,
  CASE WHEN n_good > 0 THEN a.ids ELSE t.ids END AS cited
FROM sums s LEFT JOIN allgood a ON a.query_id = s.query_id LEFT JOIN top3 t ON t.query_id = s.query_id""",
    ),
    "ask_judged": (
        ask_judged,
        f"""{_ASKED},
asked AS (
  SELECT item_id AS query_id, item_id % 8 = 7 AS unread, item_id % 3 <> 0 AS found,
    CASE WHEN item_id % 4 = 0 THEN '' ELSE 'reply ' || item_id END AS reply FROM benchmark),
cites AS (
  SELECT query_id, pos, c FROM (
    SELECT item_id AS query_id, unnest([0, 1, 2]) AS pos, unnest([item_id % 4, 0, 1]) AS c FROM benchmark
    WHERE item_id % 5 <> 0 AND item_id % 7 <> 0)),
firsts AS (SELECT query_id, c, min(pos) AS pos FROM cites GROUP BY query_id, c),
receipts AS (
  SELECT f.query_id, string_agg(g.chunk_id, ',' ORDER BY f.pos) AS ids
  FROM firsts f JOIN good g ON g.query_id = f.query_id AND g.g = f.c GROUP BY f.query_id),
kinds AS (
  SELECT s.query_id, CASE WHEN n_good = 0 THEN 'none' WHEN unread THEN 'extractive' WHEN NOT found THEN 'declined'
    WHEN r.ids IS NULL THEN 'unsupported' ELSE 'llm' END AS kind, reply, r.ids
  FROM sums s JOIN asked a ON a.query_id = s.query_id LEFT JOIN receipts r ON r.query_id = s.query_id)
SELECT k.query_id, kind = 'llm' AS found, CASE WHEN kind IN ('llm', 'extractive') THEN kind ELSE 'abstain' END AS mode,
  CASE kind WHEN 'llm' THEN reply WHEN 'extractive' THEN '{retrieval.EXTRACT_TEXT}'
    WHEN 'declined' THEN coalesce(nullif(reply, ''), '{retrieval.ABSTAIN_TEXT}') ELSE '{retrieval.ABSTAIN_TEXT}' END AS answer,
  CASE kind WHEN 'llm' THEN k.ids WHEN 'extractive' THEN a.ids WHEN 'none' THEN t.ids ELSE g.ids END AS cited
FROM kinds k LEFT JOIN allgood a ON a.query_id = k.query_id LEFT JOIN top3 t ON t.query_id = k.query_id
LEFT JOIN good3 g ON g.query_id = k.query_id""",
    ),
    "valid_citations": (
        valid_citations,
        """WITH c AS (
  SELECT DISTINCT o_orderkey, o_custkey FROM orders),
x AS (SELECT o_orderkey, unnest([0, 1, 2]) AS pos, unnest([o_orderkey % 9 - 1, o_custkey % 9 - 1, 2]) AS v FROM c),
f AS (SELECT o_orderkey, v, min(pos) AS pos FROM x WHERE v >= 0 AND v < 6 GROUP BY o_orderkey, v)
SELECT o_orderkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS kept FROM f GROUP BY o_orderkey""",
    ),
    "build_prompts": (
        build_prompts,
        f"""{GATED}, lines AS (
  SELECT query_id, string_agg('[Excerpt ' || g || '] (from ' || doc_name || ', page ' || page || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS g FROM gated WHERE relevant) GROUP BY query_id),
p AS (SELECT l.query_id, 'Passages to answer from:' || chr(10) || chr(10) || x || chr(10) || chr(10) || 'To answer: ' || trim(q.question) AS prompt
  FROM lines l JOIN questions q ON q.query_id = l.query_id)
SELECT query_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM p""",
    ),
    "parse_answers": (
        parse_answers,
        f"""SELECT o_orderkey AS query_id,
  CASE WHEN o_orderkey % 11 = 0 THEN false WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 5 = 1 THEN false END AS found,
  CASE WHEN o_orderkey % 11 = 0 THEN '{retrieval.ABSTAIN_TEXT}' WHEN o_orderkey % 5 = 0 THEN 'order ' || o_custkey
       WHEN o_orderkey % 5 = 1 THEN '' END AS answer,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 7) || ',1' WHEN o_orderkey % 5 = 1 THEN '' END AS citations,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 > 1 THEN 'unparseable' END AS reason
FROM orders""",
    ),
    "parse_findings": (
        parse_findings,
        """WITH kept AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0)
SELECT o_orderkey AS doc_id, 0::BIGINT AS pos, 'a' || (o_custkey % 3) AS category, 'high' AS severity, 'x' AS explanation,
  CAST(o_orderkey % 7 AS VARCHAR) AS citations, NULL AS reason FROM kept WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 1, 'b', 'odd', '', '', NULL FROM kept WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, 'unparseable' FROM kept WHERE o_orderkey % 4 > 1""",
    ),
}
