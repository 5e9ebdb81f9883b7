"""Queries over versions in time, differences, grouped totals, first sights and embedders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import history, retrieval, sizes
from quire.plans.answer_queries import features_sql
from quire.sources.tables import spread, table


def valid_at(spark, folder):
    """Every event of a user with the user's last sign-up before it."""
    seen = table(spark, folder, "events")
    versions = seen.where("event_type = 'signup'").selectExpr("user_id AS doc_id", "event_id AS version", "ts AS since")
    events = seen.where("event_type <> 'signup'").selectExpr("user_id AS doc_id", "ts AS at", "event_id")
    return history.valid_at(events, versions).select(
        "event_id", "version", F.unix_micros(F.col("since").cast("timestamp")).alias("since_us")
    )


def _manifests(spark, folder):
    """Conversations as documents before and after an edit; pages repeat."""
    talks = table(spark, folder, "conversations").selectExpr(
        "conv_id AS out_doc", "bigint(turn) AS position", "conv_id AS src_doc", "bigint(turn % 3) AS src_page", "0 AS rotation"
    )
    kept = talks.where("(out_doc + position) % 5 <> 0").withColumn("position", F.col("position") * 2)
    twice = kept.where("(out_doc + position) % 7 = 0").withColumn("position", F.col("position") + 1)
    blank = talks.where("position = 0 AND out_doc % 3 = 0").withColumn("position", F.lit(1000).cast("long")).withColumn(
        "src_page", F.lit(None).cast("long")
    )
    return talks, kept.unionByName(twice).unionByName(blank)


def manifest_difference(spark, folder):
    found = history.manifest_difference(*_manifests(spark, folder))
    none = F.lit(None).cast("long")
    columns = ["out_doc", "src_page", "copy"]
    return (
        found.added.select(F.lit("added").alias("change"), *columns, "position", none.alias("was"))
        .unionByName(found.dropped.select(F.lit("dropped").alias("change"), *columns, none.alias("position"), F.col("position").alias("was")))
        .unionByName(found.kept.select(F.lit("kept").alias("change"), *columns, "position", "was"))
    )


def grouped_totals(spark, folder):
    docs = table(spark, folder, "documents")
    lines = sizes.grouped_totals(docs, ["source", "lang"], "n_chars", "n_chars")
    near = F.abs(F.col("about") - F.col("n_distinct")) <= F.col("n_distinct") * 0.1 + 1
    return lines.select("source", "lang", "grouping", "n_rows", "total", "n_distinct", near.alias("near"))


def first_seen_hosts(spark, folder):
    seen = table(spark, folder, "events").selectExpr(
        "user_id AS session", "ts", "nullif(concat(event_type, '-', event_id % 50), 'error-7') AS host"
    )
    found = sizes.first_seen_hosts(seen)
    return found.select("session", "place", "host", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"))


def _texts(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text")).selectExpr("doc_id AS vec_id", "text")
    return docs, table(spark, folder, "benchmark").selectExpr("item_id AS query_id", "text AS question")


def _hits(found):
    return found.selectExpr("query_id", "vec_id", "bigint(rank) AS rank", "round(score, 6) AS score", "relevant")


def embed_top_k_hashing(spark, folder):
    """Documents nearest to the benchmark texts by an embedder of built-in functions."""
    return _hits(retrieval.embed_top_k(*_texts(spark, folder), retrieval.hashing_embedder(), k=3))


def embed_top_k_loaded(spark, folder):
    """The same by an embedder that is loaded in the workers: hashed trigrams of characters."""

    def load():
        import numpy as np

        def model(texts):
            out = []
            for text in texts:
                c = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
                buckets = (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % 256 if len(c) > 2 else c[:0]
                out.append(np.bincount(buckets, minlength=256).astype(float))
            return out

        return model

    return _hits(retrieval.embed_top_k(*_texts(spark, folder), retrieval.loaded_embedder(load, 256, 0.9), k=3))


# Sums come in any order here; nine places make copies of a text tie, as they do in the operator.
_RANKED = """scored AS (SELECT q.query_id, d.vec_id, round(least(1, greatest(0, coalesce(s.s, 0))), 9) AS score
  FROM (SELECT item_id AS query_id FROM benchmark) AS q CROSS JOIN (SELECT doc_id AS vec_id FROM documents) AS d
  LEFT JOIN dots AS s ON s.query_id = q.query_id AND s.vec_id = d.vec_id)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, round(score, 6) AS score,
  score >= {bar} AS relevant FROM scored QUALIFY rank <= 3"""

_TRIGRAMS = """{name} AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM (
  SELECT id, (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 256 AS b, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT id, c, unnest(range(1, len(c) - 1)) AS i FROM (
    SELECT {id} AS id, list_transform(string_split(lower(text), ''), lambda x: unicode(x)) AS c FROM {table})) GROUP BY ALL))"""

QUERIES = {
    "valid_at": (
        valid_at,
        """SELECT e.event_id, v.event_id AS version, epoch_us(v.ts) AS since_us
FROM (SELECT * FROM events WHERE event_type <> 'signup') AS e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') AS v ON e.user_id = v.user_id AND e.ts >= v.ts""",
    ),
    "manifest_difference": (
        manifest_difference,
        """WITH o AS (SELECT conv_id AS out_doc, turn AS position, turn % 3 AS src_page FROM conversations),
k AS (SELECT out_doc, position * 2 AS position, src_page FROM o WHERE (out_doc + position) % 5 <> 0),
n AS (SELECT * FROM k UNION ALL SELECT out_doc, position + 1, src_page FROM k WHERE (out_doc + position) % 7 = 0
  UNION ALL SELECT out_doc, 1000, NULL FROM o WHERE position = 0 AND out_doc % 3 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY out_doc, src_page ORDER BY position) - 1 AS copy FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY out_doc, src_page ORDER BY position) - 1 AS copy FROM n)
SELECT CASE WHEN a.copy IS NULL THEN 'added' WHEN b.copy IS NULL THEN 'dropped' ELSE 'kept' END AS change,
  coalesce(a.out_doc, b.out_doc) AS out_doc, coalesce(a.src_page, b.src_page) AS src_page, coalesce(a.copy, b.copy) AS copy,
  b.position, a.position AS was
FROM a FULL JOIN b ON a.out_doc = b.out_doc AND a.src_page IS NOT DISTINCT FROM b.src_page AND a.copy = b.copy""",
    ),
    "grouped_totals": (
        grouped_totals,
        """SELECT source, lang, grouping_id(source, lang) AS grouping, count(*) AS n_rows, sum(n_chars)::BIGINT AS total,
  count(DISTINCT n_chars) AS n_distinct, true AS near FROM documents GROUP BY CUBE (source, lang)""",
    ),
    "first_seen_hosts": (
        first_seen_hosts,
        """WITH s AS (SELECT user_id AS session, ts, nullif(event_type || '-' || event_id % 50, 'error-7') AS host FROM events),
f AS (SELECT session, host, min(ts) AS first FROM s WHERE host IS NOT NULL GROUP BY session, host)
SELECT session, row_number() OVER (PARTITION BY session ORDER BY first, host) - 1 AS place, host, epoch_us(first) AS first_us FROM f""",
    ),
    "embed_top_k_hashing": (
        embed_top_k_hashing,
        f"""WITH {features_sql('qf', 'benchmark', 'item_id', 'text')}, {features_sql('df', 'documents', 'doc_id', 'text')},
dots AS (SELECT q.item_id AS query_id, d.doc_id AS vec_id, sum(q.w * d.w) AS s FROM qf AS q JOIN df AS d ON d.b = q.b GROUP BY ALL),
{_RANKED.format(bar=retrieval.MIN_RELEVANCE)}""",
    ),
    "embed_top_k_loaded": (
        embed_top_k_loaded,
        f"""WITH {_TRIGRAMS.format(name='qf', id='item_id', table='benchmark')}, {_TRIGRAMS.format(name='df', id='doc_id', table='documents')},
dots AS (SELECT q.id AS query_id, d.id AS vec_id, sum(q.w * d.w) AS s FROM qf AS q JOIN df AS d ON d.b = q.b GROUP BY ALL),
{_RANKED.format(bar=0.9)}""",
    ),
}
