"""Queries over chunking, with the packing rule restated as recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chunking
from quire.plans.intake_queries import catalog
from quire.sources import fixtures as fx

# White space as a regular expression class and as characters.
_WS = r"[\t-\r\x1c-\x20]"
_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)"


def units_sql(pages: str, hard_max: int = 2200) -> str:
    """CTEs ending in ``units(doc_id, page, unit, s, e)`` for the CTE ``pages``."""
    return rf"""paras AS (
  SELECT doc_id, page, unnest(list) AS piece, unnest(range(len(list))) AS p
  FROM (SELECT doc_id, page, string_split(regexp_replace(text, '(\n{{2,}})', chr(1) || '\1', 'g'), chr(1)) AS list FROM {pages})),
sents AS (
  SELECT doc_id, page, p, unnest(list) AS piece, unnest(range(len(list))) AS q
  FROM (SELECT doc_id, page, p, CASE WHEN length(trim(piece, {_CHARS})) <= {hard_max} THEN [piece]
          ELSE string_split(regexp_replace(piece, '([.!?])({_WS})', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS list
        FROM paras)),
placed AS (
  SELECT doc_id, page, p, q,
    coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, page ORDER BY p, q
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + length(piece) - length(ltrim(piece, {_CHARS})) AS s,
    length(trim(piece, {_CHARS})) AS n
  FROM sents),
cut AS (
  SELECT doc_id, page, p, q, s, n, unnest(range((n - 1) // {hard_max} + 1)) AS c FROM placed WHERE n > 0),
units AS (
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY p, q, c) - 1 AS unit,
    s + c * {hard_max} AS s, least(s + (c + 1) * {hard_max}, s + n) AS e
  FROM cut)"""


def spans_sql(target: int = 1100, overlap: int = 180) -> str:
    """CTEs from ``units`` to ``spans(doc_id, page, idx, s, e)``.

    For every unit the last unit that fits after it and the unit the next chunk
    would start at are found by range joins; the chain is then walked.
    """
    return f"""reach AS (
  SELECT a.doc_id, a.page, a.unit, any_value(a.s) AS s, max(b.unit) AS j
  FROM units a JOIN units b ON a.doc_id = b.doc_id AND a.page = b.page AND b.unit >= a.unit
    AND (b.e - a.s <= {target} OR b.unit = a.unit)
  GROUP BY a.doc_id, a.page, a.unit),
steps AS (
  SELECT r.doc_id, r.page, r.unit, any_value(r.s) AS s, any_value(l.e) AS e,
    coalesce(min(k.unit), any_value(r.j) + 1) AS nxt, any_value(r.j) AS j
  FROM reach r JOIN units l ON l.doc_id = r.doc_id AND l.page = r.page AND l.unit = r.j
  LEFT JOIN units k ON k.doc_id = r.doc_id AND k.page = r.page AND k.unit > r.unit
    AND k.unit <= r.j AND l.e - k.s <= {overlap}
  GROUP BY r.doc_id, r.page, r.unit),
sizes AS (SELECT doc_id, page, max(unit) AS top FROM units GROUP BY doc_id, page),
walk AS (
  SELECT doc_id, page, 0 AS idx, s, e, nxt, j FROM steps WHERE unit = 0
  UNION ALL
  SELECT t.doc_id, t.page, w.idx + 1, t.s, t.e, t.nxt, t.j
  FROM walk w JOIN sizes z ON z.doc_id = w.doc_id AND z.page = w.page AND w.j < z.top
  JOIN steps t ON t.doc_id = w.doc_id AND t.page = w.page AND t.unit = w.nxt),
spans AS (SELECT doc_id, page, idx, s, e FROM walk)"""


def chunks_sql(pages: str) -> str:
    """CTEs ending in ``chunks(chunk_id, doc_id, page, idx, s, e, text)``."""
    return f"""{units_sql(pages)},
{spans_sql()},
chunks AS (
  SELECT c.doc_id || ':' || c.page || ':' || c.idx AS chunk_id, c.doc_id, c.page, c.idx, c.s, c.e,
    substr(p.text, CAST(c.s + 1 AS INT), CAST(c.e - c.s AS INT)) AS text
  FROM spans c JOIN {pages} p ON p.doc_id = c.doc_id AND p.page = c.page)"""


def paragraph_units(spark, folder):
    return chunking.paragraph_units(fx.corpus(spark, folder))


def sentence_units(spark, folder):
    return chunking.sentence_units(fx.corpus(spark, folder))


def sentence_units_short(spark, folder):
    """A small hard maximum, so that hard cuts happen."""
    return chunking.sentence_units(fx.corpus(spark, folder), hard_max=60)


def pack_chunks(spark, folder):
    units = chunking.sentence_units(fx.corpus(spark, folder))
    return chunking.pack_chunks(units)


def pack_chunks_tight(spark, folder):
    """A budget the carried units often exceed, so suffix chunks appear."""
    units = chunking.sentence_units(fx.corpus(spark, folder), hard_max=200)
    return chunking.pack_chunks(units, target=220, overlap=200)


def chunk_documents(spark, folder):
    return chunking.chunk_documents(fx.corpus(spark, folder)).select(
        "chunk_id", "doc_id", "page", "idx", "start", "end", F.md5("text").alias("digest")
    )


def chunk_talks(spark, folder):
    return chunking.chunk_documents(fx.talks(spark, folder), target=400, overlap=120, hard_max=300).select(
        "chunk_id", "start", "end", "text"
    )


def audit_spans(spark, folder):
    """A shifted, thinned copy of the chunks must be caught."""
    pages = fx.corpus(spark, folder)
    chunks = chunking.chunk_documents(pages)
    broken = chunks.where("idx % 5 <> 3").withColumn(
        "start", F.expr("CASE WHEN doc_id % 10 = 0 THEN start + 1 ELSE start END")
    )
    return chunking.audit_spans(broken, pages).union(
        chunking.audit_spans(chunks, pages).withColumn("reason", F.concat(F.lit("clean:"), "reason"))
    )


_CORPUS = fx.with_("corpus")

QUERIES = {
    "paragraph_units": (
        paragraph_units,
        f"""{_CORPUS}, {units_sql('corpus', 10**9)}
SELECT doc_id, page, CAST(unit AS INT) AS unit, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM units""",
    ),
    "sentence_units": (
        sentence_units,
        f"""{_CORPUS}, {units_sql('corpus')}
SELECT doc_id, page, CAST(unit AS INT) AS unit, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM units""",
    ),
    "sentence_units_short": (
        sentence_units_short,
        f"""{_CORPUS}, {units_sql('corpus', 60)}
SELECT doc_id, page, CAST(unit AS INT) AS unit, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM units""",
    ),
    "pack_chunks": (
        pack_chunks,
        f"""{_CORPUS}, {units_sql('corpus')}, {spans_sql()}
SELECT doc_id, page, idx, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM spans""",
    ),
    "pack_chunks_tight": (
        pack_chunks_tight,
        f"""{_CORPUS}, {units_sql('corpus', 200)}, {spans_sql(220, 200)}
SELECT doc_id, page, idx, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM spans""",
    ),
    "chunk_documents": (
        chunk_documents,
        f"""{_CORPUS}, {chunks_sql('corpus')}
SELECT chunk_id, doc_id, page, idx, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", md5(text) AS digest FROM chunks""",
    ),
    "chunk_talks": (
        chunk_talks,
        f"""{fx.with_('talks')}, {units_sql('talks', 300)}, {spans_sql(400, 120)}
SELECT c.doc_id || ':' || c.page || ':' || c.idx AS chunk_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end",
  substr(p.text, CAST(c.s + 1 AS INT), CAST(c.e - c.s AS INT)) AS text
FROM spans c JOIN talks p ON p.doc_id = c.doc_id AND p.page = c.page""",
    ),
    "audit_spans": (
        audit_spans,
        rf"""{_CORPUS}, {chunks_sql('corpus')},
broken AS (
  SELECT doc_id, page, idx, CASE WHEN doc_id % 10 = 0 THEN s + 1 ELSE s END AS s, e, text AS quote
  FROM chunks WHERE idx % 5 <> 3),
linked AS (
  SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe,
    coalesce(max(e) OVER (PARTITION BY doc_id, page ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far,
    lead(s) OVER w IS NULL AS is_last
  FROM broken WINDOW w AS (PARTITION BY doc_id, page ORDER BY idx)),
both_ AS (SELECT l.*, p.text FROM linked l JOIN corpus p ON p.doc_id = l.doc_id AND p.page = l.page)
SELECT doc_id, page, idx, 'not-a-slice' AS reason FROM both_ WHERE substr(text, CAST(s + 1 AS INT), CAST(e - s AS INT)) <> quote
UNION ALL SELECT doc_id, page, idx, 'no-progress' FROM both_ WHERE s <= ps
UNION ALL SELECT doc_id, page, idx, 'overlap-over-budget' FROM both_ WHERE pe - s > 180
UNION ALL SELECT doc_id, page, idx, 'gap' FROM both_
  WHERE regexp_matches(substr(text, CAST(far + 1 AS INT), CAST(greatest(s - far, 0) AS INT)), '\S')
UNION ALL SELECT doc_id, page, idx, 'tail-uncovered' FROM both_
  WHERE is_last AND regexp_matches(substr(text, CAST(greatest(far, e) + 1 AS INT)), '\S')""",
    ),
    "catalog": (
        catalog,
        f"""{fx.with_('docs', 'corpus')}, {chunks_sql('corpus')}
SELECT d.doc_id, d.doc_name, count(DISTINCT c.page) AS n_pages, count(c.idx) AS n_chunks, any_value(d.sample) AS sample,
  any_value(d.created_s) AS created_s
FROM docs d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY d.doc_id, d.doc_name""",
    ),
}
