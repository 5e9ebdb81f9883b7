"""Queries over the risk scan, with a category table made of words that occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chunking, scan
from quire.plans.answer_queries import TOKENS, features_sql
from quire.plans.chunk_queries import chunks_sql
from quire.sources import fixtures as fx
from quire.sources.scratch import scratch_folder
from quire.sources.tables import table

CATS = [
    ("grant", "Grants", "license thtion attion as is licensed ertion", "a grant", ["license", "as is"], "Says what is granted."),
    ("price", "Prices", "ontion antion $ retion edtion hation", "a price", ["$", "ontion", "antion"], "Names a price."),
    ("party", "Parties", "eriner thanea thanedble inging", "a party", ["eriner", "inging.", "thanedble"], "Names a party."),
    ("place", "Places", "eaueaux letre lement quevirei pa", "a place", ["eaux", "lement"], "Names a place."),
]


def _cats(spark):
    return scan.category_table(spark, CATS)


def _candidates(spark, folder):
    return scan.scan_candidates(chunking.chunk_documents(fx.corpus(spark, folder)), _cats(spark))


def _quote(v):
    return "'" + v.replace("'", "''") + "'"


CATS_SQL = "cats AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_quote(i)}, {n}, {_quote(t)}, {_quote(p)}, {_quote(h)}, [{', '.join(map(_quote, s))}], {_quote(w)})"
    for n, (i, t, p, h, s, w) in enumerate(CATS)
) + ") v(id, ord, title, probe, hint, signals, why))"


def categories(spark, folder):
    """How often each built-in signal occurs, over whole documents."""
    signals = scan.categories(spark).select("id", "ord", F.explode("signals").alias("signal"))
    grams = fx.corpus(spark, folder).select("doc_id", F.lower("text").alias("low"))
    packed = signals.groupBy().agg(F.sort_array(F.collect_list(F.struct("ord", "id", "signal")))).scalar()
    return (
        grams.withColumn("_s", packed)
        .select(F.explode(F.filter("_s", lambda s: F.contains(F.col("low"), s["signal"]))).alias("s"))
        .groupBy("s.id", "s.signal")
        .agg(F.count("*").alias("n_docs"))
    )


def scan_candidates(spark, folder):
    return _candidates(spark, folder).selectExpr(
        "doc_id", "category", "chunk_id", "bigint(rank) AS rank", "round(score, 6) AS score", "signalled"
    )


def candidate_pool(spark, folder):
    return scan.candidate_pool(_candidates(spark, folder)).selectExpr(
        "doc_id", "chunk_id", "bigint(pool_index) AS pool_index", "round(score, 6) AS score"
    )


def signal_gate(spark, folder):
    return scan.signal_gate(_candidates(spark, folder)).selectExpr(
        "doc_id", "category", "chunk_id", "bigint(rank) AS rank"
    )


def narrow_passage(spark, folder):
    hits = scan.signal_gate(_candidates(spark, folder))
    return scan.narrow_passage(hits, fx.corpus(spark, folder), _cats(spark)).select(
        "doc_id", "category", "chunk_id", "start", "end", "quote"
    )


def scan_extractive(spark, folder):
    pages = fx.corpus(spark, folder)
    flags = scan.scan_extractive(pages, chunking.chunk_documents(pages), _cats(spark))
    return flags.select(
        "doc_id", "category", "title", "severity", "explanation",
        F.col("sources")[0]["chunk_id"].alias("chunk_id"), F.col("sources")[0]["score"].alias("score"),
    )


def _findings(spark, folder):
    """Three model findings per document: valid, unknown category, odd fields."""
    none = "cast(array() AS array<double>)"
    return table(spark, folder, "documents").selectExpr(
        "doc_id",
        f"""inline(array(
          named_struct('pos', 0, 'category', 'price', 'severity', CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'sideways' END,
            'explanation', concat(' note ', doc_id, ' '), 'citations', array(1.0D, 0.0D, 1.0D, 99.0D)),
          named_struct('pos', 1, 'category', 'made-up', 'severity', 'high', 'explanation', 'x', 'citations', array(0.0D)),
          named_struct('pos', 2, 'category', 'party', 'severity', 'info', 'explanation', '  ',
            'citations', CASE WHEN doc_id % 4 = 0 THEN {none} ELSE array(-1.0D, 0.0D, 0.5D) END),
          named_struct('pos', 3, 'category', 'grant', 'severity', 'high', 'explanation', 'y', 'citations', array(double(doc_id % 5)))))""",
    )


def _judged(spark, folder):
    pool = scan.candidate_pool(_candidates(spark, folder))
    return scan.scan_judged(pool, _findings(spark, folder), _cats(spark))


def scan_judged(spark, folder):
    return _judged(spark, folder).select(
        "doc_id", "pos", "category", "title", "severity", "explanation",
        F.array_join(F.transform("sources", lambda s: s["chunk_id"]), ",").alias("cited"),
    )


def order_flags(spark, folder):
    return scan.order_flags(_judged(spark, folder)).selectExpr(
        "doc_id", "bigint(flag_no) AS flag_no", "severity", "category"
    )


def scan_summary(spark, folder):
    pages = fx.corpus(spark, folder)
    flags = scan.scan_extractive(pages, chunking.chunk_documents(pages), _cats(spark))
    return scan.scan_summary(fx.docs(spark, folder), flags)


def scan_prompts(spark, folder):
    # Both inputs come from the candidates; narrow rows, stored so that the chunks are scored once.
    found, at = _candidates(spark, folder), scratch_folder(spark)
    found.write.parquet(at)
    cands = spark.read.schema(found.schema).parquet(at)
    prompts = scan.scan_prompts(
        scan.candidate_pool(cands), cands, fx.corpus(spark, folder), _cats(spark)
    )
    return prompts.select(
        "doc_id", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("digest")
    )


CAND = f"""{fx.with_('corpus')}, {CATS_SQL}, {chunks_sql('corpus')},
{features_sql('qf', 'cats', 'id', 'probe')},
{features_sql('cf', 'chunks', 'chunk_id', 'text')},
dots AS (SELECT q.id, c.chunk_id, round(least(1, sum(q.w * c.w)), 12) AS score FROM qf q JOIN cf c ON c.b = q.b GROUP BY ALL),
ranked AS (
  SELECT c.*, d.id AS category, d.score,
    row_number() OVER (PARTITION BY c.doc_id, d.id ORDER BY d.score DESC, c.page, c.idx) AS rank
  FROM dots d JOIN chunks c ON c.chunk_id = d.chunk_id WHERE d.score > 0),
cands AS (
  SELECT r.*, k.ord, k.signals, k.title, k.why, k.hint, len(list_filter(k.signals, lambda s: contains(lower(r.text), s))) > 0 AS signalled
  FROM ranked r JOIN cats k ON k.id = r.category
  WHERE rank <= 6 AND score >= 0.03 AND len(list_intersect({TOKENS.format('k.probe')}, {TOKENS.format('r.text')})) > 0),
pool AS (
  SELECT doc_id, chunk_id, any_value(page) AS page, any_value(s) AS s, any_value(e) AS e, any_value(text) AS text,
    arg_min(score, ord * 100 + rank) AS score,
    row_number() OVER (PARTITION BY doc_id ORDER BY min(ord * 100 + rank)) - 1 AS pool_index
  FROM cands GROUP BY doc_id, chunk_id),
gate AS (SELECT * FROM cands WHERE signalled QUALIFY row_number() OVER (PARTITION BY doc_id, category ORDER BY rank) = 1)"""

JUDGED = f"""{CAND}, findings AS (
  SELECT doc_id, 0 AS pos, 'price' AS category, CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'sideways' END AS severity,
    ' note ' || doc_id || ' ' AS explanation, [1, 0] AS cites FROM documents
  UNION ALL SELECT doc_id, 1, 'made-up', 'high', 'x', [0] FROM documents
  UNION ALL SELECT doc_id, 2, 'party', 'info', '  ', CASE WHEN doc_id % 4 = 0 THEN [] ELSE [0] END FROM documents
  UNION ALL SELECT doc_id, 3, 'grant', 'high', 'y', [CAST(doc_id % 5 AS INT)] FROM documents),
cited AS (SELECT doc_id, pos, unnest(cites) AS c, unnest(range(len(cites))) AS o FROM findings),
judged AS (
  SELECT f.doc_id, f.pos, f.category, k.title,
    CASE WHEN f.severity IN ('high', 'medium', 'low', 'info') THEN f.severity ELSE 'medium' END AS severity,
    coalesce(nullif(trim(f.explanation), ''), k.why) AS explanation, s.cited
  FROM findings f JOIN cats k ON k.id = f.category
  JOIN (SELECT c.doc_id, c.pos, string_agg(p.chunk_id, ',' ORDER BY c.o) AS cited
        FROM cited c JOIN pool p ON p.doc_id = c.doc_id AND p.pool_index = c.c GROUP BY c.doc_id, c.pos) s
    ON s.doc_id = f.doc_id AND s.pos = f.pos)"""

# The passage rule on whole pages: boundary ends by splitting, no windows.
NARROW = rf"""{CAND}, sited AS (
  SELECT g.doc_id, g.category, g.chunk_id, g.s, g.e, p.text AS t,
    g.s - 1 + list_min(list_filter(list_transform(g.signals, lambda z: instr(substr(lower(p.text), CAST(g.s + 1 AS INT), CAST(g.e - g.s AS INT)), z)), lambda v: v > 0)) AS pos
  FROM gate g JOIN corpus p ON p.doc_id = g.doc_id AND p.page = g.page),
begun AS (
  SELECT *, length(regexp_extract(substr(t, 1, CAST(pos AS INT)), '(?s)^.*[.!?](\s|$)')) AS b FROM sited),
clamped AS (
  SELECT *, CASE WHEN pos - b <= 220 THEN b
    ELSE pos - length(CASE WHEN regexp_matches(substr(t, CAST(pos - 220 AS INT), 220), '\s')
           THEN substr(substr(t, CAST(pos - 220 AS INT), 220), length(regexp_extract(substr(t, CAST(pos - 220 AS INT), 220), '^\S*\s')) + 1) || '.'
           ELSE '' END) END AS b2,
    length(regexp_extract(substr(t, CAST(pos + 1 AS INT)), '(?s)^.*?[.!?](\s|$)')) AS ahead FROM begun),
ended AS (SELECT *, CASE WHEN ahead > 0 THEN pos + ahead ELSE length(t) END AS e2 FROM clamped),
cutdown AS (
  SELECT *, b2 + length(substr(t, CAST(b2 + 1 AS INT), CAST(e2 - b2 AS INT))) - length(regexp_replace(substr(t, CAST(b2 + 1 AS INT), CAST(e2 - b2 AS INT)), '^\s+', '')) AS b3,
    b2 + length(regexp_replace(substr(t, CAST(b2 + 1 AS INT), CAST(e2 - b2 AS INT)), '\s+$', '')) AS e3 FROM ended),
narrowed AS (
  SELECT doc_id, category, chunk_id, coalesce(b3, s) AS b, coalesce(least(e3, b3 + 320), e) AS e, t FROM cutdown)"""

QUERIES = {
    "categories": (
        categories,
        """WITH sig AS (SELECT * FROM (VALUES """
        + ", ".join(f"({_quote(c[0])}, {_quote(s)})" for c in scan.CATEGORIES for s in c[4])
        + """) v(id, signal))
SELECT id, signal, count(*) AS n_docs FROM sig JOIN documents d
  ON contains(lower(CASE WHEN d.doc_id % 2 = 0 THEN replace(d.text, chr(10), chr(10) || chr(10)) ELSE d.text END), signal)
GROUP BY id, signal""",
    ),
    "scan_candidates": (
        scan_candidates,
        f"{CAND} SELECT doc_id, category, chunk_id, rank, round(score, 6) AS score, signalled FROM cands",
    ),
    "candidate_pool": (
        candidate_pool,
        f"{CAND} SELECT doc_id, chunk_id, pool_index, round(score, 6) AS score FROM pool",
    ),
    "signal_gate": (signal_gate, f"{CAND} SELECT doc_id, category, chunk_id, rank FROM gate"),
    "narrow_passage": (
        narrow_passage,
        f"""{NARROW} SELECT doc_id, category, chunk_id, CAST(b AS INT) AS start, CAST(e AS INT) AS "end",
  substr(t, CAST(b + 1 AS INT), CAST(e - b AS INT)) AS quote FROM narrowed""",
    ),
    "scan_extractive": (
        scan_extractive,
        f"""{CAND} SELECT doc_id, category, title, 'info' AS severity, why AS explanation, chunk_id, round(score, 4) AS score FROM gate""",
    ),
    "scan_judged": (
        scan_judged,
        f"{JUDGED} SELECT doc_id, pos, category, title, severity, explanation, cited FROM judged",
    ),
    "order_flags": (
        order_flags,
        f"""{JUDGED} SELECT doc_id, severity, category, row_number() OVER (PARTITION BY doc_id
  ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, pos) AS flag_no FROM judged""",
    ),
    "scan_summary": (
        scan_summary,
        f"""{CAND} SELECT d.doc_id, 'extractive' AS mode, count(g.category) AS n_flags,
  CASE WHEN count(g.category) > 0 THEN '{scan.FOUND_NOTE}' ELSE '{scan.EMPTY_NOTE}' END AS note
FROM documents d LEFT JOIN gate g ON g.doc_id = d.doc_id GROUP BY d.doc_id""",
    ),
    "scan_prompts": (
        scan_prompts,
        f"""{CAND}, ex AS (SELECT doc_id, string_agg('[Excerpt ' || pool_index || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY pool_index) AS x FROM pool GROUP BY doc_id),
off AS (SELECT doc_id, string_agg('- ' || category || ': ' || hint, chr(10) ORDER BY ord) AS o
  FROM (SELECT DISTINCT doc_id, category, hint, ord FROM cands) GROUP BY doc_id),
p AS (SELECT ex.doc_id, 'Kinds of risk:' || chr(10) || o || chr(10) || chr(10) || 'Passages:' || chr(10) || chr(10) || x AS prompt
  FROM ex JOIN off ON off.doc_id = ex.doc_id)
SELECT doc_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM p""",
    ),
}
