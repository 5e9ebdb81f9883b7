"""Queries over the leak check and redaction planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import (
    DASHES, DOUBLE_QUOTES, INVISIBLE, SINGLE_QUOTES, normalize_for_search,
)
from quire.operators import intake, leaks
from quire.sources import fixtures as fx
from quire.sources.tables import table

_FOLD = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES
_TO = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES)


def norm_sql(text: str) -> str:
    """Search form of a text column in SQL, for text NFKC leaves alone."""
    to = _TO.replace("'", "''")
    folded = f"translate({text}, '{_FOLD}', '{to}')"
    return rf"lower(regexp_replace(regexp_replace({folded}, '[{INVISIBLE}]', '', 'g'), '\s+', '', 'g'))"


def normalize_search(spark, folder):
    raw = fx.corpus(spark, folder).selectExpr(
        "doc_id",
        "replace(replace(replace(text, ' the ', ' “the” ‘'), ', ', '–​ '), 'an', 'a­n’') AS text",
    )
    folded = normalize_for_search(F.col("text"))
    return raw.select("doc_id", F.length(folded).cast("long").alias("n_chars"), F.md5(folded).alias("digest"))


def phrases(spark, folder):
    """Benchmark texts, and short phrases made from their words."""
    return table(spark, folder, "benchmark").selectExpr(
        "item_id",
        """inline(array(
          named_struct('j', 0, 'phrase', text),
          named_struct('j', 1, 'phrase', concat(split_part(text, ' ', 2), '‐', split_part(text, ' ', 3), ' ', split_part(text, ' ', 4))),
          named_struct('j', 2, 'phrase', CASE WHEN item_id = 0 THEN ' - ' WHEN item_id = 1 THEN ' ' ELSE split_part(text, ' ', 1) END)))""",
    ).selectExpr("item_id * 3 + j AS phrase_id", "phrase")


PHRASES = """phrases AS (
  SELECT item_id * 3 AS phrase_id, text AS phrase FROM benchmark
  UNION ALL SELECT item_id * 3 + 1, split_part(text, ' ', 2) || '‐' || split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4) FROM benchmark
  UNION ALL SELECT item_id * 3 + 2, CASE WHEN item_id = 0 THEN ' - ' WHEN item_id = 1 THEN ' ' ELSE split_part(text, ' ', 1) END FROM benchmark)"""


def phrase_hits(spark, folder):
    return leaks.phrase_hits(fx.corpus(spark, folder), phrases(spark, folder))


def long_phrases(spark, folder):
    """Ends and beginnings of conversations' turns, and every whole document that is a multiple of fifty."""
    turns = table(spark, folder, "conversations").selectExpr(
        "conv_id * 1000 + turn * 2 AS phrase_id", "right(text, 40) AS phrase"
    ).unionByName(table(spark, folder, "conversations").selectExpr("conv_id * 1000 + turn * 2 + 1", "left(text, 25)").toDF("phrase_id", "phrase"))
    whole = table(spark, folder, "documents").where("doc_id % 50 = 0").selectExpr("-1 - doc_id AS phrase_id", "text AS phrase")
    return turns.unionByName(whole)


LONG_PHRASES = """phrases AS (SELECT conv_id * 1000 + turn * 2 AS phrase_id, right(text, 40) AS phrase FROM conversations
  UNION ALL SELECT conv_id * 1000 + turn * 2 + 1, left(text, 25) FROM conversations
  UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 50 = 0)"""


def phrase_hits_long_list(spark, folder):
    """As many phrases as there are turns, and whole documents, against all documents and turns."""
    docs = fx.corpus(spark, folder).selectExpr("doc_id", "page", "text")
    talks = fx.talks(spark, folder).selectExpr("-1 - doc_id AS doc_id", "page", "text")
    return leaks.phrase_hits(docs.unionByName(talks), long_phrases(spark, folder))


def phrase_hits_across_pages(spark, folder):
    """Single words of the benchmark against whole conversations."""
    return leaks.phrase_hits(fx.talks(spark, folder), phrases(spark, folder))


def requests(spark, folder):
    """Per turn: a phrase across the page break, one inside the page, one absent."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    return (
        table(spark, folder, "conversations")
        .withColumn("nxt", F.coalesce(F.lead("text").over(order), F.lit("#end#")))
        .selectExpr(
            "conv_id AS doc_id",
            "turn",
            """inline(array(
              named_struct('j', 0, 'phrase', concat(right(text, 12), ' - ', left(nxt, 12))),
              named_struct('j', 1, 'phrase', substring(text, 5, 15)),
              named_struct('j', 2, 'phrase', CASE WHEN turn % 2 = 0 AND conv_id % 3 = 0 THEN concat('zz', conv_id) ELSE split_part(text, ' ', 1) END)))""",
        )
        .selectExpr("doc_id", "int(turn * 3 + j) AS ord", "phrase")
    )


REQUESTS = """turns AS (
  SELECT conv_id AS doc_id, turn, text, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '#end#') AS nxt FROM conversations),
requests AS (
  SELECT doc_id, CAST(turn * 3 AS INT) AS ord, right(text, 12) || ' - ' || left(nxt, 12) AS phrase FROM turns
  UNION ALL SELECT doc_id, CAST(turn * 3 + 1 AS INT), substr(text, 5, 15) FROM turns
  UNION ALL SELECT doc_id, CAST(turn * 3 + 2 AS INT), CASE WHEN turn % 2 = 0 AND doc_id % 3 = 0 THEN 'zz' || doc_id ELSE split_part(text, ' ', 1) END FROM turns)"""


def requested_hits(spark, folder):
    return leaks.requested_hits(fx.talks(spark, folder), requests(spark, folder))


def phrases_missing(spark, folder):
    return leaks.phrases_missing_from_source(fx.talks(spark, folder), requests(spark, folder))


def _after(spark, folder):
    """Redacted pages, with annotations that survived beside them."""
    pages = fx.talks(spark, folder).selectExpr(
        "doc_id", "page", "CASE WHEN page % 2 = 1 OR doc_id % 4 = 0 THEN '' ELSE text END AS text"
    )
    notes = table(spark, folder, "conversations").where("conv_id % 9 = 0 AND turn = 0").selectExpr(
        "conv_id AS doc_id", "100 AS page", "concat('note: ', text) AS text"
    )
    return pages.unionByName(notes)


AFTER = """after AS (
  SELECT doc_id, page, CASE WHEN page % 2 = 1 OR doc_id % 4 = 0 THEN '' ELSE text END AS text FROM talks
  UNION ALL SELECT conv_id, 100, 'note: ' || text FROM conversations WHERE conv_id % 9 = 0 AND turn = 0)"""


def leak_verdict(spark, folder):
    """Nothing is asked about a tenth of the conversations, which have a verdict too."""
    asked = requests(spark, folder).where("doc_id % 10 <> 7")
    verdict = leaks.leak_verdict(fx.talks(spark, folder), _after(spark, folder), asked)
    return verdict.select("doc_id", F.array_join("found", "|").alias("found"), "n_missing", "clean")


def annots(spark, folder):
    return table(spark, folder, "conversations").selectExpr(
        "conv_id AS doc_id",
        "int(turn + 1) AS page",
        "int(turn) AS seq",
        "CASE WHEN turn % 2 = 0 THEN array(role, '', text) ELSE cast(array() AS array<string>) END AS field_value",
        "CASE WHEN turn % 3 = 0 THEN array('default') END AS default_value",
        "CASE WHEN turn % 4 = 1 THEN 'On' END AS button",
        "concat(role, '.', turn) AS name",
        "cast(null AS string) AS alt",
        "CASE WHEN turn % 5 = 0 THEN 'http://a.example/' END AS url",
        "'' AS unsafe_url",
        "right(text, 20) AS contents",
        "role AS title",
        "cast(null AS string) AS rich",
        "CASE WHEN turn % 2 = 1 THEN array(named_struct('export', 'y', 'display', 'Yes'), named_struct('export', '', 'display', text)) END AS options",
    )


def annotation_text(spark, folder):
    return leaks.annotation_text(annots(spark, folder))


def metadata_text(spark, folder):
    meta = table(spark, folder, "documents").selectExpr(
        "doc_id",
        """map('Title', named_struct('kind', 'string', 'value', text),
               'Pages', named_struct('kind', 'number', 'value', string(n_chars)),
               'Author', named_struct('kind', CASE WHEN doc_id % 2 = 0 THEN 'string' ELSE 'name' END, 'value', source)) AS info""",
        "CASE WHEN doc_id % 3 = 0 THEN concat('<x>', lang, '</x>') END AS xmp",
    )
    return leaks.metadata_text(meta)


def residual_text(spark, folder):
    affected = fx.talks(spark, folder).where("page % 2 = 1").select("doc_id", "page")
    read = table(spark, folder, "conversations").where("conv_id % 5 <> 0").selectExpr(
        "conv_id AS doc_id", "int(turn + 1) AS page",
        "CASE WHEN turn % 4 = 0 THEN ' .-* ' ELSE text END AS text",
    )
    return leaks.residual_text(affected, read)


def boxes(spark, folder):
    return table(spark, folder, "conversations").selectExpr(
        "conv_id AS doc_id",
        "int(turn + CASE WHEN conv_id % 17 = 0 THEN 50 ELSE 0 END) AS page_index",
        "CASE WHEN conv_id % 19 = 1 AND turn = 0 THEN double('NaN') ELSE double((conv_id * 37 + turn * 211) % 900 - 100) END AS x",
        "double((conv_id * 53 + turn * 131) % 900 - 100) + 0.25D AS y",
        "CASE WHEN conv_id % 23 = 2 THEN 0.0D ELSE double((conv_id * 13 + turn * 71) % 200 - 60) END AS width",
        "double((conv_id * 29 + turn * 17) % 160 - 60) + 0.5D AS height",
    )


def doc_pages(spark, folder):
    return table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.count("*").alias("n_pages")
    )


def view_shapes(spark, folder):
    shapes = intake.page_shapes(fx.page_boxes(spark, folder))
    return shapes.withColumn("page_index", F.col("page") - 1)


BOXES = f"""boxes AS (
  SELECT conv_id AS doc_id, CAST(turn + CASE WHEN conv_id % 17 = 0 THEN 50 ELSE 0 END AS INT) AS page_index,
    CASE WHEN conv_id % 19 = 1 AND turn = 0 THEN 'NaN'::DOUBLE ELSE CAST((conv_id * 37 + turn * 211) % 900 - 100 AS DOUBLE) END AS x,
    CAST((conv_id * 53 + turn * 131) % 900 - 100 AS DOUBLE) + 0.25 AS y,
    CAST(CASE WHEN conv_id % 23 = 2 THEN 0 ELSE (conv_id * 13 + turn * 71) % 200 - 60 END AS DOUBLE) AS width,
    CAST((conv_id * 29 + turn * 17) % 160 - 60 AS DOUBLE) + 0.5 AS height
  FROM conversations),
doc_pages AS (SELECT conv_id AS doc_id, count(*) AS n_pages FROM conversations GROUP BY conv_id),
faults AS (
  SELECT b.doc_id, CASE WHEN bool_or(page_index < 0 OR page_index >= n_pages) THEN 'page-out-of-range'
    WHEN bool_or(isnan(x)) THEN 'not-a-number' WHEN bool_and(width = 0 OR height = 0) THEN 'nothing-marked' END AS reason
  FROM boxes b JOIN doc_pages d ON d.doc_id = b.doc_id GROUP BY b.doc_id),
good AS (
  SELECT b.doc_id, page_index, least(x, x + width) AS x, least(y, y + height) AS y, abs(width) AS width, abs(height) AS height
  FROM boxes b JOIN faults f ON f.doc_id = b.doc_id WHERE reason IS NULL AND width <> 0 AND height <> 0),
shapes AS (
  SELECT doc_id, page_index, CASE WHEN (rotation + 720) % 180 = 90 THEN height ELSE width END AS vw,
    CASE WHEN (rotation + 720) % 180 = 90 THEN width ELSE height END AS vh FROM page_boxes),
clipped AS (
  SELECT g.doc_id, g.page_index, greatest(0, x) AS x, greatest(0, y) AS y,
    least(vw, x + width) - greatest(0, x) AS width, least(vh, y + height) - greatest(0, y) AS height, vw, vh
  FROM good g JOIN shapes s ON s.doc_id = g.doc_id AND s.page_index = g.page_index
  WHERE least(vw, x + width) > greatest(0, x) AND least(vh, y + height) > greatest(0, y)),
plan AS (
  SELECT m.doc_id, m.page_index, count(c.doc_id) AS n_rects, CASE WHEN count(c.doc_id) > 0 THEN 'paint' ELSE 'missed' END AS action
  FROM (SELECT DISTINCT doc_id, page_index FROM good) m
  LEFT JOIN clipped c ON c.doc_id = m.doc_id AND c.page_index = m.page_index GROUP BY m.doc_id, m.page_index)"""
_B = f"{fx.with_('page_boxes', 'talks')}, {BOXES}"


def _good(spark, folder):
    return leaks.validate_boxes(boxes(spark, folder), doc_pages(spark, folder))


def _plan(spark, folder):
    return leaks.plan_redaction(_good(spark, folder), view_shapes(spark, folder))


def validate_boxes(spark, folder):
    return _good(spark, folder)


def rejected_boxes(spark, folder):
    return leaks.rejected_boxes(boxes(spark, folder), doc_pages(spark, folder))


def clip_boxes(spark, folder):
    return leaks.clip_boxes(_good(spark, folder), view_shapes(spark, folder))


def plan_redaction(spark, folder):
    return _plan(spark, folder).withColumn("n_rects", F.col("n_rects").cast("long"))


def pixel_rects(spark, folder):
    shapes = view_shapes(spark, folder)
    rects = leaks.clip_boxes(_good(spark, folder), shapes)
    dpi = F.expr("CASE WHEN doc_id % 3 = 0 THEN double('NaN') ELSE double(doc_id % 5 * 150) END")
    return leaks.pixel_rects(rects, shapes, dpi)


def redaction_cost(spark, folder):
    return leaks.redaction_cost(_plan(spark, folder), doc_pages(spark, folder))


def redact_pages(spark, folder):
    return leaks.redact_pages(fx.talks(spark, folder), _plan(spark, folder)).select(
        "doc_id", "page", F.md5("text").alias("digest")
    )


def redact_annotations(spark, folder):
    return leaks.redact_annotations(annots(spark, folder), _plan(spark, folder)).select(
        "doc_id", "page", "seq", "fillable"
    )


def _placed_runs(spark, folder):
    """Runs with their baseline start; every 101st has a twin a point away."""
    base = fx.runs(spark, folder).where("str <> ''").selectExpr(
        "doc_id", "page", "seq * 2 AS seq", "str", "x AS px", "y + font_size AS py", "seq % 13 <> 0 AS placed"
    )
    twins = base.where("seq % 202 = 0").selectExpr(
        "doc_id", "page", "seq + 1 AS seq", "str", "px + 1.0D AS px", "py", "true AS placed"
    )
    return base.unionByName(twins)


def excise_runs(spark, folder):
    targets = fx.runs(spark, folder).where("seq % 7 = 3 AND str <> ''").selectExpr(
        "doc_id", "page", "seq AS target",
        "x + CASE WHEN seq % 5 = 0 THEN 2.0D ELSE 0.75D END AS tx", "y + font_size - 0.5D AS ty",
        "CASE WHEN seq % 11 = 0 THEN ' ' WHEN seq % 6 = 0 THEN 'other' ELSE concat(left(str, 1), ' ', substring(str, 2)) END AS text",
    )
    return leaks.excise_runs(_placed_runs(spark, folder), targets)


def page_survived(spark, folder):
    pages = fx.corpus(spark, folder).selectExpr("doc_id", "text AS before", "split_part(text, ' ', 3) AS removed")
    cut = pages.withColumn(
        "after",
        F.expr(
            """CASE WHEN doc_id % 3 = 0 THEN before
                 WHEN removed = '' THEN before
                 WHEN doc_id % 3 = 1 THEN concat(left(before, instr(before, removed) - 1), '  ', substring(before, instr(before, removed) + length(removed)))
                 ELSE concat(left(before, length(before) - 1 - length(removed) + 0), '') END"""
        ),
    )
    return cut.select(
        "doc_id", leaks.page_survived(F.col("before"), F.col("after"), F.col("removed")).alias("survived")
    )


_FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"

QUERIES = {
    "normalize_for_search": (
        normalize_search,
        f"""{fx.with_('corpus')}, raw AS (
  SELECT doc_id, replace(replace(replace(text, ' the ', ' “the” ‘'), ', ', '–​ '), 'an', 'a­n’') AS text FROM corpus),
n AS (SELECT doc_id, {norm_sql('text')} AS t FROM raw)
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM n""",
    ),
    "phrase_hits": (
        phrase_hits,
        f"""{fx.with_('corpus')}, {PHRASES},
d AS (SELECT doc_id, {norm_sql('text')} AS t FROM corpus), p AS (SELECT phrase_id, {norm_sql('phrase')} AS n FROM phrases)
SELECT doc_id, phrase_id FROM d JOIN p ON n <> '' AND (contains(t, n) OR (replace(n, '-', '') <> '' AND contains(replace(t, '-', ''), replace(n, '-', ''))))""",
    ),
    "phrase_hits_long_list": (
        phrase_hits_long_list,
        f"""{fx.with_('corpus', 'talks')}, {LONG_PHRASES},
h AS (SELECT doc_id, replace({norm_sql("text")}, '-', '') AS t FROM corpus
  UNION ALL SELECT -1 - doc_id, replace({norm_sql("string_agg(text, chr(10) ORDER BY page)")}, '-', '') FROM talks GROUP BY doc_id),
n AS (SELECT phrase_id, replace({norm_sql('phrase')}, '-', '') AS n FROM phrases)
SELECT h.doc_id, n.phrase_id FROM n JOIN h ON n.n <> '' AND contains(h.t, n.n)""",
    ),
    "phrase_hits_across_pages": (
        phrase_hits_across_pages,
        f"""{fx.with_('talks')}, {PHRASES},
w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS text FROM talks GROUP BY doc_id),
d AS (SELECT doc_id, {norm_sql('text')} AS t FROM w), p AS (SELECT phrase_id, {norm_sql('phrase')} AS n FROM phrases)
SELECT doc_id, phrase_id FROM d JOIN p ON n <> '' AND (contains(t, n) OR (replace(n, '-', '') <> '' AND contains(replace(t, '-', ''), replace(n, '-', ''))))""",
    ),
    "requested_hits": (
        requested_hits,
        f"""{fx.with_('talks')}, {REQUESTS},
w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS text FROM talks GROUP BY doc_id),
d AS (SELECT doc_id, {norm_sql('text')} AS t FROM w)
SELECT r.doc_id, r.ord, r.phrase FROM requests r JOIN d ON d.doc_id = r.doc_id
WHERE {norm_sql('phrase')} <> '' AND (contains(t, {norm_sql('phrase')}) OR (replace({norm_sql('phrase')}, '-', '') <> '' AND contains(replace(t, '-', ''), replace({norm_sql('phrase')}, '-', ''))))""",
    ),
    "phrases_missing_from_source": (
        phrases_missing,
        f"""{fx.with_('talks')}, {REQUESTS},
w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS text FROM talks GROUP BY doc_id),
d AS (SELECT doc_id, replace({norm_sql('text')}, '-', '') AS t FROM w)
SELECT r.doc_id, r.ord, r.phrase FROM requests r JOIN d ON d.doc_id = r.doc_id
WHERE replace({norm_sql('phrase')}, '-', '') = '' OR NOT contains(t, replace({norm_sql('phrase')}, '-', ''))""",
    ),
    "leak_verdict": (
        leak_verdict,
        f"""{fx.with_('talks')}, {REQUESTS}, {AFTER},
b AS (SELECT doc_id, replace({norm_sql("string_agg(text, chr(10) ORDER BY page)")}, '-', '') AS t FROM talks GROUP BY doc_id),
a AS (SELECT doc_id, replace({norm_sql("string_agg(text, chr(10) ORDER BY page)")}, '-', '') AS t FROM after GROUP BY doc_id),
r AS (SELECT doc_id, phrase, min(ord) AS ord, replace({norm_sql('phrase')}, '-', '') AS n FROM requests WHERE doc_id % 10 <> 7 GROUP BY doc_id, phrase),
j AS (SELECT r.*, n <> '' AND contains(a.t, n) AS found, n <> '' AND contains(b.t, n) AS known
  FROM r JOIN a ON a.doc_id = r.doc_id JOIN b ON b.doc_id = r.doc_id),
v AS (SELECT doc_id, coalesce(string_agg(CASE WHEN found THEN phrase END, '|' ORDER BY ord), '') AS found,
  count(*) FILTER (WHERE NOT known) AS n_missing, bool_and(known) AND NOT bool_or(found) AS clean FROM j GROUP BY doc_id)
SELECT b.doc_id, coalesce(found, '') AS found, coalesce(n_missing, 0) AS n_missing, coalesce(clean, false) AS clean
FROM b LEFT JOIN v ON v.doc_id = b.doc_id""",
    ),
    "annotation_text": (
        annotation_text,
        """WITH parts AS (
  SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, CAST(turn AS INT) AS seq,
    list_concat(CASE WHEN turn % 2 = 0 THEN [role, '', text] ELSE [] END, CASE WHEN turn % 3 = 0 THEN ['default'] ELSE [] END,
      [CASE WHEN turn % 4 = 1 THEN 'On' END, role || '.' || turn, CASE WHEN turn % 5 = 0 THEN 'http://a.example/' END, right(text, 20), role],
      CASE WHEN turn % 2 = 1 THEN ['y', 'Yes', text] ELSE [] END) AS l FROM conversations)
SELECT doc_id, page, seq, array_to_string(list_filter(l, lambda x: length(x) > 0), chr(10)) AS text FROM parts""",
    ),
    "metadata_text": (
        metadata_text,
        """SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || source ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '<x>' || lang || '</x>' ELSE '' END AS text FROM documents""",
    ),
    "residual_text": (
        residual_text,
        f"""{fx.with_('talks')} SELECT doc_id, page, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN (page - 1) % 4 = 0 THEN 'clean'
  WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 'survived' ELSE 'clean' END AS "check" FROM talks WHERE page % 2 = 1""",
    ),
    "validate_boxes": (validate_boxes, f"{_B} SELECT * FROM good"),
    "rejected_boxes": (rejected_boxes, f"{_B} SELECT * FROM faults WHERE reason IS NOT NULL"),
    "clip_boxes": (clip_boxes, f"{_B} SELECT doc_id, page_index, x, y, width, height FROM clipped"),
    "plan_redaction": (plan_redaction, f"{_B} SELECT * FROM plan"),
    "pixel_rects": (
        pixel_rects,
        f"""{_B}, s AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 200.0::DOUBLE ELSE least(greatest(doc_id % 5 * 150, 72), 400)::DOUBLE END / 72 AS k FROM clipped),
r AS (SELECT doc_id, page_index, floor(x * k) AS l, floor(y * k) AS t, least(floor(vw * k), ceil((x + width) * k)) AS r,
  least(floor(vh * k), ceil((y + height) * k)) AS b FROM s)
SELECT doc_id, page_index, CAST(l AS BIGINT) AS px, CAST(t AS BIGINT) AS py, CAST(r - l AS BIGINT) AS pw, CAST(b - t AS BIGINT) AS ph,
  CAST(NULL AS VARCHAR) AS reason FROM r WHERE r > l AND b > t""",
    ),
    "redaction_cost": (
        redaction_cost,
        f"""{_B}, h AS (SELECT doc_id, count(*) AS n FROM plan WHERE action = 'paint' GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_hit, n_pages - coalesce(n, 0) AS n_kept,
  CAST(round(coalesce(n, 0) * 1700 * 2200 * 0.12) AS BIGINT) AS rough_bytes, coalesce(n, 0) > 120 AS slow
FROM doc_pages d LEFT JOIN h ON h.doc_id = d.doc_id""",
    ),
    "redact_pages": (
        redact_pages,
        f"""{_B} SELECT t.doc_id, t.page, md5(CASE WHEN p.action = 'paint' THEN '' ELSE t.text END) AS digest
FROM talks t LEFT JOIN plan p ON p.doc_id = t.doc_id AND p.page_index = t.page - 1""",
    ),
    "redact_annotations": (
        redact_annotations,
        f"""{_B} SELECT t.doc_id, t.page, CAST(t.page - 1 AS INT) AS seq, false AS fillable
FROM talks t LEFT JOIN plan p ON p.doc_id = t.doc_id AND p.page_index = t.page - 1 WHERE coalesce(p.action, '') <> 'paint'""",
    ),
    "excise_runs": (
        excise_runs,
        rf"""{fx.with_('runs')}, base AS (
  SELECT doc_id, page, seq * 2 AS seq, str, x AS px, y + font_size AS py, seq % 13 <> 0 AS placed FROM runs WHERE str <> ''),
laid AS (SELECT * FROM base UNION ALL SELECT doc_id, page, seq + 1, str, px + 1, py, true FROM base WHERE seq % 202 = 0),
linked AS (SELECT *, NOT coalesce(lead(placed) OVER (PARTITION BY doc_id, page ORDER BY seq), true) AS leaning FROM laid),
targets AS (
  SELECT doc_id, page, seq AS target, x + CASE WHEN seq % 5 = 0 THEN 2.0 ELSE 0.75 END AS tx, y + font_size - 0.5 AS ty,
    CASE WHEN seq % 11 = 0 THEN ' ' WHEN seq % 6 = 0 THEN 'other' ELSE left(str, 1) || ' ' || substr(str, 2) END AS text
  FROM runs WHERE seq % 7 = 3 AND str <> ''),
found AS (
  SELECT t.doc_id, t.page, t.target, any_value(t.text) AS text, count(l.seq) AS n, min(l.seq) AS seq, bool_or(l.leaning) AS leaning, min(l.str) AS str
  FROM targets t LEFT JOIN linked l ON l.doc_id = t.doc_id AND l.page = t.page AND l.placed AND l.px BETWEEN t.tx - 1.5 AND t.tx + 1.5
    AND sqrt((l.px - t.tx) * (l.px - t.tx) + (l.py - t.ty) * (l.py - t.ty)) <= 1.5
  GROUP BY t.doc_id, t.page, t.target),
judged AS (
  SELECT *, CASE WHEN trim(text) = '' THEN 'no-text' WHEN n = 0 THEN 'no-run-there' WHEN n > 1 THEN 'several-runs-there'
    WHEN leaning THEN 'next-run-would-slide' WHEN regexp_replace(str, '\s+', '', 'g') <> regexp_replace(text, '\s+', '', 'g') THEN 'says-something-else' END AS reason FROM found)
SELECT doc_id, page, target, CASE WHEN reason IS NULL THEN seq END AS seq, reason FROM judged""",
    ),
    "page_survived": (
        page_survived,
        rf"""{fx.with_('corpus')}, p AS (SELECT doc_id, text AS before, split_part(text, ' ', 3) AS removed FROM corpus),
c AS (SELECT *, CASE WHEN doc_id % 3 = 0 OR removed = '' THEN before
    WHEN doc_id % 3 = 1 THEN left(before, CAST(instr(before, removed) - 1 AS INT)) || '  ' || substr(before, CAST(instr(before, removed) + length(removed) AS INT))
    ELSE left(before, length(before) - 1 - length(removed)) END AS after FROM p),
f AS (SELECT doc_id, {_FLAT.format('before')} AS s, {_FLAT.format('after')} AS r, {_FLAT.format('removed')} AS n FROM c),
-- Only a cut where the first difference falls can work: its start lies within one copy of the shared prefix.
o AS (SELECT *, unnest(list_filter(range(1, length(s) + 1), lambda i: n <> '' AND substr(s, CAST(i AS INT), length(n)) = n)) AS i FROM f WHERE length(s) - length(r) BETWEEN 0 AND length(n) + 2)
SELECT f.doc_id, coalesce(bool_or(trim(regexp_replace(left(o.s, CAST(i - 1 AS INT)) || substr(o.s, CAST(i + length(o.n) AS INT)), '\s+', ' ', 'g')) = o.r), false) AS survived
FROM f LEFT JOIN o ON o.doc_id = f.doc_id GROUP BY f.doc_id""",
    ),
}
