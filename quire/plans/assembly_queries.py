"""Queries over page assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import assembly as asm
from quire.sources import fixtures as fx
from quire.sources.tables import table

def _now():
    return F.timestamp_seconds(F.lit(1717200000))


_REPORT = ["out_doc", "position", "src_doc", "src_page", "rotation", "width", "height"]


def _report(outcome, extra=()):
    """Manifest rows and refusals in one table."""
    kept = outcome.manifest.select(
        *[F.col(c).cast("long") if c not in ("width", "height") else F.col(c) for c in _REPORT],
        *extra, F.lit(None).cast("string").alias("reason"),
    )
    return kept.unionByName(outcome.rejected, allowMissingColumns=True)


def _talk(spark, folder, **columns):
    """Conversation rows with their page count ``n`` and derived columns."""
    t = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    sizes = t.groupBy("conv_id").agg(F.count("*").alias("n"))
    return t.join(sizes, "conv_id")


TALK = "talk AS (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
_W = f"{fx.with_('manifest')}, {TALK}"


def _selected(spark, folder):
    return table(spark, folder, "conversations").where("(conv_id * 7 + turn * 3) % 4 = 0").selectExpr(
        "conv_id AS out_doc",
        "int(turn + CASE WHEN conv_id % 13 = 0 THEN 100 ELSE 0 END) AS page_index",
        "int(CASE WHEN conv_id % 11 = 0 THEN 45 ELSE 90 * (conv_id % 5 - 2) END) AS turn",
    )


SELECTED = """sel AS (
  SELECT conv_id AS out_doc, turn + CASE WHEN conv_id % 13 = 0 THEN 100 ELSE 0 END AS page_index,
    CASE WHEN conv_id % 11 = 0 THEN 45 ELSE 90 * (conv_id % 5 - 2) END AS turn
  FROM conversations WHERE (conv_id * 7 + turn * 3) % 4 = 0)"""


def specs(spark, folder):
    cases = ["1-3, 7, 9-", "ALL", "-2;3 to 1", "2–", "0,1,99", "x, 3abc, +2", "5-1", " , "]
    listed = F.array(*[F.lit(c) for c in cases])
    return _talk(spark, folder).select(
        F.col("conv_id").alias("doc_id"),
        F.get(listed, (F.col("conv_id") % len(cases)).cast("int")).alias("spec"),
        F.col("n").alias("n_pages"),
    ).distinct()


PARSED = """parsed AS (
  SELECT conv_id AS doc_id, turn AS page_index FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE CASE conv_id % 8
    WHEN 0 THEN turn < 3 OR turn = 6 OR turn + 1 >= least(9, n) WHEN 1 THEN true WHEN 2 THEN turn < 3 WHEN 3 THEN turn >= 1
    WHEN 4 THEN turn = 0 WHEN 5 THEN turn IN (1, 2) WHEN 6 THEN turn < 5 ELSE false END)"""


def parse_ranges(spark, folder):
    return asm.parse_ranges(specs(spark, folder)).select("doc_id", "page_index")


def format_ranges(spark, folder):
    picked = table(spark, folder, "conversations").where("conv_id % 6 <> 0 AND (conv_id + turn * turn) % 4 <> 1")
    docs = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return asm.format_ranges(docs, picked.selectExpr("conv_id AS doc_id", "turn AS page_index"))


def rotate_pages(spark, folder):
    """Some documents are asked for two turns of one page."""
    asked = _selected(spark, folder)
    again = asked.where("out_doc % 17 = 4").withColumn("turn", F.col("turn") + 90)
    return _report(asm.rotate_pages(fx.manifest(spark, folder), asked.unionByName(again)))


def _doomed(spark, folder):
    return table(spark, folder, "conversations").where(
        "(conv_id * 7 + turn * 3) % 4 = 0 OR conv_id % 9 = 0"
    ).selectExpr("conv_id AS out_doc", "int(turn + CASE WHEN conv_id % 13 = 0 THEN 100 ELSE 0 END) AS page_index")


def delete_pages(spark, folder):
    return _report(asm.delete_pages(fx.manifest(spark, folder), _doomed(spark, folder)))


def duplicate_pages(spark, folder):
    return _report(asm.duplicate_pages(fx.manifest(spark, folder), _doomed(spark, folder)))


def reorder_pages(spark, folder):
    order = _talk(spark, folder).where("NOT (conv_id % 10 = 1 AND turn = n - 1)").selectExpr(
        "conv_id AS out_doc",
        "int(turn) AS position",
        "int(CASE conv_id % 10 WHEN 0 THEN turn % 2 WHEN 2 THEN turn + 1 ELSE (turn + 1 + conv_id % 3) % n END) AS old",
    )
    return _report(asm.reorder_pages(fx.manifest(spark, folder), order))


def move_page(spark, folder):
    moves = _talk(spark, folder).where("turn = 0 OR turn = 1 AND conv_id % 16 = 3").selectExpr(
        "conv_id AS out_doc",
        "int(CASE WHEN conv_id % 8 = 0 THEN 99 ELSE conv_id % n END) AS src",
        "int(CASE WHEN conv_id % 8 = 1 THEN -1 ELSE (conv_id * 3 + 1) % n END) AS dst",
    )
    return _report(asm.move_page(fx.manifest(spark, folder), moves))


def extract_pages(spark, folder):
    picks = _talk(spark, folder).selectExpr(
        "conv_id AS out_doc", "int(turn) AS ord",
        "int(CASE WHEN conv_id % 12 = 0 THEN -1 ELSE (turn * 5 + conv_id) % (n + 1) END) AS page_index",
    )
    return _report(asm.extract_pages(fx.manifest(spark, folder), picks))


def insert_blank(spark, folder):
    asked = _talk(spark, folder).where("turn = 0 OR turn = 1 AND conv_id % 16 = 5").selectExpr(
        "conv_id AS out_doc",
        "int(conv_id % (n + 2)) AS at",
        "CASE WHEN conv_id % 4 < 2 THEN 300.0D END AS new_width",
        "CASE WHEN conv_id % 4 = 0 THEN 200.0D END AS new_height",
    )
    return _report(asm.insert_blank(fx.manifest(spark, folder), asked))


def reverse_pages(spark, folder):
    return asm.reverse_pages(fx.manifest(spark, folder)).select("out_doc", "position", "src_page")


def merge_inputs(spark, folder):
    return table(spark, folder, "conversations").where("turn = 0").selectExpr(
        "conv_id div 3 AS out_doc",
        "int(conv_id % 3) AS input_ord",
        "CASE WHEN conv_id % 37 = 7 THEN -1L ELSE conv_id END AS src_doc",
        "concat('talk-', conv_id) AS name",
        "CASE WHEN conv_id % 29 = 5 THEN array(0, 99) WHEN conv_id % 31 = 6 THEN cast(array() AS array<int>) "
        "WHEN conv_id % 4 = 1 THEN array(1, 0, 1) WHEN conv_id % 4 = 3 THEN array(0) END AS pages",
    )


MERGE = """inputs AS (
  SELECT conv_id // 3 AS out_doc, conv_id % 3 AS input_ord, CASE WHEN conv_id % 37 = 7 THEN -1 ELSE conv_id END AS src_doc, 'talk-' || conv_id AS name,
    CASE WHEN conv_id % 29 = 5 THEN 'bad' WHEN conv_id % 31 = 6 THEN 'none' WHEN conv_id % 4 = 1 THEN 'two' WHEN conv_id % 4 = 3 THEN 'one' ELSE 'all' END AS take
  FROM conversations WHERE turn = 0),
sized AS (SELECT i.*, coalesce(t.n, 0) AS n FROM inputs i LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) t ON t.conv_id = i.src_doc),
verdicts AS (
  SELECT out_doc, CASE WHEN count(*) < 2 THEN 'needs-two-inputs' ELSE
    arg_min(CASE WHEN n = 0 THEN 'no-pages: ' || name WHEN take = 'none' THEN 'nothing-picked: ' || name WHEN take = 'bad' THEN 'no-such-page: ' || name END,
            CASE WHEN n = 0 OR take IN ('none', 'bad') THEN input_ord END) END AS reason
  FROM sized GROUP BY out_doc)"""


def merge_docs(spark, folder):
    return _report(asm.merge_docs(merge_inputs(spark, folder), fx.manifest(spark, folder)))


def merge_sources(spark, folder):
    return asm.merge_sources(merge_inputs(spark, folder), fx.manifest(spark, folder)).selectExpr(
        "out_doc", "input_ord", "name", "bigint(n_taken) AS n_taken"
    )


def _cuts(spark, folder):
    return table(spark, folder, "conversations").where("(conv_id + turn) % 3 = 0").selectExpr(
        "conv_id AS out_doc", "explode(array(int(turn), int(turn), -1, 99)) AS cut"
    )


CUT = """marked AS (
  SELECT m.*, (out_doc + position) % 3 = 0 AND position < count(*) OVER (PARTITION BY out_doc) - 1 AS is_cut FROM manifest m),
numbered AS (
  SELECT *, coalesce(sum(is_cut::INT) OVER (PARTITION BY out_doc ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part,
    (sum(is_cut::INT) OVER (PARTITION BY out_doc) + 1)::BIGINT AS n_parts FROM marked),
parts AS (SELECT out_doc, part, n_parts, src_page, row_number() OVER (PARTITION BY out_doc, part ORDER BY position) - 1 AS position FROM numbered)"""
_PART = ["out_doc", "part", "n_parts", "position", "src_page"]


def split_at(spark, folder):
    return asm.split_at(fx.manifest(spark, folder), _cuts(spark, folder)).select(
        *[F.col(c).cast("long") for c in _PART]
    )


def split_every(spark, folder):
    sizes = table(spark, folder, "conversations").where("turn = 0 OR turn = 1 AND conv_id % 16 = 6").selectExpr(
        "conv_id AS out_doc", "int(conv_id % 4) AS n"
    )
    out = asm.split_every(fx.manifest(spark, folder), sizes)
    return out.manifest.select(*[F.col(c).cast("long") for c in _PART]).unionByName(
        out.rejected, allowMissingColumns=True
    )


def split_by_ranges(spark, folder):
    groups = _talk(spark, folder).where("turn = 0").selectExpr(
        "conv_id AS out_doc",
        """inline(array(named_struct('part', 0, 'pages', array(1, 0, 1)),
             named_struct('part', 1, 'pages', CASE conv_id % 6 WHEN 0 THEN cast(array() AS array<int>)
               WHEN 1 THEN array(0, 99) ELSE array(int(n - 1), 0) END)))""",
    )
    out = asm.split_by_ranges(fx.manifest(spark, folder), groups)
    return out.manifest.select(*[F.col(c).cast("long") for c in _PART]).unionByName(
        out.rejected, allowMissingColumns=True
    )


def range_groups(spark, folder):
    return asm.range_groups(specs(spark, folder)).select(
        "out_doc", F.col("part").cast("long").alias("part"),
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
    )


def _parts(spark, folder):
    return table(spark, folder, "documents").selectExpr(
        "doc_id AS out_doc",
        "CASE doc_id % 4 WHEN 0 THEN 'My: Lease?.PDF' WHEN 1 THEN concat(' a/b  - c ', source, '.pdf') "
        "WHEN 2 THEN '.pdf' ELSE replace(text, '\\n', ' ') END AS base",
        "int(doc_id % 12 + 1) AS n_parts",
    ).selectExpr("*", "explode(sequence(0, n_parts - 1)) AS part")


PARTS_IN = r"""base_ AS (
  SELECT doc_id AS out_doc, CASE doc_id % 4 WHEN 0 THEN 'My: Lease?.PDF' WHEN 1 THEN ' a/b  - c ' || source || '.pdf'
    WHEN 2 THEN '.pdf' ELSE replace(text, chr(10), ' ') END AS base, CAST(doc_id % 12 + 1 AS INT) AS n_parts FROM documents),
parts_in AS (SELECT *, CAST(unnest(range(n_parts)) AS INT) AS part FROM base_)"""


def part_names(spark, folder):
    return asm.part_names(_parts(spark, folder)).select("out_doc", "part", "file_name")


def _meta(spark, folder):
    return table(spark, folder, "documents").selectExpr(
        "doc_id AS out_doc",
        "CASE WHEN doc_id % 3 <> 0 THEN text END AS title",
        "source AS author",
        "CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS subject",
        "'a, b c' AS keywords",
        "CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Writer' END AS creator",
        "timestamp_seconds(n_chars) AS created",
    )


META = """meta AS (
  SELECT doc_id AS out_doc, CASE WHEN doc_id % 3 <> 0 THEN text END AS title, source AS author,
    CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END AS subject, 'a, b c' AS keywords,
    CASE WHEN doc_id % 5 = 0 THEN 'quire' ELSE 'Writer' END AS creator, n_chars AS created_s FROM documents)"""


def _meta_rows(df):
    return df.withColumn("created_s", F.unix_timestamp("created")).withColumn(
        "modified_s", F.unix_timestamp("modified")
    ).drop("created", "modified")


def carry_metadata_split(spark, folder):
    return _meta_rows(asm.carry_metadata_split(_parts(spark, folder), _meta(spark, folder), _now()))


def carry_metadata_merge(spark, folder):
    inputs = table(spark, folder, "documents").selectExpr(
        "doc_id div 4 AS out_doc", "int(3 - doc_id % 4) AS input_ord", "doc_id AS src_doc"
    )
    return _meta_rows(asm.carry_metadata_merge(inputs, _meta(spark, folder), _now()))


def carry_metadata_edit(spark, folder):
    return _meta_rows(asm.carry_metadata_edit(_meta(spark, folder), _now())).select(
        "out_doc", "title", "author", "keywords", "created_s", "modified_s"
    )


def unique_names(spark, folder):
    names = table(spark, folder, "documents").selectExpr(
        "doc_id % 10 AS archive", "doc_id AS seq",
        "concat('scan', doc_id div 10 % 5, CASE doc_id % 10 WHEN 0 THEN CASE doc_id div 50 % 4 WHEN 1 THEN '-2' WHEN 2 THEN '-2-2' ELSE '' END ELSE '' END, "
        "CASE WHEN doc_id % 10 = 3 THEN '' ELSE '.png' END) AS name",
    )
    return asm.unique_names(names)


def unique_names_archive(spark, folder):
    """One archive of a hundred names a document: equal ones, and forms of them that are wanted as well."""
    names = table(spark, folder, "documents").selectExpr("doc_id", "explode(sequence(0, 99)) AS j").selectExpr(
        "1 AS archive", "doc_id * 100 + j AS seq",
        "CASE WHEN doc_id * 100 + j = 40 THEN 'a-5000.png' WHEN j = 50 THEN 'a-2.png' ELSE 'a.png' END AS name",
    )
    return asm.unique_names(names)


def relink(spark, folder):
    parts = asm.split_at(fx.manifest(spark, folder), _cuts(spark, folder)).withColumn(
        "out_doc", F.col("out_doc") * 100 + F.col("part")
    )
    sizes = asm.totals(fx.manifest(spark, folder)).withColumnRenamed("out_doc", "src_doc")
    links = parts.join(sizes, "src_doc").selectExpr(
        "out_doc", "src_page AS link", "src_doc", "int((src_page + 1) % n_pages) AS target"
    )
    return asm.relink(links, parts).selectExpr(
        "out_doc", "link", "target", "bigint(new_target) AS new_target"
    )


def page_ceiling(spark, folder):
    return asm.page_ceiling(fx.manifest(spark, folder), limit=6)


def plan_image_pages(spark, folder):
    t = table(spark, folder, "conversations")
    images = t.selectExpr(
        "conv_id AS out_doc", "int(turn) AS seq", "double(100 + turn * 37 % 300) AS width",
        "double(80 + conv_id * 53 % 500) AS height", "int(turn % 4 * 90) AS turn", "length(text) * 200000L AS n_bytes",
    )
    requests = t.where("turn = 0").selectExpr(
        "conv_id AS out_doc",
        "CASE conv_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'a4' ELSE 'letter' END AS page_size",
        "CASE conv_id % 7 WHEN 0 THEN -1.0D WHEN 1 THEN 300.0D ELSE 36.0D END AS margin",
    )
    out = asm.plan_image_pages(images, requests)
    rounded = [F.round(c, 6).alias(c) for c in ("page_width", "page_height", "x", "y", "width", "height")]
    return out.manifest.select("out_doc", "position", *rounded).unionByName(
        out.rejected, allowMissingColumns=True
    )


QUERIES = {
    "parse_ranges": (parse_ranges, f"WITH {PARSED} SELECT * FROM parsed"),
    "format_ranges": (
        format_ranges,
        """WITH sel AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations
  WHERE conv_id % 6 <> 0 AND (conv_id + turn * turn) % 4 <> 1),
isl AS (SELECT conv_id, min(turn) AS a, max(turn) AS b FROM sel GROUP BY conv_id, g),
txt AS (SELECT conv_id, string_agg(CASE WHEN a = b THEN (a + 1)::VARCHAR ELSE (a + 1) || '-' || (b + 1) END, ', ' ORDER BY a) AS t FROM isl GROUP BY conv_id)
SELECT d.conv_id AS doc_id, coalesce(t, 'none') AS ranges FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN txt ON txt.conv_id = d.conv_id""",
    ),
    "rotate_pages": (
        rotate_pages,
        f"""{_W}, {SELECTED}, v AS (SELECT out_doc, CASE WHEN any_value(turn) % 90 <> 0 THEN 'not-a-quarter-turn'
  WHEN out_doc % 17 = 4 THEN 'conflicting-turns' WHEN out_doc % 13 = 0 THEN 'no-pages-selected' END AS reason FROM sel GROUP BY out_doc)
SELECT m.out_doc, position, src_doc, src_page, (rotation + coalesce(s.turn, 0) + 720) % 360 AS rotation, width, height, NULL AS reason
FROM manifest m JOIN v ON v.out_doc = m.out_doc AND v.reason IS NULL LEFT JOIN sel s ON s.out_doc = m.out_doc AND s.page_index = m.position
UNION ALL SELECT out_doc, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM v WHERE reason IS NOT NULL""",
    ),
    "delete_pages": (
        delete_pages,
        f"""{_W}, marked AS (SELECT m.*, (out_doc * 7 + position * 3) % 4 = 0 OR out_doc % 9 = 0 AS hit FROM manifest m),
v AS (SELECT out_doc, CASE WHEN out_doc % 13 = 0 THEN 'no-pages-selected' WHEN bool_and(hit) THEN 'would-delete-everything' END AS reason
  FROM marked GROUP BY out_doc HAVING bool_or(hit))
SELECT m.out_doc, row_number() OVER (PARTITION BY m.out_doc ORDER BY position) - 1 AS position, src_doc, src_page, rotation, width, height, NULL AS reason
FROM marked m JOIN v ON v.out_doc = m.out_doc AND v.reason IS NULL WHERE NOT hit
UNION ALL SELECT out_doc, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM v WHERE reason IS NOT NULL""",
    ),
    "duplicate_pages": (
        duplicate_pages,
        f"""{_W}, marked AS (SELECT m.*, (out_doc * 7 + position * 3) % 4 = 0 OR out_doc % 9 = 0 AS hit FROM manifest m),
v AS (SELECT out_doc, CASE WHEN out_doc % 13 = 0 THEN 'no-pages-selected' END AS reason FROM marked GROUP BY out_doc HAVING bool_or(hit)),
c AS (SELECT m.*, unnest(CASE WHEN hit THEN [0, 1] ELSE [0] END) AS copy FROM marked m JOIN v ON v.out_doc = m.out_doc AND v.reason IS NULL)
SELECT out_doc, row_number() OVER (PARTITION BY out_doc ORDER BY position, copy) - 1 AS position, src_doc, src_page, rotation, width, height, NULL AS reason FROM c
UNION ALL SELECT out_doc, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM v WHERE reason IS NOT NULL""",
    ),
    "reorder_pages": (
        reorder_pages,
        f"""{_W}, o AS (SELECT conv_id AS out_doc, turn AS position, n,
  CASE conv_id % 10 WHEN 0 THEN turn % 2 WHEN 2 THEN turn + 1 ELSE (turn + 1 + conv_id % 3) % n END AS old
  FROM talk WHERE NOT (conv_id % 10 = 1 AND turn = n - 1)),
v AS (SELECT out_doc, CASE WHEN count(*) <> any_value(n) THEN 'wrong-length' WHEN max(old) >= any_value(n) THEN 'no-such-page'
  WHEN count(DISTINCT old) < count(*) THEN 'page-used-twice' END AS reason FROM o GROUP BY out_doc)
SELECT m.out_doc, o.position, src_doc, src_page, rotation, width, height, NULL AS reason
FROM manifest m JOIN v ON v.out_doc = m.out_doc AND v.reason IS NULL JOIN o ON o.out_doc = m.out_doc AND o.old = m.position
UNION ALL SELECT out_doc, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM v WHERE reason IS NOT NULL""",
    ),
    "move_page": (
        move_page,
        f"""{_W}, mv AS (SELECT conv_id AS out_doc, n, CASE WHEN conv_id % 8 = 0 THEN 99 ELSE conv_id % n END AS src,
  CASE WHEN conv_id % 8 = 1 THEN -1 ELSE (conv_id * 3 + 1) % n END AS dst FROM talk WHERE turn = 0),
v AS (SELECT *, CASE WHEN out_doc % 16 = 3 AND n > 1 THEN 'more-than-one-request' WHEN src >= n THEN 'no-such-page' WHEN dst < 0 THEN 'no-such-place' END AS reason FROM mv),
keyed AS (SELECT m.*, CASE WHEN m.position = src THEN dst + CASE WHEN dst > src THEN 0.5 ELSE -0.5 END ELSE m.position END AS k
  FROM manifest m JOIN v ON v.out_doc = m.out_doc AND v.reason IS NULL)
SELECT out_doc, row_number() OVER (PARTITION BY out_doc ORDER BY k) - 1 AS position, src_doc, src_page, rotation, width, height, NULL AS reason FROM keyed
UNION ALL SELECT out_doc, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM v WHERE reason IS NOT NULL""",
    ),
    "extract_pages": (
        extract_pages,
        f"""{_W}, p AS (SELECT conv_id AS out_doc, turn AS ord, n, CASE WHEN conv_id % 12 = 0 THEN -1 ELSE (turn * 5 + conv_id) % (n + 1) END AS page_index FROM talk),
v AS (SELECT out_doc, CASE WHEN NOT bool_or(page_index BETWEEN 0 AND n - 1) THEN 'no-pages-selected' END AS reason FROM p GROUP BY out_doc)
SELECT m.out_doc, row_number() OVER (PARTITION BY m.out_doc ORDER BY p.ord) - 1 AS position, src_doc, src_page, rotation, width, height, NULL AS reason
FROM p JOIN manifest m ON m.out_doc = p.out_doc AND m.position = p.page_index
UNION ALL SELECT out_doc, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM v WHERE reason IS NOT NULL""",
    ),
    "insert_blank": (
        insert_blank,
        f"""{_W}, q AS (SELECT conv_id AS out_doc, n, conv_id % (n + 2) AS spot, CASE WHEN conv_id % 16 = 5 AND n > 1 THEN 'more-than-one-request' WHEN conv_id % (n + 2) > n THEN 'no-such-place' WHEN conv_id % 4 = 1 THEN 'bad-size' END AS reason
  FROM talk WHERE turn = 0)
SELECT m.out_doc, position + (position >= spot)::INT AS position, src_doc, src_page, rotation, width, height, NULL AS reason
FROM manifest m JOIN q ON q.out_doc = m.out_doc AND q.reason IS NULL
UNION ALL SELECT m.out_doc, spot, NULL, NULL, CASE WHEN m.out_doc % 4 = 0 THEN 0 ELSE rotation END, CASE WHEN m.out_doc % 4 = 0 THEN 300 ELSE width END,
  CASE WHEN m.out_doc % 4 = 0 THEN 200 ELSE height END, NULL
FROM manifest m JOIN q ON q.out_doc = m.out_doc AND q.reason IS NULL AND m.position = least(spot, n - 1)
UNION ALL SELECT out_doc, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM q WHERE reason IS NOT NULL""",
    ),
    "reverse_pages": (
        reverse_pages,
        f"""{_W} SELECT out_doc, CAST(row_number() OVER (PARTITION BY out_doc ORDER BY position DESC) - 1 AS INT) AS position, src_page FROM manifest""",
    ),
    "merge_docs": (
        merge_docs,
        f"""{_W}, {MERGE}
SELECT s.out_doc, row_number() OVER (PARTITION BY s.out_doc ORDER BY s.input_ord, m.position) - 1 AS position, m.src_doc, m.src_page, m.rotation, m.width, m.height, NULL AS reason
FROM sized s JOIN verdicts v ON v.out_doc = s.out_doc AND v.reason IS NULL
JOIN manifest m ON m.out_doc = s.src_doc AND (take = 'all' OR (take = 'two' AND m.position IN (0, 1)) OR (take = 'one' AND m.position = 0))
UNION ALL SELECT out_doc, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM verdicts WHERE reason IS NOT NULL""",
    ),
    "merge_sources": (
        merge_sources,
        f"""{_W}, {MERGE} SELECT out_doc, CAST(input_ord AS INT) AS input_ord, name,
  CASE take WHEN 'bad' THEN 2 WHEN 'none' THEN 0 WHEN 'two' THEN 2 WHEN 'one' THEN 1 ELSE n END AS n_taken FROM sized""",
    ),
    "split_at": (split_at, f"{_W}, {CUT} SELECT out_doc, part, n_parts, position, src_page FROM parts"),
    "split_every": (
        split_every,
        f"""{_W}, twice AS (SELECT out_doc FROM manifest WHERE out_doc % 16 = 6 GROUP BY out_doc HAVING count(*) > 1)
SELECT out_doc, position // (out_doc % 4) AS part, ceil(count(*) OVER (PARTITION BY out_doc) / (out_doc % 4))::BIGINT AS n_parts,
  position % (out_doc % 4) AS position, src_page, NULL AS reason FROM manifest WHERE out_doc % 4 > 0 AND out_doc NOT IN (SELECT out_doc FROM twice)
UNION ALL SELECT out_doc, NULL, NULL, NULL, NULL, 'more-than-one-request' FROM twice
UNION ALL SELECT DISTINCT out_doc, NULL, NULL, NULL, NULL, 'bad-size' FROM manifest WHERE out_doc % 4 = 0""",
    ),
    "split_by_ranges": (
        split_by_ranges,
        f"""{_W}, g AS (SELECT DISTINCT conv_id AS out_doc, 0 AS part, unnest([0, 1]) AS p FROM talk WHERE conv_id % 6 > 1
  UNION SELECT conv_id, 1, unnest([0, n - 1]) FROM talk WHERE conv_id % 6 > 1)
SELECT g.out_doc, g.part, 2 AS n_parts, row_number() OVER (PARTITION BY g.out_doc, g.part ORDER BY g.p) - 1 AS position, m.src_page, NULL AS reason
FROM g JOIN manifest m ON m.out_doc = g.out_doc AND m.position = g.p
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, CASE WHEN conv_id % 6 = 0 THEN 'empty-part' ELSE 'missing-page' END FROM talk WHERE conv_id % 6 <= 1""",
    ),
    "range_groups": (
        range_groups,
        f"""WITH {TALK}, pieces AS (
  SELECT conv_id, turn, n, unnest(CASE conv_id % 8 WHEN 0 THEN [0, 1, 2] WHEN 2 THEN [0, 1] WHEN 5 THEN [1, 2] ELSE [0] END) AS i FROM talk),
hit AS (
  SELECT conv_id, i, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS pages FROM pieces WHERE CASE conv_id % 8
    WHEN 0 THEN (i = 0 AND turn < 3) OR (i = 1 AND turn = 6) OR (i = 2 AND turn + 1 >= least(9, n))
    WHEN 1 THEN true WHEN 2 THEN (i = 0 AND turn < 2) OR (i = 1 AND turn < 3) WHEN 3 THEN turn >= 1 WHEN 4 THEN turn = 0
    WHEN 5 THEN (i = 1 AND turn = 2) OR (i = 2 AND turn = 1) WHEN 6 THEN turn < 5 ELSE false END GROUP BY conv_id, i)
SELECT conv_id AS out_doc, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS part, pages FROM hit""",
    ),
    "part_names": (
        part_names,
        rf"""WITH {PARTS_IN}, s AS (SELECT *, coalesce(nullif(left(regexp_replace(regexp_replace(base, '(?i)\.pdf$', ''), '[\\/:*?"<>|]+', '-', 'g'), 120), ''), 'document') AS a FROM parts_in),
t AS (SELECT *, left(regexp_replace(regexp_replace(a, '[\s-]+', '-', 'g'), '^-+|-+$', '', 'g'), 100) AS b FROM s)
SELECT out_doc, part, coalesce(nullif(b, ''), 'document') || '-' || lpad((part + 1)::VARCHAR, CAST(length(n_parts::VARCHAR) AS INT), '0') || '.pdf' AS file_name FROM t""",
    ),
    "carry_metadata_split": (
        carry_metadata_split,
        f"""WITH {PARTS_IN}, {META} SELECT p.out_doc, p.part, coalesce(title, base) || ' (part ' || (part + 1) || ' of ' || n_parts || ')' AS title,
  author, subject, keywords, creator, 'quire' AS producer, created_s, 1717200000 AS modified_s FROM parts_in p JOIN meta m ON m.out_doc = p.out_doc""",
    ),
    "carry_metadata_merge": (
        carry_metadata_merge,
        f"""WITH {META}, f AS (SELECT doc_id // 4 AS out_doc, max(doc_id) AS src FROM documents GROUP BY doc_id // 4)
SELECT f.out_doc, title, author, subject, keywords, creator, 'quire' AS producer, created_s, 1717200000 AS modified_s FROM f JOIN meta m ON m.out_doc = f.src""",
    ),
    "carry_metadata_edit": (
        carry_metadata_edit,
        f"WITH {META} SELECT out_doc, title, author, keywords, created_s, 1717200000 AS modified_s FROM meta",
    ),
    "unique_names": (
        unique_names,
        r"""WITH RECURSIVE names AS (
  SELECT doc_id % 10 AS archive, doc_id AS seq, doc_id // 10 AS i, 'scan' || (doc_id // 10 % 5) AS root,
    CASE doc_id % 10 WHEN 0 THEN CASE doc_id // 50 % 4 WHEN 1 THEN '-2' WHEN 2 THEN '-2-2' ELSE '' END ELSE '' END AS tail,
    CASE WHEN doc_id % 10 = 3 THEN '' ELSE '.png' END AS ext FROM documents),
walk AS (
  SELECT archive, seq, i, root || tail || ext AS unique_name, [root || tail || ext] AS used FROM names WHERE i = 0
  UNION ALL
  SELECT archive, seq, i, pick, list_append(used, pick) FROM (
    SELECT n.archive, n.seq, n.i, w.used, CASE WHEN NOT list_contains(w.used, n.root || n.tail || n.ext) THEN n.root || n.tail || n.ext
      ELSE n.root || n.tail || '-' || list_filter(range(2, len(w.used) + 3), lambda k: NOT list_contains(w.used, n.root || n.tail || '-' || k || n.ext))[1] || n.ext END AS pick
    FROM walk w JOIN names n ON n.archive = w.archive AND n.i = w.i + 1))
SELECT archive, seq, unique_name FROM walk""",
    ),
    # The second a.png takes a-2.png before any row wants it; a-5000.png is wanted long before the count gets there.
    "unique_names_archive": (
        unique_names_archive,
        r"""WITH n AS (SELECT doc_id * 100 + j AS seq,
    CASE WHEN doc_id * 100 + j = 40 THEN 'a-5000' WHEN j = 50 THEN 'a-2' ELSE 'a' END AS stem
  FROM documents, range(100) AS t(j)),
c AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY seq) AS k FROM n)
SELECT 1 AS archive, seq, CASE stem WHEN 'a-5000' THEN stem WHEN 'a-2' THEN stem || '-' || (k + 1)
  ELSE CASE WHEN k = 1 THEN stem WHEN k < 5000 THEN stem || '-' || k ELSE stem || '-' || (k + 1) END END || '.png' AS unique_name FROM c""",
    ),
    "relink": (
        relink,
        f"""{_W}, {CUT}, pl AS (SELECT out_doc * 100 + part AS doc, out_doc, src_page, position FROM parts),
l AS (SELECT doc, pl.out_doc, src_page AS link, (src_page + 1) % n AS target FROM pl JOIN (SELECT DISTINCT conv_id, n FROM talk) t ON t.conv_id = pl.out_doc)
SELECT l.doc AS out_doc, link, CAST(target AS INT) AS target, k.position AS new_target FROM l LEFT JOIN pl k ON k.doc = l.doc AND k.src_page = l.target""",
    ),
    "page_ceiling": (
        page_ceiling,
        "SELECT conv_id AS out_doc, count(*) AS n_pages FROM conversations GROUP BY conv_id HAVING count(*) > 6",
    ),
    "plan_image_pages": (
        plan_image_pages,
        """WITH r AS (SELECT conv_id AS out_doc, conv_id % 3 AS s, CASE conv_id % 7 WHEN 0 THEN -1.0 WHEN 1 THEN 300.0 ELSE 36.0 END::DOUBLE AS margin,
    sum(length(text)) * 200000 AS b FROM conversations GROUP BY conv_id),
v AS (SELECT *, CASE s WHEN 1 THEN 595.28 WHEN 2 THEN 612.0 END::DOUBLE AS fw, CASE s WHEN 1 THEN 841.89 WHEN 2 THEN 792.0 END::DOUBLE AS fh,
  CASE WHEN b > 524288000 THEN 'too-large' WHEN margin < 0 THEN 'bad-margin' WHEN s = 1 AND margin * 2 >= 595.28 THEN 'no-room' END AS reason FROM r),
i AS (SELECT conv_id AS out_doc, turn, CASE WHEN turn % 2 = 1 THEN 80 + conv_id * 53 % 500 ELSE 100 + turn * 37 % 300 END::DOUBLE AS w,
  CASE WHEN turn % 2 = 1 THEN 100 + turn * 37 % 300 ELSE 80 + conv_id * 53 % 500 END::DOUBLE AS h FROM conversations),
f AS (SELECT i.*, v.*, CASE WHEN s = 0 THEN 1 ELSE least((fw - 2 * margin) / w, (fh - 2 * margin) / h) END AS k FROM i JOIN v ON v.out_doc = i.out_doc AND v.reason IS NULL)
SELECT out_doc, turn AS position, round(coalesce(fw, w), 6) AS page_width, round(coalesce(fh, h), 6) AS page_height,
  round(CASE WHEN s = 0 THEN 0 ELSE (fw - w * k) / 2 END, 6) AS x, round(CASE WHEN s = 0 THEN 0 ELSE (fh - h * k) / 2 END, 6) AS y,
  round(w * k, 6) AS width, round(h * k, 6) AS height, NULL AS reason FROM f
UNION ALL SELECT out_doc, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM v WHERE reason IS NOT NULL""",
    ),
}
