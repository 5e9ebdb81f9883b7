"""Queries over intake, page text and catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chunking, intake
from quire.sources import fixtures as fx
from quire.sources import tables
from quire.sources.scratch import scratch_folder
from quire.sources.tables import table

with_ = fx.with_
NOW = 1704067200 + 5400


def read_pages(spark, folder):
    """The corpus written as a page table and read by the reader."""
    at = scratch_folder(spark)
    fx.corpus(spark, folder).withColumn("doc_id", F.col("doc_id").cast("string")).write.parquet(at)
    return tables.read_pages(spark, at).select(
        F.col("doc_id").cast("long").alias("doc_id"), "page", F.length("text").cast("long").alias("n_chars")
    )


def intake_check(spark, folder):
    return intake.intake_check(fx.files(spark, folder), fx.file_contents(spark, folder))


def classify_bytes(spark, folder):
    return fx.signed_bytes(spark, folder).select(
        "page_id", intake.classify_bytes(F.col("content")).alias("kind")
    )


def normalize_page_text(spark, folder):
    raw = table(spark, folder, "documents").select(
        "doc_id", F.expr(r"concat('\n', replace(text, '. ', '.\r\n\r\n\n\r'), '\n\n')").alias("text")
    )
    clean = intake.normalize_page_text(F.col("text"))
    return raw.select(
        "doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("digest")
    )


def place_runs(spark, folder):
    return intake.place_runs(fx.runs(spark, folder)).select(
        "doc_id", "page", "seq", "start", "end"
    )


def assemble_page_text(spark, folder):
    return intake.assemble_page_text(fx.runs(spark, folder)).select(
        "doc_id", "page", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest")
    )


def _thinned(spark, folder):
    return table(spark, folder, "conversations").selectExpr(
        "conv_id AS doc_id",
        "int(turn + 1) AS page",
        "CASE conv_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN substring(text, 1, 8) ELSE text END AS text",
    )


THINNED = """thinned AS (
  SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page,
         CASE conv_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN substr(text, 1, 8) ELSE text END AS text
  FROM conversations)"""


def needs_ocr(spark, folder):
    return intake.needs_ocr(_thinned(spark, folder))


def export_text(spark, folder):
    selection = table(spark, folder, "conversations").where("(conv_id + turn) % 2 = 0").selectExpr(
        "conv_id AS doc_id", "int(turn + 1) AS page"
    )
    return intake.export_text(_thinned(spark, folder), selection)


def catalog(spark, folder):
    pages = fx.corpus(spark, folder)
    listed = intake.catalog(fx.docs(spark, folder), pages, chunking.chunk_documents(pages))
    return listed.select(
        "doc_id", "doc_name", "n_pages", "n_chunks", "sample",
        F.unix_timestamp("created_at").alias("created_s"),
    )


def restrict_docs(spark, folder):
    toxic = table(spark, folder, "labels").where("toxic = 1")
    return intake.restrict(fx.corpus(spark, folder), toxic).select("doc_id", "page")


def remove_docs(spark, folder):
    good = table(spark, folder, "labels").where("quality = 1")
    return intake.remove(fx.corpus(spark, folder), good).select("doc_id", "page")


def missing_ids(spark, folder):
    asked = table(spark, folder, "orders").selectExpr("o_orderkey AS doc_id")
    return intake.missing_ids(fx.docs(spark, folder), asked)


def expire(spark, folder):
    kept = intake.expire(fx.docs(spark, folder), F.timestamp_seconds(F.lit(NOW)))
    return kept.select("doc_id", "sample")


def latest_versions(spark, folder):
    versions = table(spark, folder, "events").selectExpr(
        "user_id AS doc_id", "event_id AS version", "event_type AS label"
    )
    return intake.latest_versions(versions).selectExpr(
        "doc_id", "version", "label", "bigint(age) AS age"
    )


def page_shapes(spark, folder):
    return intake.page_shapes(fx.page_boxes(spark, folder))


KINDS = "CASE page_id % 12 " + " ".join(
    f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(fx.SIGNATURES)
) + " END"

QUERIES = {
    "read_pages": (read_pages, f"{with_('corpus')} SELECT doc_id, page, length(text) AS n_chars FROM corpus"),
    "intake_check": (
        intake_check,
        """SELECT 'file' || page_id || CASE WHEN page_id % 7 = 0 THEN '.txt' ELSE '.PDF' END AS name,
  CASE WHEN page_id % 7 = 0 THEN 'not-a-pdf-name'
       WHEN page_id % 11 = 0 THEN 'too-large'
       WHEN page_id % 5 = 0 THEN 'not-a-pdf'
       WHEN page_id % 13 = 0 OR page_id % 350 = 0 THEN 'unreadable'
       WHEN page_id % 350 > 300 THEN 'too-many-pages'
       WHEN page_id % 17 = 0 THEN 'no-text' ELSE 'ok' END AS verdict
FROM pages""",
    ),
    "classify_bytes": (classify_bytes, f"SELECT page_id, {KINDS} AS kind FROM pages"),
    "normalize_page_text": (
        normalize_page_text,
        r"""WITH raw AS (
  SELECT doc_id, chr(10) || replace(text, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || chr(13)) || chr(10) || chr(10) AS text
  FROM documents),
clean AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS text
  FROM raw)
SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM clean""",
    ),
    "place_runs": (
        place_runs,
        f"""{with_('runs')}, moved AS (
  SELECT doc_id, page, seq, str, coalesce(sum(length(str) + has_eol::INT) OVER (
    PARTITION BY doc_id, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM runs)
SELECT doc_id, page, seq, CAST(s AS INT) AS start, CAST(s + length(str) AS INT) AS "end"
FROM moved WHERE str <> ''""",
    ),
    "assemble_page_text": (
        assemble_page_text,
        f"""{with_('runs')}, joined AS (
  SELECT doc_id, page, string_agg(str || CASE WHEN has_eol THEN chr(10) ELSE '' END, '' ORDER BY seq) AS text
  FROM runs GROUP BY doc_id, page)
SELECT doc_id, page, length(text) AS n_chars, md5(text) AS digest FROM joined""",
    ),
    "needs_ocr": (
        needs_ocr,
        rf"""WITH {THINNED}
SELECT doc_id, NOT bool_or(length(regexp_replace(text, '\s', '', 'g')) > 0) AS blank,
       NOT bool_or(length(regexp_replace(text, '\s', '', 'g')) > 8) AS no_real_text
FROM thinned GROUP BY doc_id""",
    ),
    "export_text": (
        export_text,
        rf"""WITH {THINNED}, chosen AS (
  SELECT *, min(page) OVER (PARTITION BY doc_id) AS first,
         bool_or(length(regexp_replace(text, '\s', '', 'g')) > 8) OVER (PARTITION BY doc_id) AS real_text
  FROM thinned WHERE (doc_id + page - 1) % 2 = 0)
SELECT doc_id, page, CASE WHEN NOT real_text THEN '{intake.NO_TEXT_NOTE}'
  WHEN page = first THEN text ELSE chr(12) || chr(10) || text END AS piece
FROM chosen WHERE real_text OR page = first""",
    ),
    "restrict_docs": (
        restrict_docs,
        "SELECT doc_id, 1 AS page FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    ),
    "remove_docs": (
        remove_docs,
        "SELECT doc_id, 1 AS page FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    ),
    "missing_ids": (
        missing_ids,
        "SELECT DISTINCT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)",
    ),
    "expire": (
        expire,
        f"{with_('docs')} SELECT doc_id, sample FROM docs WHERE sample OR created_s >= {NOW} - 3600",
    ),
    "latest_versions": (
        latest_versions,
        """SELECT * FROM (SELECT user_id AS doc_id, event_id AS version, event_type AS label,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events) WHERE age <= 20""",
    ),
    "page_shapes": (
        page_shapes,
        f"""{with_('page_boxes')}
SELECT doc_id, page, CAST((rotation + 720) % 360 AS INT) AS rotation,
  CASE WHEN (rotation + 720) % 180 = 90 THEN height ELSE width END AS view_width,
  CASE WHEN (rotation + 720) % 180 = 90 THEN width ELSE height END AS view_height
FROM page_boxes""",
    ),
}
