"""Derived inputs for the registered queries.

Each function derives one operator input from the given tables with Spark; the
string of the same name in :data:`SQL` states the derivation for the checker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.sources.tables import spread, table

# Signatures used to derive byte samples, with the type they mean.
SIGNATURES = [
    ("89504E470D0A1A0A00000000", "png"),
    ("FFD8FFE0000000000000", "jpeg"),
    ("524946460000000057454250", "webp"),
    ("000000206674797061766966", "avif"),
    ("000000206674797068656963", "heic"),
    ("00000020667479706D703432", "unknown"),
    ("474946383961000000000000", "gif"),
    ("424D00000000000000000000", "bmp"),
    ("49492A000000000000000000", "tiff"),
    ("4D4D002A0000000000000000", "tiff"),
    ("255044462D312E3700000000", "pdf"),
    ("", "unknown"),
]


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """One-page documents; even ids get blank lines between their paragraphs."""
    return spread(table(spark, folder, "documents").select("doc_id", "text")).selectExpr(
        "doc_id",
        "concat('doc-', doc_id) AS doc_name",
        "1 AS page",
        r"CASE WHEN doc_id % 2 = 0 THEN replace(text, '\n', '\n\n') ELSE text END AS text",
    )


def talks(spark: SparkSession, folder: str) -> DataFrame:
    """Multi-page documents: one page per turn."""
    return table(spark, folder, "conversations").selectExpr(
        "conv_id AS doc_id",
        "concat('talk-', conv_id) AS doc_name",
        "int(turn + 1) AS page",
        "text",
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document on a grid: 8 per line, 50 lines per page.

    Baselines wobble by up to two points, every tenth line is larger, every
    29th run is empty.
    """
    words = spread(table(spark, folder, "documents").select("doc_id", "text")).selectExpr(
        "doc_id", r"posexplode(regexp_extract_all(text, '[^ \\n\\t\\r]+', 0)) AS (n, word)"
    )
    placed = words.selectExpr(
        "doc_id",
        "int(n div 400 + 1) AS page",
        "n AS seq",
        "CASE WHEN n % 29 = 0 THEN '' ELSE word END AS str",
        "double(72 + (n % 8) * 60) AS x",
        "double(82 + (n div 8 % 50) * 14 + n % 3) AS base",
        "CASE WHEN n div 8 % 10 = 0 THEN 12.0D ELSE 10.0D END AS font_size",
        "n % 8 = 7 AS has_eol",
    )
    return placed.selectExpr(
        "doc_id", "page", "seq", "str", "x", "base - font_size AS y",
        "length(str) * font_size * 0.5D AS width", "font_size AS height",
        "font_size", "has_eol",
    )


def page_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """A box per conversation turn, with turns outside 0..270 and moved origins."""
    return table(spark, folder, "conversations").selectExpr(
        "conv_id AS doc_id",
        "int(turn + 1) AS page",
        "int(turn) AS page_index",
        "double(conv_id % 3 * 10) AS origin_x",
        "double(turn % 2 * 5) AS origin_y",
        "CASE WHEN conv_id % 2 = 0 THEN 612.0D ELSE 595.28D END AS width",
        "CASE WHEN conv_id % 2 = 0 THEN 792.0D ELSE 841.89D END AS height",
        "int((turn - 3) * 90) AS rotation",
    )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as an assembled document of its turns."""
    return table(spark, folder, "conversations").selectExpr(
        "conv_id AS out_doc",
        "int(turn) AS position",
        "conv_id AS src_doc",
        "int(turn) AS src_page",
        "int(turn % 4 * 90) AS rotation",
        "CASE WHEN conv_id % 2 = 0 THEN 612.0D ELSE 595.28D END AS width",
        "CASE WHEN conv_id % 2 = 0 THEN 792.0D ELSE 841.89D END AS height",
    )


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Document records; creation spread over two hours, source src0 are samples."""
    return table(spark, folder, "documents").selectExpr(
        "doc_id",
        "concat('doc-', doc_id) AS doc_name",
        "source = 'src0' AS sample",
        "timestamp_seconds(1704067200 + doc_id * 7 % 7200) AS created_at",
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").selectExpr(
        "concat('file', page_id, CASE WHEN page_id % 7 = 0 THEN '.txt' ELSE '.PDF' END) AS name",
        "CASE WHEN page_id % 11 = 0 THEN 30000000L ELSE bigint(length(html)) END AS size",
        "CAST(CASE WHEN page_id % 5 = 0 THEN html ELSE concat('%PDF-1.7', html) END AS BINARY) AS content",
    )


def file_contents(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "pages")
        .where("page_id % 13 <> 0")
        .selectExpr(
            "concat('file', page_id, CASE WHEN page_id % 7 = 0 THEN '.txt' ELSE '.PDF' END) AS name",
            "page_id % 350 AS n_pages",
            "CASE WHEN page_id % 17 = 0 THEN 0 ELSE 1 END AS n_chunks",
        )
    )


def signed_bytes(spark: SparkSession, folder: str) -> DataFrame:
    magic = F.element_at(
        F.array(*[F.lit(h) for h, _ in SIGNATURES]), (F.col("page_id") % len(SIGNATURES) + 1).cast("int")
    )
    return table(spark, folder, "pages").select(
        "page_id", F.concat(F.unhex(magic), F.col("html").cast("binary")).alias("content")
    )


SQL = {
    "corpus": """corpus AS (
  SELECT doc_id, 'doc-' || doc_id AS doc_name, 1 AS page,
         CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS text
  FROM documents)""",
    "talks": """talks AS (
  SELECT conv_id AS doc_id, 'talk-' || conv_id AS doc_name, CAST(turn + 1 AS INT) AS page, text
  FROM conversations)""",
    "runs": r"""words AS (
  SELECT doc_id, unnest(list) AS word, unnest(range(len(list))) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[^ \n\t\r]+') AS list FROM documents)),
raw_runs AS (
  SELECT doc_id, CAST(n // 400 + 1 AS INT) AS page, CAST(n AS INT) AS seq,
         CASE WHEN n % 29 = 0 THEN '' ELSE word END AS str,
         CAST(72 + (n % 8) * 60 AS DOUBLE) AS x,
         CAST(82 + (n // 8 % 50) * 14 + n % 3 AS DOUBLE) AS base,
         CAST(CASE WHEN n // 8 % 10 = 0 THEN 12.0 ELSE 10.0 END AS DOUBLE) AS font_size,
         n % 8 = 7 AS has_eol
  FROM words),
runs AS (
  SELECT doc_id, page, seq, str, x, base - font_size AS y,
         length(str) * font_size * 0.5 AS width, font_size AS height, font_size, has_eol
  FROM raw_runs)""",
    "page_boxes": """page_boxes AS (
  SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, CAST(turn AS INT) AS page_index,
         CAST(conv_id % 3 * 10 AS DOUBLE) AS origin_x, CAST(turn % 2 * 5 AS DOUBLE) AS origin_y,
         CAST(CASE WHEN conv_id % 2 = 0 THEN 612.0 ELSE 595.28 END AS DOUBLE) AS width,
         CAST(CASE WHEN conv_id % 2 = 0 THEN 792.0 ELSE 841.89 END AS DOUBLE) AS height,
         CAST((turn - 3) * 90 AS INT) AS rotation
  FROM conversations)""",
    "manifest": """manifest AS (
  SELECT conv_id AS out_doc, CAST(turn AS INT) AS position, conv_id AS src_doc,
         CAST(turn AS INT) AS src_page, CAST(turn % 4 * 90 AS INT) AS rotation,
         CAST(CASE WHEN conv_id % 2 = 0 THEN 612.0 ELSE 595.28 END AS DOUBLE) AS width,
         CAST(CASE WHEN conv_id % 2 = 0 THEN 792.0 ELSE 841.89 END AS DOUBLE) AS height
  FROM conversations)""",
    "docs": """docs AS (
  SELECT doc_id, 'doc-' || doc_id AS doc_name, source = 'src0' AS sample,
         1704067200 + doc_id * 7 % 7200 AS created_s
  FROM documents)""",
}


def with_(*names: str) -> str:
    """WITH list made of the named derivations."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
