"""Admission, page text and catalogue of a document collection."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quire.functions.packs import packed_by_group

MAX_UPLOAD_BYTES = 20 * 1024 * 1024
MAX_PAGES = 300
DOC_TTL_SECONDS = 3600
REAL_TEXT_CHARS = 8
NO_TEXT_NOTE = "no text layer on the selected pages"


def intake_check(files: DataFrame, contents: DataFrame) -> DataFrame:
    """First failing admission rule per file, ``ok`` when none fails.

    ``files``: name, size, content. ``contents``: name, n_pages, n_chunks, one
    row per file a parser could read. Where both have a ``path`` it is the key,
    and files of one name in two folders stay apart.
    """
    head = F.substring("content", 1, 4)
    key = ["path"] if "path" in files.columns and "path" in contents.columns else ["name"]
    names = list(dict.fromkeys([*key, "name"]))
    return (
        files.select(*names, "size", head.alias("head"))
        .join(contents.select(*key, "n_pages", "n_chunks"), key, "left")
        .select(
            *names,
            F.when(~F.lower("name").endswith(".pdf"), "not-a-pdf-name")
            .when(F.col("size") > MAX_UPLOAD_BYTES, "too-large")
            .when(F.col("head") != F.lit("%PDF").cast("binary"), "not-a-pdf")
            .when(F.coalesce("n_pages", F.lit(0)) == 0, "unreadable")
            .when(F.col("n_pages") > MAX_PAGES, "too-many-pages")
            .when(F.coalesce("n_chunks", F.lit(0)) == 0, "no-text")
            .otherwise("ok")
            .alias("verdict"),
        )
    )


def classify_bytes(content: Column) -> Column:
    """True file type from the first twelve bytes, whatever the name says."""
    head = F.hex(F.substring(content, 1, 12))
    brand = F.lower(F.substring(content, 9, 4).cast("string"))
    at = lambda start, magic: F.substring(head, 2 * start + 1, len(magic)) == magic
    # File signatures in hexadecimal.
    return (
        F.when(F.length(head) < 24, "unknown")
        .when(at(0, "89504E470D0A1A0A"), "png")
        .when(at(0, "FFD8FF"), "jpeg")
        .when(at(0, "52494646") & at(8, "57454250"), "webp")
        .when(
            at(4, "66747970"),
            F.when(brand.isin("avif", "avis"), "avif")
            .when(
                brand.startswith("hei") | brand.startswith("hev") | brand.isin("mif1", "msf1"),
                "heic",
            )
            .otherwise("unknown"),
        )
        .when(at(0, "47494638"), "gif")
        .when(at(0, "424D"), "bmp")
        .when(at(0, "49492A00") | at(0, "4D4D002A"), "tiff")
        .when(at(0, "25504446"), "pdf")
        .otherwise("unknown")
    )


def normalize_page_text(text: Column) -> Column:
    """One newline style, at most one blank line in a row, no outer newlines."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return F.btrim(F.regexp_replace(unix, r"\n{3,}", "\n\n"), F.lit("\n"))


def place_runs(runs: DataFrame) -> DataFrame:
    """Give every text run its span in the page string; empty runs only advance it.

    One page is one group here and in the layout steps, which then need no further exchange; to its
    task it goes as packs of neighbouring runs.
    """

    def place(page: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        page = page.take(pc.sort_indices(page, [("seq", "ascending")], null_placement="at_start"))
        length = pc.utf8_length(page["str"])
        ended = pc.add(length, pc.fill_null(page["has_eol"], False).cast(length.type))
        stop = np.cumsum(pc.fill_null(ended, 0).to_numpy())
        start = pa.array(np.append(0, stop[:-1])[: len(page)], pa.int32())
        page = page.append_column("start", start).append_column("end", pc.add(start, length.cast(pa.int32())))
        return page.filter(pc.not_equal(page["str"], ""))

    page = ["doc_id", "page"]
    given = [T.StructField(f.name, f.dataType) for f in runs.schema if f.name not in page]
    made = T.StructType([*given, T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return packed_by_group(runs, page, place, made).select(*runs.columns, "start", "end")


def assemble_page_text(runs: DataFrame) -> DataFrame:
    """Page strings from runs in order, a newline after each end-of-line run."""
    piece = F.struct(
        "seq", F.concat("str", F.when(F.col("has_eol"), "\n").otherwise("")).alias("s")
    )
    ordered = F.sort_array(F.collect_list(piece))
    return runs.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(ordered, lambda r: r["s"]), "").alias("text")
    )


def needs_ocr(pages: DataFrame) -> DataFrame:
    """Per document: blank throughout (intake) and no real text (export)."""
    solid = F.length(F.regexp_replace("text", r"(?U)\s", ""))
    return pages.groupBy("doc_id").agg(
        (~F.bool_or(solid > 0)).alias("blank"),
        (~F.bool_or(solid > REAL_TEXT_CHARS)).alias("no_real_text"),
    )


def export_text(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected pages as an ordered stream of pieces per document.

    The pieces of a document, in page order, concatenate to its export file
    (pages separated by a form feed line), so no document has to fit one row.
    A document without real text yields one piece saying so.
    """
    chosen = pages.join(
        selection.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi"
    )
    status = chosen.groupBy("doc_id").agg(
        F.bool_or(F.length(F.regexp_replace("text", r"(?U)\s", "")) > REAL_TEXT_CHARS).alias("real"),
        F.min("page").alias("first"),
    )
    first = F.col("page") == F.col("first")
    return (
        chosen.join(status, "doc_id")
        .where(F.col("real") | first)
        .select(
            "doc_id",
            "page",
            F.when(~F.col("real"), NO_TEXT_NOTE)
            .when(first, F.col("text"))
            .otherwise(F.concat(F.lit("\f\n"), "text"))
            .alias("piece"),
        )
    )


def catalog(docs: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One line per document: page and chunk counts; samples first, then by age."""
    n_pages = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    n_chunks = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return (
        docs.join(n_pages, "doc_id", "left")
        .join(n_chunks, "doc_id", "left")
        .select(
            "doc_id",
            "doc_name",
            F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
            F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
            "sample",
            "created_at",
        )
        .orderBy(F.col("sample").desc(), "created_at", "doc_id")
    )


def restrict(rows: DataFrame, doc_ids: DataFrame | None) -> DataFrame:
    """Keep the listed documents; ``None`` keeps all, an empty list keeps none."""
    if doc_ids is None:
        return rows
    return rows.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def remove(rows: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Drop the listed documents from a document or child table."""
    return rows.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def missing_ids(docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Asked-for ids no document carries."""
    return doc_ids.select("doc_id").distinct().join(docs, "doc_id", "left_anti")


def expire(docs: DataFrame, now: Column, ttl: int = DOC_TTL_SECONDS) -> DataFrame:
    """Documents that stay: samples, and those created no longer ago than the ttl."""
    cutoff = now - F.make_interval(secs=F.lit(ttl))
    return docs.where(F.col("sample") | (F.col("created_at") >= cutoff))


def latest_versions(versions: DataFrame, depth: int = 20) -> DataFrame:
    """The newest ``depth`` snapshots per document, rank 1 is the current state."""
    newest = Window.partitionBy("doc_id").orderBy(F.col("version").desc())
    return versions.withColumn("age", F.row_number().over(newest)).where(
        F.col("age") <= depth
    )


def fold_rotation(degrees: Column) -> Column:
    """Any turn folded to 0, 90, 180 or 270; halves round up as in the reader."""
    return F.pmod(F.floor(degrees / 90.0 + 0.5).cast("long") * 90, F.lit(360)).cast("int")


def page_shapes(boxes: DataFrame) -> DataFrame:
    """Size as displayed: a quarter turn swaps the sides."""
    turn = fold_rotation(F.col("rotation"))
    quarter = turn.isin(90, 270)
    return boxes.select(
        "doc_id",
        "page",
        turn.alias("rotation"),
        F.when(quarter, F.col("height")).otherwise(F.col("width")).alias("view_width"),
        F.when(quarter, F.col("width")).otherwise(F.col("height")).alias("view_height"),
    )
