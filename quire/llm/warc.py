"""WARC archives with revisit records: write pages once per payload, and read archives back.

Headers (digest, size, id) are cut from the pages and shuffled by payload digest, without the
payloads; of records with equal payloads of at least ``SMALLEST`` bytes the one with the largest
``page_id`` is the original, the others revisit it. Revisit records are made of headers alone. The
other pages become responses where they lie: a Bloom filter of the revisiting pages lets them pass, and
only the few pages that it takes for revisits by mistake are joined to tell them apart.

An archive is written by Spark's text writer: a record is one row, and the row separator is the
blank line that ends a record. Records are written by classes of size, so that a file holds some
``FILE_BYTES`` at most (or one larger record), and ``PER_FILE`` records; a task reads back one file at a
time. Records are made of UTF-8 text, as the payloads are.

A null html is an empty payload, a null url an empty target. Every row of the pages gives one record;
repeated rows of the largest ``page_id`` are all originals. A ``page_id`` that is null is kept as
null; it is never the original of others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bloom
from quire.llm.shared import batches, folder, store

SMALLEST = 1000
PER_FILE = 2000
FILE_BYTES = 64 << 20
CLASSES = [1 << n for n in (15, 18, 21, 24)]  # largest payloads of the classes of size; the last has no limit
END = "\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def headers(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest`` of every page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"),
    )


def originals(heads: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """``payload_digest, original``: the page that keeps each payload that occurs repeatedly."""
    return (
        heads.where((F.col("payload_bytes") >= smallest) & F.col("page_id").isNotNull())
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("original"), F.min("page_id").alias("least"), F.count("*").alias("n"))
        .where("n > 1").select("payload_digest", "original")
    )


_KEY = "__page"


def resolve(pages: DataFrame, smallest: int = SMALLEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All headers; responses with their payload; and the headers of revisits with ``refers_to``."""
    key = F.concat_ws(":", "payload_digest", F.col("page_id").cast("string")).alias(_KEY)
    full = headers(pages).withColumn("refers_to", F.lit(None).cast("long")).select("*", key)
    heads = store(full.drop("html", "refers_to"), "headers")
    kept = store(originals(heads, smallest), "originals")
    revisits = (F.col("payload_bytes") >= smallest) & ~F.col("page_id").eqNullSafe(F.col("original"))
    again = store(
        heads.join(kept, "payload_digest").where(revisits).withColumnRenamed("original", "refers_to").withColumn("html", F.lit("")), "revisits"
    )
    keys = store(again.select(_KEY).distinct(), "revisiting")
    passed, maybe = bloom.split(full, _KEY, keys)
    # Without payloads: pages that the filter takes for revisits by mistake.
    mistaken = store(bloom.split(heads, _KEY, keys)[1].join(keys, _KEY, "left_anti").select(_KEY).distinct(), "mistaken")
    spared = bloom.split(maybe, _KEY, mistaken)[1].join(mistaken, _KEY, "left_semi")
    return heads, passed.unionByName(spared), again


def record() -> Column:
    """The text of a page's record without the blank line that ends it."""
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]+", "%20")
    name = F.when(F.col("page_id").isNull(), "<urn:quire:page:>").otherwise(
        F.concat(F.lit("<urn:quire:page:"), F.col("page_id").cast("string"), F.lit(">"))
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    more = F.when(
        revisit,
        F.concat(
            F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:quire:page:"), F.col("refers_to").cast("string"),
            F.lit(">\r\n"),
        ),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"), more,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END), block,
    )


def write_archives(
    pages: DataFrame, path: str, smallest: int = SMALLEST, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES
) -> None:
    """Write the pages as archives below ``path``, each repeated payload once."""
    heads, responses, revisits = resolve(pages, smallest)
    bounds = [-1, *(c for c in CLASSES), None]
    size = F.col("payload_bytes")
    inside = [(size > low) & (size <= high) if high else size > low for low, high in zip(bounds[:-1], bounds[1:], strict=True)]
    met = heads.agg(*(F.max(rule.cast("int")).alias(f"c{n}") for n, rule in enumerate(inside))).first()
    out = lambda rows, n: (
        rows.select(record().alias("record")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", n).text(path)
    )
    for n, (rule, high) in enumerate(zip(inside, bounds[1:], strict=True)):
        if n == 0 or met[f"c{n}"]:
            out(responses.where(rule), max(1, min(per_file, file_bytes // high)) if high else 1)
    out(revisits, per_file)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives below ``path`` (``RECORD``), with the payload if wanted.

    Payloads are checked against their digest; a damaged record fails the job.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in RECORD.split(", ")]
        schema = pa.schema(names + [("payload", pa.binary())] * payloads)
        for batch in source:
            for content in batch.column(0):
                yield from batches(parse(content.as_py(), payloads), schema, 256)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORD + ", payload binary" * payloads)


def parse(data: bytes, payloads: bool = False) -> Iterator[tuple]:
    """Records of one archive."""
    at, gap = 0, END.encode()
    while at < len(data):
        top = data.index(gap, at)
        lines = data[at:top].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin = top + len(gap)
        end = begin + int(fields["Content-Length"])
        body = data.index(gap, begin) + len(gap)
        http = dict(line.split(": ", 1) for line in data[begin:body].decode().rstrip().split("\r\n")[1:])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        payload = data[body:end]
        if data[end : end + len(gap)] != gap:
            raise ValueError(f"record at byte {at} does not end where it says")
        if fields["WARC-Type"] == "response":
            found = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
            if found != digest or len(payload) != int(http["Content-Length"]):
                raise ValueError(f"payload of the record at byte {at} is damaged")
        row = (
            _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"],
            int(http["Content-Length"]), digest, _page(fields.get("WARC-Refers-To", ":>")),
        )
        yield (*row, payload) if payloads else row
        at = end + len(gap)


def _page(name: str) -> int | None:
    number = name.rsplit(":", 1)[1].rstrip(">")
    return int(number) if number else None


def round_trip(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """Write archives to the shared folder and read their records back, without payloads."""
    path = f"{folder(pages.sparkSession)}/archives"
    write_archives(pages, path, smallest)
    return read_archives(pages.sparkSession, path)
