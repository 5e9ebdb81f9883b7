"""The engine's work on streams. Every query has a batch twin it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.binding import bind
from quire.functions.text import hash_features, l2_normalize, tokens
from quire.operators.chunking import chunk_documents
from quire.operators.intake import normalize_page_text
from quire.operators.sizes import BOOT_MILLISECONDS
from quire.streaming.versions import CHANGES, newest_pages, texts_to_stand


def ingest(pages: DataFrame) -> DataFrame:
    """Clean page text, cut it and compute features; stateless, page by page."""
    clean = pages.withColumn("text", normalize_page_text(F.col("text")))
    return chunk_documents(clean).withColumn(
        "features", l2_normalize(hash_features(tokens(F.col("text"))))
    )


def run_ingest(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append chunks to a table; of a page delivered twice in a batch the newest version counts.

    ``pages`` may have a ``version`` (an increasing number); without one all deliveries of a
    page are the same. The batch number is a partition of the target and is overwritten, so a
    batch replayed after a lost driver or executor does not write its rows again. Read the
    table with :func:`newest_chunks`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch if "version" in batch.columns else batch.withColumn("version", F.lit(0))
        others = [c for c in known.columns if c not in ("doc_id", "page")]
        last = F.max_by(F.struct(*others), "version")
        once = known.groupBy("doc_id", "page").agg(last.alias("_last")).select("doc_id", "page", "_last.*")
        chunks = ingest(once).join(once.select("doc_id", "page", "version"), ["doc_id", "page"])
        chunks.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_chunks(written: DataFrame) -> DataFrame:
    """Of all batches the chunks of each page's newest version; of equal ones the later batch."""
    by_page = written.groupBy("doc_id", "page").agg(F.max(F.struct("version", "batch")).alias("_top"))
    return (
        written.join(by_page, ["doc_id", "page"])
        .where((F.col("version") == F.col("_top.version")) & (F.col("batch") == F.col("_top.batch")))
        .drop("_top", "version", "batch")
    )


def scan(chunks: DataFrame, categories: list[tuple]) -> DataFrame:
    """Chunks that carry a signal of a category and share its words, as they come.

    ``categories`` are (id, title, probe, hint, signals, why); they are few, so
    they are part of the expression and every chunk is tested in its row.
    """
    words = lambda values: F.array(*[F.lit(v) for v in values])
    rules = F.array(
        *[
            F.struct(
                F.lit(c[0]).alias("id"), words(c[4]).alias("signals"), tokens(F.lit(c[2])).alias("words")
            )
            for c in categories
        ]
    )
    matching = bind(
        F.struct(F.lower("text").alias("low"), tokens(F.col("text")).alias("words")),
        lambda t: F.filter(
            rules,
            lambda r: F.exists(r["signals"], lambda s: F.contains(t["low"], s))
            & F.arrays_overlap(t["words"], r["words"]),
        ),
    )
    return chunks.select(
        "chunk_id", "doc_id", "page", "start", "end", F.explode(matching).alias("r")
    ).select("chunk_id", "doc_id", "page", "start", "end", F.col("r.id").alias("category"))


def scan_table(chunks: DataFrame, categories: DataFrame) -> DataFrame:
    """:func:`scan` with the categories (id, probe, signals) as a table of any size.

    A chunk meets a category by a word that both have; signals are looked for in those pairs only.
    """
    words = lambda text: F.explode(F.array_distinct(tokens(F.col(text)))).alias("_word")
    rules = categories.select(F.col("id").alias("category"), "signals", words("probe"))
    span = ["chunk_id", "doc_id", "page", "start", "end"]
    met = chunks.select(*span, F.lower("text").alias("_low"), words("text")).join(rules, "_word")
    signalled = F.exists("signals", lambda s: F.contains(F.col("_low"), s))
    return met.where(signalled).select(*span, "category").distinct()


def run_scan(chunks: DataFrame, categories: str, target: str, checkpoint: str) -> StreamingQuery:
    """Flags of a stream of chunks against a table of categories that may change while it runs.

    The table at ``categories`` is read anew for every batch, so a category that was added, changed
    or taken out counts from the next batch on. Batches are written as by :func:`run_ingest`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rules = batch.sparkSession.read.schema("id string, probe string, signals array<string>").parquet(categories)
        scan_table(batch, rules).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        chunks.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_traffic(
    requests: DataFrame, loads: DataFrame, uploads: DataFrame, width: str, late: str, longest: str = "6 hours"
) -> DataFrame:
    """Traffic of sessions after they had loaded, in windows, from three streams.

    ``requests``: session, ts, url, host, bytes; ``loads``: session, loaded_at; ``uploads``: session,
    ts, bytes. A request counts once, if a load of its session came at least the boot time and at most
    ``longest`` before it (a stream-stream join; both bounds let Spark drop old state), and not at all
    if its address is local. Uploads always count, as bytes sent. Rows later than ``late`` are dropped.
    """
    remote = requests.where(~F.regexp_like("url", F.lit(r"\A(blob|data|filesystem):"))).withWatermark("ts", late)
    begun = loads.select(F.col("session").alias("_session"), "loaded_at").withWatermark("loaded_at", late)
    after = F.expr(
        f"session = _session AND ts >= loaded_at + INTERVAL {BOOT_MILLISECONDS} MILLISECONDS AND ts <= loaded_at + INTERVAL {longest}"
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    heard = remote.join(begun, after, "left_semi").select(
        "session", "ts", "host", one.alias("request"), F.col("bytes").alias("received"), zero.alias("sent")
    )
    sent = uploads.withWatermark("ts", late).select(
        "session", "ts", F.lit(None).cast("string").alias("host"), zero.alias("request"), zero.alias("received"), F.col("bytes").alias("sent")
    )
    sums = [F.sum(c).alias(c) for c in ("request", "received", "sent")]
    return (
        heard.unionByName(sent)
        .groupBy("session", F.window("ts", width), "host").agg(*sums)
        .groupBy("session", "window").agg(*sums, F.count("host").alias("n_hosts"))
        .select(
            "session", F.col("window.start").alias("from"), F.col("window.end").alias("until"), F.col("request").alias("n_requests"),
            F.col("received").alias("bytes_in"), F.col("sent").alias("bytes_out"), "n_hosts",
        )
    )


def page_changes(pages: DataFrame, ttl_seconds: int, late: str) -> DataFrame:
    """What each delivery changes: rows of pages to put in and of pages to take out.

    ``pages``: doc_id (string), page, version, text, ts. A document's newest versions are its state:
    a newer delivery of a page gives a ``delete`` of the version that is in and a ``put`` of its own;
    older and repeated ones give nothing. Event time that passes a document's last delivery by
    ``ttl_seconds`` takes all its pages out and forgets it. Nothing written before is read again.
    """
    return (
        pages.select("doc_id", "page", "version", "text", "ts")
        .withWatermark("ts", late)
        .groupBy("doc_id")
        .transformWithStateInPandas(
            statefulProcessor=newest_pages(ttl_seconds), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
        )
    )


def run_changes(pages: DataFrame, target: str, checkpoint: str, ttl_seconds: int, late: str) -> StreamingQuery:
    """Write the changes of a page stream as chunks to put in and versions to take out.

    ``target/put`` has the chunks with page and version, ``target/delete`` the versions that went.
    Read both with :func:`standing_chunks`. Texts that a newer delivery beside them outdates are left
    behind before the exchange by document; what came and went within a batch is not cut anyway.
    """
    pages = pages.select("doc_id", "page", "version", "text", "ts")
    pages = pages.mapInArrow(texts_to_stand(), pages.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        gone = batch.where("op = 'delete'").select("doc_id", "page", "version", "at")
        # What came and went within the batch is not cut at all.
        put = batch.where("op = 'put'").select("doc_id", "page", "version", "text").join(gone, ["doc_id", "page", "version"], "left_anti")
        chunks = ingest(put.select("doc_id", "page", "text")).join(put.select("doc_id", "page", "version"), ["doc_id", "page"])
        chunks.write.mode("overwrite").parquet(f"{target}/put/batch={batch_id}")
        gone.write.mode("overwrite").parquet(f"{target}/delete/batch={batch_id}")
        batch.unpersist()

    return (
        page_changes(pages, ttl_seconds, late)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def standing_chunks(put: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks whose version was not taken out by the same or a later batch."""
    taken = gone.groupBy("doc_id", "page", "version").agg(F.max("batch").alias("_batch"))
    return put.join(taken, ["doc_id", "page", "version"], "left").where("_batch IS NULL OR _batch < batch").drop("_batch", "batch")


def traffic(requests: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Requests, bytes and distinct hosts per session in windows; rows later than ``late`` are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        requests.where(~F.regexp_like("url", F.lit(r"\A(blob|data|filesystem):")))
        .withWatermark("ts", late)
        .groupBy("session", window, "host")
        .agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
        .groupBy("session", "window")
        .agg(F.sum("n").alias("n_requests"), F.sum("b").alias("bytes_in"), F.count("host").alias("n_hosts"))
        .select("session", F.col("window.start").alias("from"), F.col("window.end").alias("until"), "n_requests", "bytes_in", "n_hosts")
    )


def visits(requests: DataFrame, pause: str, late: str) -> DataFrame:
    """Totals per visit: a visit ends when a session is silent for ``pause``."""
    return (
        requests.withWatermark("ts", late)
        .groupBy("session", F.session_window("ts", pause))
        .agg(F.count("*").alias("n_requests"), F.sum("bytes").alias("bytes_in"))
        .select(
            "session",
            F.col("session_window.start").alias("from"),
            F.col("session_window.end").alias("until"),
            "n_requests",
            "bytes_in",
        )
    )


def expire(docs: DataFrame, ttl_seconds: int, late: str) -> DataFrame:
    """Documents that outlive their time, emitted once event time has passed it.

    ``docs``: doc_id of any type, sample, created_at. A document is a session that lasts
    until nothing new of it has come for its time to live, so its state is one row.
    """
    life = F.session_window("created_at", f"{ttl_seconds} seconds")
    return (
        docs.where("not sample")
        .withWatermark("created_at", late)
        .groupBy("doc_id", life)
        .agg(F.count("*").alias("n"))
        .select("doc_id", F.unix_timestamp("session_window.end").alias("expired_s"))
    )


def run_to_table(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's results as files until the available input is used up."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
