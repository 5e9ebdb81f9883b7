"""Stream queries run over the whole tables until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chunking
from quire.plans.answer_queries import TOKENS
from quire.plans.chunk_queries import chunks_sql
from quire.plans.scan_queries import CATS, CATS_SQL
from quire.sources import fixtures as fx
from quire.sources.scratch import scratch_folder
from quire.sources.tables import table
from quire.streaming import streams


# State partitions of the registered streams; a stream that is to run for long states more.
STATE_PARTITIONS = 16


def _stream(spark, folder, name):
    """A given table as a stream of its files, in a session of its own.

    The table may be one file or a folder of files; a stream's path has to be a pattern for the
    first and must not be a filter on file names for the second. A stream fixes its number of state partitions when it first runs; it is stated here, and
    the caller's session keeps its settings.
    """
    schema = table(spark, folder, name).schema
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", STATE_PARTITIONS)
    return own.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _finish(spark, stream):
    """Run a stream to its end and read what it wrote."""
    at = scratch_folder(spark)
    streams.run_to_table(stream, f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


_PAGES = [
    "doc_id",
    "1 AS page",
    r"CASE WHEN doc_id % 2 = 0 THEN replace(text, '\n', '\n\n') ELSE text END AS text",
]


def stream_ingest(spark, folder):
    at = scratch_folder(spark)
    pages = _stream(spark, folder, "documents").selectExpr(*_PAGES)
    streams.run_ingest(pages, f"{at}/out", f"{at}/log").awaitTermination()
    written = streams.newest_chunks(spark.read.parquet(f"{at}/out"))
    return written.select(
        "chunk_id", "start", "end", F.md5("text").alias("digest"), F.size("features").cast("long").alias("n_features")
    )


def stream_scan(spark, folder):
    chunks = chunking.chunk_documents(_stream(spark, folder, "documents").selectExpr(*_PAGES))
    return _finish(spark, streams.scan(chunks, CATS)).select("chunk_id", "category")


def _requests(spark, folder):
    return _stream(spark, folder, "events").selectExpr(
        "user_id AS session", "cast(ts AS timestamp) AS ts", "bigint(value * 100) AS bytes",
        "CASE WHEN event_type = 'error' THEN 'blob:x' ELSE concat('http://', event_type, '.example/') END AS url",
        "event_type AS host",
    )


def stream_traffic(spark, folder):
    out = _finish(spark, streams.traffic(_requests(spark, folder), "1 day", "10 minutes"))
    return out.select(
        "session", F.unix_timestamp("from").alias("from_s"), F.unix_timestamp("until").alias("until_s"),
        "n_requests", "bytes_in", "n_hosts",
    )


def stream_traffic_sliding(spark, folder):
    out = _finish(spark, streams.traffic(_requests(spark, folder), "2 days", "10 minutes", "1 day"))
    return out.select("session", F.unix_timestamp("from").alias("from_s"), "n_requests", "bytes_in")


def stream_visits(spark, folder):
    out = _finish(spark, streams.visits(_requests(spark, folder), "6 hours", "10 minutes"))
    return out.select(
        "session", F.unix_micros("from").alias("from_us"), F.unix_micros("until").alias("until_us"), "n_requests", "bytes_in"
    )


def stream_expire(spark, folder):
    docs = _stream(spark, folder, "documents").selectExpr(
        "doc_id", "source = 'src0' AS sample", "timestamp_seconds(1704067200 + doc_id * 7 % 7200) AS created_at"
    )
    return _finish(spark, streams.expire(docs, 3600, "60 seconds"))


def stream_live_traffic(spark, folder):
    """Views, clicks and errors within six hours of a sign-up, and all purchases as uploads, by day."""
    of = lambda kind: _stream(spark, folder, "events").where(kind).selectExpr(
        "user_id AS session", "cast(ts AS timestamp) AS ts", "event_type AS host", "bigint(value * 100) AS bytes",
        "CASE WHEN event_type = 'error' THEN 'data:x' ELSE concat('http://', event_type, '.example/') END AS url",
    )
    out = streams.live_traffic(
        of("event_type IN ('view', 'click', 'error')"), of("event_type = 'signup'").withColumnRenamed("ts", "loaded_at"),
        of("event_type = 'purchase'"), "1 day", "10 minutes",
    )
    return _finish(spark, out).select(
        "session", F.unix_timestamp("from").alias("from_s"), "n_requests", "bytes_in", "bytes_out", "n_hosts"
    )


def stream_scan_table(spark, folder):
    """:func:`stream_scan` with the categories in a table."""
    at = scratch_folder(spark)
    rules = [(c[0], c[2], list(c[4])) for c in CATS]
    spark.createDataFrame(rules, "id string, probe string, signals array<string>").coalesce(1).write.parquet(f"{at}/categories")
    chunks = chunking.chunk_documents(_stream(spark, folder, "documents").selectExpr(*_PAGES))
    streams.run_scan(chunks, f"{at}/categories", f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("chunk_id", "category")


def stream_changes(spark, folder):
    """Documents as deliveries of the pages of fewer documents; the chunks that stand at the end."""
    at = scratch_folder(spark)
    pages = _stream(spark, folder, "documents").selectExpr(
        "concat('d', doc_id % 100) AS doc_id", "int(doc_id div 100 % 3 + 1) AS page", "doc_id AS version", "text",
        "timestamp_seconds(1704067200 + doc_id % 3600) AS ts",
    )
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    streams.run_changes(pages, f"{at}/out", f"{at}/log", 86_400, "2 hours").awaitTermination()
    put, gone = (spark.read.parquet(f"{at}/out/{part}") for part in ("put", "delete"))
    return streams.standing_chunks(put, gone).select("chunk_id", "version", F.md5("text").alias("digest"))


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SEEN = """seen AS (SELECT user_id AS session, ts, CAST(trunc(value * 100) AS BIGINT) AS bytes, event_type FROM events),
top AS (SELECT max(ts) - INTERVAL 10 MINUTES AS mark FROM events WHERE event_type <> 'error')"""

QUERIES = {
    "stream_ingest": (
        stream_ingest,
        rf"""WITH RECURSIVE raw AS (
  SELECT doc_id, 1 AS page, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS text FROM documents),
clean AS (SELECT doc_id, page, trim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS text FROM raw),
{chunks_sql('clean')},
f AS (SELECT chunk_id, count(DISTINCT ('0x' || substr(md5(t), 1, 8))::UBIGINT % 512) AS n
  FROM (SELECT chunk_id, unnest({TOKENS.format('text')}) AS t FROM chunks) GROUP BY chunk_id)
SELECT c.chunk_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", md5(text) AS digest, coalesce(n, 0) AS n_features
FROM chunks c LEFT JOIN f ON f.chunk_id = c.chunk_id""",
    ),
    "stream_scan": (
        stream_scan,
        f"""{fx.with_('corpus')}, {CATS_SQL}, {chunks_sql('corpus')}
SELECT c.chunk_id, k.id AS category FROM chunks c JOIN cats k
  ON len(list_filter(k.signals, lambda s: contains(lower(c.text), s))) > 0 AND len(list_intersect({TOKENS.format('k.probe')}, {TOKENS.format('c.text')})) > 0""",
    ),
    "stream_traffic": (
        stream_traffic,
        f"""WITH {_SEEN}, w AS (SELECT session, date_trunc('day', ts) AS d, bytes, event_type FROM seen WHERE event_type <> 'error')
SELECT session, epoch(d)::BIGINT AS from_s, epoch(d)::BIGINT + 86400 AS until_s, count(*) AS n_requests, sum(bytes)::BIGINT AS bytes_in, count(DISTINCT event_type) AS n_hosts
FROM w, top WHERE d + INTERVAL 1 DAY <= mark GROUP BY session, d""",
    ),
    "stream_traffic_sliding": (
        stream_traffic_sliding,
        f"""WITH {_SEEN}, w AS (SELECT session, date_trunc('day', ts) - to_days(unnest([0, 1])) AS d, bytes FROM seen WHERE event_type <> 'error')
SELECT session, epoch(d)::BIGINT AS from_s, count(*) AS n_requests, sum(bytes)::BIGINT AS bytes_in FROM w, top WHERE d + INTERVAL 2 DAYS <= mark GROUP BY session, d""",
    ),
    "stream_live_traffic": (
        stream_live_traffic,
        """WITH e AS (SELECT user_id AS session, ts, event_type AS kind, CAST(trunc(value * 100) AS BIGINT) AS bytes FROM events),
loads AS (SELECT session, ts FROM e WHERE kind = 'signup'),
r AS (SELECT session, ts, kind AS host, 1 AS request, bytes AS received, 0 AS sent FROM e WHERE kind IN ('view', 'click') AND EXISTS (
    SELECT 1 FROM loads AS l WHERE l.session = e.session AND e.ts >= l.ts + INTERVAL 400 MILLISECONDS AND e.ts <= l.ts + INTERVAL 6 HOURS)
  UNION ALL SELECT session, ts, NULL, 0, 0, bytes FROM e WHERE kind = 'purchase'),
m AS (SELECT min(t) - INTERVAL 10 MINUTES AS mark FROM (SELECT max(ts) AS t FROM e WHERE kind IN ('view', 'click') UNION ALL
  SELECT max(ts) FROM loads UNION ALL SELECT max(ts) FROM e WHERE kind = 'purchase'))
SELECT session, epoch(date_trunc('day', ts))::BIGINT AS from_s, sum(request)::BIGINT AS n_requests, sum(received)::BIGINT AS bytes_in,
  sum(sent)::BIGINT AS bytes_out, count(DISTINCT host) AS n_hosts
FROM r, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY ALL""",
    ),
    "stream_scan_table": (
        stream_scan_table,
        f"""{fx.with_('corpus')}, {CATS_SQL}, {chunks_sql('corpus')}
SELECT c.chunk_id, k.id AS category FROM chunks c JOIN cats k
  ON len(list_filter(k.signals, lambda s: contains(lower(c.text), s))) > 0 AND len(list_intersect({TOKENS.format('k.probe')}, {TOKENS.format('c.text')})) > 0""",
    ),
    "stream_changes": (
        stream_changes,
        rf"""WITH RECURSIVE given AS (SELECT 'd' || doc_id % 100 AS doc_id, doc_id // 100 % 3 + 1 AS page, doc_id AS version, text FROM documents),
newest AS (SELECT doc_id, page, max(version) AS version, arg_max(text, version) AS text FROM given GROUP BY ALL),
clean AS (SELECT doc_id, page, trim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS text FROM newest),
{chunks_sql('clean')}
SELECT c.chunk_id, n.version, md5(c.text) AS digest FROM chunks c JOIN newest n ON n.doc_id = c.doc_id AND n.page = c.page""",
    ),
    "stream_visits": (
        stream_visits,
        """WITH seen AS (SELECT user_id AS session, ts, CAST(trunc(value * 100) AS BIGINT) AS bytes FROM events),
top AS (SELECT max(ts) - INTERVAL 10 MINUTES AS mark FROM events),
g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY session ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM seen),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM g),
t AS (SELECT session, min(ts) AS a, max(ts) + INTERVAL 6 HOURS AS b, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM v GROUP BY session, visit)
SELECT session, epoch_us(a) AS from_us, epoch_us(b) AS until_us, n AS n_requests, bytes AS bytes_in FROM t, top WHERE b <= mark""",
    ),
    "stream_expire": (
        stream_expire,
        """WITH d AS (SELECT doc_id, source, 1704067200 + doc_id * 7 % 7200 AS c FROM documents),
m AS (SELECT max(c) - 60 AS mark FROM d WHERE source <> 'src0')
SELECT doc_id, c + 3600 AS expired_s FROM d, m WHERE source <> 'src0' AND c + 3600 < mark""",
    ),
}
