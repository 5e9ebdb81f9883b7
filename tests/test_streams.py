from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quire.operators import chunking, scan as batch_scan
from quire.sources.scratch import scratch_folder
from quire.sources.tables import read_pages, stream_pages
from quire.streaming import streams
from tests.conftest import pages


@pytest.fixture
def arrivals(spark, lease, manual, tmp_path):
    """Page files as they might arrive, one page delivered twice."""
    at = str(tmp_path / "pages")
    lease.unionByName(lease.where("page = 1")).coalesce(1).write.mode("append").parquet(at)
    manual.coalesce(1).write.mode("append").parquet(at)
    return at


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_ingest_equals_its_batch_twin(spark, arrivals, tmp_path):
    out = str(tmp_path / "out")
    streams.run_ingest(stream_pages(spark, arrivals), out, str(tmp_path / "log")).awaitTermination()
    batch = streams.ingest(read_pages(spark, arrivals).dropDuplicates(["doc_id", "page"]))
    want = rows(batch, "chunk_id", "start", "end", "text")
    assert rows(spark.read.parquet(out), "chunk_id", "start", "end", "text") == want
    # Nothing new has arrived: running again adds nothing.
    streams.run_ingest(stream_pages(spark, arrivals), out, str(tmp_path / "log")).awaitTermination()
    assert rows(spark.read.parquet(out), "chunk_id", "start", "end", "text") == want


def test_scan_stream_equals_batch(spark, arrivals, tmp_path):
    chunks = chunking.chunk_documents(stream_pages(spark, arrivals))
    out = str(tmp_path / "flags")
    streams.run_to_table(streams.scan(chunks, batch_scan.CATEGORIES), out, str(tmp_path / "log")).awaitTermination()
    twin = streams.scan(chunking.chunk_documents(read_pages(spark, arrivals)), batch_scan.CATEGORIES)
    got = rows(spark.read.parquet(out), "chunk_id", "category")
    assert got == rows(twin, "chunk_id", "category") and ("lease:3:0", "cancellation") in got


def test_late_requests_are_dropped(spark, tmp_path):
    at = str(tmp_path / "requests")
    schema = "session int, s long, bytes long, url string, host string"

    def deliver(*requests):
        spark.createDataFrame([(1, s, b, "http://h/", "h") for s, b in requests], schema).coalesce(1).write.mode("append").parquet(at)

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
        timed = source.withColumn("ts", F.timestamp_seconds("s"))
        out = streams.traffic(timed, "60 seconds", "30 seconds")
        streams.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()

    deliver((10, 5), (50, 7))
    run()
    deliver((200, 1))
    run()
    deliver((20, 100), (400, 1))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.unix_timestamp("from"), "n_requests", "bytes_in").collect()
    assert sorted(tuple(r) for r in got) == [(0, 2, 12), (180, 1, 1)]


def test_newest_version_of_a_page_wins(spark, tmp_path):
    at, out = str(tmp_path / "pages"), str(tmp_path / "out")
    schema = "doc_id string, page int, text string, version int"

    def deliver(*rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(at)
        streams.run_ingest(spark.readStream.schema(schema).parquet(at), out, str(tmp_path / "log")).awaitTermination()

    deliver(("a", 1, "first words", 1), ("a", 1, "second words", 2), ("b", 1, "other page", 1))
    deliver(("a", 1, "third words here", 3), ("b", 1, "an old text", 0))
    got = streams.newest_chunks(spark.read.parquet(out))
    assert rows(got, "doc_id", "text") == [("a", "third words here"), ("b", "other page")]


def test_hosts_are_counted_exactly_and_ids_may_be_words(spark, tmp_path):
    at = str(tmp_path / "requests")
    data = [("s", 10 + i % 40, 1, "http://h/", f"h{i % 700}") for i in range(2100)] + [("s", 5000, 1, "http://h/", "h")]
    spark.createDataFrame(data, "session string, s long, bytes long, url string, host string").coalesce(1).write.parquet(at)
    source = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)
    timed = source.withColumn("ts", F.timestamp_seconds("s"))
    streams.run_to_table(streams.traffic(timed, "60 seconds", "30 seconds"), str(tmp_path / "o1"), str(tmp_path / "l1")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o1")), "n_requests", "n_hosts") == [(2100, 700)]
    docs = timed.select(F.col("host").alias("doc_id"), F.lit(False).alias("sample"), F.col("ts").alias("created_at"))
    streams.run_to_table(streams.expire(docs, 100, "30 seconds"), str(tmp_path / "o2"), str(tmp_path / "l2")).awaitTermination()
    gone = {r["doc_id"]: r["expired_s"] for r in spark.read.parquet(str(tmp_path / "o2")).collect()}
    last = {f"h{k}": max(10 + i % 40 for i in range(2100) if i % 700 == k) + 100 for k in range(700)}
    assert gone == last


def test_shared_folder_is_used_when_the_cluster_names_one(spark, tmp_path):
    conf = lambda **kv: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: kv.get(key.replace(".", "_"), default)))
    assert scratch_folder(conf(spark_checkpoint_dir=str(tmp_path))).startswith(str(tmp_path))
    assert scratch_folder(conf(spark_master="local[2]", spark_sql_warehouse_dir="/w")).startswith("/w/")
    with pytest.raises(ValueError):
        scratch_folder(conf(spark_master="spark://host:7077"))


def test_changed_categories_count_from_the_next_batch(spark, tmp_path):
    at, rules, out = str(tmp_path / "chunks"), str(tmp_path / "categories"), str(tmp_path / "out")
    schema = "chunk_id string, doc_id string, page int, start int, end int, text string"

    def deliver(*texts):
        rows_ = [(t, "d", 1, 0, len(t), t) for t in texts]
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(at)
        streams.run_scan(spark.readStream.schema(schema).parquet(at), rules, out, str(tmp_path / "log")).awaitTermination()

    def categories(*rows_):
        spark.createDataFrame(rows_, "id string, probe string, signals array<string>").write.mode("overwrite").parquet(rules)

    categories(("fees", "late fee charge", ["fee", "charge"]))
    deliver("a late FEE of ten", "a pet clause", "a fees schedule")
    categories(("fees", "late fee charge", ["penalty"]), ("pets", "pet animal", ["pet"]))
    deliver("another late fee", "a fee penalty", "one more pet")
    got = rows(spark.read.parquet(out), "chunk_id", "category")
    assert got == [("a fee penalty", "fees"), ("a late FEE of ten", "fees"), ("one more pet", "pets")]


def test_live_traffic_joins_three_streams(spark, tmp_path):
    def stream(name, schema, *batches):
        at = str(tmp_path / name)
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(at)
        return spark.readStream.schema(schema).parquet(at)

    ms = lambda df, *cols: df.withColumns({c: F.timestamp_millis(c) for c in cols})
    requests = ms(stream("r", "session string, ts long, url string, host string, bytes long",
        [("s", 1000, "http://a/", "a", 1), ("s", 1399, "http://a/", "a", 2), ("s", 1400, "http://a/", "a", 4), ("s", 2000, "blob:x", "a", 8),
         ("s", 3000, "http://b/", "b", 16), ("t", 3000, "http://b/", "b", 32), ("s", 4_000_000, "http://a/", "a", 64)]), "ts")
    loads = ms(stream("l", "session string, loaded_at long", [("s", 1000), ("s", 1500), ("t", 5000), ("z", 9_000_000)]), "loaded_at")
    uploads = ms(stream("u", "session string, ts long, bytes long", [("s", 500, 7), ("q", 600, 9), ("z", 9_000_000, 1)]), "ts")
    # Something much later in every stream closes the windows.
    spark.createDataFrame([("z", 9_000_000, "http://z/", "z", 1)], "session string, ts long, url string, host string, bytes long").coalesce(1).write.mode(
        "append"
    ).parquet(str(tmp_path / "r"))
    out = streams.live_traffic(requests, loads, uploads, "60 seconds", "30 seconds", "1 hour")
    streams.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "session", "n_requests", "bytes_in", "bytes_out", "n_hosts")
    assert got == [("q", 0, 0, 9, 0), ("s", 2, 20, 7, 2)]


def test_versions_are_held_in_state(spark, tmp_path):
    at, out = str(tmp_path / "pages"), str(tmp_path / "out")
    schema = "doc_id string, page int, version long, text string, s long"
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", rocks)
    own.conf.set("spark.sql.shuffle.partitions", 2)

    def deliver(*rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(at)
        source = own.readStream.schema(schema).parquet(at).withColumn("ts", F.timestamp_seconds("s"))
        streams.run_changes(source, out, str(tmp_path / "log"), 1000, "10 seconds").awaitTermination()

    def standing():
        return rows(streams.standing_chunks(*(spark.read.parquet(f"{out}/{p}") for p in ("put", "delete"))), "doc_id", "page", "version", "text")

    deliver(("a", 1, 1, "one", 100), ("a", 1, 2, "two", 100), ("a", 2, 1, "page two", 100), ("b", 1, 5, "bee", 100))
    assert standing() == [("a", 1, 2, "two"), ("a", 2, 1, "page two"), ("b", 1, 5, "bee")]
    deliver(("a", 1, 1, "an old one", 200), ("a", 1, 2, "two again", 200), ("b", 1, 6, "new bee", 900))
    assert standing() == [("a", 1, 2, "two"), ("a", 2, 1, "page two"), ("b", 1, 6, "new bee")]
    # Time passes: a was last heard of at 200, b at 900.
    deliver(("c", 1, 1, "sea", 1500))
    deliver(("c", 1, 2, "see", 1501))
    assert standing() == [("b", 1, 6, "new bee"), ("c", 1, 2, "see")]
    # A document that was forgotten starts anew.
    deliver(("a", 1, 1, "one more", 1600))
    assert ("a", 1, 1, "one more") in standing()


@pytest.mark.parametrize("name", ["stream_ingest", "stream_scan_table", "stream_changes"])
def test_a_table_of_several_files_is_streamed_like_one_file(spark, tmp_path, name):
    from quire.plans.stream_queries import QUERIES

    text = "The license is given as is.\n\nNothing else is promised."
    docs = spark.createDataFrame([(i, text + " x" * i) for i in range(6)], "doc_id long, text string")
    one, several = tmp_path / "one", tmp_path / "several"
    docs.coalesce(1).write.parquet(str(several / "documents.parquet"))
    part = next((several / "documents.parquet").glob("part-*.parquet"))
    one.mkdir()
    (one / "documents.parquet").write_bytes(part.read_bytes())
    docs.withColumn("doc_id", F.col("doc_id") + 6).coalesce(1).write.mode("append").parquet(str(several / "documents.parquet"))
    run = QUERIES[name][0]
    assert run(spark, str(one)).count() == 6
    assert run(spark, str(several)).count() == 12


def test_outdated_texts_are_left_behind_unless_the_newer_page_may_come_too_late():
    import pyarrow as pa

    from quire.streaming.versions import texts_to_stand

    given = [
        ("a", 1, 1, "old", 100), ("a", 1, 3, "new", 100), ("a", 1, 2, "later than the new one", 101), ("a", 2, 1, "another page", 50),
        ("b", 1, 1, "another document", 50), ("b", 1, 1, "the same again", 60), (None, 1, 1, "no document", 50), (None, 1, 2, "no document", 60),
        ("c", 1, 1, "no time", None), ("c", 1, 2, None, 70), ("c", 1, 1, "older", 70),
    ]
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "page", "version", "text", "ts"), r, strict=True)) for r in given])
    batch = batch.set_column(4, "ts", batch.column(4).cast(pa.timestamp("us", "UTC")))
    out = next(texts_to_stand()(iter([batch])))
    assert out.schema == batch.schema and out.drop_columns(["text"]) == batch.drop_columns(["text"])
    gone = {"old", "older"}
    assert out.column("text").to_pylist() == [None if r[3] in gone else r[3] for r in given]


def test_the_state_is_asked_once_for_a_page():
    import pandas as pd

    from quire.streaming.versions import newest_pages

    class Held:
        def __init__(self):
            self.rows, self.calls = {(2,): (7,)}, []

        def getValue(self, key):
            self.calls.append(("get", key))
            return self.rows.get(key)

        def updateValue(self, key, value):
            self.calls.append(("update", key))
            self.rows[key] = value

        def get(self):
            return None

        def update(self, value):
            pass

    class Handle:
        held = Held()

        def getMapState(self, *_):
            return self.held

        def getValueState(self, *_):
            return Held()

        def registerTimer(self, _):
            pass

    pages, ts = newest_pages(10), pd.Timestamp("2024-01-01", tz="UTC")
    pages.init(Handle())
    rows_ = [pd.DataFrame({"page": [1, 2] * 50, "version": range(i, i + 100), "text": "t", "ts": ts}) for i in (5, 0)]
    out = next(pages.handleInputRows(("d",), iter(rows_), None))
    assert sorted(Handle.held.calls) == [("get", (1,)), ("get", (2,)), ("update", (1,)), ("update", (2,))]
    assert Handle.held.rows == {(1,): (103,), (2,): (104,)}
    page_two = out[out["page"] == 2]
    assert page_two["op"].tolist()[:3] == ["delete", "put", "delete"] and page_two["version"].tolist()[:3] == [7, 8, 8]
