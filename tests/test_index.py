"""The inverted index gives what the plain product gives."""

import random
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pytest

from quire.functions import postings
from quire.functions.postings import Shard
from quire.operators import chunking, index, retrieval
from tests.conftest import pages


def words(rng, n, vocabulary=300):
    return " ".join(f"w{int(rng.paretovariate(0.8)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randint(1, 400)) for _ in range(120)]
    texts += [texts[5]] * 40 + ["the of and"] * 3 + [words(rng, 6000)]
    rows = [(f"d{i:03}", f"d{i}.pdf", 1, t) for i, t in enumerate(texts)]
    return chunking.chunk_documents(spark.createDataFrame(rows, "doc_id string, doc_name string, page int, text string")).cache()


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(4)
    asked = [words(rng, rng.randint(1, 60)) for _ in range(60)] + ["the of", "", None, "zzz qqq"]
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("shard, k", [(16, 6), (64, 1), (4096, 3)])
def test_index_equals_product(spark, corpus, questions, tmp_path, shard, k):
    built = index.build(corpus, str(tmp_path / "index"), shard=shard)
    want = ranked(retrieval.top_k(corpus, questions, k))
    assert ranked(index.index_top_k(built, questions, k)) == want
    # An index serves later batches too, from its files.
    assert ranked(index.index_top_k(index.load(spark, str(tmp_path / "index")), questions, k)) == want


def test_fewer_chunks_than_asked_for_and_empty_tables(spark, questions, tmp_path, lease):
    few = chunking.chunk_documents(lease)
    asked = spark.createDataFrame([(1, "late fee"), (2, "unrelated")], "query_id long, question string")
    built = index.build(few, str(tmp_path / "few"))
    assert ranked(index.index_top_k(built, asked, 6)) == ranked(retrieval.top_k(few, asked, 6))
    empty = index.build(few.limit(0), str(tmp_path / "none"))
    assert index.index_top_k(empty, asked).count() == 0
    assert index.index_top_k(built, asked.limit(0)).count() == 0


def test_bounds_hold_and_leave_shards_out(spark, tmp_path):
    """Documents of two vocabularies: a question of one does not visit shards of the other."""
    rng = random.Random(6)
    texts = [" ".join(f"{side}{rng.randint(0, 40)}" for _ in range(80)) for side in "ab" for _ in range(64)]
    rows = [(f"{i:03}", "n", 1, t) for i, t in enumerate(texts)]
    chunks = chunking.chunk_documents(spark.createDataFrame(rows, "doc_id string, doc_name string, page int, text string"))
    built = index.build(chunks, str(tmp_path / "index"), shard=4)
    asked = spark.createDataFrame([(1, texts[0])], "query_id long, question string")
    features = retrieval.with_features(asked.withColumnRenamed("question", "text")).select("query_id", "features")
    bounds = {r["shard"]: r["bound"] for r in index.bounds(built, features).collect()}
    own = retrieval.score_chunks(chunks, asked).join(built.chunks, "chunk_id").collect()
    best = max(r["score"] for r in own)
    assert all(r["score"] <= bounds[r["shard"]] + 1e-9 for r in own)
    assert best > 0.99 and sum(b >= best for b in bounds.values()) < built.sizes.count()


def test_shard_stops_reading_lists():
    """Rows that cannot reach the best are dropped before all lists are read."""
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2000, 64)) * (rng.random((2000, 64)) < 0.4)
    rows[7] = rng.normal(size=64)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    lists = {b: (np.flatnonzero(rows[:, b]).astype(np.int32), rows[np.flatnonzero(rows[:, b]), b]) for b in range(64)}
    shard = Shard(2000, lists, 64)
    numbers, scores = shard.best(np.arange(64), rows[7], 1, 0.0)
    assert numbers.tolist() == [7] and scores[0] == 1.0
    assert shard.read < sum(len(n) for n, _ in lists.values())
    for seed in range(30):
        query = np.random.default_rng(seed).normal(size=64) ** 3
        query /= np.linalg.norm(query)
        exact = np.round(np.clip(rows @ query, 0, 1), 12)
        want = sorted(np.flatnonzero(exact > 0).tolist(), key=lambda i: (-exact[i], i))[:5]
        for bar in (0.0, float(exact[want[-1]])):
            numbers, scores = Shard(2000, lists, 64).best(np.arange(64), query, 5, bar)
            assert numbers.tolist() == want and np.allclose(scores, exact[want])


def test_embedders(spark):
    texts = spark.createDataFrame([(1, "red fox"), (2, "blue owl"), (3, None), (4, "red red fox")], "vec_id long, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "owl")], "query_id long, question string")
    hashed = retrieval.embed_top_k(texts, asked, retrieval.hashing_embedder(64), k=2).collect()
    assert {(r["query_id"], r["vec_id"]) for r in hashed if r["rank"] == 1} == {(1, 1), (2, 2)}

    def load():
        def model(batch):
            return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in batch]

        return model

    letters = retrieval.loaded_embedder(load, 26, 0.9)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["relevant"]) for r in retrieval.embed_top_k(texts, asked, letters, k=3).collect()}
    assert found[1, 1] == (1, True) and found[2, 1] == (2, False)


def test_chunks_are_made_once_for_many_blocks_of_questions(spark):
    rows = [(f"d{i}", "n", 1, f"word{i} and more") for i in range(50)]
    plain = chunking.chunk_documents(spark.createDataFrame(rows, "doc_id string, doc_name string, page int, text string"))
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    chunks = plain.coalesce(1).mapInPandas(counted, plain.schema)
    asked = spark.createDataFrame([(i, f"word{i % 50}") for i in range(2500)], "query_id long, question string")
    best = retrieval.score_chunks(chunks, asked, k=1)
    # One word cancels itself out in the hashed features.
    assert best.count() > 2400 and made.value == 50


def test_workers_without_the_package(tmp_path):
    """Started in a folder of its own, with the package on the driver's path only."""
    root = Path(__file__).resolve().parents[1]
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(root)!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
                 .config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).config("spark.ui.enabled", "false").getOrCreate())
        from quire.operators import chunking, index, retrieval, scan
        pages = spark.createDataFrame([("a", "a.pdf", 1, "A tenant may cancel. The late fee is $60.")], "doc_id string, doc_name string, page int, text string")
        chunks = chunking.chunk_documents(pages)
        asked = spark.createDataFrame([(1, "late fee")], "query_id long, question string")
        assert retrieval.top_k(chunks, asked).count() == 1
        assert index.index_top_k(index.build(chunks, {str(tmp_path / "i")!r}), asked).count() == 1
        vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
        assert retrieval.dense_top_k(vectors, vectors.withColumnRenamed("vec_id", "query_id")).count() == 1
        scan.scan_candidates(chunks, scan.categories(spark)).collect()
        print("all ran")
    """))
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}
    import os

    env |= {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PWD")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_visits_move_no_features(spark, corpus, questions, tmp_path, monkeypatch):
    """Shards and blocks of queries meet in a product of stored rows, whatever the number of visits."""
    built = index.build(corpus, str(tmp_path / "index"), shard=16)
    monkeypatch.setattr(index, "VISITS", 10)
    found = index.index_top_k(built, questions, 6)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan
    moved = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert moved and not any("part#" in line for line in moved)
    assert ranked(found) == ranked(retrieval.top_k(corpus, questions, 6))


def test_many_queries_of_a_shard_are_scored_together(monkeypatch):
    """As one by one, with copies, bars, negative weights and shards of few rows; no list is read for it."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(postings, "TOGETHER", 7)
    monkeypatch.setattr(postings, "PAIRS", 5)
    for size in (1, 3, 40, 300):
        rows = rng.normal(size=(size, 32)) * (rng.random((size, 32)) < 0.5)
        rows[rng.integers(0, size, size // 2)] = rows[0]
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        lists = {b: (np.flatnonzero(rows[:, b]), rows[np.flatnonzero(rows[:, b]), b]) for b in range(32)}
        queries = np.concatenate([rng.normal(size=(20, 32)), rows[:3]])
        queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
        bars = rng.choice([0.0, 0.1, 0.5, 0.9], len(queries))
        alone, shard = postings.Shard(size, lists, 32), postings.Shard(size, lists, 32)
        place, numbers, scores = shard.best_of(queries, 4, bars)
        for q, query in enumerate(queries):
            # One alone may give back more than it needs below a bar that it learned, never less.
            want = alone.best(np.flatnonzero(query), query[np.flatnonzero(query)], 4, bars[q])
            assert numbers[place == q].tolist() == want[0].tolist()
            assert np.allclose(scores[place == q], want[1], atol=2e-12)
        assert shard.read == 0
