import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quire.functions.text import dense_vector, hash_features, l2_normalize, tokens
from quire.operators import chunking, retrieval


def ask(spark, pages, question, answers=None, doc_ids=None, k=6):
    asked = spark.createDataFrame([(1, question)], "query_id int, question string")
    scope = None if doc_ids is None else spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
    hits = retrieval.top_k(chunking.chunk_documents(pages), asked, k, scope)
    gated = retrieval.relevance_gate(hits, asked, pages)
    said = None if answers is None else spark.createDataFrame(
        [(1, *answers)], "query_id int, found boolean, answer string, citations array<double>"
    )
    return retrieval.ask_batch(asked, gated, said).collect()[0], gated.orderBy("rank").collect()


def features(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(hash_features(tokens(F.col("t"))).alias("f")).collect()[0]["f"]


def test_golden_features(spark):
    one = features(spark, "abc")
    digest = int(hashlib.md5(b"abc").hexdigest()[:8], 16)
    assert digest == 0x90015098
    assert [(r["bucket"], r["weight"]) for r in one] == [(152, 1.0)]
    two = {r["bucket"]: r["weight"] for r in features(spark, "abc ABC def")}
    other = next(w for b, w in two.items() if b != 152)
    assert two[152] / abs(other) == pytest.approx(1 + math.log(2))
    assert features(spark, "what is the of and") == []


def test_unit_length_and_dense_form(spark):
    df = spark.createDataFrame([("late fee late rent",), ("the",)], "t string")
    f = l2_normalize(hash_features(tokens(F.col("t"))))
    rows = df.select(f.alias("f"), dense_vector(f).alias("v")).collect()
    assert sum(x["weight"] ** 2 for x in rows[0]["f"]) == pytest.approx(1)
    assert len(rows[0]["v"]) == 512 and sum(x * x for x in rows[0]["v"]) == pytest.approx(1)
    assert set(rows[1]["v"]) == {0.0}


def test_finds_the_right_page_and_document(spark, lease, manual):
    _, hits = ask(spark, lease, "Am I allowed to keep a pet?")
    assert hits[0]["page"] == 2
    both = lease.unionByName(manual)
    _, hits = ask(spark, both, "how long is the blender motor warranty")
    assert hits[0]["doc_id"] == "manual" and "warranty" in hits[0]["quote"].lower()
    _, hits = ask(spark, both, "how long is the warranty", doc_ids=["lease", "nobody"])
    assert {h["doc_id"] for h in hits} == {"lease"}
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    _, hits = ask(spark, both, "rent and fees", k=2)
    assert len(hits) == 2
    assert ask(spark, both, "rent", doc_ids=["nobody"])[1] == []


def test_zero_scores_rank_in_document_order(spark, lease, manual):
    both = lease.unionByName(manual)
    _, hits = ask(spark, both, "the of and")
    assert [(h["doc_id"], h["page"], h["score"]) for h in hits] == [
        ("lease", 1, 0.0), ("lease", 2, 0.0), ("lease", 3, 0.0), ("manual", 1, 0.0), ("manual", 2, 0.0),
    ]


def test_abstain_layers(spark, lease):
    answer, _ = ask(spark, lease, "quantum zebra harmonics flugelhorn recipe")
    assert (answer["found"], answer["mode"], len(answer["sources"])) == (False, "abstain", 3)
    declined, _ = ask(spark, lease, "rules about rent payment?", (False, "Not about parking.", []))
    assert (declined["mode"], declined["answer"]) == ("abstain", "Not about parking.")
    for cites in ([99.0, -1.0], [], [0.5]):
        made_up, _ = ask(spark, lease, "What is the late fee?", (True, "Trust me.", cites))
        assert (made_up["mode"], made_up["answer"]) == ("abstain", retrieval.ABSTAIN_TEXT)
    plain, _ = ask(spark, lease, "What is the late fee?")
    assert (plain["mode"], plain["found"]) == ("extractive", False) and plain["sources"]


def test_supported_answer_keeps_order_and_receipts(spark, lease):
    answer, hits = ask(spark, lease, "rent late fee and pet fee", (True, "ok", [1.0, 0.0, 1.0, 0.0]))
    assert answer["found"] and answer["mode"] == "llm"
    assert [s["chunk_id"] for s in answer["sources"]] == [hits[1]["chunk_id"], hits[0]["chunk_id"]]
    text = {r["page"]: r["text"] for r in lease.collect()}
    for s in answer["sources"]:
        assert text[s["page"]][s["start"] : s["end"]] == s["quote"]


def test_many_queries_meet_the_chunks_in_blocks(spark, lease, manual, monkeypatch):
    from quire.functions import scoring

    both = chunking.chunk_documents(lease.unionByName(manual))
    asked = spark.createDataFrame(
        [(i, q) for i, q in enumerate(["pet fee", "blender motor", "late rent", "written notice", "the"])],
        "query_id int, question string",
    )
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    once = key(retrieval.top_k(both, asked, 3))
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 2)
    assert key(retrieval.top_k(both, asked, 3)) == once and len(once) == 15
    assert key(retrieval.top_k(both.repartition(3), asked.repartition(2), 3)) == once


def test_a_third_of_all_chunks_may_be_copies(spark, monkeypatch):
    """Ties among copies are settled by document order, also across blocks and tasks."""
    from quire.functions import scoring

    monkeypatch.setattr(scoring, "BLOCK_ROWS", 16)
    texts = [("same late fee sentence" if i % 3 == 0 else f"other words {i} late") for i in range(600)]
    rows = [(i, f"d{i}", 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, doc_name string, page int, text string").repartition(7)
    asked = spark.createDataFrame([(1, "same late fee sentence")], "query_id int, question string")
    hits = retrieval.top_k(chunking.chunk_documents(df), asked, 5).orderBy("rank").collect()
    assert [h["doc_id"] for h in hits] == [0, 3, 6, 9, 12]
    assert {h["score"] for h in hits} == {1.0}


def test_dense_ranking_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8))
    vectors[5] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id int, embedding array<float>")
    asked = spark.createDataFrame([(0, [float(x) for x in vectors[17]])], "query_id int, embedding array<float>")
    got = retrieval.dense_top_k(df, asked, 4).orderBy("rank").collect()
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    want = np.argsort(-(unit @ unit[17]), kind="stable")[:4]
    assert [r["vec_id"] for r in got] == list(want)
    assert got[0]["score"] == pytest.approx(1) and got[0]["relevant"]


def test_model_output_is_untrusted(spark):
    raw = spark.createDataFrame(
        [
            (1, '{"found": true, "answer": "a", "citations": [0, 1.5]}', False),
            (2, "not json", False),
            (3, '{"found": true}', False),
            (4, "anything", True),
        ],
        "query_id int, body string, refused boolean",
    )
    rows = {r["query_id"]: r for r in retrieval.parse_answers(raw).collect()}
    assert rows[1]["found"] and rows[1]["citations"] == [0.0, 1.5] and rows[1]["reason"] is None
    assert rows[2]["reason"] == rows[3]["reason"] == "unparseable"
    assert rows[4]["found"] is False and rows[4]["citations"] == []


def test_dense_vectors_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.5, None]), (6, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<double>")
    hits = retrieval.dense_top_k(vectors, asked).collect()
    assert [(h["vec_id"], h["score"]) for h in sorted(hits, key=lambda h: h["rank"])] == [(1, 1.0), (6, 0.0)]
    faults = {r["vec_id"]: r["reason"] for r in retrieval.unusable_vectors(vectors, "vec_id", 2).collect()}
    assert faults == {2: "no-vector", 3: "wrong-length", 4: "not-a-number", 5: "not-a-number"}
    assert retrieval.dense_top_k(vectors, asked.limit(0)).count() == 0


def test_two_replies_support_nothing(spark, lease):
    asked = spark.createDataFrame([(1, "What is the late fee?")], "query_id int, question string")
    gated = retrieval.relevance_gate(retrieval.top_k(chunking.chunk_documents(lease), asked), asked, lease)
    said = spark.createDataFrame([(1, True, "one", [0.0]), (1, False, "two", [0.0])], "query_id int, found boolean, answer string, citations array<double>")
    rows = retrieval.ask_batch(asked, gated, said).collect()
    assert len(rows) == 1 and (rows[0]["mode"], rows[0]["answer"]) == ("abstain", retrieval.ABSTAIN_TEXT)


def test_queries_are_packed_by_many_tasks(spark):
    from quire.functions import scoring

    asked = spark.range(5000).selectExpr("id AS query_id", "array(double(id % 7), 1D, double(id % 3)) AS embedding")
    blocks = scoring.query_blocks(asked)
    held = blocks.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(held) == 5 and all(r["count"] <= 2 for r in held)
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "vec_id int, embedding array<double>")
    hits = retrieval.dense_top_k(vectors, asked, k=1)
    assert hits.count() == 5000 == hits.select("query_id").distinct().count()
    assert {r["vec_id"] for r in hits.where("query_id % 7 > 1").collect()} == {1}
