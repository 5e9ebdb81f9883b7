"""Registered queries and the pipeline on the smallest tables."""

import array
import hashlib
import os
import re
import zlib
from html import unescape

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import bpe
from quire.llm.queries import QUERIES
from tools.check_queries import TABLES, canonical

from .helpers import components, near_links, without_repeated_windows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    run, sql = QUERIES[name]
    df, cur = run(spark, FOLDER), db.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), names)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_near_duplicates_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r["doc_id"]: r["component_id"] for r in QUERIES["op7_near_duplicates"][0](spark, FOLDER).collect()}
    assert found == components(texts, near_links(texts))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, FOLDER)
    assert good.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in texts for i in clean) >= 0.97 * len(clean)

    cut = stages["line dedup"](spark, good, FOLDER)
    want = {i: t for i, t in without_repeated_windows(texts).items() if t or not texts[i]}
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == want

    left = stages["near duplicates"](spark, cut, FOLDER)
    label = components(want, near_links(want, 80))
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert left.columns == docs.columns and set(kept) == {i for i in want if label[i] == i}

    packed = stages["packing"](spark, left, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    sizes = {}
    for r in packed:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == lengths


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def _texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_packing_query_equals_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, used = {}, {}
    for r in QUERIES["op2_pack_documents"][0](spark, FOLDER).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in _texts(spark).items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        rows = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and sum(r["length"] for r in rows) == len(ids)
        for r in rows:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(array.array("I", own).tobytes())
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_coding_and_counting_queries_equal_libraries(spark):
    texts = _texts(spark)
    ranks = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    coded = {r["doc_id"]: r for r in QUERIES["op5_bpe_round_trip"][0](spark, FOLDER).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counted = {r["doc_id"]: r for r in QUERIES["op9_token_counts"][0](spark, FOLDER).collect()}
    assert coded.keys() == counted.keys() == texts.keys()
    for doc, text in texts.items():
        ids, r = own.encode_ordinary(text), coded[doc]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode()))
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert tuple(counted[doc]) == (doc, len(text.encode()), n, n > 512)


def test_quality_and_main_text_queries(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op4_quality_scores"][0](spark, FOLDER).collect()}
    assert rows.keys() == _texts(spark).keys() and all(r["kept"] == (r["score"] >= 0.25) for r in rows.values())
    clean = [rows[i]["kept"] for i, q in labels.items() if q == 1]
    assert sum(clean) >= 0.97 * len(clean)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = {r["page_id"]: r for r in QUERIES["op10_main_text"][0](spark, FOLDER).collect()}
    assert found.keys() == pages.keys()
    for page, html in pages.items():
        lines, article = found[page]["text"].split("\n"), " ".join(unescape(re.sub("<[^>]*>", " ", html.split("<article>")[1].split("</article>")[0])).split())
        assert found[page]["n_chars"] == len(found[page]["text"]) and all(line.replace(" ", "") in article.replace(" ", "") for line in lines)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_corpus_and_other_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
    few = docs.where("doc_id < 40").withColumn("n_tokens", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("__y", F.lit(2))
    out = stage(spark, few, FOLDER)
    assert out.count() > 0 and (name == "packing" or out.columns == few.columns)
