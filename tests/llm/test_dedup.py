"""Exact, near and line de-duplication, and vectors, against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from quire.llm import components, exact, lines, minhash, shingles, vectors

from .helpers import components as plain_components
from .helpers import documents, near_links, without_repeated_windows
from .helpers import shingles as plain_shingles

EDGES = [None, "", " \t\n", "a", "A  a", "one two three four", "é\x0bè\x85", "x" * 200_000, "w " * 50_000]


def _bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_equals_plain(spark):
    rng = random.Random(4)
    texts = EDGES + ["copy of  one", "copy\tof one", "copyofone ", "copy of one"] + ["hot text"] * 300
    texts += ["".join(rng.choice("ab \n") for _ in range(6)) for _ in range(200)]
    rows = {r["doc_id"]: r for r in exact.mark(documents(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(_bare(t), []).append(i)
    assert len(rows) == len(texts)
    for bare, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        digest = hashlib.sha256(bare.encode()).hexdigest()
        for i in ids:
            r = rows[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(ids), i == keep, digest)


def test_exact_with_a_filter_that_is_too_small(spark):
    """A full filter lets more rows shuffle, and changes nothing."""
    texts = [f"text {i % 700}" for i in range(1500)]
    wide = sorted(map(tuple, exact.mark(documents(spark, texts)).collect()))
    assert wide == sorted(map(tuple, exact.mark(documents(spark, texts), max_words=1).collect()))


def test_exact_repeated_rows_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(None, "t", "x"), (3, "t", "x"), (3, "t", "x"), (5, None, "y")], "doc_id long, text string, digest string"
    )
    rows = sorted(map(tuple, exact.mark(docs).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert rows == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (5, 5, 1, True)], key=str)
    kept = exact.dedup(docs.where("doc_id IS NOT NULL").distinct())
    assert kept.columns == docs.columns and kept.count() == 2


def test_exact_is_native(spark):
    plan = exact.mark(documents(spark, ["a", "a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    none = documents(spark, [])
    assert exact.mark(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_shingle_sets_equal_plain():
    rng = random.Random(1)
    texts = EDGES + [" ".join(rng.choice(["A", "b", "cc", "É"]) for _ in range(n)) for n in range(40)]
    for size in (1, 7, len(texts)):
        found = []
        for at in range(0, len(texts), size):
            found += shingles.shingle_sets(texts[at : at + size])
        assert [len(f) for f in found] == [len(plain_shingles(t)) for t in texts]
    again = shingles.shingle_sets(texts[::-1])[::-1]
    assert all((a == b).all() for a, b in zip(found, again, strict=True))


def _near_texts(seed, base_words, copies, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    out = []
    for _ in range(6):
        base = [word() for _ in range(base_words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("edits", [2, 5])
def test_near_duplicates_equal_plain(spark, edits):
    texts = _near_texts(edits, 120, 30, edits) + EDGES[:7] + ["same words here"] * 40 + ["Same  WORDS here"]
    found = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    label = plain_components(range(len(texts)), near_links(dict(enumerate(texts))))
    assert {i: r["component_id"] for i, r in found.items()} == label
    assert all(r["n_shingles"] == len(plain_shingles(texts[i])) for i, r in found.items())
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


def test_near_duplicates_nulls_and_columns(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d e f", 1), (2, "a b c d e f", 1), (2, "a b c d e f", 1), (1, "A b c d e f", 1), (7, None, 1)],
        "doc_id long, text string, component_id int",
    )
    rows = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    want = [(None, 2, None, True), (2, 2, 1, False), (2, 2, 1, False), (1, 2, 1, True), (7, 0, 7, True)]
    assert rows == sorted(want, key=str)
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 7]


def test_signature_estimates_similarity():
    texts = _near_texts(9, 400, 2, 8)
    sets = shingles.shingle_sets(texts)
    values = minhash.signatures(sets)
    for a, b in zip(range(0, len(texts), 2), range(1, len(texts), 2), strict=True):
        true = len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
        assert abs((values[a] == values[b]).mean() - true) < 0.17


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 201), (201, 200)]
    found = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: label for i, label in plain_components({x for p in links for x in p}, links).items()}


def test_buckets_larger_than_a_block(spark):
    """Every two members of a large bucket meet once."""
    rows = [(1, 300, i, 0, bytes([i % 3])) for i in range(300)] + [(2, 1, 7, 0, b"\1")]
    members = spark.createDataFrame(rows, "bucket long, n long, id long, mark long, payload binary")
    met = components.compare_in_buckets(members, lambda bucket, mx, x, my, y: x[:, 0][:, None] == y[:, 0][None])
    assert met.count() == 3 * (100 * 99 // 2)


def test_lines_equal_plain(spark):
    rng = random.Random(3)
    pool = ["alpha one", "beta two", "gamma three", "delta", "", "  ", "alpha one  ", "\tdelta\r"]
    texts = {i: "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for i in range(120)}
    texts |= {500: "a\nb\nc", 501: "x\na\nb\nc\nd", 502: "a\nb\nc", 503: "a\na\na\na\na", 504: "\n".join(map(str, range(3000)))}
    found = {r["doc_id"]: r for r in lines.dedup_lines(documents(spark, list(texts.values()), list(texts))).collect()}
    want = without_repeated_windows(texts)
    assert {i: r["text"] for i, r in found.items()} == want
    assert all(r["n_chars"] == len(want[i]) for i, r in found.items())
    left = lines.dedup_lines(documents(spark, list(texts.values()), list(texts)), drop_emptied=True)
    assert {r["doc_id"] for r in left.collect()} == {i for i, t in want.items() if t or not texts[i]}


def test_lines_nulls_and_columns(spark):
    docs = spark.createDataFrame(
        [(None, "a\nb\nc", 1.5), (1, "a\nb\nc", None), (2, None, 2.5), (3, "a\nb\nc\nd", 3.5)],
        "doc_id long, text string, lines double",
    )
    rows = {r["doc_id"]: (r["text"], r["lines"]) for r in lines.dedup_lines(docs).collect()}
    assert rows == {None: ("a\nb\nc", 1.5), 1: ("a\nb\nc", None), 2: (None, 2.5), 3: ("d", 3.5)}


def test_vectors_equal_plain(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 64))
    rows = [base[i % 40] + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.33]) for i in range(240)]
    rows += [rows[3]] * 30 + [-rows[3], rows[4] * 7]
    data = [[float(v) for v in np.float32(r)] for r in rows]
    data += [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] * 64, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(data)], "vec_id long, embedding array<float>, n_links int")
    found = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    assert len(found) == len(data)
    n = len(rows)
    unit = np.float32(rows).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(n, dtype=bool)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)] + [(n + 6, n + 7)]
    label = plain_components(range(len(data)), links)
    assert {i: r["component_id"] for i, r in found.items()} == label
    assert [found[i]["n_links"] for i in range(n)] == near.sum(axis=1).tolist()
    assert [found[n + k]["n_links"] for k in range(8)] == [0] * 6 + [1, 1]


def test_vectors_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, -0.0])]
    found = sorted(map(tuple, vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert found == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 1, 1, False)], key=str)
