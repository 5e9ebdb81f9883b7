"""Token counts, BPE and packing against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe, counts, packing, units

from .helpers import documents

JSON = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = [
    "a", "b", "é", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "​", "1", "²", "½", "Ⅷ", "'s", "'",
    "中文", "🎉", "́", "ß", "'ll", "!", "...", "_", "﻿", "the ", "ing", "\x0b", "\x1f", "aaaa", units.SPECIAL,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return [None, "", "x" * 30_000, "word and word. " * 20_000, "lines\n" * 3000, *made]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_library(spark, texts, library):
    rows = counts.token_counts(documents(spark, texts), JSON).collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows}
    want = {}
    for i, t in enumerate(texts):
        n = len(_ids(library, t))
        want[i] = (len((t or "").encode()), n, n > 512)
    assert found == want


def test_counts_without_table_and_with_few_kept(spark, texts, monkeypatch):
    """Neither tier's size changes a count."""
    docs = documents(spark, texts)
    wide = {r["doc_id"]: r["n_tokens"] for r in counts.token_counts(docs, JSON).collect()}
    assert wide == {r["doc_id"]: r["n_tokens"] for r in counts.token_counts(docs, JSON, table=1).collect()}
    monkeypatch.setattr(units, "KEPT", 3)
    known = units.Known(lambda parts: [len(i) for i in units.encode(JSON, parts)])
    for i, t in enumerate(texts):
        if t and units.plain(t):
            blocks = list(units.pieces(t))
            known.learn(blocks)
            assert sum(v for b in blocks for v in known.values(b)) == wide[i]


def test_counts_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in counts.token_counts(docs, JSON).collect()) == [0, 2]
    assert counts.token_counts(documents(spark, []), JSON).count() == 0


def test_bpe_equals_library(spark, texts):
    ranks = bpe.vocabulary(MULTI).ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, texts)
    coded = bpe.encode(docs, MULTI)
    found = {r["doc_id"]: r["ids"] for r in coded.collect()}
    want = {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert found == want
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(coded, MULTI).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.round_trip(docs, MULTI).collect():
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_replay_takes_a_lower_rank_first(tmp_path):
    """Ranks that fall along a merge chain: as the library, the lowest pair at any time, leftmost first."""
    tokens = [bytes([b]) for b in range(256)] + [b"abab", b"ab", b"aba", b"bab", b"aa", b"aaa", b"aab"]
    for seed in range(6):
        rng = random.Random(seed)
        tail = tokens[256:]
        rng.shuffle(tail)
        path = tmp_path / f"{seed}.tiktoken"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens[:256] + tail)))
        known = bpe.Vocabulary(str(path))
        own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=known.ranks, special_tokens={})
        words = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 14))) for _ in range(300)]
        assert known.replay([w.encode() for w in words]) == [own.encode_ordinary(w) for w in words]


def test_bpe_null_ids(spark):
    docs = spark.createDataFrame([(None, None), (1, "a")], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in bpe.round_trip(docs, MULTI).collect()) == [0, 1]
    assert bpe.round_trip(documents(spark, []), MULTI).count() == 0


def _check_packing(rows, lengths, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(lengths)
    for doc, n in lengths.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == capacity or k == 0)
            at += r["length"]
        assert at == n
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_places_every_piece(spark, texts, library):
    rows = packing.packed(documents(spark, texts), JSON).collect()
    ids = {i: np.array([*_ids(library, t), 0], "<u4") for i, t in enumerate(texts)}
    n = _check_packing(rows, {i: len(v) for i, v in ids.items()}, 2048)
    assert all(
        r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in rows
    )
    assert n <= 1.1 * sum(map(len, ids.values())) / 2048 + 2


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6, 1, 4000).astype(int) + 1, 1, 2048)
    where, offset = packing.place(lengths, 2048)
    assert len(set(zip(where, offset, strict=True))) == len(lengths)
    assert where.max() + 1 <= 1.01 * np.ceil(lengths.sum() / 2048)


def test_packing_ties_follow_the_squares():
    """Of two open sequences with room the one goes whose gap is the commoner one."""
    where, _ = packing.place(np.array([7, 7, 6, 3]), 10)
    assert where[3] in (where[0], where[1]) and where[2] not in (where[0], where[1])


def test_packing_repeated_ids_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = packing.packed(docs, JSON).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (1, 3), (1, 3)]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.packed(documents(spark, []), JSON).count() == 0


def test_sequences_hold_the_ids(spark, library):
    texts = ["one two three", "four", "five six " * 40]
    got = packing.sequences(documents(spark, texts), JSON, capacity=64).collect()
    total = sorted(i for r in got for i in np.frombuffer(r["ids"], "<u4").tolist())
    assert total == sorted(i for t in texts for i in [*_ids(library, t), 0])
    assert all(len(r["ids"]) <= 4 * 64 for r in got)


def test_long_units_are_not_kept_and_generations_turn(monkeypatch):
    """Texts without spaces: nothing of them stays in the worker, and counts hold."""
    known = units.Known(lambda parts: [len(i) // 4 for i in units.unit_ids(JSON, parts)])
    for k in range(40):
        text = f"{'字' * 5000}{k} a{k} word, word. end"
        blocks = list(units.pieces(text))
        known.learn(blocks)
        assert sum(v for b in blocks for v in known.values(b)) == len(units.encode(JSON, [text])[0])
    assert max(map(len, known.young)) <= units.LONG + 1 and len(known.young) < 200
    monkeypatch.setattr(units, "KEPT", 20_000)
    turning = units.Known(lambda parts: [len(i) // 4 for i in units.unit_ids(JSON, parts)])
    for k in range(300):
        blocks = [["", *(f"w{k * 7 + j}" for j in range(10)), "often"]]
        turning.learn(blocks)
        assert turning.values(blocks[0]) == [len(units.encode(JSON, [f" {u}"])[0]) for u in blocks[0][1:]]
    assert "often" in turning.young and len(turning.young) + len(turning.old) < 400


def test_units_coded_together_equal_each_alone():
    rng = random.Random(5)
    parts = ["a", "don't", "12", "…", "é", "中文", "x,", "--", "\ttab", "end\t", "", " ", "\n", "\nq", "'s", "🎉!", "\u00a0n", "n\u00a0", "b\rc"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) for _ in range(800)]
    texts += [" " + t for t in texts] + ["\n" + t for t in texts]
    assert units.unit_ids(JSON, texts) == units.ids_bytes(JSON, texts)


def test_whole_corpora_with_long_units_and_other_columns(spark):
    rng = random.Random(2)
    texts = ["漢" * 100_000, "x" * 200_000, "a\n\nb  c\r\n\tindented\n\n\nend " * 50, f"{units.SPECIAL} a  b", "nul\0byte \0x"]
    texts += [" ".join(rng.choice(["word,", "don't", "end.", "\n", "", "été!"]) for _ in range(60)) for _ in range(100)]
    docs = documents(spark, texts).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("clash")).withColumn("part", F.lit(0))
    library = Tokenizer.from_file(JSON)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in counts.token_counts(docs, JSON).collect()} == want
    sizes = {}
    for r in packing.packed(docs, JSON).collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: n + 1 for i, n in want.items()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(MULTI).ranks, special_tokens={})
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(docs, MULTI).collect()} == {i: len(own.encode_ordinary(t)) for i, t in enumerate(texts)}

