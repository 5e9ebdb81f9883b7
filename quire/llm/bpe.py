"""Byte-level BPE by replaying the merges over all distinct words of a slice at once.

The words of a slice lie end to end in one array of token ids. An inverted index holds, for every
rank, the positions of the pairs that would merge into it. Ranks are taken in order; each merge is
applied at all its positions, from left to right, and only the pairs with the two neighbours of a
merged place are looked up again. A word whose bytes are a token is that token. Ranks need not grow
along a merge chain: a lower rank that turns up is taken before the rest of the current one.

A worker process keeps the ids of the words and units it has met, whatever the task, in two generations
of bounded size; a slice replays only words that are new there, and no pre-token is shuffled. Decoding
joins the tokens' bytes.

A null text is empty (no ids). Every row gives one row. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm import units
from quire.llm.shared import batches

WORDS = 300_000  # words of a generation that a worker keeps the ids of
GONE = -1  # a place whose token was merged into its left neighbour
_SPLIT = regex.compile(public_tokenizers.PATTERN)


class Vocabulary:
    """Ranks of a ``.tiktoken`` file; a token's id is its rank."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.words: dict[str, bytes] = {}  # ids of words met, and of those met some time ago
        self.older: dict[str, bytes] = {}
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        # Every way to join two tokens into one: left << 32 | right -> rank.
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self._single = np.array(self.single)
        self._first = np.array(
            [[self.pairs.get(a << 32 | b, -1) for b in self.single] for a in self.single], dtype=np.int64
        )

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word by the merges."""
        whole = [self.ranks.get(w) for w in words]
        parts = [w for w, rank in zip(words, whole, strict=True) if rank is None]
        merged = iter(self._replay(parts))
        return [[rank] if rank is not None else next(merged) for rank in whole]

    def _replay(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        pairs = self.pairs
        raw = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum([0] + [len(w) for w in words])
        n = len(raw)
        ids = self._single[raw].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for begin in begins[:-1].tolist():
            before[begin] = after[begin - 1] = -1
        # The index of the bytes' own pairs: positions grouped by rank.
        rank_at = self._first[raw[:-1], raw[1:]]
        rank_at[begins[1:-1] - 1] = -1
        places = np.flatnonzero(rank_at >= 0)
        places = places[np.argsort(rank_at[places], kind="stable")]
        found, starts = np.unique(rank_at[places], return_index=True)
        index = {
            rank: group.tolist()
            for rank, group in zip(found.tolist(), np.split(places, starts[1:]), strict=True)
        } if len(places) else {}
        waiting = list(index)  # in order, so already a heap
        while waiting:
            rank = heapq.heappop(waiting)
            held = index.pop(rank, ())
            if len(held) > 1:
                held.sort()
            for done, at in enumerate(held):
                right = after[at]
                if right < 0 or pairs.get(ids[at] << 32 | ids[right]) != rank:
                    continue
                ids[at], ids[right] = rank, GONE
                beyond, left = after[right], before[at]
                after[at], after[right] = beyond, -1
                lower = False
                if beyond >= 0:
                    before[beyond] = at
                    new = pairs.get(rank << 32 | ids[beyond])
                    if new is not None:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(waiting, new)
                            lower = new < rank
                if left >= 0:
                    new = pairs.get(ids[left] << 32 | rank)
                    if new is not None:
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heapq.heappush(waiting, new)
                            lower = lower or new < rank
                if lower:
                    index.setdefault(rank, []).extend(held[done + 1 :])
                    heapq.heappush(waiting, rank)
                    break
        bounds = begins.tolist()
        return [[i for i in ids[a:b] if i != GONE] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def code(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit numbers; their words that are not known yet are replayed together."""
        split = [_SPLIT.findall(t) for t in texts]
        wanted = {w for s in split for w in s}
        if len(self.words) > WORDS:
            self.words, self.older = {}, self.words
        words, older = self.words, self.older
        new = []
        for w in wanted:
            if w not in words:
                if w in older:
                    words[w] = older[w]
                else:
                    new.append(w)
        once = {}
        for w, ids in zip(new, self.replay([w.encode() for w in new]), strict=True):
            (words if len(w) <= units.LONG else once)[w] = array("I", ids).tobytes()
        if once:
            words = words | once
        return [words[s[0]] if len(s) == 1 else b"".join([words[w] for w in s]) for s in split]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _words(path: str) -> units.Known:
    """The ids of the units that a worker has met."""
    return units.kept("merged", path, vocabulary(path).code)


def _coded(keys: pa.Array, texts: pa.Array, known: units.Known) -> Iterator[tuple]:
    """Key and ids (bytes) of every row."""
    for begin, end in units.byte_slices(texts):
        part = texts.slice(begin, end - begin).to_pylist()
        cut = [units.blocks(t or "") if units.SPECIAL not in (t or "") else [[w] for w in _SPLIT.findall(t)] for t in part]
        known.learn([block for blocks in cut for block in blocks])
        for key, blocks in zip(keys.slice(begin, end - begin).to_pylist(), cut, strict=True):
            yield key, b"".join([b"".join(known.values(block)) for block in blocks])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every whole text."""
    kind = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words(path)
        for batch in source:
            keys = batch.column(0)
            schema = pa.schema([("doc_id", keys.type), ("ids", pa.list_(pa.int32()))])
            rows = ((key, np.frombuffer(ids, "<u4")) for key, ids in _coded(keys, batch.column(1), known))
            yield from batches(rows, schema, 256)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id, bytes`` of every row of ids; null ids give null."""
    kind = T.StructType([coded.schema["doc_id"], T.StructField("bytes", T.BinaryType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in source:
            keys = batch.column(0)
            schema = pa.schema([("doc_id", keys.type), ("bytes", pa.binary())])
            rows = (
                (key, None if ids is None else b"".join([tokens[i] for i in ids.values.to_numpy()]) if len(ids) else b"")
                for key, ids in zip(keys.to_pylist(), (x if x.is_valid else None for x in batch.column(1)), strict=True)
            )
            yield from batches(rows, schema, 256)

    return coded.select("doc_id", "ids").mapInArrow(run, kind)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass, digests only."""
    kind = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
         T.StructField("decoded_sha256", T.StringType())]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = vocabulary(path), _words(path)
        for batch in source:
            keys = batch.column(0)
            schema = pa.schema(
                [("doc_id", keys.type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
            )
            yield from batches(_digests(keys, batch.column(1), known, tables), schema)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _digests(keys, texts, known, tables):
    for key, packed in _coded(keys, texts, known):
        ids = np.frombuffer(packed, "<u4").tolist()
        listed = ",".join(map(tables.digits.__getitem__, ids))
        decoded = b"".join(map(tables.tokens.__getitem__, ids))
        yield key, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()
