"""Word shingles of whole texts, hashed for a block of documents at a time with numpy.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z. A document's set
holds the 64-bit hashes of its distinct five-word shingles; a shorter document has one entry for
its whole word sequence, and a document without words (or with a null text) has an empty set.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
BLOCK = 1 << 20  # bytes hashed at once; a document may be longer, it is hashed in several blocks

_rng = np.random.default_rng(20260701)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1, 1 << 63, size=WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a lower-cased block."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def _cut(data: bytes, begin: int) -> int:
    """End of the block from ``begin``, behind white space."""
    end = begin + BLOCK
    if end >= len(data):
        return len(data)
    while end < len(data) and data[end - 1] not in b" \t\n\x0b\x0c\r":
        end += 1
    return end


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin (n + 1 values)."""
    encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = b" ".join(encoded)
    begins = np.cumsum([0] + [len(e) + 1 for e in encoded])
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = _cut(data, at)
        s, h = _hash_block(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For every text its sorted distinct shingle hashes."""
    words, first = word_hashes(texts)
    n = len(words)
    long = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        long += words[k : k + len(long)] * _MIX[k]
    long = mix(long)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(long[a : b - WORDS + 1]))
        elif b > a:
            whole = np.uint64(0)
            with np.errstate(over="ignore"):
                for k in range(a, b):
                    whole += words[k] * _MIX[k - a]
                whole += np.uint64(b - a) * _MIX[WORDS]
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def slices(texts: list[str | None], limit: int = BLOCK):
    """Ranges of rows with about ``limit`` characters each, one row at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
