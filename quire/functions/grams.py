"""Keys of short runs of bytes, which phrases and texts meet by.

A text holds a phrase only where its bytes hold every run of bytes of the phrase, so one run of a
phrase, its anchor, is enough to look for it. Keys are 64-bit hashes; a salt of the row goes into
them, so that runs of different documents need not meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

# Lengths of anchors in bytes; a phrase has the longest that fits. Those of SEED bytes and more begin
# with a seed of that many, which is looked for first, so all of them cost a text one pass; a long
# phrase then meets few texts that do not hold it.
SIZES = (128, 64, 32, 20, 12, 4, 3, 2, 1)
SEED = 12
# Bytes that are looked at together: their arrays stay in a core's cache.
WINDOW = 1 << 16


def _tools() -> tuple[Callable, Callable, Callable]:
    """Functions of the tasks; nested, so that they are shipped whole."""
    import numpy as np
    import pyarrow as pa

    def mixed(x):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x

    def keys(data, size, salt):
        """Key of the run of ``size`` bytes at every place where one begins."""
        n = len(data) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        run = data.astype(np.uint64)
        if size > 1:
            pair = run[:-1] | run[1:] << np.uint64(8)
            run = pair if size == 2 else pair[:-1] | run[2:] << np.uint64(16) if size == 3 else pair[:-2] | pair[2:] << np.uint64(16)
        if size == 12:
            run = mixed(run[:-8] | run[4:-4] << np.uint64(32)) ^ run[8:]
        return mixed(run ^ salt[:n] ^ np.uint64(size << 56))

    def grown(seeds, data, places, size):
        """Keys of the runs of ``size`` bytes at ``places``, from those of their seeds."""
        words = data[places[:, None] + np.arange(size)].view(np.uint32).astype(np.uint64)
        key = seeds ^ np.uint64(size << 56)
        for at in range(words.shape[1]):
            key = mixed(key ^ words[:, at])
        return key

    def bytes_of(texts):
        """All bytes of a column, and where each row begins and the last one ends."""
        texts = texts.fill_null("").cast(pa.large_binary())
        _, places, data = texts.buffers()
        at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8), at - at[0]

    return keys, grown, bytes_of


def anchor_size(text: str) -> Column:
    return F.coalesce(*[F.when(F.octet_length(text) >= g, F.lit(g)) for g in SIZES])


def anchor_keys(text: str, salt: Column) -> Column:
    """Keys of one run of a phrase's bytes, as array<bigint>: its own, and before it that of its seed if it has one.

    The run is picked by hash: phrases that begin alike do not all meet at one.
    """
    keys, grown, bytes_of = _tools()
    sizes, seed, window = SIZES, SEED, WINDOW

    def run(texts: pa.Array, salts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        data, at = bytes_of(texts)
        salts = salts.to_numpy(zero_copy_only=False).view(np.uint64)
        length = np.diff(at)
        first, own, a = np.zeros(len(length), np.uint64), np.zeros(len(length), np.uint64), 0
        while a < len(length):
            b = max(a + 1, int(np.searchsorted(at, at[a] + window, "right")) - 1)
            piece = data[at[a] : at[b]]
            salt = np.repeat(salts[a:b], length[a:b])
            above, known = np.inf, {}
            for size in sizes:
                rows = np.flatnonzero((length[a:b] >= size) & (length[a:b] < above))
                above = size
                if not len(rows):
                    continue
                base = min(size, seed)
                if base not in known:
                    known[base] = keys(piece, base, salt)
                begins = at[a:b][rows] - at[a]
                ends = begins + length[a:b][rows] - size + 1
                places = np.array([x + int(np.argmin(known[base][x:y])) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)])
                first[a + rows] = known[base][places]
                own[a + rows] = first[a + rows] if size < seed else grown(first[a + rows], piece, places, size)
            a = b
        seeded = (length >= seed) + 1
        ends = np.append(0, np.cumsum(seeded))
        found = np.zeros(ends[-1], np.uint64)
        found[ends[:-1]] = first
        found[ends[1:] - 1] = own
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.view(np.int64)))

    return F.arrow_udf(run, "array<bigint>")(F.col(text), salt)


def _slots(key: Column, n_bits: int) -> list[Column]:
    """Places of a key in a filter of ``n_bits``, a power of two."""
    high = F.shiftrightunsigned(key, 17).bitwiseXOR(F.shiftrightunsigned(key, 43))
    return [k.bitwiseAND(F.lit(n_bits - 1)) for k in (key, F.shiftrightunsigned(key, 32), high)]


def filter_of(keyed: DataFrame, n_words: int) -> np.ndarray:
    """All of ``keys`` as a filter of 64-bit words with three bits set for each, made by tasks."""
    each = keyed.select(F.explode("keys").alias("key"))
    places = each.select(F.explode(F.array(*_slots(F.col("key"), n_words * 64))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    found = places.groupBy(F.shiftrightunsigned("at", 6).cast("int").alias("id")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(n_words, np.int64)
    words[found["id"].to_numpy()] = found["bits"].to_numpy()
    return words.view(np.uint64)


def keys_within(text: str, salt: Column, words: Broadcast, sizes: list[int]) -> Column:
    """Distinct keys of a text's runs of ``sizes`` bytes that pass the filter, as array<bigint>.

    A filter may let other keys pass; it keeps back none that it was made of.
    """
    keys, grown, bytes_of = _tools()
    window, seed = WINDOW, SEED
    bases = sorted({min(size, seed) for size in sizes})

    def run(texts: pa.Array, salts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        data, at = bytes_of(texts)
        salts = salts.to_numpy(zero_copy_only=False).view(np.uint64)
        bits, last = words.value, np.uint64(len(words.value) * 64 - 1)
        rows, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        most = max(sizes, default=0)

        def passing(run_keys, places):
            for one in (lambda k: k, lambda k: k >> np.uint64(32), lambda k: k >> np.uint64(17) ^ k >> np.uint64(43)):
                slot = one(run_keys) & last
                passed = np.flatnonzero(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                run_keys, places = run_keys[passed], places[passed]
            return run_keys, places

        for begin in range(0, len(data), window) if sizes else ():
            # Runs that begin in the window, and end in their own row.
            end = min(begin + window + most - 1, len(data))
            a, b = int(np.searchsorted(at, begin, "right")) - 1, int(np.searchsorted(at, end, "left"))
            salt = np.repeat(salts[a:b], np.diff(np.clip(at[a : b + 1], begin, end)))
            for base in bases:
                run_keys = keys(data[begin:end], base, salt)[:window]
                run_keys, places = passing(run_keys, np.arange(len(run_keys)))
                own = a + np.searchsorted(at[a:b], places + begin, "right") - 1
                for size in (s for s in sizes if min(s, seed) == base):
                    whole = places + begin + size <= at[own + 1]
                    key, place = run_keys[whole], places[whole]
                    if size >= seed:
                        key, place = passing(grown(key, data[begin:end], place, size), place)
                    rows.append(a + np.searchsorted(at[a:b], place + begin, "right") - 1)
                    found.append(key)
        row, key = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        row, key = row[first], key[first]
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(texts))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.view(np.int64)))

    return F.arrow_udf(run, "array<bigint>")(F.col(text), salt)
