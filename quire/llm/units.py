"""Cutting texts into units that a byte-level tokenizer never joins, and counting or coding them.

The split pattern of these tokenizers (``public_tokenizers.PATTERN``) puts a single space in front
of the word that follows it, and lets a single line feed stand alone. So in a text without two
adjacent white-space characters every space and every line feed starts a new pre-token: the text
can be cut there with ``str.split``, and each unit (one or a few whole pre-tokens) is coded by
itself. Units repeat, so a worker codes each of them once and looks it up afterwards. Other texts
(and those with the special string, which the library treats apart) are given whole to the library.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

SPECIAL = "<|endoftext|>"
SLICE = 1 << 20  # characters cut at once
KEPT = 48 << 20  # bytes of a generation of kept units
LONG = 64  # characters of a unit that is worth keeping
_ENTRY = 170  # bytes of a kept unit beside its text and value
_MARKS = frozenset(".,;:!?")
_HEAD = "\0"  # marks a unit without a space in front

_ADJACENT = re.compile(r"\s\s")
_SPLIT = regex.compile(public_tokenizers.PATTERN)


def plain(text: str) -> bool:
    return SPECIAL not in text and _HEAD not in text and _ADJACENT.search(text) is None


def blocks(text: str) -> list[list[str]]:
    """Units of any text without the special string; one that ``str.split`` cannot cut is cut by the pattern."""
    return list(pieces(text)) if plain(text) else [[w] for w in _SPLIT.findall(text)]


def pieces(text: str) -> Iterator[list[str]]:
    """Units of a plain text, a block at a time.

    The first unit of a block is literal. Each later one lacks its leading space, unless it starts
    with a line feed; then it is literal too.
    """
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(" ", at + SLICE)
        if cut < 0:
            break
        yield text[at:cut].replace("\n", " \n").split(" ")
        at = cut
    yield text[at:].replace("\n", " \n").split(" ")


def literal(unit: str) -> str:
    """What a later unit stands for."""
    return unit if unit.startswith("\n") else " " + unit


@functools.cache
def tokenizer(path: str):
    """The library's tokenizer; one thread, as a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(path: str, texts: list[str]) -> list[list[int]]:
    coded = tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)
    return [c.ids for c in coded]


def ids_bytes(path: str, texts: list[str]) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""
    return [array("I", i).tobytes() for i in encode(path, texts)]


@functools.cache
def _token_bytes(path: str) -> np.ndarray:
    """How many bytes each token stands for: tokens are spelled with one character a byte."""
    known = tokenizer(path)
    return np.array([len(known.id_to_token(i) or "") for i in range(known.get_vocab_size())], dtype=np.int64)


def unit_ids(path: str, texts: list[str]) -> list[bytes]:
    """:func:`ids_bytes` of units. Those that may follow each other are coded as one text and cut by their bytes."""
    out: list[bytes | None] = [None] * len(texts)
    row = [i for i, t in enumerate(texts) if len(t) > 1 and t[0] in " \n" and not t[1].isspace() and not t[-1].isspace()]
    if row:
        ids = np.array(encode(path, ["".join([texts[i] for i in row])])[0], dtype="<u4")
        ends = np.cumsum(_token_bytes(path)[ids])
        bounds = np.cumsum([len(texts[i].encode()) for i in row])
        cuts = np.searchsorted(ends, bounds) + 1
        if cuts[-1] == len(ends) and (ends[cuts - 1] == bounds).all():
            raw, at = ids.tobytes(), 0
            for i, cut in zip(row, (4 * cuts).tolist(), strict=True):
                out[i] = raw[at:cut]
                at = cut
    rest = [i for i, ids in enumerate(out) if ids is None]
    for i, ids in zip(rest, ids_bytes(path, [texts[i] for i in rest]), strict=True):
        out[i] = ids
    return out


def byte_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SLICE`` bytes each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE)))
        yield at, min(end, len(sizes))
        at = min(end, len(sizes))


class Known:
    """Values of units, worked out for all unknown units of a slice at once, then kept.

    They are kept in two generations: when the younger one holds ``KEPT`` bytes it becomes the older
    one, and what is met again moves back, so frequent units stay. ``first`` has values to begin with
    (a broadcast table). Units over ``LONG`` characters serve their slice only.
    """

    def __init__(self, code: Callable[[list[str]], list], first: dict | None = None):
        self.code = code
        self.young, self.old, self.size = _Chain(self), {}, 0
        self.once: dict = {}
        self.begun: dict | None = None
        self.begin(first)

    def begin(self, first: dict | None) -> None:
        """Take over values that are there already."""
        if first and first is not self.begun:
            self.begun = first
            self.young.update(first)
            self.size += _ENTRY * len(first)

    def learn(self, cut: list[list[str]]) -> None:
        """Make the units of these blocks known."""
        wanted: set[str] = set()
        for block in cut:
            wanted.update(block[1:])
        wanted.update(_HEAD + block[0] for block in cut if block[0])
        self.once = {}
        if self.size > KEPT:
            self.young, self.old, self.size = _Chain(self), dict(self.young), 0
        young, old = self.young, self.old
        missing = [u for u in wanted if u not in young]
        self._keep({u: old[u] for u in missing if u in old})
        unknown, split = [], []
        for u in missing:
            if u not in old:
                (split if u[-1:] in _MARKS and u[-2:-1].isalnum() else unknown).append(u)
        # A mark behind a word is a pre-token of its own: both parts are known more often than the whole.
        parts = {p for u in split for p in (u[:-1], _HEAD + u[-1]) if p not in young}.difference(wanted)
        self._keep({p: old[p] for p in parts if p in old})
        unknown.extend(p for p in parts if p not in old)
        self._keep(dict(zip(unknown, self.code([_spelled(u) for u in unknown]), strict=True)))
        self._keep({u: young[u[:-1]] + young[_HEAD + u[-1]] for u in split})

    def _keep(self, found: dict) -> None:
        if found and max(map(len, found)) > LONG:
            self.once.update((u, v) for u, v in found.items() if len(u) > LONG)
            found = {u: v for u, v in found.items() if len(u) <= LONG}
        self.young.update(found)
        texts = sum(map(len, found))
        if found and isinstance(next(iter(found.values())), bytes):
            texts += sum(map(len, found.values()))
        self.size += texts + _ENTRY * len(found)

    def values(self, block: list[str]) -> list:
        """Values of a block's units in order."""
        found = [self.young[_HEAD + block[0]]] if block[0] else []
        found.extend(map(self.young.__getitem__, block[1:]))
        return found


class _Chain(dict):
    """The younger units, and behind them those that only the slice needs."""

    def __init__(self, known: Known):
        super().__init__()
        self.known = known

    def __missing__(self, unit):
        return self.known.once[unit]


def _spelled(key: str) -> str:
    return key[1:] if key[:1] == _HEAD else key if key[:1] == "\n" else " " + key


_kept: dict[tuple[str, str], Known] = {}


def kept(name: str, path: str, code: Callable[[list[str]], list], first: dict | None = None) -> Known:
    """The units that this worker process has met, whatever the task; ``name`` and ``path`` tell the values apart."""
    known = _kept.setdefault((name, path), Known(code))
    known.begin(first)
    return known


def release() -> None:
    """Let kept units go; for tasks of other kinds that the same worker process runs."""
    _kept.clear()
