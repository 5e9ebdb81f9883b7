"""Repair of conversations: the cheapest edits that make roles alternate, and what they leave.

A repaired conversation is empty, or an optional system row followed by pairs of a user and an
assistant row. Rows may be kept, deleted, given another role, or a row may be inserted, each at a
cost. The answer is found by iterative-deepening A*: a depth-first search that tries edits in ASCII
order (Delete, Insert, Keep, Rerole) under a cost bound that grows from an admissible estimate, and
a table of failed states with what they are known to need at least. Bounds only grow to the least
cost that was refused, so the first accepted path is the cheapest, and the ASCII-least of those.

A conversation of any length fits: its rows are sorted over range partitions and cut into blocks of
``BLOCK`` rows. A conversation inside one block is searched at once. For others the search gives each
block's least costs between the states at its ends; these are composed backwards, block by block, to
the cost that remains behind each block, and one forward pass searches every block from the state it
is entered in. Only rows' keys take part; texts are shuffled once, to the ordered hash.

Rows need ``conv_id, turn, role, text``; other columns are ignored. A null role or text is one space,
a null turn comes first and counts for no gap, rows with a null ``conv_id`` are one conversation.
Rows of one turn are ordered by role, then by the MD5 of the text; equal rows stand beside each other.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.shared import batches, store

BLOCK = 64
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"

# States: nothing so far, after the system row, after a user row, after an assistant row.
STATES = (0, 1, 2, 3)
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = (2, 2, 3, 2)  # state after the role that is wanted
_WANTED = ("user", "user", "assistant", "user")
_TAIL = ("", "II", "I", "")  # what ends a conversation in each state
END = tuple(INSERT * len(t) for t in _TAIL)
_LEGAL = {"su", "ua", "au"}


class Search:
    """Cheapest edits of one block of rows, given the cost that remains behind it in each state.

    A row is ``(initial, kind, times)``: kind ``k`` may stay, ``t`` is truncated, ``x`` has to go
    (with its equals, ``times`` in all).
    """

    def __init__(self, rows: tuple[tuple[str, str, int], ...], behind: tuple[int, ...] = END):
        self.rows, self.behind = rows, behind
        self.least = self._estimates(min(behind))
        self.failed: dict[tuple[int, int], int] = {}

    def _estimates(self, last: int) -> list[int]:
        """Every row that cannot stay costs two; an edit mends at most two bad neighbours."""
        out, cost, bad, after = [last], last, 0, ""
        for initial, kind, times in reversed(self.rows):
            if kind == "k":
                bad += bool(after) and initial + after not in _LEGAL
                after = initial or "?"
            else:
                cost += DELETE * times
            out.append(cost + (bad + 1) // 2)
        return out[::-1]

    def reaches(self, start: int, goal: int) -> bool:
        if start == goal:
            return True
        free = [r for r in self.rows if r[1] != "x"]
        if goal == 1:
            return start == 0 and any(r[0] == "s" for r in free)
        return goal > 1 and bool(free)

    def run(self, start: int) -> tuple[int, str, int]:
        """Cost with what remains behind, edits, and the state at the end."""
        bound = self.least[0]
        while True:
            path: list[str] = []
            need, state = self._descend(0, start, bound, path)
            if state >= 0:
                return bound, "".join(reversed(path)), state
            if need >= NEVER:
                raise ValueError("no edits lead to the state that is asked for")
            bound = need

    def _descend(self, i: int, state: int, left: int, path: list[str]) -> tuple[int, int]:
        """What a path from here needs at least, and its last state, -1 if ``left`` does not do."""
        if i == len(self.rows):
            need = self.behind[state]
            return need, state if need <= left else -1
        need = self.failed.get((i, state), self.least[i])
        if need > left:
            return need, -1
        initial, kind, times = self.rows[i]
        # A row that has to go is only deleted: an insertion before it would come later in the order.
        moves = [("D" * times, DELETE * times, i + 1, state)]
        if kind != "x":
            stay, then = TRUNCATED if kind == "t" else 0, _NEXT[state]
            moves.append(("I", INSERT, i, then))
            if initial in _KEEP[state]:
                moves.append(("K", stay, i + 1, _KEEP[state][initial]))
            moves.append(("R", stay + REROLE, i + 1, then))
        best = NEVER
        for edit, cost, at, after in moves:
            found, last = self._descend(at, after, left - cost, path)
            if last >= 0:
                path.append(edit)
                return found + cost, last
            best = min(best, found + cost)
        self.failed[i, state] = best
        return best, -1


@functools.lru_cache(maxsize=20_000)
def whole(rows: tuple[tuple[str, str, int], ...]) -> tuple[int, str, int]:
    """A conversation's cost, edits, and last state; equal shapes are searched once in a worker."""
    return Search(rows).run(0)


def between(rows: tuple[tuple[str, str, int], ...]) -> list[int]:
    """Least cost from each state before a block to each state behind it, 16 numbers."""
    table = [NEVER] * 16
    for goal in STATES:
        search = Search(rows, tuple(0 if q == goal else NEVER for q in STATES))
        for start in STATES:
            if search.reaches(start, goal):
                table[4 * start + goal] = search.run(start)[0]
    return table


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: each row by a fault drawn from its place.

    0 drops it (no copies), 1 empties the text, 2 takes ``.!?`` out, 3 doubles it, 4 makes it the user's.
    """
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.col("fault")
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return conversations.withColumn("fault", F.crc32(named) % 20).select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns for rows as they are."""
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies"),
    )


def _items(rows: DataFrame) -> DataFrame:
    """Distinct rows of each turn with their number, what is wrong with the first, and the rest of its kind."""
    body = F.trim(F.col("text"), F.lit(BLANKS))
    live = F.col("copies") > 0
    keyed = rows.select(
        "conv_id",
        F.when(live, F.col("turn")).alias("turn"),
        F.when(live, F.col("role")).alias("role"),
        F.when(live, F.unhex(F.md5("text"))).alias("digest"),
        "copies",
        (live & (body == "")).alias("blank"),
        (live & ~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    items = store(
        keyed.groupBy("conv_id", "turn", "role", "digest").agg(
            F.sum("copies").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("open").alias("open")
        ),
        "items",
    )
    at = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    again = (
        items.where("n > 0").groupBy("conv_id", "role", "digest")
        .agg(F.min(at).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    )
    known = again.select(*(F.col(c).alias(f"_{c}") for c in again.columns))
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    )
    return items.join(known, same, "left").select(
        "conv_id", "turn", "role", "digest", "n", "blank", "open",
        F.coalesce(F.col("_first") < at, F.lit(False)).alias("again"),
    )


_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
_FIELDS = f"""part int, seq int, done boolean, {", ".join(f"{c} bigint" for c in _COUNTS)}, first string, last string,
    audit string, tail string, cost bigint, costs array<bigint>, shape array<struct<initial: string, kind: string, times: bigint>>,
    edits array<struct<turn: bigint, role: string, digest: binary, before: string, becomes: string>>"""


class _Block:
    """Rows of one conversation in order, with their counts."""

    def __init__(self):
        self.rows: list[tuple[str, str, int]] = []
        self.keys: list[tuple] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.count = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role, digest, n, blank, open_, again):
        if not n:
            return
        kind = "x" if blank or again else "t" if open_ else "k"
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n if again else n - 1
        self.truncated += kind == "t"
        self.count += n
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.illegal += (n - 1) * (initial * 2 not in _LEGAL)
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        key = (turn, role, digest)
        if kind == "x":
            self._put((initial, "x", n), key)
        else:
            self._put((initial, kind, 1), key)
            if n > 1:
                self._put((initial, "x", n - 1), key)

    def _put(self, row, key):
        self.rows.append(row)
        self.keys.append(key)


def _edits(rows, keys, path: str) -> list[dict]:
    """Rows that stay, with the roles inserted before each and the role it gets."""
    out, state, before, i, at = [], 0, "", 0, 0
    while at < len(path):
        edit = path[at]
        if edit == "I":
            before += "I"
            at += 1
            continue
        turn, role, digest = keys[i]
        if edit != "D":
            out.append(dict(turn=turn, role=role, digest=digest, before=before, becomes=edit))
            before = ""
        at += rows[i][2]
        i += 1
    return out


def _named(edits: list[dict], state: int, tail: str) -> tuple[str, int]:
    """Turn edit letters into roles, beginning in ``state``; the roles of the tail and the last state."""
    for e in edits:
        lines = []
        for _ in e["before"]:
            lines.append(_WANTED[state])
            state = _NEXT[state]
        e["before"] = ",".join(lines)
        if e["becomes"] == "R":
            e["becomes"], state = _WANTED[state], _NEXT[state]
        else:
            e["becomes"], state = e["role"], _KEEP[state][e["role"][:1]]
    lines = []
    for _ in tail:
        lines.append(_WANTED[state])
        state = _NEXT[state]
    return ",".join(lines), state


def _blocks(items: DataFrame, size: int) -> DataFrame:
    """Blocks of every conversation in order; those that hold a whole conversation are searched.

    A partition's first and last conversation may go on in the next one and are never taken as whole.
    """
    kind = items.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(_FIELDS).fields])

    def tell(conv, part, seq, block: _Block, done: bool):
        common = (conv, part, seq, done, block.count, block.blank, block.duplicate, block.truncated, block.illegal,
                  block.turns, block.low, block.high, block.first, block.last)
        rows = tuple(block.rows)
        if done:
            cost, path, state = whole(rows)
            edits = _edits(rows, block.keys, path)
            tail, _ = _named(edits, 0, _TAIL[state])
            return (*common, path + _TAIL[state], tail, cost, None, None, edits)
        keys = [dict(turn=t, role=r, digest=d, before=None, becomes=None) for t, r, d in block.keys]
        shape = [dict(initial=i, kind=k, times=n) for i, k, n in rows]
        return (*common, None, None, None, between(rows), shape, keys)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out():
            begun, first, conv, held, seq = False, True, None, _Block(), 0
            for batch in source:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if begun and row[0] != conv:
                        yield tell(conv, part, seq, held, not first and seq == 0)
                        first, held, seq = False, _Block(), 0
                    elif len(held.rows) >= size:
                        yield tell(conv, part, seq, held, False)
                        held, seq = _Block(), seq + 1
                    begun, conv = True, row[0]
                    held.add(*row[1:])
            if begun:
                yield tell(conv, part, seq, held, False)

        yield from batches(out(), arrow, 1024)

    arrow = _arrow(schema)
    order = ("conv_id", "turn", "role", "digest")
    return items.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _behind(blocks: DataFrame) -> DataFrame:
    """Blocks with the cost that remains behind each in every state, composed from the last one."""
    schema = T.StructType(list(blocks.schema.fields)).add(T.StructField("behind", T.ArrayType(T.LongType())))
    arrow = _arrow(schema)
    own, costs = blocks.columns.index("conv_id"), blocks.columns.index("costs")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            begun, conv, left = False, None, list(END)
            for batch in source:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not begun or row[own] != conv:
                        begun, conv, left = True, row[own], list(END)
                    yield (*row, left)
                    table = row[costs]
                    left = [min(NEVER, min(table[4 * q + r] + left[r] for r in STATES)) for q in STATES]

        yield from batches(out(), arrow, 1024)

    down = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    return down.mapInArrow(run, schema)


def _forward(blocks: DataFrame, plain: T.StructType) -> DataFrame:
    """Search each block from the state it is entered in; one closing row for each conversation."""
    arrow = _arrow(plain)
    names = blocks.columns

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(conv, block: _Block, audit: list[str], cost: int, state: int):
            tail = _TAIL[state]
            lines, _ = _named([], state, tail)
            return (conv, 0, 0, True, block.count, block.blank, block.duplicate, block.truncated, block.illegal, block.turns,
                    block.low, block.high, None, None, "".join(audit) + tail, lines, cost + END[state], None, None, [])

        def out():
            begun, conv, sums, audit, cost, state = False, None, _Block(), [], 0, 0
            for batch in source:
                for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    row = dict(zip(names, values, strict=True))
                    if begun and row["conv_id"] != conv:
                        yield close(conv, sums, audit, cost, state)
                        sums, audit, cost, state = _Block(), [], 0, 0
                    begun, conv = True, row["conv_id"]
                    rows = tuple((r["initial"], r["kind"], r["times"]) for r in row["shape"])
                    behind = tuple(row["behind"])
                    total, path, last = Search(rows, behind).run(state)
                    edits = _edits(rows, [(k["turn"], k["role"], k["digest"]) for k in row["edits"]], path)
                    _named(edits, state, "")
                    audit.append(path)
                    cost, state = cost + total - behind[last], last
                    for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        setattr(sums, c, getattr(sums, c) + row[c])
                    sums.count += row["rows"]
                    if row["first"] is not None:
                        sums.illegal += sums.last is not None and sums.last + row["first"] not in _LEGAL
                        sums.last = row["last"]
                    if row["low"] is not None:
                        sums.turns -= sums.high == row["low"]
                        sums.low = row["low"] if sums.low is None else sums.low
                        sums.high = row["high"]
                    yield (conv, 0, 0, None, *[None] * len(_COUNTS), None, None, None, None, None, None, None, edits)
            if begun:
                yield close(conv, sums, audit, cost, state)

        yield from batches(out(), arrow, 1024)

    up = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return up.mapInArrow(run, plain)


def _hashes(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """``conv_id, sha``: the repaired rows of each conversation hashed in order as they stream by.

    An edit arrives right before the rows it speaks of; nothing but the running hash is held.
    """
    edits = kept.where("size(edits) > 0").select("conv_id", F.explode("edits").alias("e")).select(
        "conv_id", F.lit(0).alias("closing"), "e.turn", "e.role", "e.digest", F.lit(0).alias("tag"), "e.before", "e.becomes",
        F.lit(None).cast("string").alias("text"),
    )
    empty = F.lit(None)
    tails = kept.where("tail <> ''").select(
        "conv_id", F.lit(1).alias("closing"), empty.cast("long").alias("turn"), empty.cast("string").alias("role"),
        empty.cast("binary").alias("digest"), F.lit(0).alias("tag"), F.col("tail").alias("before"),
        empty.cast("string").alias("becomes"), empty.cast("string").alias("text"),
    )
    texts = rows.where("copies > 0").select(
        "conv_id", F.lit(0).alias("closing"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), F.lit(1).alias("tag"),
        empty.cast("string").alias("before"), empty.cast("string").alias("becomes"), "text",
    )
    stream = edits.unionByName(tails).unionByName(texts)
    order = ("conv_id", "closing", "turn", "role", "digest", "tag")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("sha", T.StringType())])
    arrow = _arrow(schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            conv, digest, waiting = None, None, None
            for batch in source:
                for own, _, turn, role, mark, tag, before, becomes, text in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True
                ):
                    if digest is None or own != conv:
                        if digest is not None:
                            yield conv, digest.sha()
                        conv, digest, waiting = own, _Lines(), None
                    if tag == 0:
                        for line in before.split(",") if before else ():
                            digest.add(f"{line}:")
                        waiting = (turn, role, mark, becomes) if becomes is not None else None
                    elif waiting is not None and waiting[:3] == (turn, role, mark):
                        digest.add(f"{waiting[3]}:{text}")
                        waiting = None
            if digest is not None:
                yield conv, digest.sha()

        yield from batches(out(), arrow)

    return stream.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


class _Lines:
    """Hash of lines joined by line feeds."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def add(self, line: str) -> None:
        if self.some:
            self.hash.update(b"\n")
        self.hash.update(line.encode())
        self.some = True

    def sha(self) -> str:
        return self.hash.hexdigest()


def plan(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Searched conversations of ``conv_id, turn, role, text, copies``.

    Closing rows (``done``) have the counts, the cost, the audit and the roles put at the end; every
    row may hold ``edits``: rows that stay, what is inserted before each, and the role it gets.
    """
    blocks = store(_blocks(_items(rows), block), "blocks")
    parts = blocks.where("NOT done")
    later = store(_behind(parts), "behind")
    return store(blocks.where("done").unionByName(_forward(later, blocks.schema)), "plan")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    kept = plan(rows, block)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    told = kept.where("done").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    hashes = _hashes(rows, kept).withColumnRenamed("conv_id", "_conv_id")
    return told.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").select(
        *told.columns, F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, place, role, text``: the rows that stay, with inserted ones before or behind them.

    ``place`` orders rows of one turn: inserted rows get negative ones. Rows put at the end have a null
    turn and a place of their own, ``closing`` true.
    """
    kept = plan(rows)
    edits = kept.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")
    roles = F.split("before", ",")
    put = edits.where("before <> ''").select("conv_id", "turn", "role", "digest", F.posexplode(roles).alias("i", "new"), F.size(roles).alias("n"))
    inserted = put.select(
        "conv_id", F.lit(False).alias("closing"), "turn", F.col("role").alias("_by"), F.col("digest").alias("_and"),
        (F.col("i") - F.col("n")).alias("place"), F.col("new").alias("role"), F.lit("").alias("text"),
    )
    tails = kept.where("tail <> ''").select("conv_id", F.posexplode(F.split("tail", ",")).alias("place", "role")).select(
        "conv_id", F.lit(True).alias("closing"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("_by"),
        F.lit(None).cast("binary").alias("_and"), "place", "role", F.lit("").alias("text"),
    )
    texts = rows.where("copies > 0").withColumn("digest", F.unhex(F.md5("text"))).drop("copies").distinct()
    by = edits.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "turn", "role", "digest", "becomes")))
    met = (
        F.col("conv_id").eqNullSafe(F.col("_conv_id")) & F.col("turn").eqNullSafe(F.col("_turn"))
        & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    )
    stay = texts.join(by, met).select(
        "conv_id", F.lit(False).alias("closing"), "turn", F.col("role").alias("_by"), F.col("digest").alias("_and"),
        F.lit(0).alias("place"), F.col("_becomes").alias("role"), "text",
    )
    return stay.unionByName(inserted).unionByName(tails)
