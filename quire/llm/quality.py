"""Quality of documents by co-training two views.

The text view sees the whole text: measures of it (shares of kinds of characters, repetition,
lengths), each cut into bins, and its words, hashed. The metadata view sees language, source and
size, hashed. Each view has a logistic regression of its own. They start from labelled rows; in each
round every view marks the unlabelled documents of the whole corpus that it is sure of, and these
marks train the *other* view. At the end each view is calibrated on labelled rows held out from all
training, and a last regression on both calibrated log-odds gives the score of every document.

Only labelled rows are sampled (about ``labelled``, chosen by a hash of ``doc_id``, a quarter of them
held out). Bins come from quantiles of all documents. A round is fitted by Newton steps: tasks sum
slopes and curvature over their documents, the sums are added up in two stages, and what reaches the
driver is a matrix of the weights, whatever the corpus. How many documents a view may mark is settled by
a histogram of its scores. Scoring reads every document in the pass that reads its text.

A null text is empty; null metadata are a value of their own. Rows whose label is null are
unlabelled. With too few labelled rows, or of one class only, every document scores 0.5 and stays.
Labels that repeat for a document count once, the larger label holding. Columns other than
``doc_id, text, lang, source, n_chars`` are ignored for scores and kept by ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import shingles, units
from quire.llm.shared import store

LABELLED = 6_000
ROUNDS = 3
STEPS = 3  # Newton steps of a round, from the weights of the round before
SURE = 0.95  # a view marks documents at least as likely as this, on either side
SHARE = 0.25  # of the unlabelled documents that a view may mark more in each round, the surest first
MARKED = 0.3  # most weight of a marked document; all of them together weigh no more than the labelled ones
LEVELS = 1000  # of the histogram of scores
REJECT = 0.25  # documents below this score are rejected; below one half, as losing a clean one is worse
BINS = 12
BUCKETS = 128  # for hashed metadata
MEASURES = 16
GRAMS = 64  # buckets of hashed words

_KINDS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:?", b"!",
    b"*&%$#@^~=+<>{}[]\\_`", b"|", b"'\"()-/",
]
_TABLE = np.full(256, len(_KINDS), np.uint8)
for _k, _chars in enumerate(_KINDS):
    _TABLE[list(_chars)] = _k


def measures(texts: list[str | None]) -> np.ndarray:
    """Rows of ``MEASURES`` numbers, one row for each whole text."""
    return _measured(texts, *shingles.word_hashes(texts))


def hashed_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of length one: logarithms of how often the words of each bucket occur."""
    n = len(first) - 1
    at = np.repeat(np.arange(n), np.diff(first)) * GRAMS + (words % np.uint64(GRAMS)).astype(np.int64)
    out = np.log1p(np.bincount(at, minlength=n * GRAMS).reshape(n, GRAMS))
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def _measured(texts: list[str | None], words: np.ndarray, first: np.ndarray) -> np.ndarray:
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(texts), MEASURES))
    for row, raw in enumerate(encoded):
        mine = words[first[row] : first[row + 1]]
        n, count = max(1, len(raw)), len(mine)
        kinds = np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=len(_KINDS) + 1)
        out[row, : len(_KINDS) + 1] = kinds / n
        if count:
            values, times = np.unique(mine, return_counts=True)
            out[row, 11:] = (
                len(values) / count ** 0.85, times.max() / count, n / count, np.log2(1 + count),
                0.0 if count < 2 else np.mean(mine[1:] == mine[:-1]),
            )
    return out


def metadata(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Hashed positions of a row's language, source, size and pair of the first two."""
    rows = []
    for lang, source, size in zip(langs, sources, sizes, strict=True):
        level = -1 if size is None else int(size).bit_length()
        rows.append([_place("l", lang), _place("s", source), _place("n", level), _place("ls", (lang, source))])
    return np.array(rows, dtype=np.int64).reshape(-1, 4)


def _place(kind: str, value) -> int:
    """A position that is the same in every process."""
    n = 2166136261
    for byte in f"{kind}={value!r}".encode():
        n = (n ^ byte) * 16777619 & 0xFFFFFFFF
    return n % BUCKETS


def _log_odds(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(x @ weights, -30, 30)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Logistic regression by Newton steps; the first column is the constant and is not penalised."""
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-_log_odds(x, weights)))
        slope = x.T @ (weight * (p - y)) + ridge * weights
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return weights


@dataclass
class Model:
    """Fitted views. ``weights`` is None where there was too little to fit."""

    edges: np.ndarray
    text: np.ndarray | None
    meta: np.ndarray | None
    calibrations: list
    last: np.ndarray | None

    def text_design(self, x: np.ndarray) -> np.ndarray:
        """The constant, a column for each bin of each measure, and the hashed words if ``x`` has them."""
        design = np.zeros((len(x), 1 + MEASURES * BINS + x.shape[1] - MEASURES))
        design[:, 0] = 1
        for k in range(MEASURES):
            place = np.searchsorted(self.edges[k], x[:, k], side="right")
            design[np.arange(len(x)), 1 + k * BINS + place] = 1
        design[:, 1 + MEASURES * BINS :] = x[:, MEASURES:]
        return design

    @staticmethod
    def meta_design(m: np.ndarray) -> np.ndarray:
        design = np.zeros((len(m), BUCKETS + 1))
        design[:, 0] = 1
        np.put_along_axis(design[:, 1:], m, 1, axis=1)
        return design

    def scores(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Calibrated probability of each view and the combined one, as three columns."""
        if self.last is None or not len(x):
            return np.full((len(x), 3), 0.5)
        odds = [_log_odds(self.text_design(x), self.text), _log_odds(self.meta_design(m), self.meta)]
        odds = [a + b * o for (a, b), o in zip(self.calibrations, odds, strict=True)]
        both = np.stack([np.ones(len(x)), *odds], axis=1) @ self.last
        return 1 / (1 + np.exp(-np.clip(np.stack([*odds, both], axis=1), -30, 30)))


@dataclass
class Marks:
    """What each view thinks at the start of a round, and from where it is sure enough to say so."""

    weights: list[np.ndarray]
    cuts: list[tuple[float, float]]
    weight: list[float]  # of the documents marked by each view


def histogram(designs, free: np.ndarray, weights) -> np.ndarray:
    """How many unlabelled rows have which probability, for both views."""
    p = [1 / (1 + np.exp(-_log_odds(d[free], w))) for d, w in zip(designs, weights, strict=True)]
    return np.stack([np.bincount(np.minimum((q * LEVELS).astype(int), LEVELS - 1), minlength=LEVELS) for q in p]).astype(float)


def cuts(levels: np.ndarray, share: float, part: float) -> tuple[tuple[float, float], float]:
    """From which probabilities a view marks ``part`` of the rows at most, and how many it marks."""
    most, total = part * levels.sum(), np.arange(LEVELS)
    sure = int(np.ceil(SURE * LEVELS))
    high = sure + int(np.argmax(np.append(levels[sure:][::-1].cumsum()[::-1], 0.0) <= max(1.0, most * share)))
    falling = np.append(levels[: LEVELS - sure].cumsum()[::-1], 0.0) <= max(1.0, most * (1 - share))
    low = LEVELS - sure - int(np.argmax(falling))
    return (low / LEVELS, high / LEVELS), float(levels[total >= high].sum() + levels[total < low].sum())


def sums(designs, y: np.ndarray, held: np.ndarray, weights, marks: Marks) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slope and curvature of both views' losses: labelled rows, and what the other view marked."""
    out = []
    for view in (0, 1):
        other = 1 / (1 + np.exp(-_log_odds(designs[1 - view], marks.weights[1 - view])))
        low, high = marks.cuts[1 - view]
        target = np.where(y >= 0, y, np.where(other >= high, 1, np.where(other < low, 0, -1)))
        rows = np.flatnonzero((target >= 0) & ~held)
        x = designs[view][rows]
        weight = np.where(y[rows] >= 0, 1.0, marks.weight[1 - view])
        p = 1 / (1 + np.exp(-_log_odds(x, weights[view])))
        out.append((x.T @ (weight * (p - target[rows])), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x))
    return out


PENALTIES = (1.0, 4.0)


def _rounds(model: Model, x, m, y, held, levels_of: Callable, sums_of: Callable, rounds: int) -> Model:
    """Co-train on labelled rows ``x, m, y`` and on what ``levels_of`` and ``sums_of`` tell of all rows."""
    seed = ~held
    if min((y[seed] == 0).sum(), (y[seed] == 1).sum()) < 5 or len(set(y[held])) < 2:
        return model
    designs = [model.text_design(x), model.meta_design(m)]
    share, labelled = float(y[seed].mean()), float(seed.sum())
    weights = [fit(d[seed], y[seed].astype(float), np.ones(int(seed.sum())), e) for d, e in zip(designs, PENALTIES, strict=True)]
    for done in range(1, rounds):
        levels = levels_of(weights)
        chosen = [cuts(levels[view], share, SHARE * done) for view in (0, 1)]
        marks = Marks(list(weights), [c for c, _ in chosen], [min(MARKED, labelled / max(1.0, n)) for _, n in chosen])
        for _ in range(STEPS):
            moved = []
            for (slope, curve), w, penalty in zip(sums_of(weights, marks), weights, PENALTIES, strict=True):
                ridge = np.full(len(w), penalty)
                ridge[0] = 1e-6
                moved.append(w - np.clip(np.linalg.solve(curve + np.diag(ridge), slope + ridge * w), -4, 4))
            weights = moved
    model.text, model.meta = weights
    kept = np.flatnonzero(held)
    odds = []
    for view in (0, 1):
        own = _log_odds(designs[view][kept], weights[view])
        line = fit(np.stack([np.ones(len(own)), own], axis=1), y[kept].astype(float), np.ones(len(own)), 0.05)
        model.calibrations.append((float(line[0]), float(line[1])))
        odds.append(line[0] + line[1] * own)
    together = np.stack([np.ones(len(kept)), *odds], axis=1)
    model.last = fit(together, y[kept].astype(float), np.ones(len(kept)), 0.05)
    if (model.last[1:] < 0).any():  # a view that tells nothing must not count against the other
        together[:, 1:][:, model.last[1:] < 0] = 0
        model.last = fit(together, y[kept].astype(float), np.ones(len(kept)), 0.05)
    return model


def co_train(x, m, y, held: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Co-training of rows in memory; ``y``: 0, 1 or -1 (no label), ``held``: kept for calibration."""
    edges = np.stack([_edges(x[:, k]) for k in range(MEASURES)]) if len(x) else np.zeros((MEASURES, BINS - 1))
    model = Model(edges, None, None, [], None)
    held = held & (y >= 0)
    designs, known = [model.text_design(x), model.meta_design(m)], y >= 0
    return _rounds(
        model, x[known], m[known], y[known], held[known],
        lambda weights: histogram(designs, ~known, weights), lambda weights, marks: sums(designs, y, held, weights, marks), rounds,
    )


def _edges(values: np.ndarray) -> np.ndarray:
    return np.quantile(values, np.arange(1, BINS) / BINS)


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """``x, m`` and the columns ``keep`` of each document."""
    kept = [docs.schema[k] for k in keep]
    kind = T.StructType(
        [*kept, T.StructField("x", T.ArrayType(T.FloatType())), T.StructField("m", T.ArrayType(T.LongType()))]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units.release()
        for batch in source:
            for begin, end in units.byte_slices(batch.column("text")):
                part = batch.slice(begin, end - begin)
                x, m = views(part)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())),
                     pa.array(list(m), pa.list_(pa.int64()))],
                    names=[*keep, "x", "m"],
                )

    return docs.select(*keep, "text", "lang", "source", "n_chars").mapInArrow(run, kind)


def views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = part.column("text").to_pylist()
    words = shingles.word_hashes(texts)
    x = np.concatenate([_measured(texts, *words), hashed_words(*words)], axis=1)
    m = metadata(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
    return x, m


def _rows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``x, m, y, held`` of stored features."""
    n = len(batch)
    x, m = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch["x"], batch["m"]))
    x = np.asarray(x.flatten(), dtype=np.float64).reshape(n, MEASURES + GRAMS)
    m = np.asarray(m.flatten(), dtype=np.int64).reshape(n, 4)
    y = np.array([-1 if v is None else int(v > 0) for v in batch["__y"].to_pylist()], dtype=np.int64)
    return x, m, y, np.array(batch["__held"].to_pylist(), dtype=bool) & (y >= 0)


def summed(stored: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``work`` over all batches: in each task, then in a few, then here."""
    schema = pa.schema([("part", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in source:
            for at in range(0, len(batch), 1024):
                own = work(batch.slice(at, 1024))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in source:
            for part in batch.column(0):
                own = np.frombuffer(part.as_buffer())
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

    parts = stored.mapInArrow(run, "part binary").repartition(4).mapInArrow(add, "part binary").collect()
    return sum((np.frombuffer(r["part"]) for r in parts), np.zeros(0) if not parts else 0.0)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit both views on a bounded sample of labelled rows and on all of ``docs``; see the module's head."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.max("quality").cast("long").alias("__y"))
    )
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # About ``labelled`` ids: the bound of what is broadcast.
    held = (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0).alias("__held")
    sample = known.where(drawn < labelled / max(1, known.count())).select(F.col("doc_id").alias("__id"), "__y", held)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows = plain.join(F.broadcast(sample), plain["doc_id"] == sample["__id"], "left").drop("__id")
    stored = store(features(rows, "doc_id", "__y", "__held"), "features")
    quantiles = [k / BINS for k in range(1, BINS)]
    found = stored.agg(*(F.percentile_approx(F.col("x")[k], quantiles, 1000).alias(f"q{k}") for k in range(MEASURES))).first()
    edges = np.zeros((MEASURES, BINS - 1)) if found["q0"] is None else np.array([found[f"q{k}"] for k in range(MEASURES)], dtype=float)
    model = Model(edges, None, None, [], None)

    table = stored.where("__y IS NOT NULL").toArrow()
    x, m, y, held = _rows(table.take(pa.array(np.argsort(table["doc_id"].to_numpy(), kind="stable"))))

    def levels_of(weights):
        def work(batch):
            x, m, y, _ = _rows(batch)
            return histogram([model.text_design(x), model.meta_design(m)], y < 0, weights).ravel()

        return summed(stored, work).reshape(2, LEVELS)

    def sums_of(weights, marks):
        def work(batch):
            x, m, y, held = _rows(batch)
            both = sums([model.text_design(x), model.meta_design(m)], y, held, weights, marks)
            return np.concatenate([a.ravel() for pair in both for a in pair])

        flat, out, at = summed(stored, work), [], 0
        for w in weights:
            n = len(w)
            out.append((flat[at : at + n], flat[at + n : at + n + n * n].reshape(n, n)))
            at += n + n * n
        return out

    return _rounds(model, x, m, y, held, levels_of, sums_of, rounds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text_score, meta_score, score`` of every row."""
    kind = T.StructType([docs.schema["doc_id"]] + [T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score")])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units.release()
        for batch in source:
            for begin, end in units.byte_slices(batch.column("text")):
                part = batch.slice(begin, end - begin)
                scores = model.scores(*views(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(scores[:, k]) for k in range(3))],
                    names=["doc_id", "text_score", "meta_score", "score"],
                )

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, kind)


def filter_documents(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows that score ``reject`` or more, with all their columns."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units.release()
        for batch in source:
            for begin, end in units.byte_slices(batch.column("text")):
                part = batch.slice(begin, end - begin)
                yield part.filter(pa.array(model.scores(*views(part))[:, 2] >= reject))

    kept = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return docs.mapInArrow(run, kept)
