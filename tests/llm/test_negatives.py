"""Hard negatives against all inner products."""

import random

import numpy as np
import pytest

from quire.llm import negatives

TABLE = "vec_id long, label int, embedding array<float>"


def plain(rows, every=50, shift=True):
    """Rows of vec_id, label, vector that take part."""
    label, vector = {}, {}
    for i, l, v in rows:
        label[i] = (l + 1) % 10 if shift and i % 7 == 0 else l
        vector[i] = np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)
    out = []
    for a in sorted(i for i in label if i % every == 0):
        scores = {i: int(vector[a] @ vector[i]) for i in label if i != a and len(vector[i]) == len(vector[a])}
        ranked = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in ranked if label[i] == label[a]][:5]:
            fit = [i for i in ranked if label[i] != label[a] and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p]][:3]
            out += [(a, p, k + 1, n, scores[p], scores[n]) for k, n in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every=50):
    table = negatives.prepared(negatives.relabelled(spark.createDataFrame(rows, TABLE)))
    got = negatives.hard_negatives(table, table.where(f"vec_id % {every} = 0"))
    return sorted(map(tuple, got.collect()))


def vectors(rng, n, d, spread=1.0):
    """Vectors around a few centres, of lengths that differ by ``spread``."""
    centres = rng.normal(size=(6, d))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=d) * rng.choice([0.05, 0.5, 2.0])
        out.append((i, int(rng.integers(10)), (v / np.linalg.norm(v) * spread ** rng.random()).astype(float).tolist()))
    return out


@pytest.mark.parametrize("d, spread", [(3, 1.0), (16, 50.0), (64, 1.0)])
def test_equals_brute_force(spark, d, spread):
    rows = vectors(np.random.default_rng(d), 5000, d, spread)
    assert mined(spark, rows) == plain(rows)


def test_pruning_is_used_and_loses_nothing():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(4000, 8))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1, keepdims=True) * (0.2 + rng.random((4000, 1)))).astype(np.int64)
    order = np.argsort(-(rows**2).sum(axis=1))
    calls = []

    class Counted(negatives.Anchors):
        def _verify(self, *a):
            calls.append(1)
            super()._verify(*a)

    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    few = np.arange(0, 4000, 40)
    low, cap = np.full((len(few), 1), negatives._NONE), np.full((len(few), 1), -negatives._NONE)
    anchors = Counted(ids[few], labels[few], rows[few], low, cap, 5, True)
    for at in range(0, 4000, 500):
        some = order[at : at + 500]
        anchors.meet(negatives.Bucket(ids[some], labels[some], rows[some], float(np.sqrt((rows[some] ** 2).sum(axis=1).max()))))
    assert len(calls) > 20
    for n, a in enumerate(few.tolist()):
        scores = rows @ rows[a]
        scores[a] = negatives._NONE
        want = sorted(range(4000), key=lambda i: (-scores[i], i))[:5]
        assert anchors.best[n, 0][1].tolist() == want


def test_ties_repeats_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    good = vectors(rng, 400, 4)
    same = [(1000 + i, i % 3, [0.5, 0.25, 0.0, 0.0]) for i in range(600)]  # one very common vector
    short = [(5000 + i, i % 2, [0.3, 0.1]) for i in range(51)]
    bad = [
        (None, 1, [1.0] * 4), (2000, None, [1.0] * 4), (2050, 1, None), (2100, 1, [1.0, None, 0.0, 0.0]),
        (2150, 1, [float("nan"), 0.0, 0.0, 0.0]), (2200, 2, [float("inf"), 0.0, 0.0, 0.0]), (2250, 1, [1e30, 0.0, 0.0, 0.0]), (2300, 1, []),
    ]
    rows = good + same + short + bad + good[:30] + same[:30]
    random.Random(1).shuffle(rows)
    assert mined(spark, rows) == plain(good + same + short)


def test_same_id_with_two_vectors_counts_once(spark):
    rows = vectors(np.random.default_rng(8), 200, 5)
    twin = [(50, 9, [9.0] * 5), (50, rows[50][1], rows[50][2])]
    least = min([rows[50], *twin], key=lambda r: (r[1], [int(np.floor(256 * np.float64(np.float32(x)))) for x in r[2]]))
    assert mined(spark, rows + twin) == plain([*(r for r in rows if r[0] != 50), least])


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(2)), np.round(rng.normal(size=3) * 1e6, 1).astype(np.float32).astype(float).tolist()) for i in range(300)]
    rows = [r for r in rows if max(map(abs, r[2])) * 256 <= (2**31 - 1) / 3**0.5]
    assert mined(spark, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], TABLE)
    table = negatives.prepared(negatives.relabelled(empty))
    assert negatives.hard_negatives(table, table).count() == 0
    rows = vectors(np.random.default_rng(6), 120, 3)
    wide = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TABLE + ", d int, g int, v string")
    table = negatives.prepared(negatives.relabelled(wide))
    assert sorted(map(tuple, negatives.hard_negatives(table, table.where("vec_id % 50 = 0")).collect())) == plain(rows)
