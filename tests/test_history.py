"""As-of versions, differences, grouped totals, first sights, and spans and points in cells, against loops."""

import random

from pyspark.sql import functions as F

from quire.operators import history, layout, sizes


def test_valid_at_equals_a_loop(spark):
    rng = random.Random(1)
    versions = [(rng.choice("ab"), v, rng.randint(0, 400_000)) for v in range(40)] + [("a", 100, 5000), ("a", 101, 5000), ("c", 1, None)]
    events = [(rng.choice(["a", "b", "z", None]), rng.randint(-5, 500_000), e) for e in range(400)] + [("a", None, 1000), ("a", 5000, 1001)]
    made = lambda rows, names, kinds: spark.createDataFrame(rows, kinds).withColumn(names, F.timestamp_seconds(names))
    known = made(versions, "since", "doc_id string, version int, since long")
    asked = made(events, "at", "doc_id string, at long, event int")
    want = {}
    for doc, at, event in events:
        held = [(s, v) for d, v, s in versions if d == doc and s is not None and at is not None and s <= at]
        want[event] = max(held)[1] if held else None
    for stretch in (60, 86_400, 10_000_000):
        got = history.valid_at(asked, known, stretch)
        assert got.columns == ["doc_id", "at", "event", "version", "since"]
        assert {r["event"]: r["version"] for r in got.collect()} == want
    assert history.valid_at(asked.limit(0), known).count() == 0
    assert history.valid_at(asked, known.limit(0)).where("version IS NOT NULL").count() == 0


def test_difference_counts_repeats(spark):
    schema = "out_doc int, position int, src_doc string, src_page int, rotation int"
    before = spark.createDataFrame([(1, 0, "a", 1, 0), (1, 1, "a", 1, 0), (1, 2, None, None, 0), (1, 3, "a", 2, 0)], schema)
    after = spark.createDataFrame([(1, 0, "a", 2, 0), (1, 1, "a", 1, 0), (1, 2, None, None, 0), (1, 3, None, None, 0), (1, 4, "a", 2, 90)], schema)
    found = history.manifest_difference(before, after)
    spot = lambda df, *names: sorted(tuple(r) for r in df.select(*names).collect())
    assert spot(found.added, "position") == [(3,), (4,)]
    assert spot(found.dropped, "position") == [(1,)]
    assert spot(found.kept, "was", "position") == [(0, 1), (2, 2), (3, 0)]
    same = history.manifest_difference(before, before)
    assert same.added.count() == same.dropped.count() == 0 and same.kept.count() == 4


def test_grouped_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice("pq"), rng.randint(1, 9), rng.choice([*range(3000), None])) for _ in range(6000)]
    table = spark.createDataFrame(rows, "a string, b string, size int, id int")
    got = {(r["grouping"], r["a"], r["b"]): (r["n_rows"], r["total"], r["n_distinct"], r["about"]) for r in sizes.grouped_totals(table, ["a", "b"], "size", "id").collect()}
    want = {}
    for a, b, size, own in rows:
        for key in ((0, a, b), (1, a, None), (2, None, b), (3, None, None)):
            n, total, ids = want.setdefault(key, (0, 0, set()))
            want[key] = n + 1, total + size, ids | ({own} - {None})
    assert got.keys() == want.keys()
    for key, (n, total, ids) in want.items():
        assert got[key][:3] == (n, total, len(ids)) and abs(got[key][3] - len(ids)) <= 0.08 * len(ids) + 1
    assert "n_distinct" not in sizes.grouped_totals(table, ["a", "b"], "size", "id", exact=False).columns


def test_first_seen_hosts(spark):
    rng = random.Random(3)
    rows = [(rng.choice("st"), rng.randint(0, 20_000), rng.choice([*(f"h{i}" for i in range(60)), None])) for _ in range(800)]
    seen = spark.createDataFrame(rows, "session string, s long, host string").withColumn("ts", F.timestamp_seconds("s"))
    first = {}
    for session, s, host in rows:
        if host is not None:
            first[session, host] = min(s, first.get((session, host), s))
    want = []
    for session in "st":
        order = sorted((s, h) for (own, h), s in first.items() if own == session)
        want += [(session, place, host) for place, (_, host) in enumerate(order)]
    assert sorted(tuple(r)[:3] for r in sizes.first_seen_hosts(seen).collect()) == sorted(want)


def test_spans_in_bins_equal_a_loop(spark):
    rng = random.Random(4)
    runs = [("d", 1, i, rng.choice(["x", " "]), s, s + rng.choice([0, 1, 5, 600, 3000])) for i, s in enumerate(rng.randint(0, 4000) for _ in range(150))]
    cites = [("d", 1, i, s, s + rng.choice([0, 1, 40, 512, 5000])) for i, s in enumerate(rng.randint(0, 4000) for _ in range(60))]
    got = layout.locate_citations(
        spark.createDataFrame(cites, "doc_id string, page int, cite int, start int, end int"),
        spark.createDataFrame(runs, "doc_id string, page int, seq int, str string, start int, end int"),
    )
    want = sorted((c[2], r[2]) for c in cites for r in runs if r[3] != " " and r[4] < c[4] and r[5] > c[3])
    assert sorted((r["cite"], r["seq"]) for r in got.collect()) == want


def test_points_in_cells_equal_a_loop(spark):
    rng = random.Random(5)
    side = lambda: rng.choice([0.0, 3.0, 100.0, 128.0, 700.0, 1e5, 3e9])
    blocks = [("d", 1, i, rng.uniform(-500, 900), rng.uniform(-500, 900), side(), side()) for i in range(80)]
    blocks += [("d", 1, 90, float("nan"), 0.0, 5.0, 5.0), ("d", 1, 91, 0.0, 0.0, float("inf"), 5.0), ("d", 1, 92, 0.0, 0.0, -900.0, 5.0)]
    points = [("d", 1, i, rng.uniform(-600, 1000), rng.uniform(-600, 1000)) for i in range(300)]
    points += [("d", 1, 400 + i, b[3] + b[5] + 2, b[4] - 2) for i, b in enumerate(blocks[:80])] + [("d", 1, 900, float("nan"), 0.0), ("e", 1, 901, 0.0, 0.0)]
    got = layout.block_at(
        spark.createDataFrame(blocks, "doc_id string, page int, block_no int, x double, y double, width double, height double"),
        spark.createDataFrame(points, "doc_id string, page int, point int, px double, py double"),
    )
    want = {}
    for d, _, p, px, py in points:
        under = [
            (b[5] * b[6], b[2]) for b in blocks[:80]
            if d == "d" and b[3] - 2 <= px <= b[3] + b[5] + 2 and b[4] - 2 <= py <= b[4] + b[6] + 2
        ]
        if under:
            want[p] = min(under)[1]
    assert {r["point"]: r["block_no"] for r in got.collect()} == want
