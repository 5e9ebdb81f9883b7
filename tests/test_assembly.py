import random

import pytest
from pyspark.sql import functions as F

from quire.functions import running
from quire.operators import assembly as asm


def book(spark, **docs):
    rows = [(d, i, d, i, (i % 4) * 90, 612.0, 792.0) for d, n in docs.items() for i in range(n)]
    return spark.createDataFrame(rows, "out_doc string, position int, src_doc string, src_page int, rotation int, width double, height double")


def order(manifest, doc="d"):
    return [r["src_page"] for r in manifest.where(F.col("out_doc") == doc).orderBy("position").collect()]


def dense(manifest, doc="d"):
    got = [r["position"] for r in manifest.where(F.col("out_doc") == doc).orderBy("position").collect()]
    return got == list(range(len(got)))


def sel(spark, *pages, doc="d"):
    return spark.createDataFrame([(doc, p) for p in pages], "out_doc string, page_index int")


def reasons(outcome):
    return {r["out_doc"]: r["reason"] for r in outcome.rejected.collect()}


def test_delete_duplicate_extract(spark):
    m = book(spark, d=6)
    out = asm.delete_pages(m, sel(spark, 1, 3, 3, 99))
    assert order(out.manifest) == [0, 2, 4, 5] and dense(out.manifest) and reasons(out) == {}
    assert reasons(asm.delete_pages(m, sel(spark, *range(6)))) == {"d": "would-delete-everything"}
    assert reasons(asm.delete_pages(m, sel(spark, 99))) == {"d": "no-pages-selected"}
    assert order(asm.duplicate_pages(m, sel(spark, 0, 5)).manifest) == [0, 0, 1, 2, 3, 4, 5, 5]
    picks = spark.createDataFrame([("d", i, p) for i, p in enumerate([4, 0, 99, 2, 4])], "out_doc string, ord int, page_index int")
    assert order(asm.extract_pages(m, picks).manifest) == [4, 0, 2, 4]


@pytest.mark.parametrize("src,dst,want", [(0, 3, [1, 2, 3, 0]), (3, 0, [3, 0, 1, 2]), (1, 2, [0, 2, 1, 3]), (2, 2, [0, 1, 2, 3])])
def test_move(spark, src, dst, want):
    moves = spark.createDataFrame([("d", src, dst)], "out_doc string, src int, dst int")
    assert order(asm.move_page(book(spark, d=4), moves).manifest) == want


def test_reorder_accepts_only_permutations(spark):
    m = book(spark, a=3, b=3, c=3, d=3)
    rows = {"a": [2, 0, 1], "b": [0, 1], "c": [0, 1, 3], "d": [0, 1, 1]}
    asked = spark.createDataFrame([(d, i, o) for d, v in rows.items() for i, o in enumerate(v)], "out_doc string, position int, old int")
    out = asm.reorder_pages(m, asked)
    assert order(out.manifest, "a") == [2, 0, 1]
    assert reasons(out) == {"b": "wrong-length", "c": "no-such-page", "d": "page-used-twice"}


def test_rotation_adds_up(spark):
    turns = spark.createDataFrame([("d", 3, 90), ("d", 0, -90)], "out_doc string, page_index int, turn int").groupBy("out_doc", "page_index").agg(F.max("turn").alias("turn"))
    out = asm.rotate_pages(book(spark, d=4), turns).manifest.orderBy("position").collect()
    assert [r["rotation"] for r in out] == [270, 90, 180, 0]


def test_blank_page_copies_its_neighbour(spark):
    m = book(spark, d=3).withColumn("origin_x", F.col("position") * 1.0)
    ask = lambda at, w=None, h=None: spark.createDataFrame([("d", at, w, h)], "out_doc string, at int, new_width double, new_height double")
    first = asm.insert_blank(m, ask(1)).manifest.orderBy("position").collect()
    assert [r["src_page"] for r in first] == [0, None, 1, 2]
    assert (first[1]["rotation"], first[1]["origin_x"]) == (90, 1.0)
    last = asm.insert_blank(m, ask(3)).manifest.orderBy("position").collect()
    assert last[3]["src_page"] is None and last[3]["rotation"] == 180
    sized = asm.insert_blank(m, ask(0, 100.0, 50.0)).manifest.orderBy("position").collect()
    assert (sized[0]["width"], sized[0]["rotation"]) == (100.0, 0)
    assert reasons(asm.insert_blank(m, ask(4))) == {"d": "no-such-place"}
    assert reasons(asm.insert_blank(m, ask(1, 100.0, 0.0))) == {"d": "bad-size"}


def cuts(spark, *at):
    return spark.createDataFrame([("d", c) for c in at], "out_doc string, cut int")


@pytest.mark.parametrize(
    "n,at,parts",
    [(10, [2, 5], [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9]]), (6, [3, 0, 3, 99, -1, 0], [[0], [1, 2, 3], [4, 5]]), (4, [1, 3], [[0, 1], [2, 3]]), (3, [], [[0, 1, 2]])],
)
def test_split_at(spark, n, at, parts):
    rows = asm.split_at(book(spark, d=n), cuts(spark, *at)).orderBy("part", "position").collect()
    got = [[r["src_page"] for r in rows if r["part"] == p] for p in range(len(parts))]
    assert got == parts and {r["n_parts"] for r in rows} == {len(parts)}
    assert all(r["position"] == parts[r["part"]].index(r["src_page"]) for r in rows)


def test_split_by_ranges(spark):
    groups = lambda doc, *g: [(doc, i, p) for i, p in enumerate(g)]
    asked = spark.createDataFrame(groups("a", [4, 0, 4, 2], [0]) + groups("b", [0], [1, 99]) + groups("c", [0], []), "out_doc string, part int, pages array<int>")
    out = asm.split_by_ranges(book(spark, a=5, b=3, c=3), asked)
    rows = out.manifest.orderBy("part", "position").collect()
    assert [r["src_page"] for r in rows if r["part"] == 0] == [0, 2, 4]
    assert reasons(out) == {"b": "missing-page", "c": "empty-part"}


def test_merge_orders_inputs_and_names_the_bad_one(spark):
    m = book(spark, a=3, b=2, e=0)
    inputs = spark.createDataFrame(
        [("x", 0, "b", "b.pdf", None), ("x", 1, "a", "a.pdf", [2, 0, 2]), ("y", 0, "a", "a.pdf", None), ("y", 1, "b", "b.pdf", [5]),
         ("z", 0, "a", "a.pdf", None), ("w", 0, "a", "a.pdf", None), ("w", 1, "e", "e.pdf", None)],
        "out_doc string, input_ord int, src_doc string, name string, pages array<int>",
    )
    out = asm.merge_docs(inputs, m)
    rows = out.manifest.orderBy("out_doc", "position").collect()
    assert [(r["src_doc"], r["src_page"]) for r in rows] == [("b", 0), ("b", 1), ("a", 0), ("a", 2)]
    assert reasons(out) == {"y": "no-such-page: b.pdf", "z": "needs-two-inputs", "w": "no-pages: e.pdf"}


def test_ranges_both_ways(spark):
    cases = {"1-3, 7, 9-": [0, 1, 2, 6, 8, 9, 10, 11], "3-1": [0, 1, 2], "all": list(range(12)), "-": list(range(12)), "11 TO 99": [10, 11], "x;2": [1], "0,13": [], "": []}
    df = spark.createDataFrame([(k, k, 12) for k in cases], "doc_id string, spec string, n_pages int")
    got = {k: [] for k in cases}
    for r in asm.parse_ranges(df).orderBy("page_index").collect():
        got[r["doc_id"]].append(r["page_index"])
    assert got == cases
    picked = spark.createDataFrame([("a", p) for p in (0, 2, 3, 4, 8, 8)], "doc_id string, page_index int")
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert {r["doc_id"]: r["ranges"] for r in asm.format_ranges(docs, picked).collect()} == {"a": "1, 3-5, 9", "b": "none"}


def test_unique_names_follow_the_sequence(spark):
    rng = random.Random(11)
    pool = ["a.png", "a-2.png", "a-2-2.png", "a", "b.png", ".png", "a.", "c.tar.gz"]
    rows = [(i % 3, i, rng.choice(pool)) for i in range(200)] + [(9, i, "same.jpg") for i in range(50)]
    want, used = {}, {}
    for archive, seq, name in rows:
        taken = used.setdefault(archive, set())
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        settled, n = name, 2
        while settled in taken:
            settled, n = f"{stem}-{n}{ext}", n + 1
        taken.add(settled)
        want[(archive, seq)] = settled
    df = spark.createDataFrame(rows, "archive int, seq int, name string")
    assert {(r["archive"], r["seq"]): r["unique_name"] for r in asm.unique_names(df).collect()} == want


def test_links_follow_their_pages(spark):
    parts = asm.split_at(book(spark, d=5), cuts(spark, 1)).where("part = 1")
    links = spark.createDataFrame([("d", 0, "d", 4), ("d", 1, "d", 0)], "out_doc string, link int, src_doc string, target int")
    assert {r["link"]: r["new_target"] for r in asm.relink(links, parts).collect()} == {0: 2, 1: None}


def test_one_huge_document_is_numbered_in_blocks(spark):
    rows = spark.range(3000).select(F.lit("big").alias("k"), (F.col("id") * 2).cast("int").alias("o")).unionByName(
        spark.range(5).select(F.lit("small").alias("k"), F.col("id").cast("int").alias("o"))
    )
    got = running.renumber(rows, ["k"], ["o"], "n", block=64).collect()
    assert all(r["n"] == (r["o"] // 2 if r["k"] == "big" else r["o"]) for r in got)
    total = running.running_total(rows, ["k"], ["o"], F.col("o"), "t", block=64).where("k = 'big'").collect()
    assert all(r["t"] == (r["o"] // 2) * (r["o"] // 2 - 1) for r in total)


def test_image_pages(spark):
    images = spark.createDataFrame([("a", 0, 200.0, 100.0, 90, 10), ("a", 1, 100.0, 100.0, 0, 10)], "out_doc string, seq int, width double, height double, turn int, n_bytes long")
    ask = lambda size, margin: spark.createDataFrame([("a", size, margin)], "out_doc string, page_size string, margin double")
    auto = asm.plan_image_pages(images, ask("auto", 36.0)).manifest.orderBy("position").collect()
    assert (auto[0]["page_width"], auto[0]["page_height"]) == (100.0, 200.0)
    fit = asm.plan_image_pages(images, ask("letter", 36.0)).manifest.orderBy("position").collect()
    assert fit[1]["width"] == 540.0 and fit[1]["x"] == 36.0 and fit[1]["y"] == 126.0
    assert reasons(asm.plan_image_pages(images, ask("a4", 300.0))) == {"a": "no-room"}


def test_doubled_requests_are_refused(spark):
    """Two requests where one is meant never multiply pages."""
    m = book(spark, d=3, e=3)
    turns = spark.createDataFrame([("d", 0, 90), ("d", 0, 180), ("e", 0, 90), ("e", 0, 90)], "out_doc string, page_index int, turn int")
    out = asm.rotate_pages(m, turns)
    assert reasons(out) == {"d": "conflicting-turns"} and out.manifest.count() == 3
    moves = spark.createDataFrame([("d", 0, 1), ("d", 0, 2), ("e", 0, 2)], "out_doc string, src int, dst int")
    out = asm.move_page(m, moves)
    assert reasons(out) == {"d": asm.DOUBLED} and order(out.manifest, "e") == [1, 2, 0]
    blanks = spark.createDataFrame([("d", 0, None, None), ("d", 1, None, None), ("e", 3, None, None)], "out_doc string, at int, new_width double, new_height double")
    out = asm.insert_blank(m, blanks)
    assert reasons(out) == {"d": asm.DOUBLED} and out.manifest.count() == 4
    sizes = spark.createDataFrame([("d", 2), ("d", 2), ("e", 2)], "out_doc string, n int")
    out = asm.split_every(m, sizes)
    assert reasons(out) == {"d": asm.DOUBLED} and out.manifest.count() == 3


def test_merge_refuses_a_null_page(spark):
    inputs = spark.createDataFrame(
        [("o", 0, "d", "first", [None, 0]), ("o", 1, "e", "second", None)],
        "out_doc string, input_ord int, src_doc string, name string, pages array<int>",
    )
    assert reasons(asm.merge_docs(inputs, book(spark, d=3, e=2))) == {"o": "no-such-page: first"}


def _plain_names(rows):
    want, used = {}, {}
    for archive, seq, name in rows:
        taken, after = used.setdefault(archive, (set(), {}))
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        settled, n = name, after.get(name, 2)
        while settled in taken:
            settled, n = f"{stem}-{n}{ext}", n + 1
        taken.add(settled)
        after[name] = n
        want[archive, seq] = settled
    return want


def test_a_mixed_family_is_not_gathered(spark):
    """A single form among many equal names; no task gets the rows of the family."""
    rows = [(1, i, "a-2.png" if i == 777 else "a-60000.png" if i == 5 else "a.png") for i in range(100_000)]
    got = asm.unique_names(spark.createDataFrame(rows, "archive int, seq int, name string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan
    assert {(r["archive"], r["seq"]): r["unique_name"] for r in got.collect()} == _plain_names(rows)


def test_forms_of_forms_and_odd_numbers(spark):
    rng = random.Random(3)
    pool = ["a.png", "a-2.png", "a-2-2.png", "a-3.png", "a-23.png", "a-02.png", "a-1.png", "a-2-3.png", "a-5-2-2.png", "-2.png", ".png", ".png-2",
            "-2", "", "a", "a-2", "a-99999999999999999999999.png", "a\nb.png", "a\nb-2.png"]
    weights = [rng.random() ** 3 for _ in pool]
    rows = [(i % 3, i * 37, name) for i, name in enumerate(rng.choices(pool, weights, k=3000))]
    df = spark.createDataFrame(rows, "archive int, seq int, name string").repartition(3)
    assert {(r["archive"], r["seq"]): r["unique_name"] for r in asm.unique_names(df).collect()} == _plain_names(rows)


def test_rows_of_one_name_do_not_share_a_task(spark):
    """Most rows want one name, and another name has a form that is wanted: rows stay spread over the partitions."""
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(keep, ("-1", "false"), strict=True):
            spark.conf.set(c, v)
        names = spark.range(200_000).selectExpr(
            "1 AS archive", "id AS seq", "CASE WHEN id = 9 THEN 'c-2.png' WHEN id IN (5, 6) THEN 'c.png' ELSE 'a.png' END AS name"
        )
        done = asm.unique_names(names).withColumn("p", F.spark_partition_id())
        joins = [line for line in done._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftAnti" in line]
        assert joins and all("_part#" in line for line in joins)
        sizes = [r["count"] for r in done.groupBy("p").count().collect()]
        assert sum(sizes) == 200_000 and max(sizes) < 150_000
        last = done.where("seq IN (0, 5, 6, 9, 70, 199999)").orderBy("seq").collect()
        assert [r["unique_name"] for r in last] == ["a.png", "c.png", "c-2.png", "c-2-2.png", "a-68.png", "a-199997.png"]
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
