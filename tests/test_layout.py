import random

import pytest
from pyspark.sql import functions as F

from quire.operators import intake, layout, marks


def runs(spark, pieces):
    """(str, x, y, size, width) rows; width defaults to half a size per letter."""
    rows, at = [], 0
    for i, (text, x, y, *more) in enumerate(pieces):
        size = float(more[0]) if more else 10.0
        width = float(more[1]) if len(more) > 1 else len(text) * size * 0.5
        rows.append(("d", 1, i, text, float(x), float(y), width, size, size, at, at + len(text)))
        at += len(text)
    return spark.createDataFrame(
        rows, "doc_id string, page int, seq int, str string, x double, y double, width double, height double, font_size double, start int, end int"
    )


def lines_of(df):
    return layout.lines(layout.rows_by_baseline(df))


def texts(df, order):
    return [r["text"] for r in df.orderBy(order).collect()]


def test_lines(spark):
    word = runs(spark, [("Confid", 100, 50), ("ential", 130, 50), (" Memorandum", 160, 50.3)])
    assert texts(lines_of(word), "line_no") == ["Confidential Memorandum"]
    columns = runs(spark, [("Left hand title", 90, 50, 10, 95), ("Right, 2024", 430, 50, 10, 60)])
    assert texts(lines_of(columns), "line_no") == ["Left hand title", "Right, 2024"]
    order = runs(spark, [("second", 90, 70), ("first", 90, 50), ("   ", 10, 10), ("", 20, 10)])
    assert texts(lines_of(order), "line_no") == ["first", "second"]
    tall = lines_of(runs(spark, [("Word", 100, 40, 14)])).collect()[0]
    assert tall["y"] == 40 and tall["height"] > 14


@pytest.mark.parametrize(
    "pieces,blocks",
    [
        ([("Wrote the yearly", 110, 100), ("report, with tables", 110, 112)], 1),
        ([("first bullet", 110, 100), ("continued", 110, 112), ("indented", 140, 124)], 2),
        ([("end of one", 90, 100), ("start of next", 90, 160)], 2),
        ([("SECTION HEAD", 90, 100, 12), ("Body text", 90, 114, 10)], 2),
    ],
)
def test_blocks(spark, pieces, blocks):
    made = layout.blocks(lines_of(runs(spark, pieces))).collect()
    assert len(made) == blocks
    if blocks == 1:
        assert made[0]["text"].count("\n") == 1 and made[0]["start"] == 0


def test_smallest_block_under_a_point(spark):
    big = layout.blocks(lines_of(runs(spark, [("one broad title row", 50, 50, 20, 400)])))
    small = layout.blocks(lines_of(runs(spark, [("x", 100, 52, 8, 6)]))).withColumn("block_no", F.lit(7).cast("long"))
    points = spark.createDataFrame([("d", 1, 0, 102.0, 56.0), ("d", 1, 1, 900.0, 900.0)], "doc_id string, page int, point int, px double, py double")
    got = layout.block_at(big.unionByName(small), points).collect()
    assert [(r["point"], r["block_no"]) for r in got] == [(0, 7)]


def test_rows_follow_drawing_order(spark):
    rng = random.Random(5)
    pieces = [("w", rng.randint(0, 500), rng.uniform(0, 60), rng.choice([6, 10, 14])) for _ in range(250)]
    df = runs(spark, pieces)
    rows: list[list] = []
    want = {}
    for seq, (_, _, y, size) in enumerate(pieces):
        base = y + size
        for i, (b, f) in enumerate(rows):
            if abs(b - base) <= max(f, size) * 0.4:
                want[seq] = i
                break
        else:
            want[seq] = len(rows)
            rows.append((base, size))
    got = {r["seq"]: r["row_no"] for r in layout.rows_by_baseline(df).collect()}
    assert got == want


def test_runs_keep_their_place_in_the_page_string(spark):
    df = spark.createDataFrame(
        [("d", 1, 0, "He", False), ("d", 1, 1, "llo", True), ("d", 1, 2, "", True), ("d", 1, 3, "end", False)],
        "doc_id string, page int, seq int, str string, has_eol boolean",
    )
    page = intake.assemble_page_text(df).collect()[0]["text"]
    assert page == "Hello\n\nend"
    for r in intake.place_runs(df).collect():
        assert page[r["start"] : r["end"]] == r["str"]
    cites = spark.createDataFrame([("d", 1, 0, 1, 3), ("d", 1, 1, 5, 7)], "doc_id string, page int, cite int, start int, end int")
    found = layout.locate_citations(cites, intake.place_runs(df)).collect()
    assert sorted((r["cite"], r["str"]) for r in found) == [(0, "He"), (0, "llo")]


def test_points_survive_the_round_trip(spark):
    boxes = spark.createDataFrame(
        [("d", i, 10.0, 5.0, 612.0, 792.0, t) for i, t in enumerate([0, 90, 180, -90, 450])],
        "doc_id string, page_index int, origin_x double, origin_y double, width double, height double, rotation int",
    )
    points = boxes.select("doc_id", "page_index", F.lit(30.0).alias("x"), F.lit(40.0).alias("y"))
    got = {r["page_index"]: r for r in marks.points_to_user(points, boxes).collect()}
    assert all((r["vx"], r["vy"]) == (30.0, 40.0) for r in got.values())
    assert (got[0]["ux"], got[0]["uy"]) == (40.0, 757.0)
    assert (got[1]["ux"], got[1]["uy"]) == (got[4]["ux"], got[4]["uy"]) == (50.0, 35.0)
    assert (got[3]["ux"], got[3]["uy"]) == (582.0, 767.0)


def test_fit_shrinks_to_a_floor(spark):
    widths = spark.createDataFrame([("a", 0.5)], "ch string, em double")
    edits = spark.createDataFrame(
        [(1, "aaaa", 100.0, 12.0, None), (2, "aaaaaaaaaa", 50.0, 12.0, None), (3, "a" * 100, 50.0, 12.0, None), (4, "", 1.0, 12.0, None), (5, "aa?", 10.0, 10.0, 1.0)],
        "edit int, text string, room double, size double, squeeze double",
    )
    got = {r["edit"]: r for r in marks.fit_text(edits, widths).collect()}
    assert got[1]["fits"] and got[1]["suggested"] == 12.0 and got[1]["warning"] is None
    assert not got[2]["fits"] and got[2]["suggested"] == 9.99 or got[2]["suggested"] == 10.0
    assert got[2]["warning"] == "shrunk" and got[2]["overflow"] == pytest.approx(10.0)
    assert got[3]["suggested"] == 7.2 and got[3]["warning"] == "overflows"
    assert got[4]["fits"] and not got[5]["fits"] and got[5]["warning"] == "no-such-glyph"


def test_labels_count_to_the_last_number_printed(spark):
    docs = spark.createDataFrame([("d", 6)], "doc_id string, n_pages int")
    picked = spark.createDataFrame([("d", p) for p in (4, 0, 2, 2, 99)], "doc_id string, page_index int")
    got = marks.page_labels(picked, docs, "{n} of {total}").orderBy("page_index").collect()
    assert [(r["page_index"], r["label"]) for r in got] == [(0, "1 of 3"), (2, "2 of 3"), (4, "3 of 3")]
    late = marks.page_labels(picked, docs, "{n} of {total}", start=7).orderBy("page_index").collect()
    assert late[0]["label"] == "7 of 9"


def test_text_without_a_glyph_does_not_fit(spark):
    widths = spark.createDataFrame([("a", 0.5)], "ch string, em double")
    edits = spark.createDataFrame([(1, "AAAA", 5.0, 12.0, None), (2, "a", 50.0, 12.0, None)], "edit int, text string, room double, size double, squeeze double")
    got = {r["edit"]: r for r in marks.fit_text(edits, widths).collect()}
    assert not got[1]["fits"] and got[1]["warning"] == "no-such-glyph" and got[1]["suggested"] is None
    assert got[2]["fits"] and got[2]["warning"] is None


def _words(spark):
    rows = [(d, p, n, f"w{n}", 72.0 + n % 8 * 60, 82.0 + n // 8 * 14, 20.0, 10.0) for d in range(2) for p in (1, 2) for n in range(40)]
    runs = spark.createDataFrame(rows, "doc_id int, page int, seq int, str string, x double, y double, width double, font_size double")
    return runs.withColumn("start", F.col("seq") * 4).withColumn("end", F.col("start") + 3)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_and_blocks_deal_the_runs_by_page_twice_at_most(spark):
    made = layout.blocks(layout.lines(layout.rows_by_baseline(_words(spark))))
    assert _exchanges(made) == 2
    assert made.agg(F.sum("n_lines")).first()[0] == layout.lines(layout.rows_by_baseline(_words(spark))).count()


def test_rows_of_many_pages_in_one_task(spark):
    rows = layout.rows_by_baseline(_words(spark).coalesce(1))
    assert all(r["row_no"] == r["seq"] // 8 for r in rows.collect())


def test_remembered_baselines_change_nothing(spark, monkeypatch):
    runs = _words(spark).withColumn("y", F.expr("double(seq * 37 % 23) * 3.125D"))
    want = sorted(layout.rows_by_baseline(runs).select("doc_id", "page", "seq", "row_no").collect())
    monkeypatch.setattr(layout, "REMEMBERED", 1)
    assert sorted(layout.rows_by_baseline(runs).select("doc_id", "page", "seq", "row_no").collect()) == want


def test_runs_far_from_every_citation_are_not_dealt(spark):
    cited = spark.createDataFrame([(0, 1, 0, 8, 20), (0, 1, 1, 30, 31), (1, 2, 0, 0, 3)], "doc_id int, page int, cite int, start int, end int")
    found = layout.locate_citations(cited, _words(spark))
    got = sorted(tuple(r) for r in found.select("doc_id", "page", "cite", "seq").collect())
    assert got == [(0, 1, 0, 2), (0, 1, 0, 3), (0, 1, 0, 4), (0, 1, 1, 7), (1, 2, 0, 0)]
    assert "_high" in found._jdf.queryExecution().optimizedPlan().toString()


def test_packs_keep_every_value_and_groups_stay_where_they_are(spark):
    """Nulls, odd numbers, rows that lie apart and groups in several packs; no second exchange by the same keys."""
    import pyarrow as pa
    from pyspark.sql import Window

    from quire.functions.packs import packed_by_group

    rng, nan = random.Random(3), float("nan")
    rows = [(d, p, n, rng.choice(["", "wört", "日本", "x" * 40]), rng.choice([0.0, -1e300, nan, 0.1]), 2**62 * (n % 3 - 1), rng.choice([None, "a", "b"]),
             rng.choice([None, 1.5]), n % 2 == 0) for d in ("a", "b", None) for p in (1, None) for n in range(30)]
    schema = "doc_id string, page int, seq int, str string, x double, big long, some string, part double, flag boolean"
    for given in (rows, rng.sample(rows, len(rows)), [r for r in rows if r[2] < 3]):
        table = spark.createDataFrame(given, schema).coalesce(2)
        made = packed_by_group(table, ["doc_id", "page"], lambda group: group, spark.createDataFrame([], ", ".join(schema.split(", ")[2:])).schema)
        assert sorted(map(str, made.collect())) == sorted(map(str, table.collect()))
        counted = made.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")))
        assert _exchanges(counted) == 1
    moved = packed_by_group(spark.createDataFrame(rows, schema), ["doc_id", "page"], lambda group: pa.table({"n": [len(group)]}), spark.range(0).toDF("n").schema)
    assert [r["n"] for r in moved.collect()] == [30] * 6


def test_runs_move_as_packs_and_placed_ones_do_not_move_again(spark):
    df = _words(spark).drop("start", "end").withColumn("has_eol", F.col("seq") % 8 == 7)
    rows = layout.rows_by_baseline(intake.place_runs(df))
    assert _exchanges(rows) == 1 and _exchanges(layout.blocks(layout.lines(rows))) == 2
    plan = layout.lines(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowAggregatePython") == 2
    nulls = df.withColumn("str", F.expr("CASE WHEN seq % 5 = 0 THEN str WHEN seq % 5 = 1 THEN '' END"))
    got = [(r["seq"], r["start"], r["end"]) for r in intake.place_runs(nulls).where("doc_id = 0 AND page = 1").orderBy("seq").collect()]
    at, want = 0, []
    for n in range(40):
        length = len(f"w{n}") if n % 5 == 0 else 0
        want += [(n, at, at + length)] if length else []
        at += length + (n % 8 == 7) if n % 5 < 2 else 0
    assert got == want


def test_lines_of_odd_numbers(spark):
    """Nulls and values that are no number count as they do in Spark's own sorting and totals."""
    nan = float("nan")
    rows = [("d", 1, i, s, x, y, w, f, a, a + 1, r) for i, (s, x, y, w, f, a, r) in enumerate([
        ("a", 0.0, 5.0, 10.0, 10.0, 7, 0), ("b", 10.0, nan, 10.0, 10.0, 3, 0), ("c", 100.0, 5.0, None, 10.0, 1, 0), ("d", 300.0, 5.0, 5.0, 10.0, 2, 0),
        ("e", nan, 9.0, 5.0, 10.0, 2, 0), ("f", None, 9.0, 5.0, 10.0, 2, 1), (None, 4.0, 9.0, 5.0, None, 2, 1), ("g", 4.0, 9.0, 5.0, nan, 2, 2),
    ])]
    schema = "doc_id string, page int, seq int, str string, x double, y double, width double, font_size double, start int, end int, row_no long"
    got = {r["text"]: (r["line_no"], str(r["x"]), str(r["y"]), str(r["width"]), str(r["font_size"]), r["start"], r["end"]) for r in layout.lines(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "f": (1, "4.0", "9.0", "5.0", "10.0", 2, 3), "cd": (0, "100.0", "5.0", "205.0", "10.0", 1, 3),
        "g": (4, "4.0", "nan", "5.0", "nan", 2, 3), "ab": (3, "0.0", "nan", "20.0", "10.0", 3, 8), "e": (2, "nan", "9.0", "nan", "10.0", 2, 3),
    }
