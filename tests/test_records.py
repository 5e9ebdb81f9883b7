import datetime as dt

from pyspark.sql import functions as F

from quire.operators import forms, intake, metadata, sizes

FIELD = (
    "doc_id string, seq int, name string, type string, v_text string, v_bool boolean, v_list array<string>,"
    " options array<string>, multiple boolean, editable boolean, read_only boolean, required boolean,"
    " max_length int, flags int, page int"
)
VALUE = "doc_id string, name string, kind string, v_text string, v_bool boolean, v_list array<string>"


def field(seq, name, kind, doc="d", **more):
    base = dict(v_text=None, v_bool=None, v_list=None, options=None, multiple=None, editable=None, read_only=False, required=False, max_length=None, flags=0, page=0)
    base.update(more)
    return (doc, seq, name, kind, *base.values())


def value(name, given, doc="d"):
    kind = "bool" if isinstance(given, bool) else "list" if isinstance(given, list) else "text"
    return (doc, name, kind, given if kind == "text" else None, given if kind == "bool" else None, given if kind == "list" else None)


FIELDS = [
    field(0, "zip", "text", max_length=5), field(1, "ok", "checkbox"), field(2, "side", "radio", options=["l", "r"]),
    field(3, "one", "dropdown", options=["a", "b"], v_list=["a"]), field(4, "free", "dropdown", options=["a"], editable=True),
    field(5, "many", "optionlist", options=["a", "b"], multiple=True), field(6, "sign", "signature"), field(7, "zip", "text", read_only=True),
]


def test_fill_checks(spark):
    fields = spark.createDataFrame(FIELDS, FIELD)
    check = lambda *v: {(r["name"], r["reason"]) for r in forms.validate_fill(fields, spark.createDataFrame(list(v), VALUE)).collect()}
    assert check(value("zip", "20742-1234")) == {("zip", "too-long")}
    assert check(value("ok", "yes"), value("side", True), value("one", False), value("zip", ["x"])) == {
        ("ok", "wrong-shape"), ("side", "wrong-shape"), ("one", "wrong-shape"), ("zip", "wrong-shape"),
    }
    assert check(value("side", "x"), value("one", "z"), value("many", ["a", "z"])) == {("side", "not-offered"), ("one", "not-offered"), ("many", "not-offered")}
    assert check(value("one", ["a", "b"])) == {("one", "one-choice-only")}
    assert check(value("sign", "me"), value("ghost", "x")) == {("sign", "holds-no-value"), ("ghost", "no-such-field")}
    assert check(value("x", "y", doc="empty")) == {("x", "no-form")}
    assert check(value("free", "typed"), value("side", ""), value("one", ""), value("many", []), value("ok", True)) == set()


def test_fill_is_all_or_nothing_and_reaches_every_copy(spark):
    fields = spark.createDataFrame(FIELDS + [field(0, "zip", "text", doc="bad", v_text="old", max_length=3)], FIELD)
    values = spark.createDataFrame([value("zip", "20742"), value("one", "b"), value("many", ["b"]), value("ok", True), value("zip", "20742", doc="bad")], VALUE)
    got = {(r["doc_id"], r["seq"]): r for r in forms.apply_fill(fields, values).collect()}
    assert got[("d", 0)]["v_text"] == got[("d", 7)]["v_text"] == "20742"
    assert got[("d", 3)]["v_list"] == ["b"] and got[("d", 5)]["v_list"] == ["b"] and got[("d", 1)]["v_bool"]
    assert got[("bad", 0)]["v_text"] == "old"


def test_changes_and_blanks(spark):
    fields = spark.createDataFrame([
        field(0, "t", "text", v_text="x", required=True), field(1, "c", "checkbox", required=True), field(2, "d", "dropdown", v_list=["a", "b"]),
        field(3, "r", "text", read_only=True), field(4, "m", "optionlist", v_list=["a"], required=True),
    ], FIELD)
    values = spark.createDataFrame([value("t", "x"), value("c", True), value("d", "a"), value("r", "new"), value("m", [])], VALUE)
    assert [r["name"] for r in forms.fill_changes(fields, values).orderBy("name").collect()] == ["c", "m"]
    assert [(r["n_required"], r["n_blank"]) for r in forms.required_blank(fields, values).collect()] == [(3, 1)]
    assert [(r["n_required"], r["n_blank"]) for r in forms.required_blank(fields, values.limit(0)).collect()] == [(3, 1)]


def test_flatten_hides_hidden_fields(spark):
    fields = spark.createDataFrame([field(0, "a", "text", v_text="seen"), field(1, "b", "text", v_text="secret", flags=2), field(2, "c", "checkbox", v_bool=True)], FIELD)
    assert sorted(r["str"] for r in forms.flatten_fields(fields).collect()) == ["X", "seen"]


def test_merged_field_names(spark):
    rows = [("x", 0, 0, 1, "name", False), ("x", 0, 1, 1, "name", False), ("x", 0, 2, 2, "name (2)", False), ("x", 1, 0, 1, "name", False),
            ("x", 1, 1, 2, "", False), ("x", 2, 0, 1, None, False), ("x", 2, 1, 2, "", True)]
    df = spark.createDataFrame(rows, "out_doc string, input_ord int, seq int, root int, name string, has_kids boolean")
    got = {(r["input_ord"], r["root"]): (r["new_name"], r["renamed"]) for r in forms.merge_fields(df).collect()}
    assert got == {(0, 1): ("name", False), (0, 2): ("name (2)", False), (1, 1): ("name (3)", True), (1, 2): ("Field", False), (2, 1): ("Field (2)", False), (2, 2): ("", False)}


def test_metadata_tolerates_damage(spark):
    rows = [("d", {"CreationDate": ("string", "last Tuesday"), "Title": ("number", "12"), "Author": ("string", "Ann"), "ModDate": ("string", "D:20240131120000+02'00'")}, 3, None)]
    df = spark.createDataFrame(rows, "doc_id string, info map<string,struct<kind:string,value:string>>, n_pages int, encrypted boolean")
    got = metadata.read_metadata(df).collect()[0]
    assert (got["title"], got["author"], got["created"], got["keywords"]) == ("", "Ann", None, [])
    assert got["modified"] == dt.datetime(2024, 1, 31, 10, 0) and got["encrypted"] is False


def test_patch_has_three_states(spark):
    meta = spark.createDataFrame([(d, "T", "A", "S", "C", "P", "k", None, None, "<x/>") for d in "abc"],
        "doc_id string, title string, author string, subject string, creator string, producer string, keywords string, created timestamp, modified timestamp, xmp string")
    patches = spark.createDataFrame([("a", {"title": "", "keywords": "x; two words"}), ("b", {"created": "soon", "title": "N"}), ("c", {"n_pages": "9"})], "doc_id string, patch map<string,string>")
    got = {r["doc_id"]: r for r in metadata.patch_metadata(meta, patches).collect()}
    assert (got["a"]["title"], got["a"]["author"], got["a"]["keywords"], got["a"]["xmp"]) == (None, "A", "x, two words", None)
    assert (got["b"]["title"], got["b"]["xmp"]) == ("T", "<x/>") and got["c"]["xmp"] == "<x/>"
    assert [(r["doc_id"], r["reason"]) for r in metadata.rejected_patches(patches).collect()] == [("b", "created-is-no-date")]
    bare = metadata.strip_metadata(meta).collect()[0]
    assert bare["author"] is None and bare["xmp"] is None and bare["created"] == dt.datetime(1970, 1, 1)


def test_size_decisions(spark):
    df = spark.createDataFrame([("a", "tidy", 1000, 1000), ("b", "tidy", 1000, 995), ("c", "tidy", 1000, 900), ("c", "flatten", 1000, 400)], "doc_id string, method string, before long, after long")
    got = {r["doc_id"]: r for r in sizes.keep_smaller(df).collect()}
    assert (got["a"]["outcome"], got["a"]["after"]) == ("kept-original", 1000)
    assert got["b"]["outcome"] == "barely" and (got["c"]["method"], got["c"]["after"]) == ("flatten", 400)
    change = sizes.size_delta(F.col("before").cast("double"), F.col("after").cast("double"))
    assert {r[0]: r[1] for r in df.where("method = 'tidy'").select("doc_id", change).collect()} == {"a": "no change", "b": "no change", "c": "-10%"}
    grown = spark.createDataFrame([(0.0, 5.0), (100.0, 150.0), (1000.0, 996.0)], "before double, after double")
    assert [r[0] for r in grown.select(sizes.size_delta(F.col("before"), F.col("after"))).collect()] == ["", "+50%", "no change"]


def test_admission_rules_in_order(spark):
    files = spark.createDataFrame(
        [("a.txt", 10, b"%PDF"), ("b.PDF", 21 * 1024 * 1024, b"no"), ("c.pdf", 5, b"hello"), ("d.pdf", 5, b"%PDF-1"), ("e.pdf", 5, b"%PDF-1"), ("f.pdf", 5, b"%PDF-1"), ("g.pdf", 5, b"%PDF-1")],
        "name string, size long, content binary",
    )
    contents = spark.createDataFrame([("e.pdf", 301, 9), ("f.pdf", 1, 0), ("g.pdf", 300, 1)], "name string, n_pages int, n_chunks int")
    got = {r["name"]: r["verdict"] for r in intake.intake_check(files, contents).collect()}
    assert got == {"a.txt": "not-a-pdf-name", "b.PDF": "too-large", "c.pdf": "not-a-pdf", "d.pdf": "unreadable", "e.pdf": "too-many-pages", "f.pdf": "no-text", "g.pdf": "ok"}


def test_expiry_spares_samples_and_the_edge(spark):
    rows = [("old", False, 0), ("edge", False, 100), ("sample", True, 0)]
    docs = spark.createDataFrame(rows, "doc_id string, sample boolean, s long").withColumn("created_at", F.timestamp_seconds("s"))
    kept = intake.expire(docs, F.timestamp_seconds(F.lit(3700))).collect()
    assert {r["doc_id"] for r in kept} == {"edge", "sample"}


def test_hosts(spark):
    urls = ["https://Ann:pw@A.example:443/x", "http://a.example:8080", "/rel/x", "x.png", "http://bad host/%%", "https://b.example?q"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = [r[0] for r in df.orderBy("i").select(sizes.host_of(F.col("url"), F.lit("own.example"))).collect()]
    assert got == ["a.example", "a.example:8080", "own.example", "own.example", None, "b.example"]


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    from quire.sources.tables import read_files

    for k, folder in enumerate(("one", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.pdf").write_bytes(b"%PDF-1.7" if k else b"other")
    files = read_files(spark, str(tmp_path))
    contents = files.selectExpr("path", "1 AS n_pages", "1 AS n_chunks")
    rows = intake.intake_check(files, contents).collect()
    assert sorted((r["path"].split("/")[-2], r["verdict"]) for r in rows) == [("one", "not-a-pdf"), ("two", "ok")]


def test_many_equal_names_are_numbered_in_one_pass(spark):
    """Equal names mixed with numbered ones; counting starts where the last one stopped."""
    from quire.operators import assembly

    rows = [(1, i, "a.png" if i % 2 else "a-2.png") for i in range(20_000)]
    df = spark.createDataFrame(rows, "archive int, seq int, name string")
    got = assembly.unique_names(df)
    assert got.count() == 20_000 and got.select("unique_name").distinct().count() == 20_000
