"""Form fields as tables: catalogue, checks, filling, flattening, merging.

A field row: doc_id, seq, name, type, v_text, v_bool, v_list, options, multiple,
editable, read_only, required, max_length, flags, page. A value row: doc_id,
name, kind (text, bool, list), v_text, v_bool, v_list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.names import NUMBER, number_path, settle_names

PICKERS = ["dropdown", "optionlist"]
FILLABLE = ["text", "checkbox", "radio", *PICKERS]
HIDDEN = 2


def _none() -> Column:
    return F.array().cast("array<string>")


def form_catalog(fields: DataFrame) -> DataFrame:
    """Every field with the value its type can hold; what cannot apply is null."""
    kind = F.col("type")
    picker = kind.isin(PICKERS)
    return fields.select(
        "doc_id",
        "seq",
        "name",
        "type",
        F.when(kind.isin("text", "radio"), F.coalesce("v_text", F.lit(""))).alias("v_text"),
        F.when(kind == "checkbox", F.coalesce("v_bool", F.lit(False))).alias("v_bool"),
        F.when(picker, F.coalesce("v_list", _none())).alias("v_list"),
        F.when(picker | (kind == "radio"), F.coalesce("options", _none())).alias("options"),
        F.when(picker, F.coalesce("multiple", F.lit(False))).alias("multiple"),
        F.when(kind == "dropdown", F.coalesce("editable", F.lit(False))).alias("editable"),
        F.coalesce("read_only", F.lit(False)).alias("read_only"),
        F.coalesce("required", F.lit(False)).alias("required"),
        "page",
    )


def form_summary(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Per document: has a form, and how many fields of each kind."""
    n = lambda test: F.count(F.when(test, 1))
    counted = fields.groupBy("doc_id").agg(
        F.count("*").alias("n_fields"),
        n(F.col("type").isin(FILLABLE)).alias("n_fillable"),
        n(F.col("required")).alias("n_required"),
        n(F.col("read_only")).alias("n_read_only"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("doc_id").join(counted, "doc_id", "left").select(
        "doc_id",
        (F.coalesce("n_fields", F.lit(0)) > 0).alias("has_form"),
        *[zero(c) for c in ("n_fields", "n_fillable", "n_required", "n_read_only")],
    )


def _wanted() -> Column:
    """A value as the list of choices a picker would hold."""
    return F.when(F.col("kind") == "list", F.col("w_list")).otherwise(
        F.when(F.col("w_text") == "", _none()).otherwise(F.array("w_text"))
    )


def _given(values: DataFrame) -> DataFrame:
    return values.select(
        "doc_id", "name", "kind", F.col("v_text").alias("w_text"),
        F.col("v_bool").alias("w_bool"), F.col("v_list").alias("w_list"),
    )


def validate_fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Values that cannot be filled in, each with its reason."""
    has_form = fields.select("doc_id").distinct().withColumn("_form", F.lit(True))
    times = F.count("*").over(Window.partitionBy("doc_id", "name"))
    joined = (
        _given(values).withColumn("_times", times)
        .join(fields.withColumn("_known", F.lit(True)), ["doc_id", "name"], "left")
        .join(has_form, "doc_id", "left")
    )
    kind, shape = F.col("type"), F.col("kind")
    options = F.coalesce("options", _none())
    wanted = _wanted()
    unlisted = F.size(F.array_except(wanted, options)) > 0
    free = (kind == "dropdown") & F.coalesce("editable", F.lit(False))
    reason = (
        F.when(F.col("_form").isNull(), "no-form")
        .when(F.col("_known").isNull(), "no-such-field")
        .when(F.col("_times") > 1, "more-than-one-value")
        .when(
            kind == "text",
            F.when(shape != "text", "wrong-shape").when(
                F.length("w_text") > F.col("max_length"), "too-long"
            ),
        )
        .when(kind == "checkbox", F.when(shape != "bool", "wrong-shape"))
        .when(
            kind == "radio",
            F.when(shape != "text", "wrong-shape").when(
                (F.col("w_text") != "") & ~F.array_contains(options, F.col("w_text")), "not-offered"
            ),
        )
        .when(
            kind.isin(PICKERS),
            F.when(shape == "bool", "wrong-shape")
            .when((F.size(wanted) > 1) & ~F.coalesce("multiple", F.lit(False)), "one-choice-only")
            .when(unlisted & ~free, "not-offered"),
        )
        .otherwise("holds-no-value")
    )
    return joined.select("doc_id", "name", "seq", reason.alias("reason")).where("reason IS NOT NULL")


def apply_fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Fields after filling. Every field of a name takes the value, read-only ones
    too; a document with any bad value keeps all of its fields as they were."""
    bad = validate_fill(fields, values).select("doc_id").distinct()
    good = _given(values).join(bad, "doc_id", "left_anti")
    kind = F.col("type")
    hit = F.col("kind").isNotNull()
    put = lambda test, new, old: F.when(hit & test, new).otherwise(F.col(old)).alias(old)
    changed = {
        "v_text": put(kind.isin("text", "radio"), F.col("w_text"), "v_text"),
        "v_bool": put(kind == "checkbox", F.col("w_bool"), "v_bool"),
        "v_list": put(kind.isin(PICKERS), _wanted(), "v_list"),
    }
    return fields.join(good, ["doc_id", "name"], "left").select(
        *[changed.get(c, F.col(c)) for c in fields.columns]
    )


def _same_as_stored() -> Column:
    """Whether a value equals what the field's control would show for its content."""
    kind, shape = F.col("type"), F.col("kind")
    first = F.coalesce(F.get("v_list", F.lit(0)), F.lit(""))
    return (
        F.when(kind == "checkbox", (shape == "bool") & F.col("w_bool").eqNullSafe(F.coalesce("v_bool", F.lit(False))))
        .when(kind.isin("text", "radio"), (shape == "text") & F.col("w_text").eqNullSafe(F.coalesce("v_text", F.lit(""))))
        .when(kind == "dropdown", (shape == "text") & F.col("w_text").eqNullSafe(first))
        .otherwise((shape == "list") & F.col("w_list").eqNullSafe(F.coalesce("v_list", _none())))
    )


def fill_changes(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Values somebody really changed, in fields that may be changed."""
    usable = fields.where(F.col("type").isin(FILLABLE) & (F.col("name") != "") & ~F.coalesce("read_only", F.lit(False)))
    return (
        usable.join(_given(values), ["doc_id", "name"])
        .where(~_same_as_stored())
        .select("doc_id", "name", "kind", "w_text", "w_bool", "w_list")
        .distinct()
    )


def required_blank(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Per document with required fields: how many still hold nothing."""
    asked = fields.where(F.col("required") & F.col("type").isin(FILLABLE) & (F.col("name") != ""))
    kind = F.col("type")
    stored_blank = (
        F.when(kind == "checkbox", ~F.coalesce("v_bool", F.lit(False)))
        .when(kind.isin("text", "radio"), F.coalesce("v_text", F.lit("")) == "")
        .when(kind == "dropdown", F.coalesce(F.get("v_list", F.lit(0)), F.lit("")) == "")
        .otherwise(F.size(F.coalesce("v_list", _none())) == 0)
    )
    given_blank = (
        F.when(F.col("kind") == "bool", ~F.col("w_bool"))
        .when(F.col("kind") == "text", F.col("w_text") == "")
        .otherwise(F.size("w_list") == 0)
    )
    blank = F.when(F.col("kind").isNotNull(), given_blank).otherwise(stored_blank)
    return asked.join(_given(values), ["doc_id", "name"], "left").groupBy("doc_id").agg(
        F.count("*").alias("n_required"), F.count(F.when(blank, 1)).alias("n_blank")
    )


def flatten_fields(fields: DataFrame) -> DataFrame:
    """Text a flattened form leaves on its pages; hidden fields leave none."""
    kind = F.col("type")
    shown = (
        F.when(kind.isin("text", "radio"), F.col("v_text"))
        .when(kind == "checkbox", F.when(F.col("v_bool"), "X"))
        .when(kind.isin(PICKERS), F.array_join("v_list", ", "))
    )
    visible = F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(HIDDEN) == 0
    return (
        fields.where(visible & F.col("page").isNotNull())
        .select("doc_id", "page", "seq", shown.alias("str"))
        .where("str <> ''")
    )


def merge_fields(fields: DataFrame) -> DataFrame:
    """Top-level fields of a merge under names that do not collide.

    ``fields``: out_doc, input_ord, seq, root, name, has_kids. A root met on
    several pages counts once; a nameless leaf is called Field; a nameless
    parent stays nameless.
    """
    once = fields.groupBy("out_doc", "input_ord", "root").agg(
        F.min("seq").alias("seq"),
        F.min_by("name", "seq").alias("had"),
        F.bool_or("has_kids").alias("has_kids"),
    )
    named = once.withColumn(
        "name",
        F.when(F.coalesce("had", F.lit("")) != "", F.col("had")).when(~F.col("has_kids"), "Field").otherwise(""),
    )
    real = named.where("name <> ''")
    tail = F.regexp_extract("name", rf"((?: \({NUMBER}\))+)\z", 1)
    settled = settle_names(
        real,
        ["out_doc"],
        ["input_ord", "seq"],
        "name",
        "new_name",
        F.left("name", F.length("name") - F.length(tail)),
        number_path(tail),
        lambda name, n: F.concat(name, F.lit(" ("), n, F.lit(")")),
    )
    silent = named.where("name = ''").withColumn("new_name", F.lit(""))
    return settled.unionByName(silent).select(
        "out_doc", "input_ord", "root", "new_name",
        (F.col("new_name") != F.coalesce("had", F.lit("")))
        .__and__(F.coalesce("had", F.lit("")) != "")
        .alias("renamed"),
    )
