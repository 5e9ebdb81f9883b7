"""Document properties: reading, patching, stripping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TEXT_KEYS = ["title", "author", "subject", "creator", "producer"]
DATE_KEYS = ["created", "modified"]
SETTABLE = [*TEXT_KEYS, "keywords", *DATE_KEYS]
# Info dictionary entry of every property.
ENTRIES = {
    "title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords",
    "creator": "Creator", "producer": "Producer", "created": "CreationDate", "modified": "ModDate",
}


def parse_date(text: Column) -> Column:
    """A document date, ``D:20240131120000+02'00'`` or ISO; null when malformed."""
    shape = r"\A(?:D:)(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:Z.*|([+-])(\d{2})'?(\d{2})?'?)?\z"
    part = lambda i, default: F.coalesce(
        F.nullif(F.regexp_extract(text, shape, i), F.lit("")), F.lit(default)
    )
    local = F.try_to_timestamp(
        F.concat(
            part(1, "x"), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "),
            part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"),
        ),
        F.lit("yyyy-MM-dd HH:mm:ss"),
    )
    minutes = (part(8, "0").cast("int") * 60 + part(9, "0").cast("int")) * F.when(
        part(7, "+") == "-", -1
    ).otherwise(1)
    shifted = local - F.make_interval(mins=minutes)
    return F.when(F.regexp_like(text, F.lit(shape)), shifted).otherwise(F.try_to_timestamp(text))


def split_keywords(raw: Column) -> Column:
    """Keyword list of the stored string: commas and semicolons win over blanks."""
    parts = F.when(
        F.regexp_like(raw, F.lit("[,;]")), F.split(raw, "[,;]", -1)
    ).otherwise(F.split(raw, r"(?U)\s+", -1))
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)\A\s+|\s+\z", ""))
    none = F.array().cast("array<string>")
    return F.coalesce(F.filter(trimmed, lambda p: p != ""), none)


def read_metadata(info: DataFrame) -> DataFrame:
    """Every property with a default; an entry of the wrong kind loses only itself.

    ``info``: doc_id, info map<string, struct<kind, value>>, n_pages, encrypted.
    """
    entry = lambda key: F.try_element_at("info", F.lit(ENTRIES[key]))
    text = lambda key: F.when(entry(key)["kind"] == "string", entry(key)["value"])
    return info.select(
        "doc_id",
        *[F.coalesce(text(k), F.lit("")).alias(k) for k in TEXT_KEYS],
        split_keywords(text("keywords")).alias("keywords"),
        *[parse_date(text(k)).alias(k) for k in DATE_KEYS],
        "n_pages",
        F.coalesce("encrypted", F.lit(False)).alias("encrypted"),
    )


def _patched(patches: DataFrame) -> DataFrame:
    """One patch per document, with the fault that refuses it, if any."""
    patches = patches.groupBy("doc_id").agg(F.count("*").alias("_asked"), F.first("patch").alias("patch"))
    bad = lambda k: F.map_contains_key("patch", k) & (F.col("patch")[k] != "") & F.try_to_timestamp(
        F.col("patch")[k]
    ).isNull()
    return patches.withColumn(
        "_fault",
        F.when(F.col("_asked") > 1, "more-than-one-request")
        .when(bad("created"), "created-is-no-date")
        .when(bad("modified"), "modified-is-no-date"),
    )


def rejected_patches(patches: DataFrame) -> DataFrame:
    """Documents with two patches, or one that names an impossible date."""
    return _patched(patches).where("_fault IS NOT NULL").select("doc_id", F.col("_fault").alias("reason"))


def patch_metadata(meta: DataFrame, patches: DataFrame) -> DataFrame:
    """Change only what the patch names: absent keeps, empty clears, else sets.

    ``meta``: doc_id, the text and date properties, keywords (stored string),
    xmp. ``patches``: doc_id, patch map<string,string>. Any change to a settable
    property drops the XMP copy. A refused patch changes nothing.
    """
    fine = _patched(patches).where("_fault IS NULL").select("doc_id", "patch")
    joined = meta.join(fine, "doc_id", "left")
    named = lambda k: F.coalesce(F.map_contains_key("patch", k), F.lit(False))
    value = lambda k: F.nullif(F.col("patch")[k], F.lit(""))
    words = F.nullif(F.array_join(split_keywords(F.col("patch")["keywords"]), ", "), F.lit(""))
    new = {k: F.when(named(k), value(k)).otherwise(F.col(k)) for k in TEXT_KEYS}
    new["keywords"] = F.when(named("keywords"), words).otherwise(F.col("keywords"))
    for k in DATE_KEYS:
        new[k] = F.when(named(k), F.try_to_timestamp(value(k))).otherwise(F.col(k))
    touched = F.lit(False)
    for k in SETTABLE:
        touched = touched | named(k)
    new["xmp"] = F.when(~touched, F.col("xmp"))
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in meta.columns])


def strip_metadata(meta: DataFrame) -> DataFrame:
    """No entry and no XMP left; both dates at the epoch, so the scrub shows."""
    epoch = F.timestamp_seconds(F.lit(0))
    gone = {k: F.lit(None).cast("string") for k in [*TEXT_KEYS, "keywords", "xmp"]}
    gone.update({k: epoch for k in DATE_KEYS})
    return meta.select(*[gone[c].alias(c) if c in gone else F.col(c) for c in meta.columns])
