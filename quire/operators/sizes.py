"""Size decisions, estimates and the traffic meter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.running import renumber
from quire.operators.assembly import safe_name

BARELY = 0.01
FLATTEN_DPI = 120.0
BYTES_PER_PIXEL = 0.12
PAGE_OVERHEAD = 1024
SLOW_PIXELS = 100_000_000
SLOW_PAGES = 120
MAX_EXPORT_PIXELS = 50_000_000
EXPORT_DPI = (36.0, 600.0)
BOOT_MILLISECONDS = 400

# What a rebuild would lose, in the order it is listed.
LOSSES = [
    ("form_fields", "form fields"), ("bookmarks", "bookmarks"), ("attachments", "file attachments"),
    ("scripts", "document scripts"), ("named_tree", "named links"), ("named_dests", "named links"),
    ("tags", "accessibility tags"), ("layers", "layers"), ("page_numbering", "page numbering"),
]


def keep_smaller(candidates: DataFrame) -> DataFrame:
    """Per document the smallest candidate, kept only if it is strictly smaller.

    ``candidates``: doc_id, method, before, after.
    """
    best = candidates.groupBy("doc_id").agg(
        F.min_by(F.struct("method", "before", "after"), F.struct("after", "method")).alias("b")
    )
    before, after = F.col("b.before"), F.col("b.after")
    smaller = after < before
    saved = F.when(smaller, (before - after) / before).otherwise(0.0)
    return best.select(
        "doc_id",
        F.col("b.method").alias("method"),
        before.alias("before"),
        F.when(smaller, after).otherwise(before).alias("after"),
        saved.alias("saved"),
        F.when(~smaller, "kept-original").when(saved < BARELY, "barely").otherwise("smaller").alias("outcome"),
    )


def size_delta(before: Column, after: Column) -> Column:
    """Signed whole percentage, or ``no change`` under half a percent."""
    pct = (after - before) / before * 100
    rounded = F.when(F.abs(pct) < 0.5, 0).otherwise(F.floor(pct + 0.5)).cast("long")
    return (
        F.when(before <= 0, "")
        .when(rounded == 0, "no change")
        .when(rounded < 0, F.concat(rounded.cast("string"), F.lit("%")))
        .otherwise(F.concat(F.lit("+"), rounded.cast("string"), F.lit("%")))
    )


def size_totals(sizes: DataFrame) -> DataFrame:
    """One line for the collection: bytes before and after, and the change."""
    summed = sizes.agg(
        F.count("*").alias("n_docs"), F.sum("before").alias("before"), F.sum("after").alias("after")
    )
    return summed.withColumn(
        "delta", size_delta(F.col("before").cast("double"), F.col("after").cast("double"))
    )


def grouped_totals(
    rows: DataFrame, by: list[str], measure: str, distinct: str, exact: bool = True
) -> DataFrame:
    """Totals by every combination of ``by``, up to one line for all.

    ``grouping`` has a bit for each column left out (the first is the highest). Rows are summed
    once for the finest groups; the coarser lines are made of these sums, and of mergeable
    sketches for the number of different values of ``distinct`` (``about``, within some percent).
    With ``exact`` that number is also counted (``n_distinct``), from one row a group and value.
    """
    finest = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(measure).alias("s"), F.hll_sketch_agg(F.col(distinct).cast("string")).alias("sketch")
    )
    grouping = F.grouping_id(*by).cast("long").alias("grouping")
    lines = finest.cube(*by).agg(
        grouping, F.sum("n").alias("n_rows"), F.sum("s").alias("total"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"),
    )
    if not exact:
        return lines
    # Groups of one value: a coarser line counts it once however many of its groups have it.
    values = rows.where(F.col(distinct).isNotNull()).select(*by, F.col(distinct).alias("_value")).distinct()
    counted = values.cube(*by).agg(grouping, F.count_distinct("_value").alias("n_distinct"))
    same = [lines["grouping"] == counted["grouping"], *[lines[c].eqNullSafe(counted[c]) for c in by]]
    return lines.join(counted, same, "left").select(
        *[lines[c] for c in by], lines["grouping"], "n_rows", "total", "about", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")
    )


def flatten_estimate(docs: DataFrame, dpi: Column) -> DataFrame:
    """Pixels and rough bytes of drawing every page. ``docs``: doc_id, n_pages."""
    bad = dpi.isNull() | F.isnan(dpi) | (dpi <= 0) | (dpi == F.lit(float("inf")))
    clean = F.when(bad, FLATTEN_DPI).otherwise(dpi)
    pages = F.greatest(F.lit(0), F.col("n_pages"))
    pixels = F.floor(pages * (8.5 * clean * 11 * clean) + 0.5)
    rough = F.floor(pixels * BYTES_PER_PIXEL + pages * PAGE_OVERHEAD + 0.5)
    return docs.select(
        "doc_id",
        pixels.alias("pixels"),
        rough.alias("rough_bytes"),
        ((pixels > SLOW_PIXELS) | (pages > SLOW_PAGES)).alias("slow"),
    )


def rebuild_losses(features: DataFrame) -> DataFrame:
    """What rebuilding a document would lose, once each, and whether it is signed."""
    found = F.array(*[F.when(F.col(c), label) for c, label in LOSSES])
    return features.select(
        "doc_id", F.array_distinct(F.array_compact(found)).alias("losses"), F.coalesce("signed", F.lit(False)).alias("signed")
    )


def host_of(url: Column, base: Column) -> Column:
    """Host of a request; a relative address belongs to the page's own host."""
    absolute = F.regexp_like(url, F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*:"))
    authority = F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), r"\A[^@]*@", ""))
    secure = F.lower(url).startswith("https:")
    plain = F.when(secure, F.regexp_replace(authority, r":443\z", "")).otherwise(
        F.regexp_replace(authority, r":80\z", "")
    )
    return F.nullif(F.when(absolute, plain).otherwise(base), F.lit(""))


def traffic(requests: DataFrame, loads: DataFrame, uploads: DataFrame) -> DataFrame:
    """Per session: requests, bytes and hosts after the page had loaded.

    ``requests``: session, ts, url, bytes. ``loads``: session, loaded_at, host.
    ``uploads``: session, bytes; those always count. Hosts are brought down to
    one row per session and host before they are listed in first-seen order.
    """
    booted = loads.select(
        "session",
        (F.col("loaded_at") + F.make_interval(secs=F.lit(BOOT_MILLISECONDS / 1000))).alias("_boot"),
        F.col("host").alias("_base"),
    )
    local = F.regexp_like("url", F.lit(r"\A(blob|data|filesystem):"))
    seen = (
        requests.where(~local)
        .join(booted, "session")
        .where(F.col("ts") >= F.col("_boot"))
        .select("session", "ts", "bytes", host_of(F.col("url"), F.col("_base")).alias("host"))
    )
    per_host = seen.groupBy("session", "host").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("b"), F.min("ts").alias("first")
    )
    listed = F.sort_array(
        F.collect_list(F.when(F.col("host").isNotNull(), F.struct("first", "host")))
    )
    heard = per_host.groupBy("session").agg(
        F.sum("n").alias("n_requests"),
        F.sum("b").alias("bytes_in"),
        F.transform(listed, lambda h: h["host"]).alias("hosts"),
    )
    sent = uploads.groupBy("session").agg(F.sum("bytes").alias("bytes_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return loads.select("session").join(heard, "session", "left").join(sent, "session", "left").select(
        "session", zero("n_requests"), zero("bytes_in"), zero("bytes_out"),
        F.coalesce("hosts", F.array().cast("array<string>")).alias("hosts"),
    )


def first_seen_hosts(seen: DataFrame, salts: int = 16) -> DataFrame:
    """``session, place, host, first``: each session's hosts in the order they were first seen.

    ``seen``: session, ts, host. One row a host instead of a list, so a session may have any number.
    First sights are found per salt and then per host; places are counted off in blocks of time.
    """
    salt = F.pmod(F.xxhash64("ts"), F.lit(salts)).alias("_salt")
    early = seen.where("host IS NOT NULL").groupBy("session", "host", salt).agg(F.min("ts").alias("first"))
    first = early.groupBy("session", "host").agg(F.min("first").alias("first"))
    timed = first.withColumn("_micros", F.unix_micros(F.col("first").cast("timestamp")))
    placed = renumber(timed, ["session"], ["_micros", "host"], "place", block=3_600_000_000)
    return placed.select("session", "place", "host", "first")


def plan_export(shapes: DataFrame, selection: DataFrame, requests: DataFrame) -> DataFrame:
    """Image files of the selected pages, or why a page cannot be exported.

    ``shapes``: doc_id, page_index, view_width, view_height for every page.
    ``requests``: doc_id, base, dpi, extension. A page over the pixel limit is
    answered with the largest resolution that fits.
    """
    sizes = shapes.groupBy("doc_id").agg(F.count("*").alias("_total"))
    chosen = (
        shapes.join(selection.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_semi")
        .join(sizes, "doc_id")
        .join(requests, "doc_id")
    )
    px = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * (F.col("dpi") / 72)))
    sized = chosen.withColumns({"_w": px("view_width"), "_h": px("view_height")})
    bad = ~F.col("dpi").between(*EXPORT_DPI) | F.isnan("dpi")
    big = F.col("_w") * F.col("_h") > MAX_EXPORT_PIXELS
    fits = F.greatest(
        F.lit(36), F.floor(F.col("dpi") * F.sqrt(F.lit(MAX_EXPORT_PIXELS) / (F.col("_w") * F.col("_h"))))
    )
    number = F.lpad((F.col("page_index") + 1).cast("string"), F.length(F.col("_total").cast("string")), F.lit("0"))
    ok = ~(bad | big)
    return sized.select(
        "doc_id",
        "page_index",
        F.when(ok, F.concat(safe_name(F.col("base")), F.lit("-"), number, F.lit("."), "extension")).alias("file_name"),
        F.when(ok, F.col("_w")).alias("width"),
        F.when(ok, F.col("_h")).alias("height"),
        F.when(bad, "dpi-out-of-range").when(big, "too-many-pixels").alias("reason"),
        F.when(~bad & big, fits).alias("largest_dpi"),
    )
