"""Page assembly: manifests in, manifests out, one job for the whole collection.

A manifest row places one page: out_doc, position (from 0), src_doc, src_page,
rotation, width, height, plus any further columns, which ride along. Requests
are tables keyed by ``out_doc``. An operator returns the new manifest of the
documents it could serve and, apart from that, the refused ones with a reason.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.names import NUMBER, number_path, settle_names
from quire.functions.running import renumber, running_total
from quire.functions.text import strip_space
from quire.operators.intake import fold_rotation

MAX_PAGES = 5000
MAX_BYTES = 500 * 1024 * 1024
PRODUCER = "quire"

# Portrait page sizes in points.
PAGE_SIZES = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}


class Outcome(NamedTuple):
    manifest: DataFrame
    rejected: DataFrame


# More than one request for a document where one is meant.
DOUBLED = "more-than-one-request"


def _single(requests: DataFrame, *names: str) -> DataFrame:
    """One row per document: the number of its requests and the values of the only one."""
    return requests.groupBy("out_doc").agg(
        F.count("*").alias("_asked"), *[F.first(n).alias(n) for n in names]
    )


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("out_doc").agg(F.count("*").alias("n_pages"))


def _settle(manifest: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of the documents whose verdict is clean, and the refusals."""
    fine = verdicts.where("reason IS NULL").select("out_doc")
    return (
        manifest.join(fine, "out_doc", "left_semi"),
        verdicts.where("reason IS NOT NULL").select("out_doc", "reason"),
    )


def _in_range(page: str = "page_index") -> Column:
    return F.coalesce((F.col(page) >= 0) & (F.col(page) < F.col("n_pages")), F.lit(False))


def _chosen(manifest: DataFrame, selection: DataFrame) -> DataFrame:
    """Distinct requested pages with the page count of their document."""
    return selection.select("out_doc", "page_index").distinct().join(
        totals(manifest), "out_doc", "left"
    )


def parse_ranges(specs: DataFrame) -> DataFrame:
    """Typed page ranges as zero-based page rows.

    ``specs``: doc_id, spec, n_pages and any other columns, which stay. Open
    ends, reversed bounds and ``all`` are understood; what is out of range or
    not a number is dropped.
    """
    part = strip_space(F.col("_part"))
    number = lambda s: s.try_cast("double")
    total = F.col("n_pages").cast("double")
    span = r"(?i)^(\d*)\s*(?:-|–|to)\s*(\d*)$"
    a, b = F.regexp_extract(part, span, 1), F.regexp_extract(part, span, 2)
    first = F.when(a != "", number(a)).otherwise(F.lit(1.0))
    last = F.when(b != "", number(b)).otherwise(total)
    single = number(F.regexp_extract(part, r"^[+-]?\d+", 0))
    low = F.when(F.lower(part) == "all", F.lit(1.0)).when(
        F.regexp_like(part, F.lit(span)), F.least(first, last)
    ).otherwise(single)
    high = F.when(F.lower(part) == "all", total).when(
        F.regexp_like(part, F.lit(span)), F.greatest(first, last)
    ).otherwise(single)
    kept = [c for c in specs.columns if c != "spec"]
    bounded = specs.select(
        *kept, F.explode(F.split("spec", "[,;]", -1)).alias("_part")
    ).select(
        *kept,
        F.greatest(low, F.lit(1.0)).cast("long").alias("_low"),
        F.least(high, total).cast("long").alias("_high"),
        (part != "").alias("_given"),
        low.isNotNull().alias("_number"),
    )
    return (
        bounded.where("_given AND _number AND _low <= _high")
        .select(*kept, F.explode(F.sequence(F.col("_low") - 1, F.col("_high") - 1)).alias("page_index"))
        .distinct()
    )


def format_ranges(docs: DataFrame, selection: DataFrame) -> DataFrame:
    """Selections written out as page numbers, ``1, 3-5, 9``; ``none`` when empty."""
    pages = selection.select("doc_id", "page_index").distinct()
    islands = (
        renumber(pages, ["doc_id"], ["page_index"], "_n")
        .groupBy("doc_id", (F.col("page_index") - F.col("_n")).alias("_island"))
        .agg(F.min("page_index").alias("a"), F.max("page_index").alias("b"))
    )
    one = lambda r: F.when(r["a"] == r["b"], (r["a"] + 1).cast("string")).otherwise(
        F.concat_ws("-", (r["a"] + 1).cast("string"), (r["b"] + 1).cast("string"))
    )
    written = islands.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "b"))), one), ", ").alias("w")
    )
    return docs.select("doc_id").join(written, "doc_id", "left").select(
        "doc_id", F.coalesce("w", F.lit("none")).alias("ranges")
    )


def rotate_pages(manifest: DataFrame, requests: DataFrame) -> Outcome:
    """Add a quarter turn to selected pages. ``requests``: out_doc, page_index, turn."""
    verdicts = (
        requests.join(totals(manifest), "out_doc", "left")
        .groupBy("out_doc")
        .agg(
            F.when(F.bool_or(F.col("turn") % 90 != 0), "not-a-quarter-turn")
            .when(F.count_distinct("page_index", "turn") > F.count_distinct("page_index"), "conflicting-turns")
            .when(~F.bool_or(_in_range()), "no-pages-selected")
            .alias("reason")
        )
    )
    pages, rejected = _settle(manifest, verdicts)
    turns = requests.select(
        "out_doc", F.col("page_index").alias("position"), F.col("turn").alias("_turn")
    ).distinct()
    turned = pages.join(turns, ["out_doc", "position"], "left").withColumn(
        "rotation",
        F.when(
            F.col("_turn").isNotNull(), fold_rotation(fold_rotation(F.col("rotation")) + F.col("_turn"))
        ).otherwise(F.col("rotation")),
    )
    return Outcome(turned.select(*manifest.columns), rejected)


def delete_pages(manifest: DataFrame, selection: DataFrame) -> Outcome:
    """Drop selected pages and close the gaps; nobody may drop them all."""
    chosen = _chosen(manifest, selection)
    hit = F.count(F.when(_in_range(), 1))
    verdicts = chosen.groupBy("out_doc").agg(
        F.when(hit == 0, "no-pages-selected")
        .when(hit >= F.max("n_pages"), "would-delete-everything")
        .alias("reason")
    )
    pages, rejected = _settle(manifest, verdicts)
    doomed = selection.select("out_doc", F.col("page_index").alias("position"))
    left = pages.join(doomed, ["out_doc", "position"], "left_anti")
    placed = renumber(left, ["out_doc"], ["position"], "_at")
    return Outcome(_placed(placed, manifest), rejected)


def _placed(numbered: DataFrame, like: DataFrame) -> DataFrame:
    """Take ``_at`` as the position; columns as in ``like``."""
    kind = dict(like.dtypes)["position"]
    return numbered.withColumn("position", F.col("_at").cast(kind)).select(*like.columns)


def reorder_pages(manifest: DataFrame, order: DataFrame) -> Outcome:
    """Shuffle whole documents. ``order``: out_doc, position (new), old."""
    verdicts = (
        order.join(totals(manifest), "out_doc", "left")
        .groupBy("out_doc")
        .agg(
            F.when(F.count("*") != F.coalesce(F.max("n_pages"), F.lit(0)), "wrong-length")
            .when(F.bool_or(~_in_range("old")), "no-such-page")
            .when(F.countDistinct("old") < F.count("*"), "page-used-twice")
            .alias("reason")
        )
    )
    pages, rejected = _settle(manifest, verdicts)
    moved = pages.withColumnRenamed("position", "old").join(
        order.select("out_doc", "old", F.col("position").alias("_at")), ["out_doc", "old"]
    )
    return Outcome(_placed(moved, manifest), rejected)


def move_page(manifest: DataFrame, moves: DataFrame) -> Outcome:
    """Move one page; ``dst`` counts after it is lifted out. ``moves``: out_doc, src, dst."""
    moves = _single(moves, "src", "dst")
    verdicts = moves.join(totals(manifest), "out_doc", "left").select(
        "out_doc",
        F.when(F.col("_asked") > 1, DOUBLED)
        .when(~_in_range("src"), "no-such-page")
        .when(~_in_range("dst"), "no-such-place")
        .alias("reason"),
    )
    pages, rejected = _settle(manifest, verdicts)
    p, a, b = F.col("position"), F.col("src"), F.col("dst")
    at = (
        F.when(p == a, b)
        .when((a < p) & (p <= b), p - 1)
        .when((b <= p) & (p < a), p + 1)
        .otherwise(p)
    )
    moved = pages.join(moves.select("out_doc", "src", "dst"), "out_doc").withColumn("_at", at)
    return Outcome(_placed(moved, manifest), rejected)


def duplicate_pages(manifest: DataFrame, selection: DataFrame) -> Outcome:
    """A copy right after each selected page."""
    hit = F.count(F.when(_in_range(), 1))
    verdicts = _chosen(manifest, selection).groupBy("out_doc").agg(
        F.when(hit == 0, "no-pages-selected")
        .when(hit + F.max("n_pages") > MAX_PAGES, "too-many-pages")
        .alias("reason")
    )
    pages, rejected = _settle(manifest, verdicts)
    twice = selection.select(
        "out_doc", F.col("page_index").alias("position"), F.lit(1).alias("_more")
    ).distinct()
    copies = pages.join(twice, ["out_doc", "position"], "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_more", F.lit(0))))
    )
    return Outcome(_placed(renumber(copies, ["out_doc"], ["position", "_copy"], "_at"), manifest), rejected)


def extract_pages(manifest: DataFrame, picks: DataFrame) -> Outcome:
    """Pages in the order asked for, repeats kept. ``picks``: out_doc, ord, page_index."""
    known = picks.join(totals(manifest), "out_doc", "left")
    hit = F.count(F.when(_in_range(), 1))
    verdicts = known.groupBy("out_doc").agg(
        F.when(hit == 0, "no-pages-selected").when(hit > MAX_PAGES, "too-many-pages").alias("reason")
    )
    pages, rejected = _settle(manifest, verdicts)
    usable = renumber(known.where(_in_range()), ["out_doc"], ["ord"], "_at").select(
        "out_doc", "_at", F.col("page_index").alias("position")
    )
    return Outcome(_placed(pages.join(usable, ["out_doc", "position"]), manifest), rejected)


def insert_blank(manifest: DataFrame, requests: DataFrame) -> Outcome:
    """One empty page per request. ``requests``: out_doc, at, new_width, new_height.

    Without a size it takes every page property of the page it pushes down (the
    last page at the end); an explicit size is upright.
    """
    finite = lambda c: ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < F.lit(float("inf")))
    sized = F.col("new_width").isNotNull() | F.col("new_height").isNotNull()
    whole = F.coalesce(finite("new_width") & finite("new_height"), F.lit(False))
    known = _single(requests, "at", "new_width", "new_height").join(totals(manifest), "out_doc", "left")
    fits = F.coalesce((F.col("at") >= 0) & (F.col("at") <= F.col("n_pages")), F.lit(False))
    verdicts = known.select(
        "out_doc",
        F.when(F.col("_asked") > 1, DOUBLED)
        .when(~fits, "no-such-place")
        .when(F.col("n_pages") + 1 > MAX_PAGES, "too-many-pages")
        .when(sized & ~whole, "bad-size")
        .alias("reason"),
    )
    pages, rejected = _settle(manifest, verdicts)
    asked = known.select("out_doc", "at", "new_width", "new_height", "n_pages")
    shifted = pages.join(asked.select("out_doc", "at"), "out_doc").withColumn(
        "_at", F.col("position") + F.when(F.col("position") >= F.col("at"), 1).otherwise(0)
    )
    beside = asked.withColumn("position", F.least("at", F.col("n_pages") - 1))
    blank = pages.join(beside, ["out_doc", "position"]).withColumns(
        {
            "_at": F.col("at"),
            "src_doc": F.lit(None).cast(dict(manifest.dtypes)["src_doc"]),
            "src_page": F.lit(None).cast(dict(manifest.dtypes)["src_page"]),
            "rotation": F.when(sized, 0).otherwise(F.col("rotation")),
            "width": F.coalesce("new_width", "width"),
            "height": F.coalesce("new_height", "height"),
        }
    )
    return Outcome(_placed(shifted, manifest).unionByName(_placed(blank, manifest)), rejected)


def reverse_pages(manifest: DataFrame) -> DataFrame:
    """Last page first."""
    turned = manifest.join(totals(manifest), "out_doc").withColumn(
        "_at", F.col("n_pages") - 1 - F.col("position")
    )
    return _placed(turned, manifest)


def _merge_plan(inputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Inputs with their page counts, wanted pages and reason, if refused."""
    counts = totals(sources).withColumnRenamed("out_doc", "src_doc")
    wanted = F.sort_array(F.array_distinct("pages"))
    bad = F.size(F.filter("pages", lambda p: p.isNull() | (p < 0) | (p >= F.col("n_pages"))))
    return (
        inputs.join(counts, "src_doc", "left")
        .withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
        .withColumn(
            "_fault",
            F.when(F.col("n_pages") == 0, F.concat(F.lit("no-pages: "), "name"))
            .when(F.size("pages") == 0, F.concat(F.lit("nothing-picked: "), "name"))
            .when(bad > 0, F.concat(F.lit("no-such-page: "), "name")),
        )
        .withColumn("wanted", wanted)
        .withColumn(
            "n_taken", F.when(F.col("pages").isNull(), F.col("n_pages")).otherwise(F.size("wanted"))
        )
    )


def merge_docs(inputs: DataFrame, sources: DataFrame) -> Outcome:
    """Concatenate documents. ``inputs``: out_doc, input_ord, src_doc, name, pages.

    ``pages`` null takes everything; otherwise the picked pages in document
    order. One bad input refuses the whole merge, by name. Positions come from
    per-input offsets, so pages are never sorted.
    """
    plan = _merge_plan(inputs, sources)
    verdicts = plan.groupBy("out_doc").agg(
        F.when(F.count("*") < 2, "needs-two-inputs")
        .when(F.max("_fault").isNotNull(), F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("input_ord"))))
        .when(F.sum("n_taken") > MAX_PAGES, "too-many-pages")
        .alias("reason")
    )
    accepted, rejected = _settle(plan, verdicts)
    placed = running_total(accepted, ["out_doc"], ["input_ord"], F.col("n_taken").cast("long"), "_offset")
    source_key = sources.select(F.col("out_doc").alias("_src"), F.col("position").alias("_page"), *[c for c in sources.columns if c not in ("out_doc", "position")])
    everything = placed.where("pages IS NULL").select(
        "out_doc", F.col("src_doc").alias("_src"), "_offset"
    ).join(source_key, "_src").withColumn("_at", F.col("_offset") + F.col("_page"))
    picked = placed.where("pages IS NOT NULL").select(
        "out_doc", F.col("src_doc").alias("_src"), "_offset", F.posexplode("wanted").alias("_i", "_page")
    ).join(source_key, ["_src", "_page"]).withColumn("_at", F.col("_offset") + F.col("_i"))
    columns = sources.columns
    merged = _placed(everything.withColumn("position", F.col("_page")), sources).unionByName(
        _placed(picked.withColumn("position", F.col("_page")), sources)
    )
    return Outcome(merged.select(*columns), rejected)


def merge_sources(inputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages each input contributes."""
    return _merge_plan(inputs, sources).select("out_doc", "input_ord", "name", "n_taken")


def split_at(manifest: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cut after the given pages; repeats and useless cuts are forgiven.

    Adds ``part`` and ``n_parts``; positions start again in every part.
    """
    usable = (
        cuts.select("out_doc", "cut")
        .distinct()
        .join(totals(manifest), "out_doc")
        .where("cut >= 0 AND cut < n_pages - 1")
        .select("out_doc", F.col("cut").alias("position"), F.lit(1).alias("_cut"))
    )
    marked = manifest.join(usable, ["out_doc", "position"], "left")
    numbered = running_total(
        marked, ["out_doc"], ["position"], F.coalesce("_cut", F.lit(0)), "part"
    )
    starts = numbered.groupBy("out_doc", "part").agg(F.min("position").alias("_from"))
    counts = usable.groupBy("out_doc").agg((F.count("*") + 1).alias("n_parts"))
    shifted = (
        numbered.join(starts, ["out_doc", "part"])
        .join(counts, "out_doc", "left")
        .withColumn("position", F.col("position") - F.col("_from"))
    )
    return shifted.select(
        *manifest.columns,
        F.col("part").cast("int").alias("part"),
        F.coalesce("n_parts", F.lit(1)).cast("int").alias("n_parts"),
    )


def split_every(manifest: DataFrame, sizes: DataFrame) -> Outcome:
    """Runs of ``n`` pages. ``sizes``: out_doc, n."""
    sizes = _single(sizes, "n")
    verdicts = sizes.select(
        "out_doc",
        F.when(F.col("_asked") > 1, DOUBLED)
        .when(~F.coalesce(F.col("n") >= 1, F.lit(False)), "bad-size")
        .alias("reason"),
    )
    pages, rejected = _settle(manifest, verdicts)
    cut = (
        pages.join(sizes.select("out_doc", "n"), "out_doc")
        .join(totals(manifest), "out_doc")
        .select(
            *[c for c in manifest.columns if c != "position"],
            (F.col("position") % F.col("n")).cast("int").alias("position"),
            F.floor(F.col("position") / F.col("n")).cast("int").alias("part"),
            F.ceil(F.col("n_pages") / F.col("n")).cast("int").alias("n_parts"),
        )
    )
    return Outcome(cut, rejected)


def split_by_ranges(manifest: DataFrame, groups: DataFrame) -> Outcome:
    """Explicit, possibly overlapping parts. ``groups``: out_doc, part, pages."""
    known = groups.join(totals(manifest), "out_doc", "left")
    missing = F.size(
        F.filter("pages", lambda p: (p < 0) | (p >= F.coalesce("n_pages", F.lit(0))) | p.isNull())
    )
    faulty = F.when(F.size("pages") == 0, F.struct("part", F.lit("empty-part").alias("r"))).when(
        missing > 0, F.struct("part", F.lit("missing-page").alias("r"))
    )
    verdicts = known.groupBy("out_doc").agg(F.min(faulty)["r"].alias("reason"), F.count("*").alias("n_parts"))
    fine = verdicts.where("reason IS NULL").select("out_doc", "n_parts")
    rows = groups.join(fine, "out_doc").select(
        "out_doc", "part", "n_parts",
        F.posexplode(F.sort_array(F.array_distinct("pages"))).alias("_at", "position"),
    )
    parts = manifest.join(rows, ["out_doc", "position"]).withColumn("position", F.col("_at").cast("int"))
    return Outcome(
        parts.select(*manifest.columns, F.col("part").cast("int").alias("part"), F.col("n_parts").cast("int").alias("n_parts")),
        verdicts.where("reason IS NOT NULL").select("out_doc", "reason"),
    )


def range_groups(specs: DataFrame) -> DataFrame:
    """Typed ranges as parts: every comma piece its own, pieces without pages dropped.

    ``specs``: doc_id, spec, n_pages. Gives out_doc, part, pages.
    """
    pieces = specs.select(
        "doc_id", "n_pages", F.posexplode(F.split("spec", "[,;]", -1)).alias("_i", "spec")
    )
    parsed = parse_ranges(pieces).groupBy("doc_id", "_i").agg(
        F.sort_array(F.collect_list(F.col("page_index").cast("int"))).alias("pages")
    )
    order = Window.partitionBy("doc_id").orderBy("_i")
    return parsed.select(
        F.col("doc_id").alias("out_doc"), (F.row_number().over(order) - 1).alias("part"), "pages"
    )


def safe_name(name: Column) -> Column:
    """A file name every platform takes."""
    clean = F.left(F.regexp_replace(name, r'[\\/:*?"<>|]+', "-"), F.lit(120))
    return F.when(clean == "", "document").otherwise(clean)


def part_names(parts: DataFrame) -> DataFrame:
    """File names of split parts, numbers padded so that they sort.

    ``parts``: out_doc, base, part, n_parts.
    """
    stem = safe_name(F.regexp_replace("base", r"(?i)\.pdf\z", ""))
    tidy = F.left(
        F.regexp_replace(F.regexp_replace(stem, r"(?U)[\s-]+", "-"), r"\A-+|-+\z", ""), F.lit(100)
    )
    number = F.lpad((F.col("part") + 1).cast("string"), F.length(F.col("n_parts").cast("string")), F.lit("0"))
    return parts.withColumn(
        "file_name",
        F.concat(F.when(tidy == "", "document").otherwise(tidy), F.lit("-"), number, F.lit(".pdf")),
    )


def carry_metadata_split(parts: DataFrame, meta: DataFrame, now: Column) -> DataFrame:
    """Details of each part: the source's, and a title that names the part.

    ``parts``: out_doc, base, part, n_parts. ``meta``: out_doc, title, author,
    subject, keywords, creator, created.
    """
    return parts.join(meta, "out_doc", "left").select(
        "out_doc",
        "part",
        F.concat(
            F.coalesce("title", "base"), F.lit(" (part "), (F.col("part") + 1).cast("string"),
            F.lit(" of "), F.col("n_parts").cast("string"), F.lit(")"),
        ).alias("title"),
        F.nullif("author", F.lit("")).alias("author"),
        F.nullif("subject", F.lit("")).alias("subject"),
        F.nullif("keywords", F.lit("")).alias("keywords"),
        F.coalesce(F.nullif("creator", F.lit("")), F.lit(PRODUCER)).alias("creator"),
        F.lit(PRODUCER).alias("producer"),
        "created",
        now.alias("modified"),
    )


def carry_metadata_merge(inputs: DataFrame, meta: DataFrame, now: Column) -> DataFrame:
    """A merged document takes the details of its first input."""
    first = inputs.groupBy("out_doc").agg(F.min_by("src_doc", "input_ord").alias("_src"))
    own = meta.withColumnRenamed("out_doc", "_src")
    keep = lambda c: F.nullif(c, F.lit("")).alias(c)
    return first.join(own, "_src", "left").select(
        "out_doc", keep("title"), keep("author"), keep("subject"), keep("keywords"),
        F.coalesce(F.nullif("creator", F.lit("")), F.lit(PRODUCER)).alias("creator"),
        F.lit(PRODUCER).alias("producer"), "created", now.alias("modified"),
    )


def carry_metadata_edit(meta: DataFrame, now: Column) -> DataFrame:
    """A page edit keeps everything and is modified now."""
    return meta.withColumn("modified", now)


def unique_names(names: DataFrame) -> DataFrame:
    """Names made unique per archive in order. ``names``: archive, seq, name.

    A clash gets ``-2``, ``-3``... before the extension, skipping taken names.
    """
    split = r"(?s)\A(.+)(\.[^.]*)\z"
    stem = lambda c: F.when(F.regexp_like(c, F.lit(split)), F.regexp_extract(c, split, 1)).otherwise(c)
    ext = lambda c: F.regexp_extract(c, split, 2)
    own = F.col("name")
    numbers = rf"((?:-{NUMBER})+)\z"
    # A stem before an extension is never empty, so '-2.png' is no form of '.png'.
    tail = F.when(ext(own) == "", F.regexp_extract(own, numbers, 1)).otherwise(
        F.regexp_extract(stem(own), rf"(?s)(?<=.){numbers}", 1)
    )
    root = F.concat(F.left(stem(own), F.length(stem(own)) - F.length(tail)), ext(own))
    return settle_names(
        names.select("archive", "seq", "name"),
        ["archive"],
        ["seq"],
        "name",
        "unique_name",
        root,
        number_path(tail),
        lambda name, n: F.concat(stem(name), F.lit("-"), n, ext(name)),
    ).drop("name")


def relink(links: DataFrame, manifest: DataFrame) -> DataFrame:
    """Follow links into the new document: new position, or null when the page is gone.

    ``links``: out_doc, link, src_doc, target. Pages kept twice: the first wins.
    """
    where = manifest.groupBy("out_doc", "src_doc", F.col("src_page").alias("target")).agg(
        F.min("position").alias("new_target")
    )
    return links.join(where, ["out_doc", "src_doc", "target"], "left").select(
        *links.columns, "new_target"
    )


def page_ceiling(manifest: DataFrame, limit: int = MAX_PAGES) -> DataFrame:
    """Documents longer than can be worked on at once."""
    return totals(manifest).where(F.col("n_pages") > limit)


def plan_image_pages(images: DataFrame, requests: DataFrame) -> Outcome:
    """One page per image, in input order.

    ``images``: out_doc, seq, width, height, turn, n_bytes. ``requests``:
    out_doc, page_size (auto, a4, letter), margin.
    """
    weighed = images.groupBy("out_doc").agg(
        F.count("*").alias("_n"), F.sum("n_bytes").alias("_bytes")
    )
    frame = lambda i: F.when(F.col("page_size") == "a4", PAGE_SIZES["a4"][i]).when(
        F.col("page_size") == "letter", PAGE_SIZES["letter"][i]
    )
    bad_margin = F.isnan("margin") | (F.col("margin") < 0) | (F.col("margin") == F.lit(float("inf")))
    verdicts = requests.join(weighed, "out_doc", "left").select(
        "out_doc",
        F.when(F.col("_n").isNull(), "no-images")
        .when(F.col("_n") > MAX_PAGES, "too-many-images")
        .when(F.col("_bytes") > MAX_BYTES, "too-large")
        .when(bad_margin, "bad-margin")
        .when((F.col("margin") * 2 >= frame(0)) | (F.col("margin") * 2 >= frame(1)), "no-room")
        .alias("reason"),
    )
    kept, rejected = _settle(images, verdicts)
    placed = renumber(kept, ["out_doc"], ["seq"], "position").join(requests, "out_doc")
    quarter = F.col("turn").isin(90, 270)
    w = F.when(quarter, F.col("height")).otherwise(F.col("width")).cast("double")
    h = F.when(quarter, F.col("width")).otherwise(F.col("height")).cast("double")
    room = lambda i: frame(i) - F.col("margin") * 2
    scale = F.when((w <= 0) | (h <= 0), 0.0).otherwise(F.least(room(0) / w, room(1) / h))
    free = F.col("page_size") == "auto"
    fit = lambda side: F.when(free, side).otherwise(side * scale)
    centred = lambda i, side: F.when(free, 0.0).otherwise((frame(i) - side * scale) / 2)
    return Outcome(
        placed.select(
            "out_doc",
            "position",
            F.when(free, w).otherwise(frame(0)).alias("page_width"),
            F.when(free, h).otherwise(frame(1)).alias("page_height"),
            centred(0, w).alias("x"),
            centred(1, h).alias("y"),
            fit(w).alias("width"),
            fit(h).alias("height"),
        ),
        rejected,
    )
