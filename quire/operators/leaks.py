"""Leak check and redaction planning."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.grams import anchor_keys, anchor_size, filter_of, keys_within
from quire.functions.running import running_total
from quire.functions.text import normalize_for_search
from quire.sources.scratch import scratch_folder

DEFAULT_DPI = 200
DPI_LOW, DPI_HIGH = 72, 400
MAX_CANVAS_SIDE = 16384
BYTES_PER_PIXEL = 0.12
SLOW_PAGES = 120
MATCH_TOLERANCE = 1.5
SEAM = "\u0000"
# Shortest segment of a document that phrases across pages are looked for in.
SEGMENT = 4096
# 64-bit words of the filter of anchors that every page's runs of bytes pass: about one for each
# anchor, between these bounds. The upper one is the size of what every task gets, 16 MB.
LEAST_WORDS, FILTER_WORDS = 1 << 14, 1 << 21
# 64-bit words of the filter of documents with several pages, 1 MB, and the most of that of pages
# that a long list found something on, 8 MB.
SEVERAL_WORDS, NEAR_WORDS = 1 << 17, 1 << 20
# Bytes of needles that may go to every task, so that a page need not be moved to be compared.
SHORT_LIST = 4 << 20


def _needles(phrases: DataFrame) -> DataFrame:
    """Phrases in the form that is searched for.

    Containment survives taking the dashes out of both sides, so the dashless
    form decides, except for a phrase made of dashes alone.
    """
    plain = normalize_for_search(F.col("phrase"))
    folded = phrases.withColumn("_plain", plain).withColumn(
        "_bare", F.replace("_plain", F.lit("-"), F.lit(""))
    )
    return (
        folded.where("_plain <> ''")
        .withColumn("view", F.when(F.col("_bare") != "", "bare").otherwise("dash"))
        .withColumn("needle", F.when(F.col("_bare") != "", F.col("_bare")).otherwise(F.col("_plain")))
        .drop("_plain", "_bare")
    )


def _views(texts: DataFrame) -> DataFrame:
    """Normalised page text, once without dashes and once for dash-only phrases."""
    plain = texts.select("doc_id", "page", normalize_for_search(F.col("text")).alias("_t"))
    both = F.array(
        F.struct(F.lit("bare").alias("view"), F.replace("_t", F.lit("-"), F.lit("")).alias("hay")),
        F.struct(
            F.lit("dash").alias("view"),
            F.when(F.contains("_t", F.lit("-")), F.col("_t")).otherwise("").alias("hay"),
        ),
    )
    return plain.select("doc_id", "page", F.inline(both))


def _seams(views: DataFrame, reach: Column) -> DataFrame:
    """Texts around page breaks, in bounded pieces, for phrases across pages.

    Only the ends of a page can take part in such a phrase, so a page longer
    than twice the longest needle is cut to its ends. The shortened pages of a
    document form one long string; it is dealt out in segments that overlap by
    the longest needle, so every crossing lies whole in one segment and no
    segment grows with the document.
    """
    sized = views.withColumn("_r", reach)
    middle = F.length("hay") > 2 * F.col("_r") + 1
    short = sized.withColumn(
        "hay",
        F.when(
            middle,
            F.concat(F.expr("left(hay, _r)"), F.lit(SEAM), F.expr("right(hay, _r)")),
        ).otherwise(F.col("hay")),
    )
    placed = running_total(
        short, ["doc_id", "view"], ["page"], F.length("hay").cast("long"), "at"
    ).where("hay <> ''")
    # As long as the longest needle at least, so a character is in three segments at most.
    length = F.greatest(F.lit(SEGMENT), F.col("_r"))
    low = F.greatest(F.lit(0), F.floor((F.col("at") - length - F.col("_r")) / length) + 1)
    high = F.floor((F.col("at") + F.length("hay") - 1) / length)

    def piece(seg: Column) -> Column:
        begin = F.greatest(seg * length, F.col("at"))
        stop = F.least(seg * length + length + F.col("_r"), F.col("at") + F.length("hay"))
        return F.struct(
            seg.alias("seg"),
            F.substring(
                F.col("hay"),
                (begin - F.col("at") + 1).cast("int"),
                (stop - begin).cast("int"),
            ).alias("piece"),
        )

    dealt = placed.select(
        "doc_id", "view", "page", F.inline(F.transform(F.sequence(low, high), piece))
    )
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("page", "piece"))), lambda p: p["piece"]), ""
    )
    return (
        dealt.groupBy("doc_id", "view", "seg")
        .agg(F.count("*").alias("n"), joined.alias("hay"))
        .where("n > 1")
        .select("doc_id", F.concat(F.lit("s"), F.col("seg").cast("string")).alias("part"), "view", "hay")
    )


def _haystacks(texts: DataFrame, wanted: Column, reach: Column) -> DataFrame:
    """Everything a needle may be found in: the pages, and the seams between them.

    Documents of one page have no seams, so only the others take that way.
    """

    def views(rows: DataFrame) -> DataFrame:
        return _views(rows).where(F.array_contains(wanted, F.col("view")))

    whole = views(texts).select(
        "doc_id", F.concat(F.lit("p"), F.col("page").cast("string")).alias("part"), "view", "hay"
    ).where("hay <> '' AND doc_id IS NOT NULL AND part IS NOT NULL")
    several = texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    # Few pages of other documents pass the filter, so their text is not moved to be left out.
    broken = texts.where(_may_be_in(several, ["doc_id"], SEVERAL_WORDS)).join(several.select("doc_id"), "doc_id", "left_semi")
    return whole.unionByName(_seams(views(broken), reach))


def _slot(columns: list[str], n_words: int) -> tuple[Column, Column]:
    """Word of a filter and bit in it."""
    h = F.xxhash64(*columns)
    return F.pmod(h, F.lit(n_words)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")


def _filter_of(rows: DataFrame, columns: list[str], n_words: int) -> Column:
    """The values of some columns as one array of words with a bit set for each."""
    word, bit = _slot(columns, n_words)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = rows.groupBy(word.alias("id")).agg(F.bit_or(one).alias("bits"))
    every = rows.sparkSession.range(0, n_words, 1, 1).join(words, "id", "left")
    listed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return every.groupBy().agg(F.transform(listed, lambda w: w["bits"])).scalar()


def _may_be_in(rows: DataFrame, columns: list[str], n_words: int) -> Column:
    """False only for rows whose ``columns`` no row of ``rows`` has."""
    word, bit = _slot(columns, n_words)
    return F.getbit(F.get(_filter_of(rows, columns, n_words), word.cast("int")), bit) == 1


def _found(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Documents and the needles in them: (doc_id, view, needle).

    An equi-join on the needle's anchor (and on the document, where needles
    belong to one) proposes pairs; only those are compared in full, so nothing
    is compared that does not share an anchor. A page's runs of bytes pass a
    filter of all anchors first, so few of them are joined. A list of some MB
    goes to the pages; of a longer one only the anchors meet the pages' runs,
    and the text follows where something was proposed: the list and what it
    proposes are stored, and a filter of the latter keeps all other pages where
    they are. For that the list is counted, and its filter made, when the plan is.
    """
    own = [c for c in ("doc_id", "view") if c in needles.columns]
    if "doc_id" in own:
        # Equal documents of other types would have other hashes.
        kind = texts.select("doc_id").unionByName(needles.select("doc_id")).schema["doc_id"].dataType
        texts, needles = (t.withColumn("doc_id", F.col("doc_id").cast(kind)) for t in (texts, needles))
    salt = F.xxhash64(*own)
    anchored = needles.distinct().withColumn("keys", anchor_keys("needle", salt)).withColumn("key", F.element_at("keys", -1))
    facts = anchored.agg(
        F.collect_set("view").alias("views"),
        F.coalesce(F.max(F.length("needle")), F.lit(1)).alias("reach"),
        F.collect_set(anchor_size("needle")).alias("sizes"),
        F.count("*").alias("n"),
        F.sum(F.octet_length("needle") + 64).alias("bytes"),
    ).first()
    n_words = 1
    while n_words < min(FILTER_WORDS, max(LEAST_WORDS, facts["n"])):
        n_words *= 2
    long, at = (facts["bytes"] or 0) > SHORT_LIST, None
    if long:
        at = scratch_folder(texts.sparkSession)
        anchored.write.parquet(f"{at}/anchored")
        anchored = texts.sparkSession.read.schema(anchored.schema).parquet(f"{at}/anchored")
    words = texts.sparkSession.sparkContext.broadcast(filter_of(anchored, n_words))
    anchored = anchored.drop("keys")
    stacks = _haystacks(texts, F.array(*[F.lit(v) for v in facts["views"]]).cast("array<string>"), F.lit(facts["reach"]))
    keys = F.explode(keys_within("hay", salt, words, facts["sizes"])).alias("key")

    if not long:
        proposed = stacks.select("doc_id", "view", "hay", keys).join(F.broadcast(anchored), [*own, "key"])
    else:
        page = ["doc_id", "part", "view"]
        near = stacks.select(*page, keys).join(anchored.select(*own, "key").distinct(), [*own, "key"], "left_semi").select(*page, "key")
        near.write.parquet(f"{at}/near")
        near = texts.sparkSession.read.schema(near.schema).parquet(f"{at}/near")
        n_words = 1
        while n_words < min(NEAR_WORDS, near.count() // 4):
            n_words *= 2
        moved = stacks.where(_may_be_in(near, ["doc_id", "part"], n_words))
        proposed = moved.join(near.join(anchored, [*own, "key"]).drop("key"), page)
    return proposed.where(F.contains("hay", F.col("needle"))).select("doc_id", "view", "needle").distinct()


def phrase_hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Documents and the phrases readable in them, one row per pair.

    ``texts``: doc_id, page, text. ``phrases``: phrase_id, phrase.
    """
    needles = _needles(phrases.select("phrase_id", "phrase"))
    return (
        _found(texts, needles.select("view", "needle"))
        .join(needles.select("phrase_id", "view", "needle"), ["view", "needle"])
        .select("doc_id", "phrase_id")
    )


def requested_hits(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """The same test for phrases asked about one document each.

    ``requests``: doc_id, ord, phrase.
    """
    needles = _needles(requests.select("doc_id", "ord", "phrase"))
    asked = texts.join(requests.select("doc_id").distinct(), "doc_id", "left_semi")
    return (
        _found(asked, needles.select("doc_id", "view", "needle"))
        .join(needles, ["doc_id", "view", "needle"])
        .select("doc_id", "ord", "phrase")
    )


def phrases_missing_from_source(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested phrases the document never contained."""
    return requests.join(
        requested_hits(pages, requests).select("doc_id", "ord"), ["doc_id", "ord"], "left_anti"
    ).select("doc_id", "ord", "phrase")


def leak_verdict(before: DataFrame, after: DataFrame, requests: DataFrame) -> DataFrame:
    """Per document: phrases still found (as asked, once each) and whether it is clean.

    ``after`` is everything readable in the result: page text, annotations and
    metadata as rows of ``doc_id, page, text``. A document of which nothing was
    asked is not clean. Both texts are searched in one go.
    """
    side = lambda df, name: df.withColumn("doc_id", F.struct(F.lit(name).alias("side"), "doc_id"))
    texts = side(before.select("doc_id", "page", "text"), "before").unionByName(
        side(after.select("doc_id", "page", "text"), "after")
    )
    asked = requests.select(
        F.explode(F.transform(F.array(F.lit("before"), F.lit("after")), lambda s: F.struct(s.alias("side"), "doc_id"))).alias("doc_id"),
        "ord",
        "phrase",
    )
    hits = requested_hits(texts, asked).select("doc_id.doc_id", "ord", "phrase", F.col("doc_id.side").alias("side"))
    no = F.lit(False)
    per_phrase = (
        hits.unionByName(requests.select("doc_id", "ord", "phrase", F.lit("asked").alias("side")))
        .groupBy("doc_id", "phrase")
        .agg(
            F.min("ord").alias("ord"),
            F.coalesce(F.bool_or(F.col("side") == "after"), no).alias("found"),
            F.coalesce(F.bool_or(F.col("side") == "before"), no).alias("known"),
        )
    )
    listed = F.sort_array(F.collect_list(F.when(F.col("found"), F.struct("ord", "phrase"))))
    per_doc = per_phrase.groupBy("doc_id").agg(
        F.transform(listed, lambda p: p["phrase"]).alias("found"),
        F.sum(F.when(~F.col("known"), 1).otherwise(0)).alias("n_missing"),
        (F.bool_and(F.col("known")) & ~F.bool_or(F.col("found"))).alias("clean"),
    )
    every = before.select("doc_id").unionByName(requests.select("doc_id")).distinct()
    return every.join(per_doc, "doc_id", "left").select(
        "doc_id",
        F.coalesce("found", F.array().cast("array<string>")).alias("found"),
        F.coalesce("n_missing", F.lit(0).cast("long")).alias("n_missing"),
        F.coalesce("clean", no).alias("clean"),
    )


def annotation_text(annots: DataFrame) -> DataFrame:
    """Readable strings of each annotation in reading order, empties skipped.

    ``annots``: doc_id, page, seq, field_value array, default_value array,
    button, name, alt, url, unsafe_url, contents, title, rich, options array of
    struct(export, display).
    """
    one = lambda c: F.array(F.col(c))
    labels = F.flatten(F.transform("options", lambda o: F.array(o["export"], o["display"])))
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.coalesce("field_value", none),
        F.coalesce("default_value", none),
        *[one(c) for c in ("button", "name", "alt", "url", "unsafe_url", "contents", "title", "rich")],
        F.coalesce(labels, none),
    )
    kept = F.filter(parts, lambda p: F.length(p) > 0)
    return annots.select("doc_id", "page", "seq", F.array_join(kept, "\n").alias("text"))


def metadata_text(meta: DataFrame) -> DataFrame:
    """String entries of the Info dictionary and the raw XMP packet.

    ``meta``: doc_id, info map<string, struct<kind, value>>, xmp.
    """
    strings = F.transform(
        F.filter(F.map_values("info"), lambda v: v["kind"] == "string"), lambda v: v["value"]
    )
    packet = F.when(F.col("xmp").isNotNull(), F.array("xmp")).otherwise(
        F.array().cast("array<string>")
    )
    return meta.select("doc_id", F.array_join(F.concat(strings, packet), "\n").alias("text"))


def residual_text(affected: DataFrame, pages: DataFrame) -> DataFrame:
    """Redrawn pages read back: clean, survived, or unknown when not readable."""
    read = pages.select("doc_id", "page", F.col("text").alias("_t"))
    return affected.join(read, ["doc_id", "page"], "left").select(
        *affected.columns,
        F.when(F.col("_t").isNull(), "unknown")
        .when(F.regexp_like("_t", F.lit(r"[\p{L}\p{N}]")), "survived")
        .otherwise("clean")
        .alias("check"),
    )


def _finite(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf")))
    return ok


def _box_faults(boxes: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document that has boxes, with the first reason to refuse them."""
    known = boxes.join(docs.select("doc_id", "n_pages"), "doc_id", "left")
    in_range = (F.col("page_index") >= 0) & (F.col("page_index") < F.col("n_pages"))
    sized = (F.abs("width") > 0) & (F.abs("height") > 0)
    return known.groupBy("doc_id").agg(
        F.when(F.bool_or(~F.coalesce(in_range, F.lit(False))), "page-out-of-range")
        .when(F.bool_or(~_finite("x", "y", "width", "height")), "not-a-number")
        .when(~F.bool_or(sized), "nothing-marked")
        .alias("reason")
    )


def validate_boxes(boxes: DataFrame, docs: DataFrame) -> DataFrame:
    """Usable boxes with positive sides; documents with a bad mark contribute none."""
    good = _box_faults(boxes, docs).where("reason IS NULL").select("doc_id")
    return boxes.join(good, "doc_id", "left_semi").where("width <> 0 AND height <> 0").select(
        "doc_id",
        "page_index",
        F.when(F.col("width") < 0, F.col("x") + F.col("width")).otherwise(F.col("x")).alias("x"),
        F.when(F.col("height") < 0, F.col("y") + F.col("height")).otherwise(F.col("y")).alias("y"),
        F.abs("width").alias("width"),
        F.abs("height").alias("height"),
    )


def rejected_boxes(boxes: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose marks are refused as a whole, with the reason."""
    return _box_faults(boxes, docs).where("reason IS NOT NULL")


def clip_boxes(boxes: DataFrame, shapes: DataFrame) -> DataFrame:
    """The part of every box that lies on its page; boxes that miss it vanish."""
    on = boxes.join(shapes.select("doc_id", "page_index", "view_width", "view_height"), ["doc_id", "page_index"])
    left = F.greatest(F.lit(0.0), "x")
    top = F.greatest(F.lit(0.0), "y")
    right = F.least("view_width", F.col("x") + F.col("width"))
    bottom = F.least("view_height", F.col("y") + F.col("height"))
    return on.where((right > left) & (bottom > top)).select(
        "doc_id", "page_index", left.alias("x"), top.alias("y"),
        (right - left).alias("width"), (bottom - top).alias("height"),
    )


def plan_redaction(boxes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Marked pages with the number of rectangles that land; none means missed."""
    landed = clip_boxes(boxes, shapes).groupBy("doc_id", "page_index").agg(
        F.count("*").alias("n_rects")
    )
    n = F.coalesce("n_rects", F.lit(0))
    return (
        boxes.select("doc_id", "page_index")
        .distinct()
        .join(landed, ["doc_id", "page_index"], "left")
        .select(
            "doc_id", "page_index", n.alias("n_rects"),
            F.when(n > 0, "paint").otherwise("missed").alias("action"),
        )
    )


def clamp_dpi(dpi: Column) -> Column:
    ok = dpi.isNotNull() & ~F.isnan(dpi) & (F.abs(dpi) < F.lit(float("inf")))
    return F.when(ok, F.least(F.greatest(dpi, F.lit(float(DPI_LOW))), F.lit(float(DPI_HIGH)))).otherwise(
        float(DEFAULT_DPI)
    )


def pixel_rects(rects: DataFrame, shapes: DataFrame, dpi: Column) -> DataFrame:
    """Rectangles in canvas pixels, edges rounded outwards and kept on the canvas.

    A page whose canvas would pass the side limit is refused: its rows carry the
    reason and no pixels.
    """
    on = rects.join(shapes.select("doc_id", "page_index", "view_width", "view_height"), ["doc_id", "page_index"])
    scaled = on.withColumn("_s", clamp_dpi(dpi) / 72)
    side = lambda c: F.floor(F.col(c) * F.col("_s") + 0.5)
    canvas = lambda c: F.floor(F.col(c) * F.col("_s"))
    scaled = scaled.withColumn(
        "_bad", (side("view_width") > MAX_CANVAS_SIDE) | (side("view_height") > MAX_CANVAS_SIDE)
    )
    left = F.greatest(F.lit(0), F.floor(F.col("x") * F.col("_s")))
    top = F.greatest(F.lit(0), F.floor(F.col("y") * F.col("_s")))
    right = F.least(canvas("view_width"), F.ceil((F.col("x") + F.col("width")) * F.col("_s")))
    bottom = F.least(canvas("view_height"), F.ceil((F.col("y") + F.col("height")) * F.col("_s")))
    put = lambda c: F.when(~F.col("_bad"), c)
    return scaled.where(F.col("_bad") | ((right > left) & (bottom > top))).select(
        "doc_id", "page_index", put(left).alias("px"), put(top).alias("py"),
        put(right - left).alias("pw"), put(bottom - top).alias("ph"),
        F.when(F.col("_bad"), "canvas-too-large").alias("reason"),
    )


def redaction_cost(plan: DataFrame, docs: DataFrame, dpi: float = DEFAULT_DPI) -> DataFrame:
    """Pages redrawn and kept, rough size, and whether it will be slow."""
    hit = plan.where("action = 'paint'").groupBy("doc_id").agg(
        F.countDistinct("page_index").alias("n_hit")
    )
    n = F.coalesce("n_hit", F.lit(0))
    per_page = 8.5 * dpi * 11 * dpi
    return docs.join(hit, "doc_id", "left").select(
        "doc_id", n.alias("n_hit"),
        F.greatest(F.lit(0), F.col("n_pages") - n).alias("n_kept"),
        F.floor(n * per_page * BYTES_PER_PIXEL + 0.5).cast("long").alias("rough_bytes"),
        (n > SLOW_PAGES).alias("slow"),
    )


def redact_pages(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Text after redaction: painted pages keep none, other pages all of theirs."""
    hit = plan.where("action = 'paint'").select(
        "doc_id", (F.col("page_index") + 1).alias("page"), F.lit(True).alias("_hit")
    )
    return pages.join(hit, ["doc_id", "page"], "left").select(
        *[c for c in pages.columns if c != "text"],
        F.when(F.col("_hit"), "").otherwise(F.col("text")).alias("text"),
    )


def redact_annotations(annots: DataFrame, plan: DataFrame) -> DataFrame:
    """Annotations after redaction: gone from painted pages, nothing fillable left."""
    hit = plan.where("action = 'paint'").select(
        "doc_id", (F.col("page_index") + 1).alias("page")
    )
    kept = annots.join(hit, ["doc_id", "page"], "left_anti")
    return kept.withColumn("fillable", F.lit(False))


def excise_runs(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Take single runs out, or say why not.

    ``runs``: doc_id, page, seq, str, px, py (start of the baseline), placed.
    ``targets``: doc_id, page, target, tx, ty, text. Points meet through cells
    twice the tolerance wide, so only neighbours are compared. Runs and targets
    of a page are brought together once; everything after that stays there.
    """
    page = ["doc_id", "page"]
    cell = lambda c: F.floor(c / (2 * MATCH_TOLERANCE))
    squash = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    both = (
        runs.select(*page, F.lit(True).alias("_run"), "seq", "placed", F.col("str").alias("words"), F.col("px").alias("x"), F.col("py").alias("y"))
        .unionByName(
            targets.select(*page, F.lit(False).alias("_run"), "target", F.col("text").alias("words"), F.col("tx").alias("x"), F.col("ty").alias("y")),
            allowMissingColumns=True,
        )
        .repartition(*page)
    )
    following = Window.partitionBy(*page, "_run").orderBy("seq")
    linked = both.withColumn("leaning", ~F.coalesce(F.lead("placed").over(following), F.lit(True))).where(
        ~F.col("_run") | (F.col("placed") & F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    )
    spot = lambda cx, cy: F.struct(cx.alias("cx"), cy.alias("cy"))
    # A little more than the tolerance, for what rounding takes away.
    around = lambda c: F.sequence(cell(c - 1.001 * MATCH_TOLERANCE), cell(c + 1.001 * MATCH_TOLERANCE))
    own = F.array(spot(cell(F.col("x")), cell(F.col("y"))))
    near = F.flatten(F.transform(around(F.col("x")), lambda cx: F.transform(around(F.col("y")), lambda cy: spot(cx, cy))))
    dealt = linked.select("*", F.posexplode(F.when(F.col("_run"), own).otherwise(F.coalesce(near, own))).alias("piece", "spot"))
    in_cell, of_target = Window.partitionBy(*page, "spot"), Window.partitionBy(*page, "target")
    here = F.collect_list(F.when(F.col("_run"), F.struct("seq", "leaning", "words", "x", "y"))).over(in_cell)
    close = F.filter("here", lambda r: F.hypot(r["x"] - F.col("x"), r["y"] - F.col("y")) <= MATCH_TOLERANCE)
    # A hit is looked at only if it is the only one.
    found = (
        dealt.withColumn("here", here).where(~F.col("_run"))
        .withColumn("hits", F.when(F.col("target").isNotNull(), close))
        .select(*page, "target", F.col("words").alias("text"), "piece", F.coalesce(F.size("hits"), F.lit(0)).alias("n"), F.get("hits", F.lit(0)).alias("hit"))
        .withColumns({"n": F.sum("n").over(of_target), "hit": F.first("hit", ignorenulls=True).over(of_target)})
        .where("piece = 0").select(*page, "target", "text", "n", "hit.*")
    )
    reason = (
        F.when(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == "", "no-text")
        .when(F.col("n") == 0, "no-run-there")
        .when(F.col("n") > 1, "several-runs-there")
        .when(F.col("leaning"), "next-run-would-slide")
        .when(squash("words") != squash("text"), "says-something-else")
    )
    return found.select(*page, "target", F.when(reason.isNull(), F.col("seq")).alias("seq"), reason.alias("reason"))


# Rows of a batch that :func:`page_survived` has as strings at a time.
AT_ONCE = 256


def page_survived(before: Column, after: Column, removed: Column) -> Column:
    """The new page is the old one minus exactly one copy of the run.

    Both pages agree up to some place and from some place on; the copy that went lies where
    these overlap, whichever it was. So neither page is built again for every copy. With the run
    goes one blank, if both its sides had one or the page begins or ends with it. Pages are compared
    in Python, whose string operations took a small part of the time that column expressions did.
    """
    at_once = AT_ONCE

    # Nested, so that it is shipped whole and workers need no package install.
    def run(before: pa.Array, after: pa.Array, removed: pa.Array) -> pa.Array:
        import re

        import pyarrow as pa

        # What Java calls white space; Python's ``split`` also takes four control characters.
        blanks = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        more = re.compile("[\x1c-\x1f]")

        def flat(text):
            return blanks.sub(" ", text).strip(" ") if more.search(text) else " ".join(text.split())

        def shared(low, high, same):
            """How far two texts are the same, by halving the interval."""
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if same(low, mid) else (low, mid - 1)
            return low

        def gone(s, r, piece, more):
            """``piece`` was cut out somewhere, and ``more`` followed it (a blank stands for the end)."""
            left = len(r)
            n = min(len(s), left)
            head = shared(0, n, lambda a, b: s[a:b] == r[a:b])
            tail = shared(0, n, lambda a, b: s[len(s) - b : len(s) - a] == r[left - b : left - a])
            low, high = max(0, left - tail), min(left, head)
            return low <= high and piece + more in (s + " ")[low : high + len(piece) + len(more)]

        def holds(before, after, removed):
            n = None if removed is None else flat(removed)
            if n == "":
                return False
            if None in (before, after, n):
                return None
            s, r = flat(before), flat(after)
            taken = len(s) - len(r) - len(n)
            return taken == 0 and gone(s, r, n, "") or taken == 1 and (gone(s, r, " " + n, " ") or s == f"{n} {r}")

        found = []
        for at in range(0, len(before), at_once):
            found += map(holds, *(c.slice(at, at_once).to_pylist() for c in (before, after, removed)))
        return pa.array(found, pa.bool_())

    return F.arrow_udf(run, "boolean")(*(c.cast("string") for c in (before, after, removed)))
