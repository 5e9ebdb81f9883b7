"""Placing marks, labels and replacement text on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.text import strip_space

from quire.functions.geometry import box_columns, rect_to_user, user_to_view, view_size, view_to_user
from quire.functions.running import renumber
from quire.operators.intake import fold_rotation

DEFAULT_MARGIN = 36.0
MIN_SHRINK = 0.6
ANCHORS = [
    "top-left", "top-center", "top-right", "center", "bottom-left", "bottom-center", "bottom-right",
]
PLACE = ["doc_id", "page_index"]


def on_pages(rows: DataFrame, page_boxes: DataFrame) -> DataFrame:
    """Rows joined to the box of their page, the turn folded."""
    return rows.join(
        page_boxes.select(*PLACE, *box_columns(fold_rotation(F.col("rotation")))), PLACE
    )


def points_to_user(points: DataFrame, page_boxes: DataFrame) -> DataFrame:
    """Displayed points with their stored position and the way back."""
    x, y = view_to_user(F.col("x"), F.col("y"))
    moved = on_pages(points, page_boxes).withColumns({"ux": x, "uy": y})
    vx, vy = user_to_view(F.col("ux"), F.col("uy"))
    return moved.withColumns({"vx": vx, "vy": vy}).select(*points.columns, "ux", "uy", "vx", "vy")


def rects_to_user(rects: DataFrame, page_boxes: DataFrame) -> DataFrame:
    """Displayed rectangles as stored ones."""
    x, y, w, h = rect_to_user(*[F.col(c) for c in ("x", "y", "width", "height")])
    kept = [c for c in rects.columns if c not in ("x", "y", "width", "height")]
    renamed = page_boxes.select(*PLACE, *box_columns(fold_rotation(F.col("rotation"))))
    return rects.join(renamed, PLACE).select(
        *kept, x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")
    )


def _anchored(anchor: Column, margin: Column, w: Column, h: Column) -> tuple[Column, Column]:
    vw, vh = view_size()
    x = (
        F.when(anchor.endswith("left"), margin)
        .when(anchor.endswith("right"), vw - w - margin)
        .otherwise((vw - w) / 2)
    )
    y = (
        F.when(anchor.startswith("top"), margin)
        .when(anchor.startswith("bottom"), vh - h - margin)
        .otherwise((vh - h) / 2)
    )
    return x, y


def _spun(left: Column, top: Column, w: Column, h: Column, ascent: Column, spin: Column):
    """First baseline of a block turned about its own centre, in view space."""
    phi = F.radians(spin)
    ax, ay = F.cos(phi), -F.sin(phi)
    ux, uy = -F.sin(phi), -F.cos(phi)
    back = ascent - h / 2
    return (
        left + w / 2 - (w / 2) * ax - back * ux,
        top + h / 2 - (w / 2) * ay - back * uy,
    )


def place_text(marks: DataFrame, page_boxes: DataFrame) -> DataFrame:
    """Where a text mark is drawn.

    ``marks``: doc_id, page_index, mark, anchor, margin, x, y (either may be
    null: the anchor decides that axis), width, height, ascent, spin. An unknown
    anchor is answered with a reason.
    """
    on = on_pages(marks, page_boxes)
    anchor = F.coalesce("anchor", F.lit("top-left"))
    margin = F.coalesce("margin", F.lit(DEFAULT_MARGIN))
    spin = F.coalesce("spin", F.lit(0.0))
    w, h = F.col("width"), F.col("height")
    fx, fy = _anchored(anchor, margin, w, h)
    bx, by = _spun(F.coalesce("x", fx), F.coalesce("y", fy), w, h, F.col("ascent"), spin)
    known = anchor.isin(ANCHORS)
    px, py = view_to_user(F.col("_bx"), F.col("_by"))
    return on.withColumns({"_bx": bx, "_by": by}).select(
        *PLACE,
        "mark",
        F.when(known, px).alias("px"),
        F.when(known, py).alias("py"),
        F.when(known, F.col("box_rotation") + spin).alias("turn"),
        F.when(~known, "no-such-anchor").alias("reason"),
    )


def place_images(marks: DataFrame, page_boxes: DataFrame) -> DataFrame:
    """Where an image mark is drawn; one given side keeps the picture's ratio.

    ``marks``: doc_id, page_index, mark, x, y, width, height (null when not
    asked for), own_width, own_height.
    """
    on = on_pages(marks, page_boxes)
    ratio = F.col("own_height") / F.col("own_width")
    both = F.col("width").isNotNull() & F.col("height").isNotNull()
    w = F.when(both | F.col("width").isNotNull(), F.col("width")).when(
        F.col("height").isNotNull(), F.col("height") / ratio
    ).otherwise(F.col("own_width"))
    h = F.when(both | (F.col("width").isNull() & F.col("height").isNotNull()), F.col("height")).when(
        F.col("width").isNotNull(), F.col("width") * ratio
    ).otherwise(F.col("own_height"))
    sized = on.withColumns({"_w": w, "_h": h})
    px, py = view_to_user(F.col("x"), F.col("y") + F.col("_h"))
    known = F.coalesce((F.col("own_width") > 0) & (F.col("own_height") > 0), F.lit(False))
    ok = known & F.coalesce((F.col("_w") > 0) & (F.col("_h") > 0), F.lit(False))
    return sized.select(
        *PLACE,
        "mark",
        *[F.when(ok, c).alias(n) for n, c in [("px", px), ("py", py), ("width", F.col("_w")), ("height", F.col("_h"))]],
        F.when(ok, F.col("box_rotation")).alias("turn"),
        F.when(~ok, "no-size").alias("reason"),
    )


def watermark_scale(marks: DataFrame, page_boxes: DataFrame) -> DataFrame:
    """How far a turned block must shrink to stay on its page; it never grows.

    ``marks``: doc_id, page_index, mark, width, height, spin.
    """
    on = on_pages(marks, page_boxes)
    c, s = F.abs(F.cos(F.radians("spin"))), F.abs(F.sin(F.radians("spin")))
    spread = F.col("width") * c + F.col("height") * s
    rise = F.col("width") * s + F.col("height") * c
    vw, vh = view_size()
    scale = F.when((spread > 0) & (rise > 0), F.least(F.lit(1.0), vw / spread, vh / rise)).otherwise(1.0)
    return on.select(*PLACE, "mark", scale.alias("scale"))


def page_labels(
    selection: DataFrame, docs: DataFrame, fmt: str = "{n}", start: int = 1
) -> DataFrame:
    """Numbers for the selected pages; ``{total}`` is the last number printed."""
    valid = (
        selection.select(*PLACE)
        .distinct()
        .join(docs.select("doc_id", "n_pages"), "doc_id")
        .where("page_index >= 0 AND page_index < n_pages")
        .drop("n_pages")
    )
    counts = valid.groupBy("doc_id").agg(F.count("*").alias("_n"))
    number = F.col("_i") + start
    last = F.col("_n") + start - 1
    label = F.replace(
        F.replace(F.lit(fmt), F.lit("{n}"), number.cast("string")),
        F.lit("{total}"),
        last.cast("string"),
    )
    return (
        renumber(valid, ["doc_id"], ["page_index"], "_i")
        .join(counts, "doc_id")
        .select(*PLACE, label.alias("label"))
        .where("label <> ''")
    )


def fit_text(edits: DataFrame, glyph_widths: DataFrame) -> DataFrame:
    """Whether replacement text fits its box, and the size it would need.

    ``edits``: edit, text, room, size, squeeze. ``glyph_widths``: ch, em.
    Characters are counted per edit before they meet the widths, so a common
    letter is one row per edit however often it occurs. A text with a character
    that has no width cannot be drawn: ``no-such-glyph``, without sizes.
    """
    chars = (
        edits.select("edit", F.explode(F.split("text", "")).alias("ch"))
        .groupBy("edit", "ch")
        .agg(F.count("*").alias("n"))
    )
    ems = (
        chars.join(glyph_widths, "ch", "left")
        .groupBy("edit")
        .agg(
            F.sum(F.col("n") * F.col("em")).alias("_ems"),
            F.bool_or(F.col("em").isNull() & (F.col("ch") != "")).alias("_missing"),
        )
    )
    width = lambda size: F.coalesce("_ems", F.lit(0.0)) * F.coalesce("squeeze", F.lit(1.0)) * size
    room = F.abs("room")
    start = F.col("size")
    halve = lambda bounds, _: F.when(
        width((bounds["low"] + bounds["high"]) / 2) <= room,
        F.struct(((bounds["low"] + bounds["high"]) / 2).alias("low"), bounds["high"].alias("high")),
    ).otherwise(
        F.struct(bounds["low"].alias("low"), ((bounds["low"] + bounds["high"]) / 2).alias("high"))
    )
    searched = F.aggregate(
        F.sequence(F.lit(1), F.lit(20)),
        F.struct((start * MIN_SHRINK).alias("low"), start.alias("high")),
        halve,
        lambda b: F.floor(b["low"] * 100 + 1e-6) / 100,
    )
    keep = ~(start > 0) | ~(room > 0) | (F.col("text") == "") | (width(start) <= room)
    fitted = edits.join(ems, "edit", "left").withColumn(
        "suggested", F.when(keep, start).otherwise(searched)
    )
    over = width(start) - room
    drawn = ~F.coalesce("_missing", F.lit(False))
    return fitted.select(
        "edit",
        (drawn & ~(over > 0)).alias("fits"),
        F.when(drawn, F.greatest(over, F.lit(0.0))).alias("overflow"),
        F.when(drawn, F.col("suggested")).alias("suggested"),
        F.when(~drawn, "no-such-glyph")
        .when(width(start) <= room, None)
        .when(width(F.col("suggested")) > room, "overflows")
        .otherwise("shrunk")
        .alias("warning"),
    )


def plan_edits(edits: DataFrame, docs: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What happens to each text edit, and the documents whose batch is refused.

    ``edits``: doc_id, edit, page_index, x, y, width, height, original.
    ``outcomes``: doc_id, edit, ok - whether the old words could be taken out.
    Edits run page by page in the order given; one without area is skipped.
    """
    # What a document's edits say about pages is one row before the documents are asked.
    ends = edits.groupBy("doc_id").agg(
        F.min("page_index").alias("low"), F.max("page_index").alias("high"), F.bool_or(F.col("page_index").isNull()).alias("odd")
    )
    in_range = F.coalesce((F.col("low") >= 0) & (F.col("high") < F.col("n_pages")) & ~F.col("odd"), F.lit(False))
    rejected = ends.join(docs.select("doc_id", "n_pages"), "doc_id", "left").groupBy("doc_id").agg(
        F.when(F.bool_or(~in_range), "no-such-page").alias("reason")
    ).where("reason IS NOT NULL")
    sized = (F.abs("width") > 0) & (F.abs("height") > 0)
    key = ["doc_id", "page_index", "_kx", "_ky"]
    placed = F.lit(True)
    for c in key:
        placed = placed & F.col(c).isNotNull()
    gone = outcomes.where("ok").groupBy("doc_id", "edit").agg(F.bool_or("ok").alias("_gone"))
    # Tests come before the joins, so that rows are moved without what they were made of.
    tried = (
        edits.withColumns(
            {
                "_kx": F.floor(F.col("x") + 0.5),
                "_ky": F.floor(F.col("y") + 0.5),
                "_sized": sized,
                "_worded": strip_space(F.coalesce("original", F.lit(""))) != "",
            }
        )
        .join(rejected, "doc_id", "left_anti")
        .join(gone, ["doc_id", "edit"], "left")
        .withColumn("_cut", F.col("_gone") & F.col("_sized") & F.col("_worded"))
    )
    planned = tried.withColumn(
        "action",
        F.when(~F.col("_sized"), "skipped")
        .when(F.bool_or("_cut").over(Window.partitionBy(*key)) & placed, "removed")
        .otherwise("covered"),
    )
    return planned.select(*edits.columns, "action"), rejected


def edit_counts(planned: DataFrame) -> DataFrame:
    """Edits applied, removed and covered per document."""
    n = lambda test: F.count(F.when(test, 1))
    return planned.groupBy("doc_id").agg(
        n(F.col("action") != "skipped").alias("applied"),
        n(F.col("action") == "removed").alias("removed"),
        n(F.col("action") == "covered").alias("covered"),
        n(F.col("action") == "skipped").alias("skipped"),
    )
