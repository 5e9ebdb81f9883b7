"""Page text to overlapping chunks whose spans are exact slices of the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.text import SPACE, SPACE_CHARS, strip_space

CHUNK_TARGET = 1100
CHUNK_OVERLAP = 180
CHUNK_HARD_MAX = 2200

# Zero-width cuts: the pieces concatenate back to the page, and the break's own
# white space ends up leading the next piece, where trimming removes it.
PARAGRAPH_CUT = r"(?<!\n)(?=\n\n)"
SENTENCE_CUT = rf"(?<=[.!?])(?={SPACE})"

PAGE = ["doc_id", "page"]


def _lead(piece: Column) -> Column:
    return F.length(piece) - F.length(F.ltrim(piece, F.lit(SPACE_CHARS)))


def _measured(piece: Column) -> Column:
    """Leading blanks, trimmed length and full length of one piece."""
    return F.struct(
        _lead(piece).alias("lead"),
        F.length(strip_space(piece)).alias("len"),
        F.length(piece).alias("total"),
    )


def _paragraph_pieces(text: Column) -> Column:
    return F.split(text, PARAGRAPH_CUT, -1)


def _unit_pieces(text: Column, hard_max: int) -> Column:
    """Measured pieces of a page: paragraphs, sentences where too long, hard cuts."""

    def refine(paragraph: Column) -> Column:
        return F.when(
            F.length(strip_space(paragraph)) <= hard_max, F.array(paragraph)
        ).otherwise(F.split(paragraph, SENTENCE_CUT, -1))

    def hard_cut(piece: Column) -> Column:
        last = F.floor((piece["len"] - 1) / hard_max).cast("int")

        def cut(i: Column) -> Column:
            lead = F.when(i == 0, piece["lead"]).otherwise(F.lit(0))
            size = F.when(i == last, piece["len"] - i * hard_max).otherwise(F.lit(hard_max))
            tail = F.when(
                i == last, piece["total"] - piece["lead"] - piece["len"]
            ).otherwise(F.lit(0))
            return F.struct(
                lead.alias("lead"), size.alias("len"), (lead + size + tail).alias("total")
            )

        return F.when(piece["len"] <= hard_max, F.array(piece)).otherwise(
            F.transform(F.sequence(F.lit(0), last), cut)
        )

    pieces = F.flatten(F.transform(_paragraph_pieces(text), refine))
    measured = F.transform(pieces, lambda p: _measured(p))
    return F.flatten(F.transform(measured, hard_cut))


def _unit_rows(pages: DataFrame, pieces: Column) -> DataFrame:
    """Explode measured pieces and give each its offsets by a running sum."""
    exploded = pages.select(*PAGE, F.posexplode(pieces).alias("pos", "p"))
    seen = Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(
        Window.unboundedPreceding, -1
    )
    kept = Window.partitionBy(*PAGE).orderBy("pos")
    begin = F.coalesce(F.sum("p.total").over(seen), F.lit(0)).cast("int") + F.col("p.lead")
    return (
        exploded.select(*PAGE, "pos", begin.alias("start"), F.col("p.len").alias("len"))
        .where("len > 0")
        .select(
            *PAGE,
            (F.row_number().over(kept) - 1).alias("unit"),
            "start",
            (F.col("start") + F.col("len")).alias("end"),
        )
    )


def paragraph_units(pages: DataFrame) -> DataFrame:
    """Trimmed paragraphs of every page with their original offsets."""
    return _unit_rows(
        pages, F.transform(_paragraph_pieces(F.col("text")), lambda p: _measured(p))
    )


def sentence_units(pages: DataFrame, hard_max: int = CHUNK_HARD_MAX) -> DataFrame:
    """Packing units: paragraphs, split by sentence and then hard where too long."""
    return _unit_rows(pages, _unit_pieces(F.col("text"), hard_max))


def _pack(pieces: str, target: int, overlap: int) -> str:
    """Greedy packing as one linear fold over a page's measured pieces.

    ``cur`` holds the units of the open chunk (bounded by the target), ``out``
    the finished spans. When a unit does not fit, the open chunk closes; of its
    units the ones within the overlap budget carry over, and any of those the
    new unit still does not fit with become chunks of their own.
    """
    spans = "array<struct<s:int,e:int>>"
    empty = f"cast(array() AS {spans})"
    unit = "named_struct('s', a.pos + x.lead, 'e', a.pos + x.lead + x.len)"
    end = "a.pos + x.lead + x.len"
    closing = "element_at(a.cur, -1).e"
    carried = (
        f"filter(slice(a.cur, 2, size(a.cur)), c -> {closing} - c.s <= {overlap})"
    )
    return f"""aggregate({pieces},
        named_struct('pos', 0, 'cur', {empty}, 'out', {empty}),
        (a, x) -> CASE
          WHEN x.len = 0
            THEN named_struct('pos', a.pos + x.total, 'cur', a.cur, 'out', a.out)
          WHEN size(a.cur) = 0 OR {end} - a.cur[0].s <= {target}
            THEN named_struct('pos', a.pos + x.total,
                              'cur', concat(a.cur, array({unit})), 'out', a.out)
          ELSE named_struct('pos', a.pos + x.total,
            'cur', concat(filter({carried}, c -> {end} - c.s <= {target}), array({unit})),
            'out', concat(a.out, array(named_struct('s', a.cur[0].s, 'e', {closing})),
              transform(filter({carried}, c -> {end} - c.s > {target}),
                        c -> named_struct('s', c.s, 'e', {closing}))))
        END,
        a -> CASE WHEN size(a.cur) = 0 THEN a.out
             ELSE concat(a.out, array(named_struct('s', a.cur[0].s, 'e', {closing}))) END)"""


def _check(target: int, overlap: int) -> None:
    if overlap > target:
        raise ValueError("overlap must not exceed target")


def pack_chunks(
    units: DataFrame, target: int = CHUNK_TARGET, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Chunk spans from unit rows ``(doc_id, page, unit, start, end)``."""
    _check(target, overlap)
    ordered = F.sort_array(F.collect_list(F.struct("unit", "start", "end")))
    # Absolute offsets, so each unit is fed with the running position at zero.
    pieces = F.transform(
        ordered,
        lambda u: F.struct(
            u["start"].alias("lead"),
            (u["end"] - u["start"]).alias("len"),
            F.lit(0).alias("total"),
        ),
    )
    return (
        units.groupBy(*PAGE)
        .agg(pieces.alias("pieces"))
        .select(*PAGE, F.posexplode(F.expr(_pack("pieces", target, overlap))).alias("idx", "c"))
        .select(*PAGE, "idx", F.col("c.s").alias("start"), F.col("c.e").alias("end"))
    )


def chunk_documents(
    pages: DataFrame,
    target: int = CHUNK_TARGET,
    overlap: int = CHUNK_OVERLAP,
    hard_max: int = CHUNK_HARD_MAX,
) -> DataFrame:
    """Chunks of every page; narrow, one row in, its chunks out, no exchange."""
    _check(target, overlap)
    packed = pages.withColumn("_pieces", _unit_pieces(F.col("text"), hard_max)).withColumn(
        "_spans", F.expr(_pack("_pieces", target, overlap))
    )
    cut = F.transform(
        F.col("_spans"),
        lambda c: F.struct(
            c["s"].alias("start"),
            c["e"].alias("end"),
            F.substring(F.col("text"), c["s"] + 1, c["e"] - c["s"]).alias("text"),
        ),
    )
    return packed.select(*PAGE, F.posexplode(cut).alias("idx", "c")).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), "page", "idx").alias("chunk_id"),
        *PAGE,
        "idx",
        F.col("c.start").alias("start"),
        F.col("c.end").alias("end"),
        F.col("c.text").alias("text"),
    )


def audit_spans(spans: DataFrame, pages: DataFrame, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Broken promises of a chunking, one row each with its reason.

    ``spans``: doc_id, page, idx, start, end, text. Checks that every text is
    the exact slice of its page, that chunks advance, that overlaps stay in
    budget and that no visible character lies outside every chunk.
    """
    order = Window.partitionBy(*PAGE).orderBy("idx")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    linked = spans.select(
        *PAGE,
        "idx",
        "start",
        "end",
        F.col("text").alias("quote"),
        F.lag("start").over(order).alias("_s"),
        F.lag("end").over(order).alias("_e"),
        F.coalesce(reach, F.lit(0)).alias("_reach"),
        F.lead("start").over(order).isNull().alias("_last"),
    ).join(pages.select(*PAGE, "text"), PAGE)

    def visible(a: Column, b: Column) -> Column:
        inside = F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))
        return F.length(F.regexp_replace(inside, rf"{SPACE}+", "")) > 0

    end_reach = F.greatest("_reach", "end")
    reasons = F.array_compact(
        F.array(
            F.when(
                F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
                != F.col("quote"),
                "not-a-slice",
            ),
            F.when(F.col("start") <= F.col("_s"), "no-progress"),
            F.when(F.col("_e") - F.col("start") > overlap, "overlap-over-budget"),
            F.when(visible(F.col("_reach"), F.col("start")), "gap"),
            F.when(F.col("_last") & visible(end_reach, F.length("text")), "tail-uncovered"),
        )
    )
    return linked.select(*PAGE, "idx", F.explode(reasons).alias("reason"))
