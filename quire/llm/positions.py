"""Benchmark decontamination over a positional inverted index, built from DataFrame functions only.

The index holds a posting (term, document, position) for every place of a training text whose word
occurs in a test item. Windows of consecutive item words are looked up from their rarest terms: the
postings of these terms, moved back by the term's place in the item, meet where a window can begin,
and only there the document's words are compared with the window. Matches are exact; ``near`` gives
matches of the rarest terms that are up to ``slack`` words out of place.

Items are cut into segments of 63 words, so that the places of a segment fit in the bits of one
number; lists are intersected by an aggregation that ORs these bits and combines on the map side, so
copies, hot documents and hot passages collapse in their task. Documents without a candidate (a
bounded Bloom filter tells) are never shuffled. Nothing is broadcast but by the optimizer's measured size.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became lower case. A null or wordless
text has no words and no hits; null or wordless items have no windows; an item without an id is the
item named by the empty string; rows with one ``item_id`` are one item. Every row of ``documents``
gives one row, repeated and null ids as well. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import bloom
from quire.llm.shared import store

WINDOW = 10
RAREST = 2  # terms of a window whose lists are intersected before words are compared
_BITS = 63
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    cut = F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAPS), lambda w: w != "")
    return F.coalesce(cut, F.array().cast("array<string>"))


@dataclass
class Items:
    """Test items cut into segments."""

    segments: DataFrame  # seg, words
    members: DataFrame  # seg, item
    windows: DataFrame  # seg, start, n: windows by their first word in the segment


def items(benchmark: DataFrame, width: int = WINDOW) -> Items:
    """Windows of ``width`` words of ``item_id, text``; a shorter item is one window."""
    if not 1 <= width <= 32:
        raise ValueError("a window has 1 to 32 words")
    span = _BITS - width + 1  # windows that begin in a segment
    cut = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    cut = cut.where(F.size("w") > 0).withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)), F.lit(span)))
    )
    cut = cut.select("item", F.slice("w", F.col("at") + 1, F.lit(_BITS)).alias("words"))
    cut = store(cut.withColumn("seg", F.md5(F.array_join("words", " "))), "segments")
    segments = store(cut.groupBy("seg").agg(F.first("words").alias("words")), "distinct-segments")
    windows = segments.select(
        "seg", F.least(F.size("words"), F.lit(width)).alias("n"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("start"),
    )
    return Items(segments, cut.select("seg", "item").distinct(), windows)


def key(docs: DataFrame) -> Column:
    """Postings name a document by this; documents that share it share candidates, not matches."""
    return F.xxhash64(docs["doc_id"])


def postings(docs: DataFrame, tests: Items) -> DataFrame:
    """The stored index: ``term, doc, pos`` for every place of a word that some item has."""
    asked = store(tests.segments.select(F.explode("words").alias("term")).distinct(), "terms")
    placed = docs.select(key(docs).alias("doc"), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return store(placed.join(asked, "term", "left_semi").select("term", "doc", "pos"), "postings")


def ranked(index: DataFrame, tests: Items, rarest: int) -> DataFrame:
    """``seg, start, n, place, rank, term``: the rarest terms of every window whose terms all occur."""
    often = store(index.groupBy("term").agg(F.count("*").alias("often")), "often")
    places = tests.segments.select("seg", F.posexplode("words").alias("place", "term")).join(often, "term", "left")
    met = tests.windows.join(places, "seg").where("place >= start AND place < start + n")
    window = Window.partitionBy("seg", "start")
    return (
        met.withColumn("rank", F.row_number().over(window.orderBy(F.coalesce("often", F.lit(0)), "place")))
        .withColumn("absent", F.max(F.col("often").isNull()).over(window))
        .where(~F.col("absent") & (F.col("rank") <= rarest))
        .select("seg", "start", "n", "place", "rank", "term")
    )


def candidates(index: DataFrame, tests: Items, rarest: int = RAREST) -> DataFrame:
    """``doc, seg, shift, windows``: where windows of a segment can begin, ``shift`` words behind its own places."""
    best = store(ranked(index, tests, rarest), "ranked")
    bit = F.expr("shiftleft(1L, place)")
    needs = best.groupBy("seg", "start", "n").agg(F.bit_or(bit).alias("need"))
    needs = store(needs.groupBy("seg").agg(F.collect_list(F.struct("start", "n", "need")).alias("windows")), "needs")
    lists = index.join(best.select("term", "seg", "place").distinct(), "term")
    met = lists.groupBy("doc", "seg", (F.col("pos") - F.col("place")).alias("shift")).agg(F.bit_or(bit).alias("got"))
    ready = F.filter("windows", lambda w: (w["need"].bitwiseAND(F.col("got")) == w["need"]) & (w["start"] + F.col("shift") >= 0))
    return (
        met.join(needs, "seg").withColumn("windows", ready).where(F.size("windows") > 0).select("doc", "seg", "shift", "windows")
    )


def matches(texts: DataFrame, found: DataFrame, tests: Items) -> DataFrame:
    """``uid, seg, start, at, n``: windows that occur, from ``uid, doc, w`` and their candidates."""
    mine = found.groupBy("doc").agg(F.collect_list(F.struct("seg", "shift", "windows")).alias("found"))
    places = F.expr(
        "flatten(transform(found, f -> transform(f.windows, x -> struct(f.seg AS seg, x.start AS start, x.n AS n,"
        " f.shift + x.start AS at, slice(w, f.shift + x.start + 1, x.n) AS got))))"
    )
    told = texts.join(mine, "doc").select("uid", F.inline(places))
    same = F.col("got") == F.slice("words", F.col("start") + 1, F.col("n"))
    return told.join(tests.segments, "seg").where(same).select("uid", "seg", "start", "at", "n")


def near(docs: DataFrame, benchmark: DataFrame, slack: int, width: int = WINDOW, rarest: int = 3) -> DataFrame:
    """``doc_id, item, n, at``: windows whose rarest terms all lie within ``slack`` words of their places.

    Places are counted from the rarest term; ``at`` is where the window would begin. A window with
    fewer terms needs all of them. With a slack of 0 every exact match is among the results.
    """
    tests = items(benchmark, width)
    index = postings(docs, tests)
    best = store(ranked(index, tests, rarest), "ranked")
    asked = best.groupBy("seg", "start").agg(F.count("*").alias("all"))
    placed = index.join(best, "term").select("doc", "seg", "start", "n", "rank", (F.col("pos") - F.col("place") + F.col("start")).alias("at"))
    # The first list's places go into their bin and both beside it, so each pair meets once.
    wide = F.lit(slack + 1)
    first = placed.where("rank = 1").withColumn("bin", F.explode(F.expr(f"transform(array(-1, 0, 1), d -> floor(at / {slack + 1}) + d)")))
    rest = placed.select("doc", "seg", "start", F.col("rank").alias("other"), F.col("at").alias("there"), F.floor(F.col("at") / wide).alias("bin"))
    met = first.drop("rank").join(rest, ["doc", "seg", "start", "bin"]).where(F.abs(F.col("at") - F.col("there")) <= slack)
    full = (
        met.groupBy("doc", "seg", "start", "n", "at").agg(F.count_distinct("other").alias("ranks"))
        .join(asked, ["seg", "start"]).where(F.col("ranks") == F.col("all")).where("at >= 0")
    )
    named = docs.select(key(docs).alias("doc"), "doc_id").distinct()
    return full.join(tests.members, "seg").join(named, "doc").select("doc_id", "item", "n", "at").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``doc_id, text``."""
    docs = docs.select("doc_id", "text")
    tests = items(benchmark, width)
    found = store(candidates(postings(docs, tests), tests), "candidates")
    passed, maybe = bloom.split(docs.withColumn("doc", key(docs)), "doc", found.select("doc").distinct())
    # The number is fixed once written.
    texts = store(maybe.select("doc_id", "doc", words(F.col("text")).alias("w")).withColumn("uid", F.monotonically_increasing_id()), "texts")
    hits = store(matches(texts, found, tests), "matches")

    before = Window.partitionBy("uid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("at") + F.col("n")).over(before), F.lit(0))
    covered = (
        hits.groupBy("uid", "at").agg(F.max("n").alias("n"))
        .withColumn("new", F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest("at", reached)))
        .groupBy("uid").agg(F.sum("new").cast("long").alias("n_hit"))
    )
    named = hits.select("uid", "seg").distinct().join(tests.members, "seg").select("uid", "item").distinct()
    named = named.groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    listed = F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256)
    zero = F.lit(0).cast("long")
    clean = passed.select(
        "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"),
        F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"),
    )
    hit = texts.select("uid", "doc_id", F.size("w").cast("long").alias("n_words")).join(covered, "uid", "left").join(named, "uid", "left")
    return clean.unionByName(
        hit.select(
            "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
            F.when(F.col("items").isNull(), zero).otherwise(F.size("items").cast("long")).alias("n_items"), listed.alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, all columns; ``doc_id`` has to be unique here."""
    gone = contaminated(docs, benchmark, width).where("contaminated").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
