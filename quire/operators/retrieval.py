"""Hashed-feature retrieval, relevance gate, answers with receipts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.scoring import best_matches, sparse_matrix, unit_matrix
from quire.functions.text import FEATURE_DIMS, dense_vector, hash_features, l2_normalize, tokens

TOP_K = 6
MIN_RELEVANCE = 0.03
MIN_RELEVANCE_DENSE = 0.25

ABSTAIN_TEXT = "The documents do not seem to answer this; the closest passages are listed."
EXTRACT_TEXT = "These passages match the question best."
SPAN = ["chunk_id", "doc_id", "page", "idx", "start", "end"]


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Content tokens of a text column, one row each, in order."""
    return df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def with_features(chunks: DataFrame, dims: int = FEATURE_DIMS) -> DataFrame:
    """Chunks with ``words`` and unit-length sparse ``features``; write it to reuse it."""
    if "features" in chunks.columns:
        return chunks
    return chunks.withColumn("words", tokens(F.col("text"))).withColumn(
        "features", l2_normalize(hash_features(F.col("words"), dims))
    )


def score_chunks(
    chunks: DataFrame,
    queries: DataFrame,
    keep: tuple[str, ...] = (),
    k: int | None = None,
    floor: float = 0.0,
    dims: int = FEATURE_DIMS,
) -> DataFrame:
    """Positive cosine scores of (query, chunk) pairs, exact.

    The chunks stay where they are and are read once, whatever the number of
    queries. With ``k`` each task gives back its best ``k`` per query, otherwise
    all pairs that reach ``floor``.
    """
    ready = with_features(chunks, dims)
    asked = queries.select(
        "query_id", l2_normalize(hash_features(tokens(F.col("question")), dims)).alias("features")
    )
    matrix = sparse_matrix("features", dims)
    return best_matches(
        ready.select(*SPAN, *keep, "features"),
        matrix,
        [*SPAN, *keep],
        ["doc_id", "page", "idx"],
        asked,
        matrix,
        k,
        floor,
    )


def _best_first(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy(F.col("score").desc(), "doc_id", "page", "idx")


def top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    doc_ids: DataFrame | None = None,
) -> DataFrame:
    """Best ``k`` chunks per query over the selected documents.

    Ties go by document, page and chunk order. A query with fewer than ``k``
    positive scores is filled with the first other chunks at score zero; the
    first 2k chunks of the scope always suffice for that.
    """
    if doc_ids is not None:
        chunks = chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    rank = F.row_number().over(_best_first("query_id"))
    best = score_chunks(chunks, queries, k=k).withColumn("rank", rank).where(F.col("rank") <= k)
    return filled(best, chunks, queries, k)


def filled(best: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Ranked positive hits of every query, made up to ``k`` with the first other chunks at score zero."""
    gathered = best.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", *SPAN, "score"))).alias("hits")
    )
    spare = (
        chunks.select(*SPAN)
        .orderBy("doc_id", "page", "idx")
        .limit(2 * k)
        .groupBy()
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "page", "idx", "chunk_id", "start", "end"))))
    )
    as_hit = lambda c, score: F.struct(*[c[n].alias(n) for n in SPAN], score.alias("score"))
    positive = F.transform(
        F.coalesce("hits", F.array()), lambda h: as_hit(h, h["score"])
    )
    zero = F.transform(
        F.filter(
            "_spare",
            lambda c: ~F.exists(
                F.coalesce("hits", F.array()), lambda h: h["chunk_id"] == c["chunk_id"]
            ),
        ),
        lambda c: as_hit(c, F.lit(0.0)),
    )
    return (
        queries.select("query_id")
        .join(gathered, "query_id", "left")
        .withColumn("_spare", spare.scalar())
        .select(
            "query_id",
            F.posexplode(F.slice(F.concat(positive, zero), 1, k)).alias("_at", "_h"),
        )
        .select("query_id", "_h.*", (F.col("_at") + 1).alias("rank"))
    )


def _vector_fault(dims: int) -> Column:
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(F.col("embedding").isNull(), "no-vector")
        .when(F.size("embedding") != dims, "wrong-length")
        .when(odd, "not-a-number")
    )


def unusable_vectors(vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """Vectors that cannot be compared, each with its reason."""
    return vectors.select(key, _vector_fault(dims).alias("reason")).where("reason IS NOT NULL")


def dense_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    min_relevance: float = MIN_RELEVANCE_DENSE,
    dims: int | None = None,
) -> DataFrame:
    """The same ranking for dense vectors from any embedder.

    ``vectors``: vec_id, embedding; ``queries``: query_id, embedding. All are ``dims`` long
    (not stated: as long as the longest vector of ``queries``, which is looked up); others, and those
    with nulls or numbers that are not finite, take no part (:func:`unusable_vectors`).
    """
    dims = dims or queries.agg(F.max(F.size("embedding"))).first()[0] or 1
    usable = lambda df, key: df.where(_vector_fault(dims).isNull()).select(key, "embedding")
    matrix = unit_matrix("embedding", dims)
    scored = best_matches(
        usable(vectors, "vec_id"), matrix, ["vec_id"], ["vec_id"], usable(queries, "query_id"), matrix, k, zeros=True
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("relevant", F.col("score") >= min_relevance)
    )


@dataclass(frozen=True)
class Embedder:
    """Turns texts into vectors of ``dims`` numbers, with the score from which a hit bears on a question.

    ``embed`` makes a column of vectors from a column of texts: a built-in expression, or a pandas
    UDF over an iterator of batches that loads its model once for each worker.
    """

    embed: Callable[[Column], Column]
    dims: int
    min_relevance: float = MIN_RELEVANCE_DENSE


def hashing_embedder(dims: int = FEATURE_DIMS) -> Embedder:
    """Hashed tokens written out; built-in functions only."""
    embed = lambda text: dense_vector(l2_normalize(hash_features(tokens(text), dims)), dims)
    return Embedder(embed, dims, MIN_RELEVANCE)


def loaded_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], dims: int, min_relevance: float = MIN_RELEVANCE_DENSE) -> Embedder:
    """An embedder of one's own: ``load`` runs once for each task and gives a function of a batch of texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model([t or "" for t in texts]), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return Embedder(F.pandas_udf(run, "array<double>"), dims, min_relevance)


def embed_top_k(texts: DataFrame, queries: DataFrame, embedder: Embedder, k: int = TOP_K) -> DataFrame:
    """:func:`dense_top_k` of ``vec_id, text`` for ``query_id, question``, by any embedder and its own bar."""
    vectors = texts.select("vec_id", embedder.embed(F.col("text")).alias("embedding"))
    asked = queries.select("query_id", embedder.embed(F.col("question")).alias("embedding"))
    return dense_top_k(vectors, asked, k, embedder.min_relevance, embedder.dims)


def relevance_gate(
    hits: DataFrame,
    queries: DataFrame,
    pages: DataFrame,
    min_relevance: float = MIN_RELEVANCE,
) -> DataFrame:
    """Hits with their quote and whether they bear on the question at all.

    Relevant means a score over the bar and a shared content token; hash
    collisions alone cannot pass.
    """
    quote = F.substring("page_text", F.col("start") + 1, F.col("end") - F.col("start"))
    shared = F.arrays_overlap(tokens(F.col("question")), tokens(F.col("quote")))
    names = [c for c in ["doc_name"] if c in pages.columns]
    texts = pages.select("doc_id", "page", *names, F.col("text").alias("page_text"))
    return (
        hits.join(texts, ["doc_id", "page"])
        .withColumn("quote", quote)
        .drop("page_text")
        .join(queries.select("query_id", "question"), "query_id")
        .withColumn("relevant", (F.col("score") >= min_relevance) & shared)
        .drop("question")
    )


def source(quote: str = "quote") -> Column:
    """Receipt of a hit: exact span, quote, score to four places."""
    return F.struct(
        "chunk_id", "doc_id", "doc_name", "page", "start", "end",
        F.col(quote).alias("quote"), F.round("score", 4).alias("score"),
    )


def to_sources(hits: DataFrame) -> DataFrame:
    """Gated hits as receipt rows."""
    return hits.select("query_id", "rank", F.inline(F.array(source())))


def valid_citations(citations: Column, pool_size: Column) -> Column:
    """Whole, in-range indexes; the first mention of each, in order."""
    whole = F.filter(
        citations, lambda c: (c == F.floor(c)) & (c >= 0) & (c < pool_size)
    )
    return F.transform(F.array_distinct(whole), lambda c: c.cast("int"))


def ask_batch(
    queries: DataFrame, hits: DataFrame, answers: DataFrame | None = None
) -> DataFrame:
    """One answer per question: llm, extractive or abstain, with its receipts.

    ``hits`` come from :func:`relevance_gate` (at most k per question);
    ``answers`` holds what a model said: query_id, found, answer, citations.
    """
    entry = F.struct("rank", "relevant", source().alias("source"))
    gathered = (
        hits.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("raw"))
        .withColumn("gated", F.filter("raw", lambda h: h["relevant"]))
    )
    asked = queries.select("query_id").join(gathered, "query_id", "left")
    if answers is None:
        asked = asked.select(
            "*",
            F.lit(None).cast("boolean").alias("said"),
            F.lit(None).cast("string").alias("reply"),
            F.lit(None).cast("array<int>").alias("cited"),
        )
    else:
        # Two replies to one question support nothing.
        once = F.count("*") == 1
        said = answers.groupBy("query_id").agg(
            (F.coalesce(F.first("found"), F.lit(False)) | ~once).alias("said"),
            F.first("answer").alias("reply"),
            F.when(once, F.first("citations")).alias("citations"),
        )
        asked = asked.join(said, "query_id", "left").withColumn(
            "cited", valid_citations(F.col("citations"), F.size("gated"))
        )
    default = F.lit(ABSTAIN_TEXT)
    nothing = F.coalesce(F.size("gated"), F.lit(0)) <= 0
    unsupported = F.coalesce(F.size("cited"), F.lit(0)) <= 0
    kind = (
        F.when(nothing, "no-hits")
        .when(F.col("said").isNull(), "extractive")
        .when(~F.col("said"), "declined")
        .when(unsupported, "unsupported")
        .otherwise("llm")
    )
    plain = lambda hits_: F.transform(hits_, lambda h: h["source"])
    result = asked.withColumn("_kind", kind)
    return result.select(
        "query_id",
        (F.col("_kind") == "llm").alias("found"),
        F.when(F.col("_kind").isin("llm", "extractive"), F.col("_kind"))
        .otherwise("abstain")
        .alias("mode"),
        F.when(F.col("_kind") == "llm", F.col("reply"))
        .when(F.col("_kind") == "extractive", EXTRACT_TEXT)
        .when(
            F.col("_kind") == "declined",
            F.when(F.length("reply") > 0, F.col("reply")).otherwise(default),
        )
        .otherwise(default)
        .alias("answer"),
        F.when(F.col("_kind") == "llm", F.transform("cited", lambda i: F.get("gated", i)["source"]))
        .when(F.col("_kind") == "extractive", plain(F.col("gated")))
        .when(F.col("_kind") == "no-hits", plain(F.slice("raw", 1, 3)))
        .otherwise(plain(F.slice("gated", 1, 3)))
        .alias("sources"),
    )


def build_prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Numbered excerpts and the question, ready for an external model job."""
    entry = F.struct("rank", "doc_name", "page", "quote")
    excerpts = F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda h, i: F.concat(
            F.lit("[Excerpt "), i.cast("string"), F.lit("] (from "), h["doc_name"],
            F.lit(", page "), h["page"].cast("string"), F.lit(")\n"), h["quote"],
        ),
    )
    return (
        hits.where("relevant")
        .groupBy("query_id")
        .agg(F.array_join(excerpts, "\n\n").alias("excerpts"))
        .join(queries.select("query_id", "question"), "query_id")
        .select(
            "query_id",
            F.concat(
                F.lit("Passages to answer from:\n\n"), "excerpts",
                F.lit("\n\nTo answer: "), F.trim("question"),
            ).alias("prompt"),
        )
    )


ANSWER_SCHEMA = "found BOOLEAN, answer STRING, citations ARRAY<DOUBLE>, _broken STRING"
FINDINGS_SCHEMA = (
    "flags ARRAY<STRUCT<category: STRING, severity: STRING, explanation: STRING,"
    " citations: ARRAY<DOUBLE>>>, _broken STRING"
)
_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}


def parse_answers(raw: DataFrame) -> DataFrame:
    """Model replies ``(query_id, body, refused)`` as answers, bad ones with a reason."""
    parsed = F.from_json("body", ANSWER_SCHEMA, _PERMISSIVE)
    read = raw.withColumn("a", F.when(~F.col("refused"), parsed))
    broken = ~F.col("refused") & (
        F.col("a._broken").isNotNull()
        | F.col("a.found").isNull()
        | F.col("a.answer").isNull()
        | F.col("a.citations").isNull()
    )
    none = F.expr("cast(array() AS array<double>)")
    return read.select(
        "query_id",
        F.when(broken, None).otherwise(F.coalesce("a.found", F.lit(False))).alias("found"),
        F.when(broken, None).otherwise(F.coalesce("a.answer", F.lit(ABSTAIN_TEXT))).alias("answer"),
        F.when(broken, None).otherwise(F.coalesce("a.citations", none)).alias("citations"),
        F.when(broken, "unparseable").alias("reason"),
    )


def parse_findings(raw: DataFrame) -> DataFrame:
    """Model scans ``(doc_id, body, refused)`` as finding rows; bad ones one reason row."""
    parsed = F.from_json("body", FINDINGS_SCHEMA, _PERMISSIVE)
    read = raw.where("not refused").withColumn("a", parsed)
    broken = F.col("a._broken").isNotNull() | F.col("a.flags").isNull()
    good = read.where(~broken).select(
        "doc_id", F.posexplode("a.flags").alias("pos", "f")
    )
    return good.select(
        "doc_id", "pos", "f.*", F.lit(None).cast("string").alias("reason")
    ).unionByName(
        read.where(broken).select("doc_id", F.lit("unparseable").alias("reason")),
        allowMissingColumns=True,
    )
