"""Risk scan: every document against a table of categories, with receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quire.functions.binding import bind
from quire.functions.text import FEATURE_DIMS, SPACE, SPACE_CHARS, dense_vector, hash_features, l2_normalize, strip_space, tokens
from quire.operators.retrieval import MIN_RELEVANCE, SPAN, TOP_K, valid_citations

QUOTE_CHARS = 320
LEAD_IN_CHARS = 220
FOUND_NOTE = "Passages worth reading, quoted exactly; no advice is given."
EMPTY_NOTE = "None of the watched categories clearly matched this text."

# The built-in categories (id, title, probe, hint, signals, why).
CATEGORIES = [
    (
        "auto_renewal",
        "Automatic renewal",
        "automatically renew renewal automatic renewal term renewed for successive periods "
        "continues unless you cancel auto-renew subscription renews notice before renewal",
        "the agreement renews on its own and keeps charging unless cancelled in time",
        ["renew", "automatically renew", "auto-renew"],
        "Renewal terms decide whether this keeps going - and keeps charging you - unless you "
        "cancel in time. Worth reading to know the deadline.",
    ),
    (
        "fees_penalties",
        "Fees and penalties",
        "fee fees late fee penalty charge charged additional charge service charge processing "
        "fee interest surcharge non-refundable",
        "fees, penalties, or extra charges the reader might not expect",
        ["fee", "penalty", "penalties", "late charge", "non-refundable", "$"],
        "This covers fees, penalties, or extra charges. Worth reading so none of them catch "
        "you by surprise.",
    ),
    (
        "cancellation",
        "Cancellation and termination",
        "termination terminate cancel cancellation early termination fee notice required days "
        "written notice end the agreement break the lease penalty for ending",
        "ending or cancelling is costly or requires long advance notice",
        ["terminat", "cancel", "cancellation"],
        "This covers how to end the agreement - the notice required and any cost to leave "
        "early. Worth reading before you need to get out.",
    ),
    (
        "arbitration",
        "Arbitration and legal rights",
        "arbitration arbitrate binding arbitration waive right to sue class action waiver jury "
        "trial dispute resolution governing law legal claims",
        "you give up the right to sue in court or to join a class action",
        ["arbitrat", "class action", "jury trial", "waive the right"],
        "Arbitration clauses can limit your right to sue in court or join a class action. "
        "Worth reading closely to see what you'd give up.",
    ),
    (
        "liability",
        "Liability and warranty",
        "limitation of liability not liable no warranty as is disclaim warranties indemnify "
        "indemnification hold harmless maximum liability damages",
        "they limit what they're responsible for, or provide no warranty",
        [
            "limitation of liability", "not liable", "as is", "hold harmless", "disclaim",
            "warrant", "indemnif",
        ],
        "This is where responsibility is capped and warranties are limited. Worth reading to "
        "see what you're on the hook for if something breaks.",
    ),
    (
        "unilateral_changes",
        "Changes to the terms",
        "we may change modify these terms at any time reserve the right to modify amend update "
        "the agreement revise terms with or without notice sole discretion",
        "they can change the terms whenever they want",
        [
            "change these terms", "update these terms", "modify these terms", "we may change",
            "we may update", "add, change, or remove", "sole discretion", "reserve the right",
        ],
        "This covers whether and how the terms can change later. Worth reading to know if what "
        "you agreed to today can shift.",
    ),
    (
        "data_sharing",
        "Data and privacy",
        "personal information data share sell third parties collect your data privacy "
        "marketing advertisers disclose information usage data",
        "your personal data can be shared, sold, or used broadly",
        [
            "personal information", "personal data", "third part", "sell your", "share your",
            "advertis", "privacy", "your data",
        ],
        "This covers how your personal information is collected, used, and shared. Worth "
        "reading to see where your data ends up.",
    ),
]

CATEGORY_SCHEMA = (
    "id STRING, ord INT, title STRING, probe STRING, hint STRING,"
    " signals ARRAY<STRING>, why STRING"
)
SEVERITIES = ["high", "medium", "low", "info"]


def category_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A category table from (id, title, probe, hint, signals, why) tuples."""
    return spark.createDataFrame(
        [(r[0], i, r[1], r[2], r[3], list(r[4]), r[5]) for i, r in enumerate(rows)],
        CATEGORY_SCHEMA,
    )


def categories(spark: SparkSession) -> DataFrame:
    """The seven built-in categories in their order."""
    return category_table(spark, CATEGORIES)


def scan_candidates(
    chunks: DataFrame, cats: DataFrame, k: int = TOP_K, min_relevance: float = MIN_RELEVANCE
) -> DataFrame:
    """Relevant chunks per (document, category), best first.

    Categories are few next to the chunks: each chunk is scored against all of them in its row, by
    its own few features. A score under the bar can never pass and never outranks one over it, so
    those pairs go first; both text tests are made next to the chunk text and only narrow rows are
    shuffled.
    """
    vector = dense_vector(l2_normalize(hash_features(tokens(F.col("probe")))))
    rules = cats.select(
        F.col("id").alias("category"), "ord", tokens(F.col("probe")).alias("probe_words"), "signals", vector.alias("weights")
    )
    listed = rules.groupBy().agg(F.collect_list(F.struct(*rules.columns))).scalar()
    # Buckets that any category weighs; the rest of a chunk's features add nothing to a score.
    weighed = rules.groupBy().agg(F.collect_list("weights").alias("all")).select(
        F.transform(F.sequence(F.lit(0), F.lit(FEATURE_DIMS - 1)), lambda b: F.exists("all", lambda w: F.get(w, b) != 0))
    ).scalar()

    def score(features: Column, rule: Column) -> Column:
        dot = F.aggregate(
            features, F.lit(0.0), lambda acc, x: acc + x["weight"] * F.get(rule["weights"], x["bucket"])
        )
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)), 12)

    # One expression: a column that is used inside a lambda would be made again for every rule.
    met = lambda t: bind(
        F.filter(t["features"], lambda x: F.get("_weighed", x["bucket"])),
        lambda own: F.filter(
            F.transform("_rules", lambda r: F.struct(r.alias("rule"), score(own, r).alias("score"))),
            lambda m: (m["score"] >= min_relevance) & (m["score"] > 0),
        ),
    )
    tested = lambda t, low: F.transform(
        t["met"],
        lambda m: F.struct(
            m["rule"]["category"].alias("category"),
            m["rule"]["ord"].alias("ord"),
            m["score"].alias("score"),
            F.arrays_overlap(t["words"], m["rule"]["probe_words"]).alias("shared"),
            F.exists(m["rule"]["signals"], lambda s: F.contains(low, s)).alias("signalled"),
        ),
    )
    lowered = lambda t: F.when(F.size(t["met"]) > 0, bind(F.lower("text"), lambda low: tested(t, low)))
    scored = lambda t: bind(F.struct(t["words"].alias("words"), met(t).alias("met")), lowered)
    if "features" in chunks.columns:
        found = bind(F.struct("words", "features"), scored)
    else:
        found = bind(
            tokens(F.col("text")),
            lambda w: bind(F.struct(w.alias("words"), l2_normalize(hash_features(w)).alias("features")), scored),
        )
    best = Window.partitionBy("doc_id", "category").orderBy(F.col("score").desc(), "page", "idx")
    return (
        chunks.withColumn("_rules", listed).withColumn("_weighed", weighed).select(*SPAN, F.inline(found))
        .withColumn("rank", F.row_number().over(best))
        .where((F.col("rank") <= k) & F.col("shared"))
        .drop("shared")
    )


def candidate_pool(cands: DataFrame) -> DataFrame:
    """Distinct candidate chunks per document, numbered by first appearance."""
    first = F.min(F.struct("ord", "rank", "score")).alias("seen")
    order = Window.partitionBy("doc_id").orderBy("seen.ord", "seen.rank")
    return (
        cands.groupBy(*SPAN)
        .agg(first)
        .withColumn("pool_index", F.row_number().over(order) - 1)
        .select(*SPAN, "pool_index", F.col("seen.score").alias("score"))
    )


def signal_gate(cands: DataFrame) -> DataFrame:
    """Per (document, category) the best-ranked chunk that contains a signal."""
    return (
        cands.where("signalled")
        .groupBy("doc_id", "category")
        .agg(F.min_by(F.struct("ord", "rank", "score", *[c for c in SPAN if c != "doc_id"]), "rank").alias("h"))
        .select("doc_id", "category", "h.*")
    )


def narrow_passage(hits: DataFrame, pages: DataFrame, cats: DataFrame) -> DataFrame:
    """Narrow each hit to the sentence that holds its category's earliest signal.

    The lead-in is clamped to 220 characters and moved to a word start, the
    quote to 320; a hit whose signal cannot be placed keeps its whole chunk. All
    looks are into bounded windows around the signal, so long pages cost no more.
    """
    boundary = rf"[.!?](?:{SPACE}|\z)"
    text = F.col("_text")
    cut = lambda a, n: F.substring(text, a + 1, n)
    lead = lambda s: F.length(s) - F.length(F.ltrim(s, F.lit(SPACE_CHARS)))
    tail = lambda s: F.length(F.rtrim(s, F.lit(SPACE_CHARS)))

    joined = hits.join(
        pages.select("doc_id", "page", *[c for c in ["doc_name"] if c in pages.columns], F.col("text").alias("_text")),
        ["doc_id", "page"],
    ).join(cats.select(F.col("id").alias("category"), "signals"), "category")

    places = bind(
        F.substring(F.lower(text), F.col("start") + 1, F.col("end") - F.col("start")),
        lambda low: F.transform("signals", lambda s: F.position(s, low)),
    )
    first = F.array_min(F.filter(places, lambda p: p > 0))
    steps = joined.withColumn("_pos", first - 1 + F.col("start"))

    pos = F.col("_pos")
    window = F.greatest(pos - LEAD_IN_CHARS - 2, F.lit(0))
    back = F.length(F.regexp_extract(cut(window, pos - window), rf"(?s)\A.*{boundary}", 0))
    begin = F.when(back > 0, window + back).when(window == 0, 0).otherwise(-1)
    word = F.regexp_instr(cut(pos - LEAD_IN_CHARS - 1, F.lit(LEAD_IN_CHARS)), F.lit(SPACE))
    clamped = F.when(word > 0, pos - LEAD_IN_CHARS + word - 1).otherwise(pos)
    steps = steps.withColumn(
        "_from",
        F.when((begin < 0) | (pos - begin > LEAD_IN_CHARS), clamped).otherwise(begin),
    )
    ahead = F.length(
        F.regexp_extract(cut(pos, F.lit(QUOTE_CHARS + 2)), rf"(?s)\A.*?{boundary}", 0)
    )
    # The window's own end only counts as the page's end when it is.
    whole = pos + QUOTE_CHARS + 2 >= F.length(text)
    closed = F.length(
        F.regexp_extract(cut(pos, F.lit(QUOTE_CHARS + 2)), rf"(?s)\A.*?[.!?]{SPACE}", 0)
    )
    found = F.when(whole, ahead).otherwise(closed)
    stop = F.when(
        found > 0, F.col("_from") + tail(cut(F.col("_from"), pos + found - F.col("_from")))
    ).otherwise(F.greatest(F.col("_from"), tail(text)))
    steps = steps.withColumn("_to", stop)
    blanks = lead(cut(F.col("_from"), F.least(F.col("_to") - F.col("_from"), F.lit(LEAD_IN_CHARS + QUOTE_CHARS))))
    steps = steps.withColumn("_from", F.col("_from") + blanks)
    steps = steps.withColumn("_to", F.least(F.col("_to"), F.col("_from") + QUOTE_CHARS))
    return (
        steps.withColumn("start", F.coalesce("_from", "start").cast("int"))
        .withColumn("end", F.coalesce("_to", "end").cast("int"))
        .withColumn("quote", cut(F.col("start"), F.col("end") - F.col("start")))
        .drop("_text", "_pos", "_from", "_to", "signals")
    )


def scan_extractive(
    pages: DataFrame, chunks: DataFrame, cats: DataFrame, k: int = TOP_K
) -> DataFrame:
    """Unrated flags: one per (document, category) whose candidates hold a signal."""
    hits = signal_gate(scan_candidates(chunks, cats, k))
    info = cats.select(F.col("id").alias("category"), "title", "why")
    return narrow_passage(hits, pages, cats).join(info, "category").select(
        "doc_id",
        F.col("ord").alias("pos"),
        "category",
        "title",
        F.lit("info").alias("severity"),
        F.col("why").alias("explanation"),
        F.array(
            F.struct(
                "chunk_id", "doc_id", "page", "start", "end", "quote",
                F.round("score", 4).alias("score"),
            )
        ).alias("sources"),
    )


def scan_judged(pool: DataFrame, findings: DataFrame, cats: DataFrame) -> DataFrame:
    """Flags from model findings, kept only with a known category and a receipt.

    ``findings``: doc_id, pos, category, severity, explanation, citations.
    """
    cited = findings.select(
        "doc_id",
        "pos",
        F.posexplode(valid_citations(F.col("citations"), F.lit(2**31 - 1))).alias("at", "pool_index"),
    ).join(pool, ["doc_id", "pool_index"])
    receipt = F.struct(
        "at", "chunk_id", "page", "start", "end", F.round("score", 4).alias("score")
    )
    sources = cited.groupBy("doc_id", "pos").agg(
        F.sort_array(F.collect_list(receipt)).alias("sources")
    )
    info = cats.select(F.col("id").alias("category"), "title", "why")
    said = strip_space(F.col("explanation"))
    return (
        findings.drop("citations")
        .join(info, "category")
        .join(sources, ["doc_id", "pos"])
        .select(
            "doc_id",
            "pos",
            "category",
            "title",
            F.when(F.col("severity").isin(SEVERITIES), F.col("severity"))
            .otherwise("medium")
            .alias("severity"),
            F.when(F.length(said) > 0, said).otherwise(F.col("why")).alias("explanation"),
            "sources",
        )
    )


def order_flags(flags: DataFrame) -> DataFrame:
    """Flags numbered per document: high, medium, low, info; otherwise as given."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    order = Window.partitionBy("doc_id").orderBy(
        F.when(rank > 0, rank).otherwise(len(SEVERITIES) + 1), "pos"
    )
    return flags.withColumn("flag_no", F.row_number().over(order))


def scan_summary(docs: DataFrame, flags: DataFrame, mode: str = "extractive") -> DataFrame:
    """A line for every document, including those without flags."""
    counted = flags.groupBy("doc_id").agg(F.count("*").alias("n_flags"))
    n = F.coalesce("n_flags", F.lit(0))
    return docs.select("doc_id").join(counted, "doc_id", "left").select(
        "doc_id",
        F.lit(mode).alias("mode"),
        n.alias("n_flags"),
        F.when(n > 0, FOUND_NOTE).otherwise(EMPTY_NOTE).alias("note"),
    )


def scan_prompts(pool: DataFrame, cands: DataFrame, pages: DataFrame, cats: DataFrame) -> DataFrame:
    """Per document: offered categories and the numbered pool excerpts."""
    text = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    quoted = pool.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"]).select(
        "doc_id", "pool_index", text.alias("quote")
    )
    excerpts = F.transform(
        F.sort_array(F.collect_list(F.struct("pool_index", "quote"))),
        lambda e: F.concat(F.lit("[Excerpt "), e["pool_index"].cast("string"), F.lit("]\n"), e["quote"]),
    )
    offered = (
        cands.select("doc_id", F.col("category").alias("id"))
        .distinct()
        .join(cats.select("id", "ord", "hint"), "id")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "id", "hint"))).alias("o"))
    )
    lines = F.transform("o", lambda c: F.concat(F.lit("- "), c["id"], F.lit(": "), c["hint"]))
    return (
        quoted.groupBy("doc_id")
        .agg(F.array_join(excerpts, "\n\n").alias("excerpts"))
        .join(offered, "doc_id")
        .select(
            "doc_id",
            F.concat(
                F.lit("Kinds of risk:\n"), F.array_join(lines, "\n"),
                F.lit("\n\nPassages:\n\n"), "excerpts",
            ).alias("prompt"),
        )
    )
