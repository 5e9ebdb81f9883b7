from pyspark.sql import functions as F

from quire.operators import chunking, scan
from tests.conftest import pages


def candidates(spark, df, cats=None):
    return scan.scan_candidates(chunking.chunk_documents(df), cats or scan.categories(spark))


def findings(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id string, pos int, category string, severity string, explanation string, citations array<double>"
    )


def test_lease_flags_quote_the_page(spark, lease):
    flags = scan.scan_extractive(lease, chunking.chunk_documents(lease), scan.categories(spark)).collect()
    found = {f["category"] for f in flags}
    assert {"fees_penalties", "cancellation"} <= found
    text = {r["page"]: r["text"] for r in lease.collect()}
    for f in flags:
        assert f["severity"] == "info" and len(f["sources"]) == 1
        s = f["sources"][0]
        assert text[s["page"]][s["start"] : s["end"]] == s["quote"]


def test_nothing_to_flag_still_gets_a_line(spark, lease):
    calm = pages(spark, "calm", [
        "The sky is blue on a clear day. Water is wet. Birds tend to sing at dawn, and the grass "
        "turns green after rain."
    ])
    both = lease.unionByName(calm)
    flags = scan.scan_extractive(both, chunking.chunk_documents(both), scan.categories(spark))
    lines = {r["doc_id"]: r for r in scan.scan_summary(both.select("doc_id").distinct(), flags).collect()}
    assert lines["calm"]["n_flags"] == 0 and lines["calm"]["note"] == scan.EMPTY_NOTE
    assert lines["lease"]["n_flags"] > 0 and lines["lease"]["note"] == scan.FOUND_NOTE


def test_judged_findings_need_a_category_and_a_receipt(spark, lease):
    pool = scan.candidate_pool(candidates(spark, lease))
    rows = [
        ("lease", 0, "fees_penalties", "low", "", [0.0]),
        ("lease", 1, "fees_penalties", "sideways", " costs ", [1.0, 0.0, 1.0]),
        ("lease", 2, "cancellation", "high", "x", [99.0, -1.0]),
        ("lease", 3, "made_up", "high", "x", [0.0]),
        ("lease", 4, "arbitration", "high", "y", [2.0]),
    ]
    flags = scan.order_flags(scan.scan_judged(pool, findings(spark, rows), scan.categories(spark)))
    got = flags.orderBy("flag_no").collect()
    assert [f["severity"] for f in got] == ["high", "medium", "low"]
    assert got[1]["explanation"] == "costs" and [s["at"] for s in got[1]["sources"]] == [0, 1]
    assert got[2]["explanation"] == scan.CATEGORIES[1][5]


def loop_passage(text, start, end, signals):
    """The passage rule by plain loops over the whole page."""
    import re

    boundary = re.compile(r"[.!?](?:\s|$)")
    low = text.lower()
    places = [low.find(s, start, end) for s in signals]
    places = [p for p in places if p != -1]
    if not places:
        return start, end
    at = min(places)
    begin = max([m.end() for m in boundary.finditer(text, 0, at)], default=0)
    if at - begin > 220:
        begin = next((i for i in range(at - 220, at) if text[i - 1].isspace()), at)
    stop = boundary.search(text, at)
    stop = stop.end() if stop else len(text)
    lead = len(text[begin:stop]) - len(text[begin:stop].lstrip())
    begin += lead
    stop = begin + len(text[begin:stop].rstrip())
    return begin, min(stop, begin + 320)


def test_passage_rule_on_many_shapes(spark):
    filler = "word " * 90
    texts = [
        "Short. The fee is due. Next.",
        "Heading fee without stops " + filler,
        filler + "fee now",
        filler + ". " + "fee " * 200 + ". End.",
        "a" * 500 + "fee" + "b" * 500,
        "Ends here fee",
        "Stop.fee glued. And on",
        "One. Two!  \n fee   \n\n ",
        "fee" + " " * 700,
        "no signal at all. None.",
        "x. fee\ny? fee. z",
        filler + "! " + "q" * 219 + " fee. " + filler,
        filler + "! " + "q" * 216 + " fee. " + filler,
        filler + "! " + "q" * 215 + " fee. " + filler,
        "fee " + "w" * 316 + ". Tail.",
        "fee " + "w" * 317 + ". Tail.",
        "fee " + "w" * 318 + ".",
        "fee " + "w" * 319 + ".",
    ]
    df = pages(spark, "d", texts)
    hits = spark.createDataFrame(
        [("d", i + 1, "c", f"d:{i + 1}:0", 0, len(t), 0.5) for i, t in enumerate(texts)],
        "doc_id string, page int, category string, chunk_id string, start int, end int, score double",
    )
    cats = scan.category_table(spark, [("c", "C", "fee", "h", ["fee", "late"], "w")])
    for r in scan.narrow_passage(hits, df, cats).collect():
        text = texts[r["page"] - 1]
        assert (r["start"], r["end"]) == loop_passage(text, 0, len(text), ["fee", "late"]), r["page"]
        assert r["quote"] == text[r["start"] : r["end"]]


def test_prompts_list_pool_and_categories(spark, lease):
    cands = candidates(spark, lease)
    made = scan.scan_prompts(scan.candidate_pool(cands), cands, lease, scan.categories(spark)).collect()
    assert len(made) == 1 and "[Excerpt 0]\n" in made[0]["prompt"]
    assert "- fees_penalties: " in made[0]["prompt"]


def test_features_are_made_once_for_a_chunk(spark):
    pages_ = spark.createDataFrame([("d", 1, "A late fee is due. We may cancel.")], "doc_id string, page int, text string")
    found = scan.scan_candidates(chunking.chunk_documents(pages_), scan.categories(spark), min_relevance=0.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Lines of the plan that hash tokens next to the chunk's offsets; the others are of the categories.
    assert sum("md5(" in line and "probe#" not in line for line in plan.split("\n")) == 1
    assert {r["category"] for r in found.where("signalled").collect()} == {"fees_penalties", "cancellation"}


def test_prompts_score_the_chunks_once(spark, tmp_path):
    from quire.plans.scan_queries import QUERIES

    docs = spark.createDataFrame([(i, "The license is given as is.\n\nontion costs $ 5.") for i in range(4)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    prompts = QUERIES["scan_prompts"][0](spark, str(tmp_path))
    assert "regexp_extract_all" not in prompts._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"] for r in prompts.collect()} == {0, 1, 2, 3}


def test_scores_look_only_at_buckets_of_the_categories(spark, lease):
    found = candidates(spark, lease)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "_weighed" in plan
    # A chunk's length is summed once, not once to test it and again to take its root.
    assert str(scan.l2_normalize(F.col("f"))).count("sqrt") == 1
    text = {r["chunk_id"]: r["text"] for r in chunking.chunk_documents(lease).collect()}
    probes = {c[0]: c[2] for c in scan.CATEGORIES}
    pair = spark.createDataFrame([(r["score"], text[r["chunk_id"]], probes[r["category"]]) for r in found.collect()], "score double, a string, b string")
    vector = lambda c: scan.dense_vector(scan.l2_normalize(scan.hash_features(scan.tokens(F.col(c)))))
    dot = F.aggregate(F.zip_with(vector("a"), vector("b"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = pair.select("score", dot.alias("dot")).collect()
    assert rows and all(abs(r["score"] - r["dot"]) < 1e-9 for r in rows)
