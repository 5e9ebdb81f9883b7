"""Archives and main text of pages, and the quality views."""

import hashlib
import html
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import extract, quality, warc

from .helpers import documents

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    big, edge = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 200, "y" * 999
    rows = [
        (1, "http://a/ b\r\nX: y", big), (2, None, big), (9, "http://c", big), (3, "u", edge), (4, "u", edge),
        (5, "u", "y" * 1000), (6, "u", "y" * 1000), (7, "u", None), (8, "u", ""), (None, "u", big), (10, "u", "\r\n\r\n"),
    ]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload_digest", F.lit("clash"))
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, per_file=3)
    found = {r["page_id"]: r for r in warc.read_archives(spark, path, payloads=True).collect()}
    assert len(found) == len(rows)
    for page, _, text in rows:
        data, r = (text or "").encode(), found[page]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else data)
    refers = {p: r["refers_to"] for p, r in found.items()}
    assert refers == {1: 9, 2: 9, None: 9, 9: None, 3: None, 4: None, 5: 6, 6: None, 7: None, 8: None, 10: None}
    assert {p for p, r in found.items() if r["record_type"] == "revisit"} == {1, 2, 5, None}
    parts = [f for f in os.listdir(path) if f.startswith("part-")]
    assert all(open(f"{path}/{f}", "rb").read().count(b"WARC-Record-ID") <= 3 for f in parts)


def test_archives_repeated_rows_and_empty(spark):
    rows = [(1, "u", "z" * 2000)] * 2 + [(2, "u", "z" * 2000)] * 2
    found = sorted((r["page_id"], r["record_type"]) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect())
    assert found == [(1, "revisit")] * 2 + [(2, "response")] * 2
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_damaged_archive_is_refused():
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP/1.1 200 OK\r\n\r\n"))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_main_text_equals_the_article(spark):
    """The pages of the table mark their article; the text is its blocks."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    found = {r["page_id"]: r for r in extract.extract(pages, extract.train(pages)).collect()}
    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"<[^>]+>", "", re.sub("<br>", " ", b)) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())
        assert found[r["page_id"]]["text"] == want and found[r["page_id"]]["n_chars"] == len(want)
        assert found[r["page_id"]]["url"] == r["url"]


@pytest.fixture(scope="module")
def model():
    counts = extract.Counter()
    for page in extract.SEEDS:
        counts.update(extract.counted(extract.parse(page), extract.SEED_WEIGHT))
    return extract.Model(counts)


def test_held_out_layouts(model):
    """Layouts that are not among the written ones."""
    para = "<p>Here the text of an unseen page goes on at some length, with a turn or two, until it stops.</p>"
    page = (
        '<body><div class="top-menu"><a href="/">Start</a><a href="/n">News</a></div><div class="post-body"><h1>Head &amp; tail</h1>'
        f'{para * 4}</div><div id="respond"><p>{"I have to say something about this. " * 4}</p></div>'
        '<div class="site-footer"><p>Imprint</p></div><script>var x = "<p>no</p>";</script></body>'
    )
    text = model.extract(page)
    assert text.startswith("Head & tail\nHere the text") and text.count("\n") == 4


_STORY = "<p>Here the text of an unseen page goes on at some length, with a turn or two, until it stops.</p>"


@pytest.mark.parametrize(
    "odd",
    ["<svg width='1'/>", '<svg class="icon" />', "<math/>", "<svg><title/><style/><path d='M0'/></svg>", "<svg><path d='M0'>", "<math>",
     "<object data='x'>", "<select>", "<select><option>One<option>Two</select>", "<noscript>", "<template>", "<OBJECT><svg/>"],
)
def test_odd_elements_do_not_drop_the_rest(model, odd):
    """Self-closed and unclosed elements ahead of an article."""
    page = f'<body><div class="header">{odd}<a href="/">Start</a></div><div class="post-body"><h1>Head</h1>{_STORY * 4}</div></body>'
    text = model.extract(page)
    assert text.startswith("Head\nHere the text") and text.count("Here the text") == 4


def test_formulas_objects_and_noscript_stay(model):
    inside = "".join(
        f"<p>Here the text of the page holds {part}, and goes on at some length after it until it stops.</p>"
        for part in ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "<object data='a'>words of an object</object>", "<noscript>words without scripts</noscript>")
    )
    text = model.extract(f'<body><div class="post-body"><h1>Head</h1>{_STORY * 2}{inside}</div></body>')
    assert all(f"holds {words}, and" in text for words in ("x=2", "words of an object", "words without scripts"))


def test_raw_elements_still_end_at_their_own_tag():
    texts = lambda page: [t for t in extract.parse(page).text if t]
    assert texts("<p>a<script/>if (x < 1) y</script>b</p>") == ["ab"]
    assert texts("<p>a</p><style>p { x: y }") == ["a"]
    assert texts("<p>a<svg><title>icon</title></svg>b<textarea>c</textarea></p>") == ["ab"]
    assert texts("<p>a<svg><path></p><p>b<script/>c</script>d</p>") == ["a", "bd"]


@pytest.mark.parametrize(
    "page", [None, "", "<", "<a <a <a", "</p></div>", "<p", "<!-- open", "<script>", "&#0;&bogus;&#x110000;", "<p>" * 3000, '<a "' * 5000 + ">"]
)
def test_broken_pages_do_not_fail(spark, model, page):
    rows = extract.extract(spark.createDataFrame([(None, None, page)], PAGES), model).collect()
    assert len(rows) == 1 and rows[0]["n_chars"] == len(rows[0]["text"])


def test_marginals_equal_enumeration(model):
    """Sum-product against the sum over all labellings of a small page."""
    tree = extract.parse('<body><div class="content"><p>Some words of a text.</p><p><a href="/">x</a></p></div><nav>y</nav></body>')
    n = len(tree.parent)
    weights = np.zeros((2**n, n + 1))
    for labelling in range(2**n):
        bits = [(labelling >> k) & 1 for k in range(n)]
        total = -60.0 * bits[0]
        for k in range(1, n):
            total += model.turn(tree.kind[k])[bits[tree.parent[k]]][bits[k]] + model.view(tree.seen[k], tree.text[k] is not None)[bits[k]]
        weights[labelling] = [*bits, np.exp(total)]
    want = (weights[:, :n] * weights[:, n:]).sum(axis=0) / weights[:, n].sum()
    assert np.allclose(model.marginals(tree), want, atol=1e-9)


def test_empty_pages(spark, model):
    assert extract.extract(spark.createDataFrame([], PAGES), model).count() == 0
    assert extract.train(spark.createDataFrame([], PAGES)).extract("<p>x</p>") is not None


def _marked(n, seed):
    rng = np.random.default_rng(seed)
    words = ["river", "stone", "under", "lights", "garden", "along", "winter", "paper", "copper", "sail"]
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        own = [words[k] for k in rng.integers(0, 10, rng.integers(20, 120))]
        text = " ".join(own) if good else " ".join(w.upper() + "!!" for w in own[:3]) * 12
        rows.append((i, text + ".", "en" if rng.random() < 0.5 else "de", "a" if good == (rng.random() < 0.8) else "b", len(text), int(good)))
    return rows


def test_quality_on_held_out_labels(spark):
    rows = _marked(1500, 1)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows if r[0] % 3 == 0], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    unseen = [r for r in rows if r[0] % 3]
    assert np.mean([(scores[r[0]] >= quality.REJECT) == bool(r[5]) for r in unseen]) > 0.98
    kept = quality.filter_documents(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= quality.REJECT}


def test_pseudo_labels_help_the_other_view():
    """With few labels, marks of the text view teach the metadata view."""
    rows = _marked(1200, 5)
    x = quality.measures([r[1] for r in rows])
    m = quality.metadata([r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows])
    y = np.array([r[5] if r[0] < 80 else -1 for r in rows])
    held = (y >= 0) & (np.arange(len(y)) % 4 == 0)
    alone, taught = quality.co_train(x, m, y, held, rounds=1), quality.co_train(x, m, y, held, rounds=3)
    truth = np.array([r[5] for r in rows])
    right = [np.mean((model.scores(x, m)[80:, 2] >= 0.5) == truth[80:]) for model in (alone, taught)]
    assert right[1] >= right[0] - 0.01 and right[1] > 0.97
    assert not np.allclose(alone.meta, taught.meta)


def test_quality_without_labels_keeps_all(spark):
    docs = documents(spark, [None, "", "a", "b " * 5000])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.filter_documents(docs, quality.train(docs, none)).count() == 4
    empty = documents(spark, [])
    assert quality.filter_documents(empty, quality.train(empty, none)).count() == 0


def test_quality_nulls_and_repeats(spark):
    rows = [(*r[:2], None, None, None) for r in _marked(300, 2)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), rows[0]], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in _marked(300, 2)] + [(0, None), (None, 1), (1, 0), (1, 1)], "doc_id long, quality int")
    assert quality.score(docs.withColumn("x", F.lit(1)), quality.train(docs, labels)).count() == 302


def test_sums_over_tasks_equal_one_pass(spark):
    """One co-training round: what tasks add up is what all rows give at once."""
    rows = _marked(700, 3)
    docs = spark.createDataFrame(
        [(*r[:5], r[5] if r[0] < 200 else None, r[0] % 4 == 0) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, __y long, __held boolean",
    )
    stored = quality.features(docs.repartition(5), "doc_id", "__y", "__held")
    x, m, y, held = quality._rows(stored.toArrow())
    model = quality.Model(np.stack([quality._edges(x[:, k]) for k in range(quality.MEASURES)]), None, None, [], None)
    designs = lambda x, m: [model.text_design(x), model.meta_design(m)]
    rng = np.random.default_rng(1)
    weights = [rng.normal(size=d.shape[1]) * 0.3 for d in designs(x, m)]
    levels = quality.summed(stored, lambda b: quality.histogram(designs(*quality._rows(b)[:2]), quality._rows(b)[2] < 0, weights).ravel())
    assert np.array_equal(levels.reshape(2, -1), quality.histogram(designs(x, m), y < 0, weights))
    marks = quality.Marks(weights, [(0.2, 0.7), (0.1, 0.8)], [0.3, 0.2])

    def flat(x, m, y, held):
        return np.concatenate([a.ravel() for pair in quality.sums(designs(x, m), y, held, weights, marks) for a in pair])

    assert np.allclose(quality.summed(stored, lambda b: flat(*quality._rows(b))), flat(x, m, y, held), rtol=1e-9, atol=1e-7)
    # Row by row: only labelled rows that are not held and what the other view is sure of pull on a view.
    other = 1 / (1 + np.exp(-designs(x, m)[1] @ weights[1]))
    own = 1 / (1 + np.exp(-designs(x, m)[0] @ weights[0]))
    slope = np.zeros(len(weights[0]))
    for i in range(len(y)):
        if y[i] >= 0 and not held[i]:
            slope += designs(x[i : i + 1], m[i : i + 1])[0][0] * (own[i] - y[i])
        elif y[i] < 0 and (other[i] >= 0.8 or other[i] < 0.1):
            slope += 0.2 * designs(x[i : i + 1], m[i : i + 1])[0][0] * (own[i] - (other[i] >= 0.8))
    assert np.allclose(quality.sums(designs(x, m), y, held, weights, marks)[0][0], slope)


def test_cuts_mark_the_surest_and_no_more_than_asked():
    levels = np.zeros(quality.LEVELS)
    levels[[999, 980, 960, 500, 20, 3]] = [10, 30, 100, 500, 40, 10]
    (low, high), n = quality.cuts(levels, 0.5, 0.2)
    assert (low, high) == (0.05, 0.961) and n == 90
    assert quality.cuts(levels, 0.5, 0.0)[1] <= 1


_ODD = [
    ("<p title=it's>{}</p>", 1), ('<p class="x"">{}</p>', 1), ("<p title=a<b>{}</p>", 1), ("<!--><p>{}</p>", 1), ("<!---><p>{}</p>", 1),
    ("<!-- no --!><p>{}</p>", 1), ("<p>{}</3></p>", 1), ('<a title="x > y"></a><p>{}</p>', 1), ("<p a= \"b>c\" d>{}</p>", 1),
]


@pytest.mark.parametrize("markup, _", _ODD)
def test_odd_markup_is_neither_text_nor_loss(model, markup, _):
    words = "Here the text of an unseen page goes on at some length, with a turn or two, until it stops."
    page = f'<body><div class="post-body"><h1>Head</h1>{_STORY}{markup.format(words)}{_STORY}</div></body>'
    assert model.extract(page) == "\n".join(["Head", *[words] * 3])


def test_head_ends_where_the_parser_says(model):
    texts = lambda page: [t for t in extract.parse(page).text if t]
    assert texts('<head><script>"</head>"</script><title>x</title></head><body>b') == ["b"]
    assert texts("<html><head><meta><p>words</p>") == ["words"] and texts("<head>words<p>x") == ["words", "x"]


def test_page_sample_does_not_depend_on_order(spark):
    pages = [(i, "u", f"<article><h1>T{i}</h1>{_STORY * (i % 3 + 1)}</article><div class='c{i % 7}'><p>x{i}</p></div>") for i in range(300)]
    one = extract.train(spark.createDataFrame(pages, PAGES), labelled=40)
    two = extract.train(spark.createDataFrame(pages[::-1], PAGES).repartition(7), labelled=40)
    assert one.counts == two.counts
    seeds = extract.train(spark.createDataFrame([], PAGES)).counts
    assert one.counts["article|0|1"] - seeds["article|0|1"] == 40


def test_archives_by_size_and_payloads_in_place(spark, tmp_path):
    big = ["x" * (3 << 20) + str(i) for i in range(4)]
    rows = [(i, "u", big[i % 4]) for i in range(8)] + [(100 + i, "u", "s" * (i % 50)) for i in range(300)] + [(900, "u", "y" * 5000), (901, "u", "y" * 5000)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, file_bytes=4 << 20)
    parts = [f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")]
    assert max(os.path.getsize(f) for f in parts) < 4 << 20
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect()}
    want = {i: ("response", None) for i, _, _ in rows} | {i: ("revisit", i + 4) for i in range(4)} | {900: ("revisit", 901)}
    assert found == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _, responses, _ = warc.resolve(pages.coalesce(3))
        plan = responses._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Only rows that both filters let through are ever exchanged with their payload.
    assert plan.count("Union") == 1

