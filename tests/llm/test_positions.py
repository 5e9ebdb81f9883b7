"""Benchmark windows against plain search over all places."""

import hashlib
import random
import re

from quire.llm import positions

from .helpers import documents

ITEMS = "item_id string, text string"


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(items, width=10):
    out = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            out.setdefault(tuple(w[i : i + width]), set()).add(item or "")
    return out


def plain(texts, items, width=10):
    known = windows(items, width)
    sizes = {len(w) for w in known}
    out = []
    for i, text in texts:
        w, hit, named = split(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                found = known.get(tuple(w[at : at + n]))
                if found:
                    hit.update(range(at, at + n))
                    named |= found
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(named), sha, bool(hit)))
    return sorted(out, key=str)


def got(spark, texts, items, width=10):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = positions.contaminated(docs, spark.createDataFrame(items, ITEMS), width).collect()
    return sorted(map(tuple, rows), key=str)


def some(rng, n, words="abcdefgh"):
    return " ".join(rng.choice(words) for _ in range(n))


def test_equals_plain_search(spark):
    rng = random.Random(2)
    vocabulary = [a + b for a in "abcdefghij" for b in "klmnop"]
    items = [(str(i), some(rng, rng.choice([3, 9, 10, 11, 40, 75, 130, 300]), vocabulary)) for i in range(40)]
    texts = []
    for i in range(300):
        w = some(rng, rng.randint(0, 200), vocabulary).split()
        for _ in range(rng.randint(0, 3)):
            source = split(rng.choice(items)[1])
            at, n = rng.randrange(len(source)), rng.randint(5, 90)
            where = rng.randint(0, len(w))
            w[where:where] = [x.upper() for x in source[at : at + n]]
        texts.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    assert got(spark, texts, items) == plain(texts, items)


def test_few_words_overlapping_windows_and_ties(spark):
    """With a vocabulary of two words no term is rare and windows overlap themselves."""
    rng = random.Random(3)
    items = [("x", "a a a a a a a a a a a a"), ("y", some(rng, 14, "ab")), ("z", some(rng, 4, "ab")), ("w", "a")]
    texts = [(i, some(rng, rng.randint(0, 60), "ab")) for i in range(120)] + [(500, "a " * 400), (501, "b " * 300)]
    assert got(spark, texts, items, 4) == plain(texts, items, 4)
    assert got(spark, texts, items) == plain(texts, items)


def test_edges(spark):
    items = [("1", "One two three"), ("2", None), ("3", " .,"), (None, "eins zwei drei vier"), ("1", "four five"), ("5", "été 中文")]
    texts = [
        (1, None), (1, "one, TWO\tthree"), (1, "one two three"), (1, "one two three"), (None, "four-five"), (None, None), (2, ""),
        (3, "x" * 300_000), (4, "one two " * 50_000 + "three"), (5, "eins zwei drei vier"), (6, "été 中文"), (7, "été 中文"),
        (8, "one\x00two\x7fthree"),
    ]
    assert got(spark, texts, items) == plain(texts, items)


def test_copies_and_a_hot_passage(spark):
    rng = random.Random(5)
    passage = some(rng, 60, [f"w{i}" for i in range(300)])
    texts = [(i, f"start {passage} end") for i in range(400)] + [(400 + i, f"{i} {passage[: 100 + i]}") for i in range(100)]
    items = [(str(i), passage) for i in range(50)]
    assert got(spark, texts, items) == plain(texts, items)


def test_empty_tables_and_clashing_columns(spark):
    docs = documents(spark, ["one two three", "four"])
    none = spark.createDataFrame([], ITEMS)
    assert [r["n_hit"] for r in positions.contaminated(docs, none).collect()] == [0, 0]
    assert positions.contaminated(docs.limit(0), spark.createDataFrame([("1", "one")], ITEMS)).count() == 0
    clash = spark.createDataFrame([(1, "one two", 5, "seg")], "doc_id long, text string, uid int, words string")
    rows = positions.contaminated(clash, spark.createDataFrame([("1", "two", 3)], ITEMS + ", seg int")).collect()
    assert [(r["doc_id"], r["n_hit"]) for r in rows] == [(1, 1)]
    left = positions.clean_documents(clash, spark.createDataFrame([("1", "three", 3)], ITEMS + ", seg int"))
    assert left.columns == clash.columns and left.count() == 1


def test_near_matches(spark):
    """Rarest terms within ``slack`` of their places, counted from the rarest one."""
    items = [("1", "the red fox and the blue owl and the cat"), ("2", "lone word")]
    common = [(100 + i, "the and the and red blue") for i in range(5)]
    texts = [
        (1, "the red fox and the blue owl and the cat"), (2, "the red fox and the very blue owl and the cat"),
        (3, "fox owl cat"), (4, "the red fox and the blue owl and then at last with great care the cat"), (5, "a lone old word"), *common,
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, ITEMS)

    def near(slack):
        return {(r["doc_id"], r["item"]) for r in positions.near(docs, bench, slack).collect()}

    # The rarest three of the first item are fox, owl and cat.
    assert near(0) == {(1, "1")}
    assert near(1) == {(1, "1"), (2, "1"), (5, "2")}
    assert near(6) == {(1, "1"), (2, "1"), (5, "2"), (4, "1")}


def test_is_native(spark):
    plan = positions.contaminated(documents(spark, ["a b", "c"]), spark.createDataFrame([("1", "a b")], ITEMS))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
