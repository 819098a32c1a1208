"""op9 and the pipeline's near-duplicate stage where an id stands at several texts; op3 on capitals beyond ASCII."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from meterlake.llm import jaccardjoin as J
from meterlake.llm import langid as L


def text(seed, changed=None):
    words = [f"{seed}w{k}" for k in range(80)]
    if changed is not None:
        words[changed] = "other"
    return " ".join(words)


ROWS = [(5, text("a")), (5, text("b")), (3, text("a", 79)), (4, text("b", 79)), (9, text("c")), (9, text("c")), (8, text("d")), (7, None), (7, ""), (None, text("a")), (None, text("d"))]


@pytest.mark.parametrize("layout", [1, 2, 7])
def test_links_of_every_text_of_an_id_hold(spark, layout):
    rows = list(ROWS)
    random.Random(layout).shuffle(rows)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(layout)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in J.join(docs).collect()), key=str)
    want = [(5, 78, 3), (5, 78, 3), (3, 78, 3), (4, 78, 3), (9, 78, 9), (9, 78, 9), (8, 78, 8), (7, 0, 7), (7, 0, 7), (None, 78, None), (None, 78, None)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("layout", [1, 3])
def test_the_pipeline_drops_rows_not_ids(spark, layout):
    rows = [(i, t, "x") for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(layout)
    out = P.unlike(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    # Of (5, a) and (3, a') the latter stays, of (5, b) and (4, b') too; (9, c) once; what has no words stays.
    want = [(3, text("a", 79)), (4, text("b", 79)), (9, text("c")), (8, text("d")), (7, None), (7, ""), (None, text("a")), (None, text("d"))]
    assert kept == sorted(want, key=str)


def test_repeated_rows_with_one_text_take_the_plain_way(spark, monkeypatch):
    monkeypatch.setattr(J, "numbered", lambda *a: pytest.fail("numbered"))
    docs = spark.createDataFrame([(1, text("a")), (1, text("a")), (2, text("a", 0))], "id long, text string")
    assert {(r.id, r.component_id) for r in J.join(docs).collect()} == {(1, 1), (2, 1)}


CAPITALS = {"x": ["ПРИВЕТ", "ДОРОГА", "ГОРОД", "ВЕСНА"], "y": ["ЖИЗНЬ", "ЮНОСТЬ", "ЩУКА", "ФЛАГ"], "z": ["ΛΟΓΟΣ", "ΚΟΣΜΟΣ"]}


def test_capitals_beyond_ascii(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(CAPITALS[lang]) for _ in range(60)), lang) for i, lang in ((k, "xyz"[k % 3]) for k in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = L.train(docs)
    for shown in (docs, docs.withColumn("text", F.lower("text"))):
        assert {(r.doc_id, r.lang_pred) for r in L.identify(shown, taught).collect()} == {(i, lang) for i, _, lang in rows}


def test_choice_and_score_by_hand(spark):
    taught = {"p": b"one two three four five", "q": b"eins zwei drei vier", "r": b"one two drei vier"}
    texts = ["one two", "zwei drei", "three four", "vier drei one", "zzz", "one two drei vier vier two"]

    def cost(text, train):
        """Bits of a greedy parse: the longest piece that occurs in the training text, an unknown byte alone."""
        data, at, n = text.encode(), 0, 0
        while at < len(data):
            end = at + 1
            while end < len(data) and data[at : end + 1] in train:
                end += 1
            at, n = end, n + 1
        return n * float(__import__("numpy").log2(len(train) + 1))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.identify(docs, taught).collect():
        costs = {k: cost(texts[r.doc_id], t) for k, t in taught.items()}
        best = min(sorted(costs), key=costs.get)
        assert r.lang_pred == best
        assert abs(r.score - 1 / sum(2.0 ** -min(c - costs[best], 60) for c in costs.values())) < 1e-9
