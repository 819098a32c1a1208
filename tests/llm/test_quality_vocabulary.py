"""op6 on labels that differ by vocabulary only."""

import random

import numpy as np

from meterlake.llm import quality as Q


def test_labels_that_differ_by_words_only(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(stems[60 * (i % 2) : 60 * (i % 2) + 60]) for _ in range(rng.randint(15, 40)))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    held = [(r.predicted, r.doc_id % 2) for r in Q.score(docs, Q.fit(docs, labels)).collect() if r.held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95


def test_words_make_other_vectors():
    one, two = "buy cheap pills now", "the small fox slept"
    counts = Q.term_counts(np.frombuffer((one + two).encode(), np.uint8), np.array([0, len(one), len(one + two)]))
    assert (counts[0] != counts[1]).any()
