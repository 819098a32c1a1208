"""Repeated strings around an anchor in op8 are one span, in however many cells of shifts they were compared."""

import random

from meterlake.llm import suffixdedup as X


def test_a_row_for_each_anchor(spark):
    rng = random.Random(5)
    rows, gone = [], {}
    for d in range(3):
        for p in rng.sample(range(400, 3_000), 20):
            for y in rng.sample(range(X.SHIFTS), rng.choice((1, 2, 9, X.SHIFTS))):
                rows.append((d, 7, p << 20 | 336 << 10 | 400, y - y % X.CELL, y))
                gone.setdefault((d, p), set()).update(range(p - y, p - y + X.LENGTH))
    shifts = spark.createDataFrame(rows, "d long, t long, place long, x short, y short")
    # All strings of an anchor hold it, so what they cover has no gap.
    assert sorted((r.d, r.t, r.s, r.e) for r in X.around(shifts).collect()) == sorted((d, 7, min(g), max(g) + 1) for (d, _), g in gone.items())
    assert all(len(g) == max(g) + 1 - min(g) for g in gone.values())
