"""Repeated rows in op10: each copy is a candidate and takes a rank of its own."""

import pytest

from meterlake.llm import topk as T


@pytest.mark.parametrize("block", [16_384, 3])
def test_copies_of_the_nearest_row_take_the_ranks(spark, monkeypatch, block):
    monkeypatch.setattr(T, "ROW_BLOCK", block)
    v = {0: [1.0, 0.0], 1: [0.9, 0.1], 2: [0.5, 0.5], 3: [0.1, 0.2]}

    def ranks(*ids):
        x = T.quantised(spark.createDataFrame([(i, v[i]) for i in ids], "vec_id long, embedding array<float>"))
        return [r.vec_id for r in T.top_k(x, x.where("id = 0")).orderBy("rank").collect()]

    assert ranks(0, 1, 1, 1, 1, 1, 1, 2, 3) == [1] * 5
    assert ranks(0, 0, 1, 1, 1, 2, 3, 3) == [1, 1, 1, 2, 3]


def test_query_rows_that_share_an_id_are_all_asked(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9]), (0, [0.0, 1.0])]
    x = T.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in T.top_k(x, x.where("id = 0"), 1).collect():
        got.setdefault(r.query, []).append(r.vec_id)
    assert sorted(map(tuple, got.values())) == [(1,), (2,)]


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BLOCK", 3)
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)]
    x = T.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in T.top_k(x, x.where("id % 5 = 0"), 3).collect()}
    v = {i: [int(256 * e) for e in e_] for i, e_ in rows}
    for q in range(0, 40, 5):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in best]
