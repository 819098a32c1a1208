"""Columns of documents named like what an operator or a stage adds."""

import pytest

import corpus_pipeline as P
from meterlake.llm import linededup as L
from meterlake.llm import mixing as M

LINES = "one\ntwo\nthree"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LINES, "a"), (2, f"zero\n{LINES}", "a"), (3, None, None), (None, "", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as N_lines", "5 as n_removed", "7 as copies",
        "8 as places", "9 as spans", "1 as __d", "2 as row", "3 as b", "4 as `a.b`")


def test_line_dedup(spark, docs):
    rows = {r.doc_id: r for r in L.dedup_lines(docs).collect()}
    assert rows[2].text == "zero" and rows[2].n_removed == 3 and rows[2].n_lines == 4 and rows[2]["a.b"] == 4
    once = P.once(spark, docs, "")
    assert once.columns == docs.columns
    assert {(r.doc_id, r.text, r.N_lines, r.n_removed) for r in once.collect()} == {(1, LINES, "x", 5), (2, "zero", "x", 5), (3, None, "x", 5), (None, "", "x", 5)}


def test_mixing(docs):
    out = M.mix(docs)
    assert out.columns == [*(c for c in docs.columns if c != "copies"), "copies"]
    assert all(r.places == 8 and r.row == 2 and r.copies >= 1 for r in out.collect())


def test_decontamination(spark, docs, tmp_path):
    spark.createDataFrame([(None, "two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.clean(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {3, None}
