"""Long passages on one or two lines, as the pipeline's line dedup cuts them."""

import corpus_pipeline as P
from meterlake.llm import linededup as L

LONG = " ".join(f"w{i}" for i in range(60))
HALF = [" ".join(f"{c}{i}" for i in range(30)) for c in "xy"]


def test_passages_on_fewer_lines_than_a_window(spark):
    rows = [
        (1, f"a\n{LONG}\nb"), (2, f"c\n {LONG} \nd\ne"), (3, LONG), (4, f"{LONG}\n{LONG}\nz"), (5, "\n".join(["f", *HALF, "g"])), (6, "\n".join([*HALF, "h", "i"])),
        (7, f"{HALF[0]}\nj"), (8, "f\nq\ng"), (9, "a"), (10, None), (11, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(docs, words=L.LONG_WORDS).collect()}
    assert got == dict(rows) | {2: "c\nd\ne", 3: "", 4: "z", 6: "h\ni"}
    assert {r.doc_id: r.text for r in L.dedup_lines(docs).collect()} == dict(rows)  # as the SQL of op5 has it
    assert {r.doc_id: r.text for r in P.once(spark, docs, "").collect()} == {d: t for d, t in got.items() if d != 3}


def test_lines_are_compared_without_spaces_only(spark):
    rows = [(1, "a\nb\nc"), (2, " a\nb  \n c"), (3, "d\ne\nf"), (4, "0d0\n1e\nf2")]
    assert {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == dict(rows) | {2: ""}
