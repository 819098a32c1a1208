"""The pipeline's stages, each on its own input, and its edges."""

import random

import corpus_pipeline as P
from meterlake.llm import queries


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    good = [text(rng, 60) for _ in range(40)]
    bad = [" ".join(w + "***" for w in text(rng, 60).split()) for _ in range(20)]
    item = text(rng, 20)
    run = "\n".join(text(rng, 12) for _ in range(4))
    near = good[0].split()
    near[-1] = "changed"
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, t) for i, t in enumerate(bad)]
    rows += [(200, " ".join(near)), (201, item + " tail"), (202, text(rng, 600) + " " + item), (203, run + "\nfirst own"), (204, "own line\n" + run),
        (205, run), (206, None), (207, ""), (None, good[1])]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, tokens int")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(20)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stage = dict(P.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = ids(stage["quality classifier"](spark, docs, d))
    assert not kept & set(range(100, 120)) and kept >= set(range(40))
    once = {r.doc_id: r for r in stage["line dedup"](spark, docs, d).collect()}
    assert once[204].text == "own line" and once[203].text.endswith("first own") and 205 not in once and once[204].n_chars == 8 and once[206].text is None
    unlike = ids(stage["n-gram Jaccard join"](spark, docs, d))
    assert 200 not in unlike and unlike >= set(range(40)) | {206, 207, None}
    clean = {r.doc_id: r for r in stage["benchmark decontamination"](spark, docs, d).collect()}
    assert 201 not in clean and item not in clean[202].text and clean[0].text == good[0]
    mixed = stage["mixing sources"](spark, docs, d)
    assert mixed.count() == len(rows) and mixed.columns == [*docs.columns, "copies"]
    for name, f in P.STAGES[:-1]:
        assert f(spark, docs.limit(0), d).columns == docs.columns, name
    out = P.run(spark, d)
    assert ids(out) >= set(range(1, 40)) and not ids(out) & {200, 201, 205}


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
