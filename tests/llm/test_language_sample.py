"""The training sample of op3: long texts teach, and every sampled row has a share."""

import random

from meterlake.llm import langid as L


def _texts(seed, n, words):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    return [" ".join(rng.choice(stems) for _ in range(words)) for _ in range(n)]


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(i, t, "aa") for i, t in enumerate(_texts(1, 40, 30))] + [(100 + i, t, "bb") for i, t in enumerate(_texts(2, 12, 4_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = L.train(docs)
    assert set(texts) == {"aa", "bb"} and L.SAMPLE_BYTES - 100 < len(texts["bb"]) <= L.SAMPLE_BYTES
    out = {r.doc_id: r.lang_pred for r in L.identify(docs, texts).collect()}
    assert all(out[i] == lang for i, _, lang in rows)


def test_one_long_text_fills_the_sample(spark):
    docs = spark.createDataFrame([(1, _texts(3, 1, 20_000)[0], "cc")], "doc_id long, text string, lang string")
    assert len(L.train(docs)["cc"]) > L.SAMPLE_BYTES - 100


def test_every_row_has_a_share():
    texts = [chr(97 + k) * 7_000 for k in range(20)] + ["zz"]
    got = L.shared_out(texts, range(21))
    assert set(got) == {*range(97, 117), ord("z"), 32} and L.SAMPLE_BYTES - 21 <= len(got) <= L.SAMPLE_BYTES
    assert min(got.count(chr(97 + k).encode()) for k in range(20)) >= 1_500
    assert L.shared_out([], []) == b""
