"""Texts of many megabytes are taken in pieces, with the same result as whole."""

import numpy as np
import pytest

from meterlake.llm import jaccardjoin as J
from meterlake.llm import quality as Q
from meterlake.llm import suffixdedup as X

from test_corpus_ops import brute_cut


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def small_pieces(folder):
    text = open(X.__file__).read().replace("from .", "from meterlake.llm.").replace("BATCH_BYTES = 1 << 19", "BATCH_BYTES = 512")
    assert "BATCH_BYTES = 512" in text
    (folder / "small_suffixdedup.py").write_text(text)
    return str(folder / "small_suffixdedup.py")


def test_suffix_pieces_equal_whole(spark, tmp_path):
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh "), 900))
    texts = ["".join(rng.choice(list("abcdefgh "), 3_000)) for _ in range(4)]
    texts = [t[:k] + passage + t[k:] for t, k in zip(texts, (100, 511, 1_300, 2_999))] + [passage[100:700], texts[0][:399]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(X.cut(docs).collect())
    # Pieces are cut in the workers, where the bound is that of the file: so by a copy of the module with another one.
    spark.sparkContext.addPyFile(small_pieces(tmp_path))
    import small_suffixdedup as S

    assert sorted(S.cut(docs, batches=3).collect()) == whole
    kept, spans = brute_cut(texts, X.LENGTH)
    assert [bytes(r.kept).decode() for r in whole] == [b.decode() for b in kept] and [r.n_spans for r in whole] == spans


@pytest.mark.parametrize("size", [20, 64, 1_000])
def test_pieces_cover_every_window_once(size):
    offsets = np.array([0, 5, 5, 700, 720, 1_500])
    seen = [(lo, at) for lo, hi, begin, end in X.pieces(offsets, size, 9) if hi - lo == 1 for at in range(begin, end - 9)]
    assert len(seen) == len(set(seen)) and {a for r, a in seen if r == 2} >= set(range(5, 691)) or size >= 1_000


def test_shingles_of_pieces_equal_whole(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abC"), 1 + rng.integers(40))) for _ in range(rng.integers(60))) for _ in range(9)]
    whole = J.shingles(*flat(texts))
    from meterlake.llm import hashing as H

    real = H.word_hashes
    monkeypatch.setattr(J, "word_hashes", lambda d, o, w, s: real(d, o, w, s, piece=50))
    assert all((a == b).all() for a, b in zip(whole, J.shingles(*flat(texts))))


def test_a_word_of_megabytes():
    word = "x" * 3_000_000
    one, two = (J.shingles(*flat([f"a {w} b", "c"])) for w in (word, word[:-1] + "y"))
    assert len(one[0]) == 1 and one[0] != two[0] and (one[1] == two[1]).all()


def test_terms_of_pieces_add_up(monkeypatch):
    texts = ["Some words, and some more. " * 40, "short one", ""]
    whole = Q.term_counts(*flat(texts))
    monkeypatch.setattr(Q, "BATCH_BYTES", 27)
    rows = np.concatenate([c for _, _, c in Q.counted(*flat(texts))])
    outline = Q.OUTLINES - 4  # but for outlines across the ends of pieces and a word like the one before
    assert (rows[:, Q.OUTLINES - 4] == whole[:, Q.OUTLINES - 4]).all() and (rows[:, Q.OUTLINES :] == whole[:, Q.OUTLINES :]).all() and (rows[:,
        :outline].sum(axis=1) <= whole[:, :outline].sum(axis=1)).all()
