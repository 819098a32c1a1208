"""Operators on single texts: decontamination, secrets, language, quality, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import decontaminate as D
from meterlake.llm import langid as L
from meterlake.llm import quality as Q
from meterlake.llm import secrets as S

words = st.lists(st.sampled_from(["a", "b", "c"]), max_size=30)


def brute_hits(doc, items, window):
    hit, ids = set(), set()
    for item_id, item in items:
        k = min(len(item), window)
        for j in range(len(item) - k + 1) if k else ():
            for i in range(len(doc) - k + 1):
                if doc[i : i + k] == item[j : j + k]:
                    hit |= set(range(i, i + k))
                    ids.add(item_id)
    return hit, ids


@settings(max_examples=300, deadline=None)
@given(words, st.lists(words, max_size=4), st.integers(1, 6))
def test_automaton_equals_brute_force(doc, texts, window):
    items = [(str(i), [w.encode() for w in t]) for i, t in enumerate(texts)]
    doc = [w.encode() for w in doc]
    spans, ids = D.WordAutomaton(items, window).scan(doc)
    got = {x for s, e in spans for x in range(s, e)}
    assert (got, ids) == brute_hits(doc, items, window)


def test_decontaminate_edge_rows_and_blocks(spark):
    docs = spark.createDataFrame([(1, "x a b c d y", 5), (2, None, 5), (3, "", 5), (None, "A-B c!d", 5), (1, "x a b c d y", 5), (4, "q " * 5000, 5)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(7, "a b c d"), (8, None), (9, "..."), (10, "q r")], "item_id long, text string")
    one = sorted(map(str, D.digest(D.find_hits(docs, bench)).collect()))
    many = sorted(map(str, D.digest(D.find_hits(docs, bench, block_words=2)).collect()))
    assert one == many and len(one) == 6
    rows = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in D.digest(D.find_hits(docs, bench)).collect()}
    assert rows[1, 6] == (4, 1, True) and rows[2, 0] == (0, 0, False) and rows[None, 4] == (4, 1, True) and rows[4, 5000] == (0, 0, False)
    kept = D.clean(docs.select("doc_id", "text"), bench)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4}
    assert D.find_hits(docs.limit(0), bench).count() == 0
    assert all(not r.contaminated for r in D.digest(D.find_hits(docs, bench.limit(0))).collect())
    assert D.cut_spans("one two, three four", [(1, 3)]) == "one  four"


def brute_windows(text, size, bits):
    out = []
    for i in range(len(text) - size + 1):
        w = text[i : i + size]
        h = -sum(w.count(c) / size * math.log2(w.count(c) / size) for c in set(w))
        if h >= bits - 1e-6:
            out.append(i)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("ab01xY", max_size=60), st.integers(2, 12), st.floats(0.3, 2.2))
def test_entropy_windows_equal_brute_force(text, size, bits):
    near = [i for i in range(len(text) - size + 1) for w in [text[i : i + size]] if abs(-sum(w.count(c) / size * math.log2(w.count(c) / size) for c in set(w)) - bits) < 1e-5]
    if near:
        return  # on the edge, floating point decides
    covered = {x for s, e in S.hot_windows(text, size, bits) for x in range(s, e)}
    assert covered == {x for i in brute_windows(text, size, bits) for x in range(i, i + size)}


def test_secret_patterns(spark):
    text = "pass PASSWORD = 'abcd1234' AKIA0123456789AB AKIAX token:abc " + "0a" * 16 + " é password=token=abcdefgh"
    base, both = S.scan(text)
    assert [S.KINDS[k] for _, k, _ in base] == ["assign", "access", "hex", "assign"]
    assert text[base[0][0] : base[0][2]] == "PASSWORD = 'abcd1234" and set(base) <= set(both)
    assert S.scan("token:secret: abcdefghij")[0] == []  # the failing match takes the keyword with it
    assert S.scan("ſecret=abcdefgh1")[0] == []  # letters are ASCII in either case
    assert [S.KINDS[k] for _, k, _ in S.scan("key Zx9Qw7Lm2Kp4Rt8Vb3Nc6Yd1 end")[1]] == ["entropy"]
    assert S.scan("id 123e4567-e89b-12d3-a456-426614174000 and supercalifragilisticexpialidocious")[1] == []
    docs = spark.createDataFrame([(1, None), (2, ""), (3, text), (3, text)], "doc_id long, text string").selectExpr("*", "1 as spans")
    rows = S.find_secrets(docs).collect()
    assert [r.n_assign for r in rows] == [0, 0, 2, 2] and rows[0].spans == ""
    assert S.find_secrets(docs.limit(0)).count() == 0


def brute_phrases(text, train):
    """Longest matches, greedily; an unseen byte is a phrase."""
    count = i = 0
    while i < len(text):
        k = 1
        if text[i : i + 1] in train:
            while i + k < len(text) and text[i : i + k + 1] in train:
                k += 1
        count, i = count + 1, i + k
    return count


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.lists(st.binary(max_size=40), min_size=1, max_size=5))
def test_cross_parsing_equals_brute_force(train, texts):
    train, texts = bytes(97 + b % 4 for b in train), [bytes(97 + b % 5 for b in t) for t in texts]
    a = L.ByteAutomaton(train)
    depth = max(map(len, texts))
    m = np.full((depth, len(texts)), a.width - 1, np.int32)
    for j, t in enumerate(texts):
        m[: len(t), j] = a.symbol[np.frombuffer(t, np.uint8)]
    assert a.phrases(m).tolist() == [brute_phrases(t, train) for t in texts]


def _language(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüé") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    return [" ".join(rng.choice(stems) for _ in range(rng.randint(5, 60))) for _ in range(n)]


def test_language_held_out_accuracy_and_edges(spark):
    rows = [(i * 3 + k, t, lang, 0) for k, lang in enumerate(("aa", "bb", "cc")) for i, t in enumerate(_language(k, 60))]
    rows += [(9001, None, "aa", 0), (9002, "", "bb", 0), (9003, "123 !?", "cc", 0), (9004, rows[0][1] * 200, None, 0), (None, rows[0][1], "aa", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = {r.doc_id: r for r in L.identify(docs, L.train(docs)).collect()}
    good = [out[r[0]].lang_pred == r[2] for r in rows[:180] if out[r[0]].held_out]
    assert len(good) > 20 and np.mean(good) > 0.95
    assert [out[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and out[9004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == 185
    assert {r.lang_pred for r in L.identify(docs, {}).collect()} == {"und"}
    assert L.identify(docs.limit(0), L.train(docs.limit(0))).count() == 0


def test_quality_held_out_and_exact_votes(spark):
    good = _language(5, 80)
    bad = [" ".join(w + "***" for w in t.split()) for t in _language(6, 80)]
    rows = [(i, t) for i, t in enumerate([x for p in zip(good, bad) for x in p])]
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9003, good[0] * 100)], "doc_id long, text string").selectExpr("*", "0 as score")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows] + [(0, None), (9001, 7)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    out = {r.doc_id: r for r in Q.score(docs, model).collect()}
    held = [(out[i].predicted, 1 - i % 2) for i, _ in rows if out[i].held_out]
    assert len(held) > 15 and np.mean([a == b for a, b in held]) > 0.95
    assert out[9001].score == out[9002].score == pytest.approx(float(model["y"].mean())) and out[9003].predicted == 1
    assert {r.score for r in Q.score(docs, Q.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert Q.keep_good(docs, model).columns == docs.columns and Q.score(docs.limit(0), model).count() == 0
    # exact blocked cosine: the same as one product over everything
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in rows])])
    counts = Q.term_counts(data, offsets)
    z = Q._unit(Q.weigh(counts, model["idf"]) @ model["axes"])
    near = z @ model["vectors"].T
    for i in range(0, len(rows), 7):
        top = np.argsort(-near[i], kind="stable")[: Q.NEIGHBOURS]
        w = np.maximum(near[i][top], 0) ** Q.SHARPNESS
        assert Q.vote(counts[i : i + 1], model)[0] == pytest.approx((w * model["y"][top]).sum() / w.sum(), abs=0.05)


def test_word_rule_matches_the_pattern():
    text = "Ab-c9 É_x z\u007f0"
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in D.words_of(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x a b y z"), (3, "q")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b"), (None, "c d"), (7, "y z"), (None, None)], "item_id long, text string")
    for block_words in (400_000, 2):
        rows = {r.doc_id: r for r in D.digest(D.find_hits(docs, bench, block_words=block_words)).collect()}
        assert [(rows[k].n_hit, rows[k].n_items) for k in (1, 2, 3)] == [(4, 1), (4, 2), (0, 0)]
        assert rows[1].items_sha256 == rows[3].items_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].items_sha256 == hashlib.sha256(b"7").hexdigest()


def slow_base(text):
    """The fixed patterns by hand: a scanner without regular expressions."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = ("password", "passwd", "secret", "token", "api_key", "apikey")
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    found, n = [], len(text)

    def run(i, chars):
        while i < n and text[i] in chars:
            i += 1
        return i

    def assigned(i):
        for w in words:
            if low.startswith(w, i):
                j = i + len(w)
                for quote in (1, 0):  # an optional quote is taken if it can be
                    k = j + 1 if quote and j < n and text[j] in "\"'" else j
                    k = run(k, " ")
                    if k < n and text[k] in ":=":
                        k = run(k + 1, " ")
                        for again in (1, 0):
                            m = k + 1 if again and k < n and text[k] in "\"'" else k
                            if m < n and text[m] in value:
                                return m, run(m, value)
        return None

    i = 0
    while i < n:
        hit = assigned(i)
        if hit and hit[1] > hit[0]:
            if hit[1] - hit[0] >= 8:
                found.append((i, 0, hit[1]))
            i = hit[1]
        else:
            i += 1
    for kind, head, chars, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), (2, "", set("0123456789abcdef"), 32)):
        i = 0
        while i < n:
            j = run(i + len(head), chars) if text.startswith(head, i) else i
            if j > i + len(head):
                if j - i >= least:
                    found.append((i, kind, j))
                i = j
            else:
                i += 1
    return sorted(found)


pieces = st.sampled_from(["password", "PassWD", "secret", "token", "api_key", "APIkey", "=", ":", " ", "'", '"', "abc12345", "x", "AKIA", "0123456789AB", "é", "0a1b2c3d" * 4, "-", "ſecret"])


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=14))
def test_base_spans_equal_a_scanner_by_hand(parts):
    text = "".join(parts)
    assert S.base_spans(text) == slow_base(text)


def test_votes_are_exact():
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.2, (40, Q.TERMS)).astype(float)
    vectors = rng.standard_normal((30, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = {"idf": np.ones(Q.TERMS, np.float32), "axes": rng.standard_normal((Q.TERMS, 8)).astype(np.float32), "vectors": vectors.astype(np.float32),
        "y": (rng.random(30) < 0.5).astype(np.float32)}
    got = Q.vote(counts, model)
    for row, score in zip(counts, got):
        z = (Q.weigh(row[None], model["idf"]).astype(np.float64) @ model["axes"].astype(np.float64))[0]
        near = model["vectors"].astype(np.float64) @ (z / np.linalg.norm(z))
        top = sorted(range(30), key=lambda i: -near[i])[: Q.NEIGHBOURS]
        w = [max(near[i], 0) ** Q.SHARPNESS + 1e-9 for i in top]
        assert score == pytest.approx(sum(a * model["y"][i] for a, i in zip(w, top)) / sum(w), abs=1e-5)
    same = Q.vote(np.repeat(counts[:1], 5, axis=0), model)
    assert same == pytest.approx([same[0]] * 5, abs=1e-6)  # ties and repeated rows
