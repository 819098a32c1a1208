"""Operators over whole tables, against brute force on small fixtures."""

import itertools
import math
import random

import numpy as np
import pytest

from meterlake.llm import components as C
from meterlake.llm import jaccardjoin as J
from meterlake.llm import linededup as L
from meterlake.llm import mixing as M
from meterlake.llm import suffixdedup as X
from meterlake.llm import topk as T
from meterlake.llm import urlfilter as U


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(17)] + [(200, 200 + i) for i in range(1, 9)]
    df = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
    got = {r.node: r.component for r in C.connected(df).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert C.connected(df.limit(0)).count() == 0


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    rows = [
        (1, "http://a.com/de/x", None), (2, "http://b.net/1#f", link.format("http://a.com/de/x")), (3, "http://c.net/2", refresh.format("http://b.net/1")),
        (4, "http://d.org/y", link.format("http://b.net/1")), (5, "https://Sub.EXAMPLE.org/en/12?q", None), (6, None, None), (7, "nothing", link.format("http://a.com/de/x")),
        (8, "http://e.net/q/p?z", link.format("../r")), (9, "http://com/fr/", ""), (10, "http://xcom/fr/", None),
            (2, "http://b.net/1#f", link.format("http://a.com/de/x")), (11, "http://f.net", link.format("/k")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as rule", "'y' as host")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages).collect()}
    assert got[1] == ("a.com", "/de/x", "com/de/", "block") and got[2] == ("b.net", "/1", None, "block") and got[3][3] == "block"
    assert got[4] == ("d.org", "/y", "org/", "allow")  # an allowed alias stays allowed
    assert got[5] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[9][2:] == ("com/fr/", "allow") and got[10][2] is None
    assert U.judge(pages).count() == len(rows) and U.judge(pages.limit(0)).count() == 0
    more = spark.createDataFrame([("http://xcom/fr/", "http://a.com/de/z")], "a string, b string")
    assert {r.page_id for r in U.judge(pages, more).where("verdict = 'block'").collect()} >= {10, 2, 3}


def brute_lines(docs, window):
    seen, gone = {}, {k: set() for k in range(len(docs))}
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    for k in order:
        lines = [x.strip(" ") for x in docs[k][1].split("\n")] if docs[k][1] is not None else []
        for i in range(len(lines) - window + 1):
            key = tuple(lines[i : i + window])
            if key in seen:
                gone[k] |= set(range(i, i + window))
            seen.setdefault(key, (k, i))
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) if t is not None else None for k, (_, t) in enumerate(docs)]


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice(["a", "b ", "c", ""]) for _ in range(rng.randrange(12)))) for i in range(60)]
    docs += [(900, None), (901, ""), (None, "q\nr\ns\nt"), (902, "x\nq\nr\ns"), (903, "n\n" * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as n_lines0", "1 as d", "2 as starts")
    rows = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    assert [rows[d].text for d, _ in docs] == brute_lines(docs, L.WINDOW)
    assert rows[900].n_lines == 0 and rows[903].n_removed > 0 and rows[5].d == 1
    assert L.dedup_lines(df.limit(0)).count() == 0


def brute_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    where = {}
    for k, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((k, i))
    gone = [np.zeros(len(b), bool) for b in raw]
    for found in where.values():
        if len(found) > 1:
            for k, i in found:
                gone[k][i : i + length] = True
    return [bytes(x for x, g in zip(b, m) if not g) for b, m in zip(raw, gone)], [int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()) for m in gone]


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (60, 110, 130, 200)]
    texts = []
    for k in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut : cut + rng.randint(350, 700)], word()]
        texts.append(" ".join(parts))
    texts += [None, "", "z" * 399, "ab" * 700, texts[0], "é" * 500, passage[3], passage[3][:-1]]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    kept, spans = brute_cut(texts, X.LENGTH)
    rows = {r.doc_id: r for r in X.cut(df).collect()}
    assert [bytes(rows[i].kept) for i in range(len(texts))] == kept
    assert [rows[i].n_spans for i in range(len(texts))] == spans
    twice = df.where("doc_id in (1, 2)").union(df.where("doc_id in (1, 41)"))
    assert {(r.doc_id, r.n_bytes == r.n_removed) for r in X.cut(twice).collect()} >= {(1, True), (41, True)}
    assert X.cut(df.limit(0)).count() == 0


def brute_sets(texts, words):
    out = []
    for t in texts:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()]
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, words, num):
    rng = random.Random(words)
    base = [[str(rng.randrange(400)) for _ in range(rng.choice([4, 40, 120]))] for _ in range(14)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 7)):
            w = list(b)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = str(rng.randrange(400))
            texts.append(" ".join(w))
    texts += [None, "", "  ", "One", "oNE", "two words", "Two  words", texts[0], " ".join(["long"] + [str(i) for i in range(20000)]), "same same same same same same"]
    sets = brute_sets(texts, words)
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = roots(range(len(texts)), links)
    df = spark.createDataFrame([*enumerate(texts), (None, "a null id")], "id long, text string")
    rows = {r.id: (r.n_shingles, r.component_id) for r in J.join(df, words, num).collect()}
    assert {i: rows[i] for i in want} == {i: (len(sets[i]), want[i]) for i in want} and rows[None][1] is None
    assert len(links) > 10


def test_divide_skip_and_filters():
    rng = random.Random(2)
    for _ in range(200):
        universe = np.sort(np.array(rng.sample(range(1 << 40), 80), np.uint64))
        sets = [np.sort(np.array(rng.sample(universe.tolist(), rng.randint(1, 80)), np.uint64)) for _ in range(12)]
        link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b))
        want = [k for k, s in enumerate(sets[1:]) if link(sets[0], s)]
        assert J.t_occurrence(sets[0], sets[1:], 60) == want
        pairs = {frozenset((i, int(j))) for i, js in J.may_link(np.array([len(s) for s in sets]), [J.bitmap(s) for s in sets], 60) for j in js}
        assert all(frozenset((i, j)) in pairs for i, j in itertools.combinations(range(12), 2) if link(sets[i], sets[j]))
        common = np.sort(universe[::3])
        prefixes = [set(J.prefix_of(s, common, 60).tolist()) for s in sets]
        assert all(prefixes[i] & prefixes[j] for i, j in itertools.combinations(range(12), 2) if link(sets[i], sets[j]))


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "FEW", 8)
    monkeypatch.setattr(T, "ROW_BLOCK", 150)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8)).astype(np.float32) * 0.3
    v[50:60] = v[50]
    rows = [(i, x.tolist(), "r") for i, x in enumerate(v)] + [(1000, None, "r"), (1050, [1.0, None], "r"), (1100, [float("nan")] * 8, "r"), (1150, [], "r"),
        (None, [1.0] * 8, "r"), (1200, [0.5, 0.25], "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    x = T.quantised(df)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in T.top_k(x, x.where("id % 50 = 0")).collect()}
    q = np.floor(256 * np.concatenate([v.astype(float), [[0.5, 0.25, 0, 0, 0, 0, 0, 0]]])).astype(int)
    ids = [*range(400), 1200]
    for a, i in enumerate(ids):
        if i % 50 == 0:
            best = sorted(((-int(q[a] @ q[b]), j) for b, j in enumerate(ids) if j != i))[:5]
            assert [got[i, r + 1] for r in range(5)] == [(j, -s) for s, j in best]
    assert len(got) == 45 and T.top_k(x.limit(0), x.limit(0)).count() == 0
    assert T.top_k(x.where("id < 3"), x.where("id = 0")).count() == 2


def test_exponent_and_budgets():
    tokens = {"a": 1000, "b": 10, "c": 100, "d": 0}
    a = M.solve(tokens, max_repeats=4)
    assert (1000 / 10) ** (1 - a) == pytest.approx(4, rel=1e-9)  # repeats of the scarcest are (max/min)**(1-a)
    e = M.solve(tokens, max_repeats=1e9, target_entropy=0.8)
    assert M.entropy(M.weights_at(tokens, e)) == pytest.approx(0.8, abs=1e-9)
    assert M.solve({"a": 5, "b": 5}) == 0.0 and M.solve({}) == 1.0
    take = M.allotted(tokens, 4)
    assert take["a"] == 1000 and take["b"] == 40 and take["d"] == 0 and math.isclose(take["c"] / 100, 10 ** (1 - a), rel_tol=0.01)


def test_mixing_realises_the_weights(spark):
    rng = random.Random(9)
    rows = [(i, None if i % 11 == 0 else f"s{i % 3}" if i % 2 else "s0", " ".join(["w"] * rng.randint(0, 9)) if i % 17 else None, 1) for i in range(600)]
    rows += [(7, "s1", "w w", 1), (7, "s1", "w w", 1), (None, "s2", " a\t\nb ", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, passes int")
    for block in (4096, 8):  # one level of sums, and several
        out = M.mix(df, block_docs=block).collect()
        tokens, got, seen = {}, {}, {}
        for d, s, t, _ in rows:
            n = len((t or "").split())
            tokens[s] = tokens.get(s, 0) + n
        for r in out:
            got[r.source] = got.get(r.source, 0) + len((r.text or "").split()) * r.copies
            seen.setdefault(r.source, set()).add(r.copies)
        want = M.allotted({str(s): n for s, n in tokens.items()})
        assert len(out) == len(rows) and all(0 <= got[s] - want[str(s)] <= 20 for s in tokens)
        assert all(max(c) - min(c) <= 1 for c in seen.values())
    few = M.mix(df, budget=300).collect()
    assert sum(len((r.text or "").split()) * r.copies for r in few) < 300 + 4 * 20
    assert M.mix(df.limit(0)).count() == 0
    assert [r.tokens for r in M.with_tokens(df.limit(3)).collect()] == [len((t or "").split()) for _, _, t, _ in rows[:3]]
