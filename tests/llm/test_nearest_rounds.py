import random

import pytest

from meterlake.llm import jaccardjoin


def components(texts):
    words = {i: t.split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in words.items()}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[a] < least[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    least[b] = least[a]
                    changed = True
    return least


@pytest.mark.parametrize(("kind", "most"), [("chains", 0), ("copies", 1)])
def test_nearest_pairs_are_asked_for_only_while_many_are_open(spark, monkeypatch, kind, most):
    monkeypatch.setattr(jaccardjoin, "LARGE", 2)
    monkeypatch.setattr(jaccardjoin, "ANCHORS", 1)
    rnd = random.Random(5)
    texts, rounds, stored = {}, [], jaccardjoin.stored
    for c in range(3):
        line = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
        for i in range(30):
            # Windows of a line, of which only neighbours link; or one text with a word of its own in each.
            texts[100 * c + i] = " ".join(line[3 * i : 3 * i + 102] if kind == "chains" else [*line[:200], f"own{i}", *line[200:]])
    verified = jaccardjoin.verified
    asked = []
    monkeypatch.setattr(jaccardjoin, "verified", lambda *a: asked.append(1) or verified(*a))
    monkeypatch.setattr(jaccardjoin, "stored", lambda df, name, *by: rounds.append(name) or stored(df, name, *by))
    found = jaccardjoin.join(spark.createDataFrame(list(texts.items()), "id long, text string")).collect()
    assert {r.id: r.component_id for r in found} == components(texts)
    assert "jaccard-near" in rounds or most
    # Those by anchors and those opened in full, besides the rounds.
    assert len(asked) - 2 <= most
