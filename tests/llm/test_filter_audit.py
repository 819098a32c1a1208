"""op12: every order applied filter by filter to whole tables, against the shared trie."""

import re
from itertools import permutations

import duckdb
import pytest

from meterlake.llm import filteraudit as A

WORDS = " ".join(f"w{k}" for k in range(60))
TEXTS = [
    None, "", " \t\n", WORDS, WORDS, WORDS, WORDS.upper(), WORDS.upper() + " $", "a " * 80, "A " * 80, "a# " * 80, "short", "Short %", "SHORT", "short",
    WORDS + " é" * 90, WORDS + "\x0bX|", "\xa0".join("ab" * 60), "x" * 200_000, "ABC " * 50_000,
]
DOCS = [(i if i != 7 else None, t, [None, "", "s1", "s2"][i % 4], 1, "x") for i, t in enumerate(TEXTS)] + [(4, WORDS, "s1", 1, "y"), (-5, "short", "s3", 1, "y")]
LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 20, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]


def brute():
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, t in LABELS if t == 1 and i is not None}
    docs = []
    for i, text, part, *_ in DOCS:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any((u or "") == t and j is not None and j < i for j, u, *_ in DOCS),
        }
        docs.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(d[1][f] for d in mine) - len(gone),
                    sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    for part, order, k in list(out):
        f = order[k - 1]
        out[part, order, k].append(sum(v[1] for (p, o, j), v in out.items() if p == part and o[j - 1] == f))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("audit")
    spark.createDataFrame(DOCS, "doc_id long, text string, source string, part int, good string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at)


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_every_order_by_hand_and_by_sql(spark, tables):
    df = A.op12_filteraudit(spark, tables)
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in df.collect()}
    assert got == brute() and len(got) == 600 * 4
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    rows = con.execute(f"SELECT part, filter_order, step, {', '.join(COLUMNS)} FROM ({A.OP12_SQL})").fetchall()
    assert {r[:3]: list(r[3:]) for r in rows} == got
    assert dict(df.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | {c: "bigint" for c in COLUMNS}


def test_states_are_visited_once_from_survivors(spark, tables):
    flags = A.flagged(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    rows = A.trie(flags).collect()
    assert len({r.state for r in rows}) <= 32 and len(rows) == len({(r.part, r.state) for r in rows})
    kept = {(r.part, r.state): r.kept for r in rows}
    for r in rows:
        for e in r.edges:
            assert r.kept - e["removed"] == kept.get((r.part, "".join(sorted(r.state + e["filter"]))), 0)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_empty_tables(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    assert A.audit(docs.where("false"), labels).collect() == []
    assert {r.good_lost for r in A.audit(docs, labels.where("false")).collect()} == {0}
