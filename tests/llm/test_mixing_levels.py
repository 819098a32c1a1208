"""Running sums of op7 over three levels and more, and its last pass as a permutation of blocks."""

import itertools
import random

from pyspark.sql import functions as F

from meterlake.llm import mixing as M


def test_running_sums_over_many_levels(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(s, rng.getrandbits(64) - 2**63, i, rng.randrange(9)) for i in range(150) for s in "ab"]
    levels = []
    once = M._running
    monkeypatch.setattr(M, "_running", lambda *a: levels.append(a[4]) or once(*a))
    got = {(r.s, r.i): r["before"] for r in M._running(spark.createDataFrame(rows, "s string, h long, i long, v long"), ["s"], ["i"], "v", "t", 2).collect()}
    assert len(levels) > 3  # the last one has a single group
    for s in "ab":
        mine = sorted(r[1:] for r in rows if r[0] == s)
        assert [got[s, i] for _, i, _ in mine] == list(itertools.accumulate((v for _, _, v in mine[:-1]), initial=0))


def test_the_last_pass_takes_whole_blocks(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("w w "), "id").alias("text"))
    taken = {r.doc_id for r in M.mix(docs, budget=600, block_docs=20).collect()}
    block = F.pmod(F.xxhash64(F.lit(M.SEED), F.lit("block"), F.lit("ss"), "doc_id", F.xxhash64(F.lit(M.SEED), "text")), F.lit(20))
    sides = {}
    for r in docs.select("doc_id", block.alias("b")).collect():
        sides.setdefault(r.b, set()).add(r.doc_id in taken)
    assert len(taken) == 200 and sum(len(x) > 1 for x in sides.values()) <= 1


def test_the_order_is_a_permutation_of_blocks_within_the_budget(spark):
    rng = random.Random(6)
    rows = [(i, f"s{min(i % 7, 2)}", " ".join(["w"] * rng.randint(0, 12))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = M.mix(docs, block_docs=32, places=True).selectExpr("doc_id", "source", "text", "copies", "inline(places)").collect()
    tokens = {i: len(t.split()) for i, _, t in rows}
    total = {s: sum(tokens[i] for i, x, _ in rows if x == s) for s in ("s0", "s1", "s2")}
    want = M.allotted(total)
    for s in total:
        mine = sorted((r["pass"], r.block_order, r.doc_order, r.doc_id) for r in mixed if r.source == s)
        members = {i for i, x, _ in rows if x == s}
        last, spent = max(p for p, *_ in mine), 0
        orders = []
        for p in range(last + 1):
            ids = [i for q, _, _, i in mine if q == p]
            orders.append(ids)
            assert len(ids) == len(set(ids)) and (set(ids) == members or p == last)
            blocks = [b for q, b, *_ in mine if q == p]
            assert len(list(itertools.groupby(blocks))) == len(set(blocks)) <= -(-len(members) // 32)
        # Read in order, every document starts within the budget, and the budget is reached.
        for _, _, _, i in mine:
            assert spent < want[s] or not tokens[i]
            spent += tokens[i]
        assert spent >= want[s]
        # The last pass is a beginning of the order that a whole one would have.
        if len(orders) > 2:
            assert orders[0] != orders[1]


def test_entropy_by_table_equals_bisection(spark):
    tokens = {"a": 1000, "b": 10, "c": 100, "d": 0}
    sums = spark.createDataFrame([(s, n, 5) for s, n in tokens.items()], "s string, n long, docs long")
    got = {r.s: r for r in M.planned(sums, max_repeats=1e9, target_entropy=0.8, block_docs=2).collect()}
    want = M.allotted(tokens, max_repeats=1e9, target_entropy=0.8)
    assert all(abs(got[s].passes * n + got[s].rest - want[s]) <= 1 for s, n in tokens.items() if n) and got["d"].passes == 1 and got["a"].blocks == 3
