import random

from pyspark.sql import functions as F

from meterlake.llm import common, jaccardjoin


def test_rows_without_a_partner_by_size_go_and_no_link_is_lost(spark):
    rnd, rows, sets = random.Random(3), [], {}
    for i in range(120):
        base = sets[rnd.randrange(i)] if i and rnd.random() < 0.6 else set(rnd.sample(range(400), rnd.randrange(1, 90)))
        sets[i] = {x if rnd.random() > 0.04 else rnd.randrange(400) for x in base}
    for i, s in sets.items():
        rows += [(i, i, len(s), at, k) for at, k in enumerate(sorted(s)[: jaccardjoin.prefix_size(len(s))])]
    keys = spark.createDataFrame(rows, "id long, component long, n int, at int, key long")
    wide = keys.select("id", "component", "n", (F.col("at") < jaccardjoin._early(90)).alias("early"), "key", F.lit(9).cast("long").alias("size"))
    kept = [(r.key, r.id) for r in jaccardjoin._partnered(wide, 90).collect()]
    assert len(kept) < 0.6 * len(rows)
    held = {}
    for k, i in kept:
        held.setdefault(i, set()).add(k)
    links = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert len(links) > 10 and all(held.get(a, set()) & held.get(b, set()) for a, b in links)


def test_a_filter_of_few_keys_is_small_and_leaves_no_shuffle(spark):
    held = common.membership(spark.range(300).toDF("k"), "k")
    assert held.value.nbytes <= 1 << 17
    rows = spark.range(5_000).toDF("k")
    found = {r.k for r in common.only_held(rows, held, "k").collect()}
    assert set(range(300)) <= found and len(found) < 400
    held.destroy()
