"""Connected components of an edge table with DataFrame operations only.

Alternating large-star and small-star steps: every node's larger neighbours, then its smaller ones,
are linked to the smallest node known. The number of edges never grows, each round is two
aggregations, and paths shorten geometrically. A round's edges are written to the shared folder, so a
lost executor costs one round, and those of the round before deleted. A node with very many
neighbours is aggregated before the shuffle, and the joins to the minima are left to Spark: broadcast
where its statistics show them small, else with a plain exchange on both sides, whose large partitions it can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, empty, stored


def _minima(edges: DataFrame, name: str) -> DataFrame:
    """(u, m), the smallest of u and its v's; stored, so that a join to it has exchanges Spark can split."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), name)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge, the smallest node reachable. Null ends link nothing."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now = stored(now, "components-0")
    done = empty(now)
    step = 0
    while not done:
        step += 1
        # Large star: both directions; the larger neighbours of u go to u's minimum.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = _minima(both, f"components-{step}-large")
        large = stored(both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"components-{step}-a")
        # Small star: u and its smaller neighbours go to the smallest of them.
        least_lows = _minima(large, f"components-{step}-small")
        least = large.join(least_lows, "u")
        small_ = least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(small_, f"components-{step}-b")
        discarded(now, lows, large, least_lows)
        # At rest when no node is both a root and a child, i.e. every edge goes straight to a root.
        chained = after.select("u").distinct().join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        done = empty(chained) and empty(after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1"))
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
