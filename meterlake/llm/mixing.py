"""Mixing sources to target weights: temperature mixing with block permutations.

Token shares of the sources are raised to an exponent and normalised. The exponent, from 0 (all
sources alike) to 1 (as they are), is the smallest for which no source repeats more often than
`max_repeats`, found by bisection, or the one that gives a wanted entropy, whichever is larger. The
budget is what the scarcest source of that mix needs to be read once, so every document is taken at
least once, unless a smaller budget is given.

Weights are realised as permutations of blocks: a source's documents are dealt into blocks of about
BLOCK_DOCS by hash, the same in every pass; each pass over the source (an epoch) takes its blocks in an order of its own, and within a block the
documents in an order of their own, until the source's tokens are spent. A document is taken in the
last pass when the tokens before it in that order are less than what is left. The order is a result:
each copy of a document has its pass, its block's place in it and its own place in the block, and
who reads a source by these three reads the permutation.

Scale: texts are scanned twice and never shuffled while the table of sources is small (Spark's statistics say so); what is ordered are ids with token counts, and as
what the last pass takes is a beginning of its order, the texts only need each source's cut. Order and running sums never bring a
source together: documents sum up within groups of about BLOCK_DOCS (whole blocks), those within groups of about
BLOCK_DOCS groups, and so on, level by level until a source is a single group; a task sees one group
of one level. Sources are rows of a table throughout: the driver holds their total, the least and the largest.

Defined results: a null source is a source of its own; tokens are runs of what is no whitespace; null
texts and texts without tokens weigh 0 and are taken once per whole pass, and in the last one if
they stand before its end; ties in the order go by doc_id, then text; rows that repeat all of
id, source and text are taken together; an empty table gives no rows; extra columns are
carried along, whatever their names, but one named like a result gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import flat_bytes, slices, stored, table

MAX_REPEATS = 4.0
BLOCK_DOCS = 4_096
SEED = 20_240
BISECTIONS = 60
#: For an entropy: parts of the interval and how often it is parted, together 2**48.
GRID, ROUNDS = 16, 12
BATCH_BYTES = 1 << 19


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def count_tokens(text: pa.Array) -> pa.Array:
    """Whitespace-separated tokens of texts."""
    data, offsets = flat_bytes(text)
    out = np.zeros(len(offsets) - 1, np.int64)
    for lo, hi in slices(offsets, BATCH_BYTES):
        bounds = offsets[lo : hi + 1] - offsets[lo]
        space = _SPACE[data[offsets[lo] : offsets[hi]]]
        begins = ~space
        begins[1:] &= space[:-1]
        edges = bounds[:-1][np.diff(bounds) > 0]
        begins[edges] = ~space[edges]  # a text's first byte follows nothing
        counted = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
        out[lo:hi] = counted[bounds[1:]] - counted[bounds[:-1]]
    return pa.array(out)


def with_tokens(df: DataFrame) -> DataFrame:
    """df with `tokens`, the count of its text's, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), count_tokens(batch.column("text"))], names=[*rest, "tokens"])

    return df.mapInArrow(run, StructType([f for f in df.schema if f.name != "text"] + [StructField("tokens", LongType())]))


def weights_at(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent for s, n in tokens.items() if n}
    norm = math.fsum(raised.values())
    return {s: raised[s] / norm for s in raised}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def solve(tokens: dict, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None) -> float:
    """The exponent: entropy and repetition both fall as it rises, so each limit is a bisection."""
    tokens = {s: n for s, n in tokens.items() if n}
    if not tokens:
        return 1.0

    def smallest(fits) -> float:
        if fits(0.0):
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(BISECTIONS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
        return hi

    def repeats(exponent: float) -> float:
        w = weights_at(tokens, exponent)
        passes = [w[s] / n for s, n in tokens.items()]
        return max(passes) / min(passes)

    found = smallest(lambda a: repeats(a) <= max_repeats)
    if target_entropy is not None:
        found = max(found, smallest(lambda a: entropy(weights_at(tokens, a)) <= target_entropy))
    return found


def _entropy_exponent(shares: DataFrame, target: float) -> float:
    """The smallest exponent from 0 to 1 whose weights' entropy is no more than target; shares has `p`, over 0.

    Entropy falls as the exponent rises; each round measures GRID - 1 exponents in one aggregation.
    """
    low, high = 0.0, 1.0
    for at_zero in [True] + [False] * ROUNDS:
        tried = [0.0] if at_zero else [low + (high - low) * k / GRID for k in range(1, GRID)]
        raised = [F.pow("p", F.lit(a)) for a in tried]
        sums = shares.agg(*(F.sum(x).alias(f"s{k}") for k, x in enumerate(raised)), *(F.sum(x * F.log(x)).alias(f"t{k}") for k, x in enumerate(raised))).first()
        fits = [math.log(sums[f"s{k}"]) - sums[f"t{k}"] / sums[f"s{k}"] <= target for k in range(len(tried))]
        if at_zero and fits[0]:
            return 0.0
        if not at_zero:
            first = fits.index(True) if True in fits else len(tried)
            low, high = ([low] + tried)[first], (tried + [high])[first]
    return high


def planned(sums: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """s, passes, rest, blocks for sources (s, n tokens, docs): whole passes, what is left in tokens, blocks; a stored table."""
    some = sums.where("n > 0")
    total, least, most = some.agg(F.sum("n"), F.min("n"), F.max("n")).first()
    # How often the scarcest source repeats depends on the least and the largest share only.
    exponent = solve({0: least, 1: most}, max_repeats) if total else 1.0
    shares = some.select((F.col("n") / F.lit(float(total or 1))).alias("p"))
    if target_entropy is not None and total:
        exponent = max(exponent, _entropy_exponent(shares, target_entropy))
    raised = lambda p: F.pow(p, F.lit(exponent))
    norm = (shares.agg(F.sum(raised(F.col("p")))).first()[0] or 1.0) if total else 1.0
    whole = most * norm / (most / total) ** exponent if total else 0.0
    spend = whole if budget is None else min(budget, whole * max_repeats)
    take = F.bround(F.lit(float(spend)) * raised(F.col("n") / F.lit(float(total or 1))) / F.lit(norm)).cast("long")
    take = F.greatest(F.col("n"), take) if budget is None else take
    passes = F.when(F.col("n") > 0, F.floor(take / F.col("n"))).otherwise(1).cast("long")
    rest = F.when(F.col("n") > 0, take % F.col("n")).otherwise(0).cast("long")
    return stored(sums.select("s", passes.alias("passes"), rest.alias("rest"), F.ceil(F.col("docs") / block_docs).cast("long").alias("blocks")), "mixing-passes")


def allotted(tokens: dict, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None) -> dict:
    """Tokens to take of each source, for a handful of sources; planned() does it for a table of them."""
    w = weights_at(tokens, solve(tokens, max_repeats, target_entropy)) if any(tokens.values()) else {}
    whole = max((n / w[s] for s, n in tokens.items() if n), default=0.0)
    spend = whole if budget is None else min(budget, whole * max_repeats)
    return {s: max(n if budget is None else 0, round(spend * w[s])) if n else 0 for s, n in tokens.items()}


def _running(docs: DataFrame, keys: list[str], order: list, value: str, name: str, group_rows: int, level: int = 0) -> DataFrame:
    """docs with `before`: the sum of `value` over the rows of the same keys that stand before.

    `docs` holds h, the place in the order as a long (equal ones further ordered by `order`). Its
    leading bits deal the rows into groups; group sums run through the same function, where the group
    of the level below is a column of the rows, so each level names its own.
    """
    own = f"__g{level}"
    count = docs.groupBy(*keys).agg(F.count("*").alias("__n"))
    most = count.agg(F.max("__n")).first()[0] or 0
    if most <= 4 * group_rows:
        return docs.withColumn("before", F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy("h", *order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    bits = min(62, math.ceil(math.log2(most / group_rows)))
    dealt = stored(docs.withColumn(own, F.shiftright("h", 64 - bits)), f"mixing-{name}")
    sums = dealt.groupBy(*keys, own).agg(F.sum(value).alias("__v")).withColumn("h", F.shiftleft(F.col(own), 64 - bits))
    above = _running(stored(sums, f"mixing-{name}-sums"), keys, [own], "__v", name + "-up", group_rows, level + 1).select(*keys, own, F.col("before").alias("__a"))
    inner = F.coalesce(F.sum(value).over(W.partitionBy(*keys, own).orderBy("h", *order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    on = [*keys, own]
    return dealt.withColumn("before", inner).join(stored(above, f"mixing-{name}-above"), on).withColumn("before", F.col("before") + F.col("__a")).drop(own, "__a")


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None, seed: int = SEED,
    block_docs: int = BLOCK_DOCS, places: bool = False) -> DataFrame:
    """Rows of docs, all columns, with `copies`, the times a document is taken; rows not taken go.

    places: with `places` too, for each copy its pass, block_order (its block's place in the pass) and
    doc_order (its place in the block). Within a pass, blocks and documents are read by these numbers.
    """
    own = {"copies", "places"} if places else {"copies"}
    columns = [c for c in docs.columns if c.lower() not in own]
    named = {"s": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "t": F.xxhash64(F.lit(seed), "text")}
    slim = stored(with_tokens(docs.select(*(v.alias(k) for k, v in named.items()), "text")), "mixing-slim")
    sums = stored(slim.groupBy("s").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")), "mixing-sources")
    plan = planned(sums, max_repeats, target_entropy, budget, block_docs)
    # Blocks are the same in every pass; their order and that of the documents in them are the pass's.
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "s", "id", "t"), "blocks")
    orders = lambda a_pass: (F.xxhash64(F.lit(seed), "s", a_pass.cast("string"), "b"), F.xxhash64(F.lit(seed), "s", a_pass.cast("string"), "id", "t"))
    placed = lambda df: df.withColumn("b", block).withColumns(dict(zip("ho", orders(F.col("passes")))))
    place = ["h", "b", "o", "id", "t"]
    # The last pass, where a source has a part of one left: what is taken are the first in its order.
    last = placed(slim.join(plan, "s").where("rest > 0")).groupBy("s", *place, "rest").agg(F.sum("tokens").alias("tokens"))
    last = _running(last, ["s"], place[1:], "tokens", "last", max(block_docs, 2)).where("before < rest")
    until = stored(last.groupBy("s").agg(F.max(F.struct(*place)).alias("until")), "mixing-until")
    plan = stored(plan.join(until, "s", "left"), "mixing-plan")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), *(v.alias(k) for k, v in named.items()))
    both = placed(whole.join(plan, "s"))
    copies = F.col("passes") + F.when(F.struct(*place) <= F.col("until"), 1).otherwise(0)
    taken = both.withColumn("copies", copies.cast("long")).where("copies > 0")
    out = [*(F.col("row").getField(c).alias(c) for c in columns), F.col("copies")]
    if places:
        each = F.transform(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")),
            lambda k: F.struct(k.alias("pass"), *(x.alias(n) for x, n in zip(orders(k), ("block_order", "doc_order")))))
        out.append(each.alias("places"))
    return taken.select(*out)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = with_tokens(mix(docs, places=True))
    return mixed.select("doc_id", "source", "tokens", "copies", F.explode("places").alias("p")).select("doc_id", "source", "tokens", "copies", "p.*")
