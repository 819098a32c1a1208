"""From arrival-ordered records to accepted usage: dedup, attribution, deltas."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import is_zero
from .sequence import folded

COUNTERS = ("input", "output", "cache_read", "cache_creation", "reasoning")


def dedup_first_wins(usage: DataFrame) -> DataFrame:
    """The first arrival of each (provider, message, request); rows without a whole key all pass.

    The first row is an aggregate, so repeats are dropped before the shuffle too; keyless rows aren't shuffled.
    """
    keyed = F.col("message").isNotNull() & F.col("request").isNotNull()
    rest = [c for c in usage.columns if c not in ("provider", "message", "request")]
    first = usage.where(keyed).groupBy("provider", "message", "request").agg(F.min_by(F.struct(*rest), "seq").alias("x"))
    return first.select("provider", "message", "request", *(F.col(f"x.{c}") for c in rest)).select(*usage.columns).unionByName(usage.where(~keyed))


#: Arrivals (in seq, which counts bytes of log) that a task looks at for one key: 16 MB of log.
CHUNK_BITS = 24


def max_before(df: DataFrame, keys: list[str], value: Column, name: str, bits: int | None = None) -> DataFrame:
    """df with `name`: the largest `value` among the rows of the same keys that arrived before, null if there is none.

    A key's arrivals are dealt into chunks by seq, and each chunk is a group of its own, so a key with a
    third of all rows runs in many tasks. What a chunk hands on is its largest value: a row a chunk, added up before the
    shuffle, and a running maximum over these is all that one task does for a whole key. Null keys are a key.
    """
    chunked = df.withColumn("__c", F.shiftright("seq", bits or CHUNK_BITS))
    ends = chunked.groupBy(*keys, "__c").agg(F.max(value).alias("__m"))
    earlier = F.max("__m").over(W.partitionBy(*keys).orderBy("__c").rowsBetween(W.unboundedPreceding, -1))
    on = [*keys, "__c"]
    carried = ends.withColumn("__b", earlier).where("__b is not null").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(on)), "__b")
    within = F.max(value).over(W.partitionBy(*on).orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(on)))
    both = chunked.withColumn("__w", within).join(carried, same, "left")
    return both.withColumn(name, F.greatest("__w", "__b")).select(*df.columns, name)


def attribute_sessions(usage: DataFrame, sessions: DataFrame, bits: int | None = None) -> DataFrame:
    """usage with project from its session's newest record among those that arrived before."""
    both = usage.withColumn("__s", F.lit(None).cast("struct<at:bigint,seq:bigint,project:string>")).unionByName(
        sessions.where("project is not null").select("provider", "session", "seq", F.struct(F.col("at_s").alias("at"), "seq", "project").alias("__s")), allowMissingColumns=True
    )
    known = max_before(both, ["provider", "session"], F.col("__s"), "__k", bits)
    return known.where("__s is null").withColumn("project", F.coalesce("project", F.col("__k.project"))).select(*usage.columns)


def next_delta(prev: dict | None, row: dict) -> tuple[dict | None, tuple | None]:
    """(baseline, increment or None) after a reading of a session's running totals.

    A row is dropped if it is older than the accepted one before, or as old without growing in every
    counter. A total below the one before means the counter restarted.
    """
    if prev is not None and row["at_s"] <= prev["at_s"]:
        same = all(row[c] == prev[c] for c in COUNTERS)
        if row["at_s"] < prev["at_s"] or same or any(row[c] < prev[c] for c in COUNTERS):
            return prev, None
    on = prev is not None and sum(row[c] for c in COUNTERS[:4]) >= sum(prev[c] for c in COUNTERS[:4])
    return row, (row["seq"], row["at_s"], *(max(row[c] - prev[c], 0) if on else row[c] for c in COUNTERS))


DELTAS = "seq bigint, at_s bigint, " + ", ".join(f"{c} bigint" for c in COUNTERS)


def cumulative_deltas(totals: DataFrame, bits: int | None = None) -> DataFrame:
    """Accepted increments of running totals per session, in order of arrival: next_delta row by row, without going row by row.

    A row newer than all before it is always accepted, so the baseline's time is the running maximum of
    the time, and older rows are dropped without knowing what was accepted. Only readings of one and the same second
    depend on one another: these few are taken in turn. The baseline of an accepted row is the accepted one before. So
    a session may be spread over many tasks.
    """
    keys = ["provider", "session"]
    rows = totals.select(*keys, "seq", "at_s", *COUNTERS)
    fresh = max_before(rows, keys, F.col("at_s"), "__t", bits).where("__t is null or at_s >= __t").drop("__t")
    taken = folded(fresh, [*keys, "at_s"], ["seq"], _next_of_a_second, "seq bigint, " + ", ".join(f"{c} bigint" for c in COUNTERS)).select(*rows.columns)
    told = max_before(taken, keys, F.struct("seq", *COUNTERS), "__p", bits)
    sum_of = lambda at: reduce(add, (F.col(f"{at}{c}") for c in COUNTERS[:4]))
    on = F.col("__p").isNotNull() & (sum_of("") >= sum_of("__p."))
    return told.select(*keys, "seq", "at_s", *(F.when(on, F.greatest(F.col(c) - F.col(f"__p.{c}"), F.lit(0))).otherwise(F.col(c)).cast("bigint").alias(c) for c in COUNTERS))


def _next_of_a_second(prev: tuple | None, row: dict) -> tuple[tuple, tuple | None]:
    """(last accepted, the row if it is accepted) among readings of one second, of which the first always is."""
    now = tuple(row[c] for c in COUNTERS)
    if prev is not None and (now == prev or any(x < y for x, y in zip(now, prev))):
        return prev, None
    return now, (row["seq"], *now)


def counted(usage: DataFrame) -> DataFrame:
    """Rows that move a series: some token or request."""
    return usage.where(~is_zero() | (F.col("requests") != 0))


def evict_oldest(state: DataFrame, cap: int, keys: list[str], at: str = "at_s") -> DataFrame:
    """The newest `cap` entries of a provider's state."""
    return state.withColumn("__rn", F.row_number().over(W.partitionBy("provider").orderBy(F.desc(at), *keys))).where(F.col("__rn") <= cap).drop("__rn")
