"""Series: five-minute buckets, hourly history, label breakdowns, latest limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import BUCKET_SECONDS, HOUR_SECONDS, floor_to, total

TOKENS = ("input", "output", "cache_read", "cache_creation", "reasoning")
LABEL_CAP = 128


def measures(requests: bool = True) -> list[Column]:
    out = [F.sum(c).alias(c) for c in TOKENS]
    if requests:
        out.append(F.round(F.sum("requests"), 6).alias("requests"))
    return [*out, F.coalesce(F.sum("usd"), F.lit(0)).cast("decimal(38,11)").alias("usd"), F.coalesce(F.sum(F.when(F.col("usd").isNull(), total())), F.lit(0)).cast("long").alias("unpriced")]


def buckets(usage: DataFrame, *more: Column) -> DataFrame:
    """The five-minute series, with `more` aggregates of a bucket's rows."""
    return usage.groupBy("provider", floor_to(F.col("at_s"), BUCKET_SECONDS).alias("start")).agg(*measures(), *more)


def in_range(series: DataFrame, begin: int, end: int, col: str = "start") -> DataFrame:
    """Half-open on the start of a bucket; nothing is prorated."""
    return series.where((F.col(col) >= begin) & (F.col(col) < end))


def resum(series: DataFrame, *keys) -> DataFrame:
    """Sums over buckets (or hours) that already hold usd and unpriced."""
    return series.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in (*TOKENS, "usd", "unpriced")))


def history(series: DataFrame, begin: int, end: int) -> DataFrame:
    return resum(in_range(series, begin, end), "provider", floor_to(F.col("start"), HOUR_SECONDS).alias("hour"))


#: dimension -> column of usage
DIMENSIONS = {"model": "model", "project": "project", "agent": "origin"}


def breakdown(usage: DataFrame, *dimensions: str) -> DataFrame:
    """provider, dimension, hour, label with sums, records and the first seq; all dimensions, or those asked for.

    One pass, in which a null label is a group.
    """
    chosen = [F.struct(F.lit(d).alias("dimension"), F.col(DIMENSIONS[d]).alias("label")) for d in dimensions or DIMENSIONS]
    one = chosen[0] if len(chosen) == 1 else F.explode(F.array(*chosen))
    rows = usage.select("provider", "seq", floor_to(F.col("at_s"), HOUR_SECONDS).alias("hour"), *TOKENS, "usd", one.alias("d")).select("*", "d.*").drop("d")
    return rows.groupBy("provider", "dimension", "hour", "label").agg(*measures(False), F.count("*").alias("records"), F.min("seq").alias("first_seq"))


def capped(breakdown_: DataFrame, cap: int = LABEL_CAP) -> tuple[DataFrame, DataFrame]:
    """(breakdown of the first `cap` labels by arrival, provider, dimension, labels_dropped in records).

    Labels without an hour in breakdown_ hold no place, so prune it first: what retention has dropped
    makes room. The labels kept are at most `cap` for a dimension of a provider, hence a broadcast.
    """
    named = breakdown_.where(F.col("label").isNotNull())
    first = named.groupBy("provider", "dimension", "label").agg(F.min("first_seq").alias("f"))
    kept = first.withColumn("k", F.row_number().over(W.partitionBy("provider", "dimension").orderBy("f", "label"))).where(F.col("k") <= cap)
    kept = F.broadcast(kept.select("provider", "dimension", "label", F.lit(True).alias("kept")))
    marked = breakdown_.join(kept, ["provider", "dimension", "label"], "left")
    dropped = marked.groupBy("provider", "dimension").agg(F.coalesce(F.sum(F.when(F.col("label").isNotNull() & F.col("kept").isNull(), F.col("records"))), F.lit(0)).alias("labels_dropped"))
    return marked.where(F.col("label").isNull() | F.col("kept")).select(breakdown_.columns), dropped


def capped_labels(usage: DataFrame, label: str, cap: int = LABEL_CAP) -> tuple[DataFrame, DataFrame]:
    """(usage with one of the first `cap` labels by arrival or none, records dropped per provider)."""
    first = usage.where(F.col(label).isNotNull()).groupBy("provider", label).agg(F.min("seq").alias("f"))
    kept = first.withColumn("k", F.row_number().over(W.partitionBy("provider").orderBy("f"))).where(F.col("k") <= cap)
    marked = usage.join(F.broadcast(kept.select("provider", label, F.lit(True).alias("__kept"))), ["provider", label], "left")
    lost = F.col(label).isNotNull() & F.col("__kept").isNull()
    dropped = marked.where(F.col(label).isNotNull()).groupBy("provider").agg(F.sum(F.when(lost, 1).otherwise(0)).alias("labels_dropped"))
    return marked.where(~lost).select(usage.columns), dropped


def points(breakdown_: DataFrame, begin: int, end: int) -> DataFrame:
    """The hours of [begin, end) in order of hour and label, null first."""
    return in_range(breakdown_, begin, end, "hour").orderBy("provider", "dimension", "hour", F.asc_nulls_first("label"))


def latest_limits(limits: DataFrame) -> DataFrame:
    """Newest reading of each window; of equally new ones the first to arrive."""
    newest = F.max_by(F.struct("observed_at", "used_percent", "resets_at", "seq"), F.struct("observed_at", (-F.col("seq")).alias("s")))
    return limits.groupBy("provider", "limit_id", "window_minutes").agg(newest.alias("x")).select("provider", "limit_id", "window_minutes", "x.*")


def prune(series: DataFrame, now: int, retention: int, step: int, col: str) -> DataFrame:
    return series.where(F.col(col) >= (now - retention) // step * step)
