"""Streams: appended log lines to a store of series, and event streams to five-minute series.

Late usage is never dropped inside retention, so batches are merged into stored days by foreachBatch; a
watermark only bounds state where a stream itself keeps some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import places
from ..sources.store import Store
from ..sources.tail import LogSource, register

def lines_of(spark: SparkSession, roots: str | list[str], key: str, **options) -> DataFrame:
    register(spark)
    stream = spark.readStream.format(LogSource.name()).option("places", places(key, roots)).option("parallelism", spark.sparkContext.defaultParallelism)
    for k, v in options.items():
        stream = stream.option(k, v)
    return stream.load()


def ingest(spark: SparkSession, roots: str | list[str], key: str, out: str, checkpoint: str, trigger: dict | None = None, **options):
    """A running query that merges a provider's appended log lines into the store below `out`, batch by batch.

    A batch that runs again replaces what it wrote, so a restart repeats nothing. seq grows
    with the batch, then with the place among the batch's bytes: no two lines share one. With `maxFilesPerBatch` the
    newest files come first, after a restart too; the store's backlog() tells how many wait.
    """
    store = Store(spark, out)

    def batch(df: DataFrame, number: int) -> None:
        seq = (F.lit(number).cast("long") * (1 << 44) + F.col("place")).alias("seq")
        store.add(key, df.select("path", seq, "line", "problem", "offset"), number)

    writer = lines_of(spark, roots, key, checkpoint=checkpoint, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def bucket_stream(usage: DataFrame, retention: str = "32 days") -> DataFrame:
    """A streaming usage table (at TIMESTAMP, provider, message, request, counters) as five-minute sums.

    Keyed repeats are dropped within the retention; rows without a key all count.
    """
    marked = usage.withWatermark("at", retention)
    keyed = marked.where("message is not null and request is not null").dropDuplicatesWithinWatermark(["provider", "message", "request"])
    every = keyed.unionByName(marked.where("message is null or request is null"))
    return every.groupBy("provider", F.window("at", "5 minutes")).agg(*(F.sum(c).alias(c) for c in ("input", "output", "cache_read",
        "cache_creation"))).select("provider", F.unix_seconds("window.start").alias("start"), "input", "output", "cache_read", "cache_creation")
