"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a table (as estimated from its row count) up to which it is broadcast;
#: larger tables take the shuffled join instead. Both ways give the same rows.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's, or where none is set the warehouse; in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/meterlake"
    found = tempfile.mkdtemp(prefix="meterlake-")
    spark.sparkContext.setCheckpointDir(found)
    return found


#: Bytes of an Arrow batch between the JVM and Python, whatever the length of a row, where the session says nothing else.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"
#: Holds while a table is written or an answer fetched: the shuffle files go when that is complete, since nothing reads them any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_default_bytes: dict[str, str] = {}


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches bounded by ARROW_BYTES if it still has Spark's own bound."""
    key, most = ARROW_BYTES
    if not _default_bytes:
        _default_bytes[key] = spark.sparkContext._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(key)
    if spark.conf.get(key) == _default_bytes[key]:
        spark.conf.set(key, most)
    return spark


@contextmanager
def cleaned(spark: SparkSession):
    """What is planned and run in here leaves no shuffle files; even empty ones take a few blocks of disk a task."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def empty(df: DataFrame) -> bool:
    """df.isEmpty() that leaves no shuffle files."""
    with cleaned(df.sparkSession):
        return df.isEmpty()


def fetched(df: DataFrame) -> list:
    """df.collect() that leaves no shuffle files; select() plans anew, under the setting."""
    with cleaned(df.sparkSession):
        return df.select("*").collect()


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df once to the shared folder, in a folder for each value of `by`, and read it back.

    That cuts the lineage and survives lost executors.
    """
    spark = bounded(df.sparkSession)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        at = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint when a count proves it small, else df unchanged."""
    most = max(1, limit // row_bytes)
    return F.broadcast(df) if fetched(df.agg(F.count("*")))[0][0] <= most else df


def free(df: DataFrame, name: str) -> str:
    """name, with underscores behind it as long as df has a column of that name."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def plain(df: DataFrame) -> DataFrame:
    """df with names that any function takes: `text` as it is, the other columns by number; toDF(*df.columns) names them again."""
    return df.toDF(*("text" if c == "text" else f"c{k}" for k, c in enumerate(df.columns)))


def byte_views(column: pa.Array) -> Iterator[memoryview]:
    """Each value of a string column as UTF-8 bytes; null is empty."""
    for value in column:
        raw = value.as_buffer() if value.is_valid else None
        yield memoryview(raw) if raw is not None else memoryview(b"")


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string column, row offsets into them); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves no remainder mod 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def hashed_sample(df: DataFrame, key: str, most: int, h: str = "h") -> DataFrame:
    """The rows of each key with the `most` smallest hashes, in a column k their rank from 1.

    Rows that can't be among them are left out before the shuffle, by the key's count: on average
    no more than four times `most` rows of a key come together in a task.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    low = df.join(small(counts, 64), key).where(F.col(h) / 2.0**64 + 0.5 <= 4.0 * most / F.col("__n")).drop("__n")
    return low.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(h, "doc_id"))).where(F.col("k") <= most)


#: Bits of a membership filter for a key, and of a filter at least and at most; with very many keys it lets all pass.
KEY_BITS, LEAST_BITS, FILTER_BITS = 64, 1 << 20, 1 << 26


#: Words of 64 bits of a filter that come to the driver as one row.
FILTER_WORDS = 1 << 14


def membership(keys: DataFrame, *cols: str):
    """A broadcast bitmap that holds the hash of each key; 8 MB at most, however many keys.

    Every executor keeps a copy on disk, so few keys have a small one. destroy() it when nothing reads what it filters.
    """
    wanted = KEY_BITS * fetched(keys.agg(F.count("*")))[0][0]
    bits = min(FILTER_BITS, max(LEAST_BITS, 1 << wanted.bit_length()))
    bit = F.pmod(F.xxhash64(*cols), F.lit(bits))
    words = keys.groupBy((bit / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(cols)}), 64) as int))")).alias("b"))

    def packed(part: pa.Table) -> pa.Table:
        w = part["w"].to_numpy()
        out = np.zeros(FILTER_WORDS, np.int64)
        out[w % FILTER_WORDS] = part["b"].to_numpy()
        return pa.table({"k": pa.array([int(w[0]) // FILTER_WORDS], pa.int32()), "b": pa.array([out.tobytes()], pa.binary())})

    bitmap = np.zeros(bits // 64, np.uint64)
    for r in fetched(words.groupBy((F.col("w") / FILTER_WORDS).cast("int")).applyInArrow(packed, "k int, b binary")):
        bitmap[r["k"] * FILTER_WORDS : (r["k"] + 1) * FILTER_WORDS] = np.frombuffer(r["b"], np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def held_rows(held, hashes: pa.Array) -> np.ndarray:
    """Which hashes (xxhash64 of a key) may be in the bitmap; all that are in it are among them."""
    at = hashes.to_numpy(zero_copy_only=False).astype(np.int64) % (64 * len(held.value))
    return (held.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1


def only_held(df: DataFrame, held, *cols: str, once: bool = False) -> DataFrame:
    """The rows of df whose key may be in the bitmap; `once`: each key once a batch, for keys that very many rows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(held_rows(held, batch.column("__key"))))
            if once and batch.num_rows:
                key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols], axis=1)
                batch = batch.take(pa.array(np.sort(np.unique(key, axis=0, return_index=True)[1])))
            yield batch

    keyed = df.withColumn("__key", F.xxhash64(*cols))
    return keyed.mapInArrow(run, keyed.schema).drop("__key")
