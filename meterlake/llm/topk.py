"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are quantised to integers. Rows are taken ROW_BLOCK at a time where they lie. A block's index
splits every impact (a row's component in a dimension) into digits of descending quanta; the digits of
one quantum, of all dimensions, are a segment. As vectors are dense, a segment is a matrix and not a
list per dimension and level: every row has a posting in each. Queries take the segments by descending
quantum and add their products to accumulators. After each quantum the part not yet taken is bounded,
row by row, by the length of what is left (Cauchy-Schwarz); a query stops only when these bounds prove
which few rows can still be members, of the block's k best and of the k best that the task has found
before. They are then scored again, exactly, from their vectors. Each task's best k are merged per query.

Scale: a stated query set against all rows, in blocks. QUERY_BLOCK queries at a time, a bounded number
of bytes, are broadcast to one map over the rows, which are neither copied nor shuffled; only k rows per
query and task are. A round's result is a stored table, so lost executors cost one round.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part,
nor do rows with a null id; a dimension one vector has and another lacks counts as 0; ties go to
the smaller vec_id; a row that repeats an id is a candidate for other ids only (a query's own id is
never its candidate), each copy of a row is a candidate and takes a rank; query rows that share an id
but not the vector are queries of their own, told apart by `query`, a hash of the vector, while equal query rows are one
query; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

K = 5
SCALE = 256
QUERY_EVERY = 50
QUERY_BLOCK = 2_048
ROW_BLOCK = 16_384
#: Queries scored at a time against a block's segments.
CHUNK = 64
#: Possible members at which rescoring is cheaper than more segments.
FEW = 512


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): whole vectors as integers, rows that take part only."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad,
        F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v"))


def _exact_dtype(most: int):
    """The fastest number type that holds every integer up to `most`."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class ImpactIndex:
    """Segments of one block of rows: their impacts as digits of descending quanta.

    A segment holds what the rows' impacts have of its quantum, a row of digits per row; what the
    quanta not yet taken hold of a row is known by its length.
    """

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        bits = int(np.abs(matrix).max(initial=1)).bit_length()
        self.quanta = sorted({1 << max(bits - 3, 0), 1 << max(bits - 5, 0), 1}, reverse=True)
        self.digits, self.left = [], []
        rest = matrix.copy()
        for quantum in self.quanta:
            digit = rest // quantum
            rest = rest - digit * quantum
            self.digits.append(digit * quantum)
            # The rest lies in 0 .. quantum - 1; it is measured from the middle.
            self.left.append(np.linalg.norm(rest - (quantum - 1) / 2, axis=1))

    def possible(self, queries: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """For each query the rows that may be among its k best; others are proven not to be."""
        n = len(self.matrix)
        if n <= max(int(k.max()), FEW):
            return [np.arange(n)] * len(queries)
        out: list[np.ndarray] = [np.zeros(0, int)] * len(queries)
        dtype = _exact_dtype(int(np.abs(queries).max(initial=0)) * int(np.abs(self.matrix).max(initial=0) + self.quanta[0]) * self.matrix.shape[1])
        running = np.arange(len(queries))
        score = np.zeros((len(queries), n), np.float64 if dtype is not np.int64 else np.int64)
        for quantum, digit, left in zip(self.quanta, self.digits, self.left):
            score[running] += queries[running].astype(dtype) @ digit.T.astype(dtype)
            middle = queries.sum(axis=1) * ((quantum - 1) / 2)
            length = np.linalg.norm(queries, axis=1)
            again = []
            for i in running:
                if quantum == 1:
                    sure, best = np.partition(score[i], n - k[i])[n - k[i]], score[i]
                else:
                    slack = left * length[i] * (1 + 1e-9) + 1
                    about = score[i] + middle[i]
                    sure, best = np.partition(about - slack, n - k[i])[n - k[i]], about + slack
                alive = np.flatnonzero(best >= sure)
                if quantum == 1 or len(alive) <= FEW:
                    out[i] = alive
                else:
                    again.append(i)
            running = np.array(again, int)
            if not len(running):
                break
        return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        x = v.values.to_numpy(zero_copy_only=False)
        out[i, : min(len(x), dims)] = x[:dims]
    return out


def block_top(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row ids, scores) of the k best rows of a block for each query, ties to the smaller id."""
    order = np.argsort(row_ids, kind="stable")
    row_ids, rows = row_ids[order], rows[order]
    index, out = ImpactIndex(rows), []
    # Its own rows may be members, so as many more are asked for.
    own = np.searchsorted(row_ids, query_ids, "right") - np.searchsorted(row_ids, query_ids, "left")
    for lo in range(0, len(query_ids), CHUNK):
        ids, part = query_ids[lo : lo + CHUNK], queries[lo : lo + CHUNK]
        possible = index.possible(part, np.minimum(k + own[lo : lo + CHUNK], len(rows)))
        for query_id, q, alive in zip(ids, part, possible):
            alive = alive[row_ids[alive] != query_id]
            exact = rows[alive] @ q
            best = np.lexsort((row_ids[alive], -exact))[:k]
            out.append((row_ids[alive[best]], exact[best]))
    return out


def _blocks(queries: DataFrame) -> Iterator[list]:
    """The distinct queries, QUERY_BLOCK at a time; the driver holds one block."""
    block = []
    for row in queries.select("id", "v").distinct().toLocalIterator():
        block.append((row["id"], np.array(row["v"], np.int64)))
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _round(rows: DataFrame, block: list, dims: int, k: int) -> DataFrame:
    """query_id, query, vec_id, score: the k best of each task for each query of the block."""
    held = rows.sparkSession.sparkContext.broadcast(block)
    keys = [int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for _, v in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([i for i, _ in held.value], np.int64)
        queries = np.zeros((len(ids), dims), np.int64)
        for n, (_, v) in enumerate(held.value):
            queries[n, : len(v)] = v
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

        def take(waiting: list[pa.RecordBatch]) -> None:
            row_ids = np.concatenate([x.column("id").to_numpy() for x in waiting])
            matrix = np.concatenate([_matrix(x.column("v"), dims) for x in waiting])
            for n, (i, s) in enumerate(block_top(ids, queries, row_ids, matrix, k)):
                i, s = np.concatenate([best[n][0], i]), np.concatenate([best[n][1], s])
                top = np.lexsort((i, -s))[:k]
                best[n] = (i[top], s[top])

        waiting, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                waiting.append(batch.slice(at, ROW_BLOCK))
                size += waiting[-1].num_rows
                if size >= ROW_BLOCK:
                    take(waiting)
                    waiting, size = [], 0
        if waiting:
            take(waiting)
        counts = [len(i) for i, _ in best]
        for lo in range(0, len(ids), CHUNK):
            part, n = best[lo : lo + CHUNK], counts[lo : lo + CHUNK]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[lo : lo + CHUNK], n)), pa.array(np.repeat(np.array(keys[lo : lo + CHUNK], np.int64), n)),
                    pa.array(np.concatenate([i for i, _ in part])), pa.array(np.concatenate([s for _, s in part]))],
                names=["query_id", "query", "vec_id", "score"],
            )

    out = stored(rows.select("id", "v").mapInArrow(run, "query_id long, query long, vec_id long, score long"), "topk-round")
    held.destroy()
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, query, rank, vec_id, score for (id, v) queries against (id, v) rows."""
    dims = rows.select(F.size("v").alias("d")).unionByName(queries.select(F.size("v").alias("d"))).agg(F.max("d")).first()[0] or 1
    found = None
    for block in _blocks(queries):
        part = _round(rows, block, dims, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_id long, query long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "query", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("id") % QUERY_EVERY == 0)).drop("query")


OP10_SQL = """
with x as (
  select vec_id as id, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as (
  select q.id as query_id, r.id as vec_id, cast(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) as bigint) as score
  from x q, x r where q.id % 50 = 0 and q.id <> r.id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 5
"""
