"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed terms: trigrams of its character-class outline (letters of a run
count once), whether words repeat the word before, and its vocabulary: words and the byte trigrams in
them, in lower case. Log counts, weighted by inverse document frequency and scaled so that outline and
vocabulary are of one length, as is the whole, are projected on the leading singular vectors of a bounded
labelled sample. The sample's vectors are broadcast; every document takes exact cosine products with
all of them, in blocks, and its NEIGHBOURS nearest vote with their labels, weighted by similarity.

Scale: one map over the documents, no shuffle of texts. The sample is at most SAMPLE_PER_LABEL
labelled rows of each label that are not held out, those with the smallest hashes; what is broadcast
is SAMPLE rows x RANK numbers. The vote is exact over that sample.

Defined results: null and empty texts have no terms and get the share of label 1 among the sample's
most alike, here all equally distant, rows, i.e. the sample's prior; labels other than 0 and 1 and
null labels teach nothing; a document labelled twice teaches its larger label; with no usable label
every score is 0.5; ties between neighbours go to the earlier in the sample's order; rows with a null doc_id count as held out and so
teach nothing; repeated rows score alike; a text of more than BATCH_BYTES bytes is counted in pieces that end after a space, and an
outline across such an end doesn't count; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fetched, flat_bytes, hashed_sample, held_out, plain, slices, table
from .hashing import RangeHash, mix, spans

#: Terms of the outline, of words and of trigrams in words.
OUTLINES, WORDS, GRAMS = 1_024, 2_048, 1_024
TERMS = OUTLINES + WORDS + GRAMS
RANK = 48
SAMPLE_PER_LABEL = 1_000
NEIGHBOURS = 15
THRESHOLD = 0.3
SHARPNESS = 8
BATCH_BYTES = 1 << 19
BLOCK = 128

#: Character classes: letter runs are outlines, each symbol is a class of its own.
_CLASS = np.array([1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b == 32 else b + 8 for b in range(256)], np.uint64)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x TERMS counts."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.zeros(n * TERMS)
    if len(data):
        kinds = _CLASS[data]
        first = np.ones(len(data), bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (row[1:] != row[:-1]) | (kinds[1:] > 3)
        kinds, owner = kinds[first], row[first]
        if len(kinds) > 2:
            gram = mix(kinds[:-2] * np.uint64(1 << 20) + kinds[1:-1] * np.uint64(1 << 10) + kinds[2:]) % np.uint64(OUTLINES - 4)
            same = owner[:-2] == owner[2:]
            counts += np.bincount(owner[:-2][same] * TERMS + gram[same].astype(np.int64), minlength=n * TERMS)
        starts, ends = spans(_CLASS[data] < 4, offsets)
        if len(starts):
            word, of = RangeHash(data)(starts, ends), row[starts]
            counts += np.bincount(of * TERMS + OUTLINES - 4, minlength=n * TERMS)
            again = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
            counts += 4 * np.bincount(of[1:][again] * TERMS + OUTLINES - 3, minlength=n * TERMS)
            capital = _CLASS[data[ends - 1]] == 2
            counts += np.bincount(of[capital] * TERMS + OUTLINES - 2, minlength=n * TERMS)
            lower = np.where(_CLASS[data] == 2, data | 32, data).astype(np.uint8)
            word = RangeHash(lower)(starts, ends) % np.uint64(WORDS)
            counts += np.bincount(of * TERMS + OUTLINES + word.astype(np.int64), minlength=n * TERMS)
            inside = _CLASS[data] < 4
            at = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:] & (row[:-2] == row[2:]))
            a, b, c = (lower[at + k].astype(np.uint64) for k in range(3))
            gram = mix(a * np.uint64(1 << 16) + b * np.uint64(1 << 8) + c) % np.uint64(GRAMS)
            counts += np.bincount(row[at] * TERMS + OUTLINES + WORDS + gram.astype(np.int64), minlength=n * TERMS)
    return counts.reshape(n, TERMS)


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, b, term counts of rows a .. b - 1), block by block; a very long row is counted in pieces."""
    for lo, hi in slices(offsets, BATCH_BYTES):
        if offsets[hi] - offsets[lo] > BATCH_BYTES:  # one row
            counts, at, stop = np.zeros((1, TERMS)), int(offsets[lo]), int(offsets[hi])
            while at < stop:
                end = min(at + BATCH_BYTES, stop)
                gaps = np.flatnonzero(data[at:end] == 32) if end < stop else ()
                end = at + int(gaps[-1]) + 1 if len(gaps) else end
                counts += term_counts(data[at:end], np.array([0, end - at]))
                at = end
            yield lo, hi, counts
        else:
            for a in range(lo, hi, BLOCK):
                b = min(a + BLOCK, hi)
                yield a, b, term_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    for part in (x[:, :OUTLINES], x[:, OUTLINES:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict | None:
    """The model from a bounded labelled sample; None without usable labels."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    sample = hashed_sample(known.withColumn("h", F.xxhash64("doc_id")), "y", SAMPLE_PER_LABEL).select("doc_id", "y", "h")
    texts = docs.where(~held_out()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"),
        F.first("h").alias("h"), F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            for a, b, counts in counted(data, offsets):
                packed = pa.array([x.tobytes() for x in counts.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("h")[a:b], batch.column("doc_id")[a:b].cast(pa.string()),
                    batch.column("y")[a:b].cast(pa.int32()), packed], names=["h", "id", "y", "counts"])

    rows = sorted(fetched(texts.mapInArrow(features, "h long, id string, y int, counts binary")))
    if not rows:
        return None
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows])
    y = np.array([r["y"] for r in rows], np.float32)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    x = weigh(counts, idf)
    rng = np.random.default_rng(7)
    basis = rng.standard_normal((TERMS, RANK + 16)).astype(np.float32)
    for _ in range(4):  # randomised subspace iteration for the leading right singular vectors
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ vt.T)[:, :RANK].astype(np.float32)
    return {"idf": idf.astype(np.float32), "axes": axes, "vectors": _unit(x @ axes).astype(np.float32), "y": y}


def vote(counts: np.ndarray, model: dict) -> np.ndarray:
    """Scores of rows of counts: similarity-weighted share of label 1 among the nearest."""
    y, vectors = model["y"], model["vectors"]
    z = _unit(weigh(counts, model["idf"]) @ model["axes"]).astype(np.float32)
    out = np.empty(len(z))
    k = min(NEIGHBOURS, len(y))
    for lo in range(0, len(z), BLOCK):
        near = z[lo : lo + BLOCK] @ vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** SHARPNESS + 1e-9
        out[lo : lo + BLOCK] = (weight * y[top]).sum(axis=1) / weight.sum(axis=1)
    out[~counts.any(axis=1)] = y.mean()
    return np.clip(out, 0, 1)


def _scores(texts: pa.Array, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    data, offsets = flat_bytes(texts)
    out = np.empty(len(offsets) - 1)
    for a, b, counts in counted(data, offsets):
        out[a:b] = vote(counts, model)
    return out


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with held_out, score and predicted; of the columns of docs only doc_id stays."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    inputs = docs.select("doc_id", held_out().alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(batch.column("text"), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return inputs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs, all columns, that are not predicted to be of label 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), held.value) >= THRESHOLD))

    rows = plain(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
