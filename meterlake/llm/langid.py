"""Language identification by cross-parsing entropy.

Text of each language becomes a suffix automaton over bytes. A document is parsed greedily into
phrases, each the longest match that occurs in the training text; the language whose phrases cost
the fewest bits per byte (phrases * log2 of the positions a phrase can point at) wins.

Scale: one map over the documents, no shuffle. Fitting reads a bounded sample: for each language at
most `SAMPLE_DOCS` labelled rows with the smallest hashes, whatever their length. Of a long text a
piece at a hashed offset is read; SAMPLE_BYTES of normalised text are shared out evenly among the rows,
and what short ones leave goes to longer ones. So the driver gathers SAMPLE_DOCS * SAMPLE_TEXT characters at most for each language
there is, of which SAMPLE_BYTES are broadcast. Texts that teach and texts that are judged are lower-cased alike, by Spark. Documents are cut into pieces of PIECE bytes that are parsed side
by side as numpy vectors, so a very long text costs what many short ones cost; each piece starts a
phrase anew, in every language alike, and every byte is parsed.

Defined results: null texts and texts without letters are `und` with score 0; equal costs go to the
language whose name sorts first; rows with a null lang teach nothing; with no labelled row at all
every document is `und`; rows with a null doc_id count as held out and so teach nothing; repeated rows are judged
alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import flat_bytes, hashed_sample, held_out, slices, table

SAMPLE_DOCS = 256
SAMPLE_BYTES = 32_000
#: Of a longer text a piece of this length is read, or of what SAMPLE_BYTES makes a row if rows are few.
SAMPLE_TEXT = 8_000
PIECE = 2_048
BATCH_BYTES = 1 << 20

#: ASCII letters and all bytes of longer characters stay, anything else is a space.
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with runs of separators as one space; offsets follow."""
    data = _KEEP[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return data[keep], kept[offsets]


class ByteAutomaton:
    """Suffix automaton of one training text as a table: entry = next state * 4 + phrases ended."""

    def __init__(self, text: bytes):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        symbols = sorted(set(text))
        self.symbol = np.zeros(256, np.int32)  # 0: not in the training text
        for k, c in enumerate(symbols):
            self.symbol[c] = k + 1
        self.width = len(symbols) + 2  # the last column is padding, which changes nothing
        root = np.zeros(self.width, np.int32)
        for c, to in nxt[0].items():
            root[self.symbol[c]] = to
        self.table = np.empty((len(nxt), self.width), np.int32)
        # A mismatch ends a phrase and the symbol starts the next; an unseen symbol is a phrase itself.
        self.table[:] = root * 4 + 1
        self.table[:, 0] = 2
        self.table[0, 0] = 1
        for state, edges in enumerate(nxt):
            for c, to in edges.items():
                self.table[state, self.symbol[c]] = to * 4
        self.table[:, -1] = np.arange(len(nxt)) * 4
        self.table = self.table.ravel()
        self.bits = float(np.log2(len(text) + 1))

    def phrases(self, matrix: np.ndarray) -> np.ndarray:
        """Phrases in each column of a (piece length x pieces) matrix of symbols."""
        state = np.zeros(matrix.shape[1], np.int32)
        count = np.zeros(matrix.shape[1], np.int32)
        for row in matrix:
            found = self.table[state * self.width + row]
            count += found & 3
            state = found >> 2
        return count + (state > 0)


def train(docs: DataFrame, labels_col: str = "lang") -> dict[str, bytes]:
    """Bounded training text per language, from rows that are not held out."""
    usable = docs.where(~held_out() & F.col(labels_col).isNotNull() & (F.length("text") > 0)).select(F.col(labels_col).alias("lang"), "doc_id", F.xxhash64("doc_id").alias("h"), "text")
    # Ids are ranked without their texts.
    chosen = hashed_sample(usable.select("lang", "doc_id", "h"), "lang", SAMPLE_DOCS).select("lang", "doc_id").distinct()
    room = F.greatest(F.lit(SAMPLE_TEXT), F.ceil(SAMPLE_BYTES / F.count("*").over(W.partitionBy("lang")))).cast("int")
    chosen = chosen.withColumn("room", room)
    at = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - F.col("room") + 1, F.lit(1))).cast("int") + 1
    pieces = usable.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "h", "doc_id").agg(F.min(F.lower(F.substring(F.col("text"), at, F.col("room")))).alias("text"))
    rows = pieces.toPandas().sort_values(["lang", "h", "text"])
    return {lang: shared_out(part["text"], part["h"]) for lang, part in rows.groupby("lang")}


def shared_out(texts: Iterable[str], hashes: Iterable[int], most: int = SAMPLE_BYTES) -> bytes:
    """`most` bytes of normalised texts, as evenly of each as their lengths allow, from hashed offsets."""
    data = [normalise(raw, np.array([0, len(raw)]))[0] for raw in (np.frombuffer(t.encode(), np.uint8) for t in texts)]
    sizes = np.array([len(d) for d in data])
    low, high = 0, int(sizes.max(initial=0))
    while low < high:  # the largest share that fits, with a space after each
        mid = (low + high + 1) // 2
        low, high = (mid, high) if (np.minimum(sizes, mid) + 1).sum() <= most + 1 else (low, mid - 1)
    begins = [h % (max(len(d) - low, 0) + 1) for h, d in zip(hashes, data)]
    return b" ".join(d[b : b + low].tobytes() for b, d in zip(begins, data))


_cache: dict[tuple, list[tuple[str, ByteAutomaton]]] = {}


def _automata(texts: dict[str, bytes]) -> list[tuple[str, ByteAutomaton]]:
    key = tuple(sorted(texts.items()))
    if key not in _cache:
        _cache.clear()
        _cache[key] = [(lang, ByteAutomaton(text)) for lang, text in key if text]
    return _cache[key]


def score_batch(data: np.ndarray, offsets: np.ndarray, automata: list[tuple[str, ByteAutomaton]]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, score) per row of a batch of lower-cased texts."""
    n = len(offsets) - 1
    data, offsets = normalise(data, offsets)
    sizes = np.diff(offsets)
    pieces = (sizes + PIECE - 1) // PIECE
    owner = np.repeat(np.arange(n), pieces)
    first = np.cumsum(pieces) - pieces
    begin = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * PIECE
    length = np.minimum(begin + PIECE, offsets[1:][owner]) - begin
    order = np.argsort(-length, kind="stable")  # so that the live columns are always the first ones
    owner, begin, length = owner[order], begin[order], length[order]
    costs = np.zeros((len(automata), n))
    at = np.arange(PIECE)
    for lo in range(0, len(owner), 2_048):
        b, ln = begin[lo : lo + 2_048], length[lo : lo + 2_048]
        depth = int(ln[0])
        index = b[None, :] + at[:depth, None]
        bytes_ = data[np.minimum(index, len(data) - 1)]
        pad = at[:depth, None] >= ln[None, :]
        for k, (_, automaton) in enumerate(automata):
            matrix = automaton.symbol[bytes_]
            matrix[pad] = automaton.width - 1
            costs[k] += np.bincount(owner[lo : lo + 2_048], automaton.phrases(matrix), n) * automaton.bits
    best = np.argmin(costs, axis=0)
    gap = np.minimum(costs - costs.min(axis=0), 60.0)
    return best, 1.0 / np.exp2(-gap).sum(axis=0)


def identify(docs: DataFrame, texts: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per document."""
    held = docs.sparkSession.sparkContext.broadcast(texts)
    inputs = docs.select("doc_id", held_out().alias("held_out"), F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(held.value)
        names = np.array([lang for lang, _ in automata] + ["und"], object)
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(len(letters), len(automata)), np.zeros(len(letters))
            if automata:
                for lo, hi in slices(offsets, BATCH_BYTES):
                    pred[lo:hi], score[lo:hi] = score_batch(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], automata)
            pred[~letters], score[~letters] = len(automata), 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[pred], pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return inputs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
