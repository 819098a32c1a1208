"""Packing: documents cut and packed into sequences of a fixed capacity, harmonic classes, nothing shared.

A document's ids (and the end id behind them) are cut into whole sequences and a rest, the rest into
pieces whose lengths are reciprocals of the capacity: capacity // k for the classes k that waste
no more than `slack` ids of a sequence, the largest that fits first, so what is left shrinks with its square
and few cuts do. A bin of class k takes k pieces and is full then: no search, no order, no
exchange between workers. What a worker has left at its end, fewer than k pieces of a class, is cut
again into powers of two, where any number of pieces makes sequences of a power of two in length.
Such sequences need no padding; so padding is at most slack / capacity, however few documents a worker has.

Ids are those that `tokenizers` gives for the whole text. A text longer than WINDOW is taken apart where a character that is no
white space is followed by one that is: the byte-level pre-tokenizer never joins these, and looks ahead only from
white space, so the parts' ids are the text's. Vocabulary, merges and special tokens come from the tokenizer's
file; the merging itself is done by `tiktoken`, five times as fast (both give the same ids around every code
point there is), and by `tokenizers` where that one fails.

Scale: one pass over the texts, no shuffle. A worker holds a batch, a window of a long text, the short tail of the
document and its open bins (a few hundred pieces); of the document in hand also its ids, as each row tells their number.
A stretch of a text without any white space is tokenized in one go. Sequence ids are the
partition's number and a count, so a task that is repeated gives the same rows as long as its input comes in
the same order: give it a stored table.

Defined results: a null text is empty; an empty text is its end id alone; null and repeated
doc_ids are documents of their own; other columns, whatever their names, are not read; an empty table
gives no rows. The length of a sequence is what its pieces add up to.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

CAPACITY = 1024
END_ID = 0
#: Ids a sequence may stay short of its capacity.
SLACK = 4
#: Characters of a text that are tokenized at a time.
WINDOW = 1 << 18
OUT_BYTES = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])

# White space is what both Python and the tokenizer take for it.
_CUT = re.compile(r"(?<=[^\s\u180e])(?=[ \t-\r])")


def classes(capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """(length, pieces a bin holds), longest first; with a capacity that is a power of two, all powers of two are there."""
    best = {}
    for k in range(1, capacity + 1):
        if capacity - k * (capacity // k) <= slack:
            best[capacity // k] = k
    return sorted(best.items(), reverse=True)


def _token_bytes(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Ids by bytes; a byte-level vocabulary writes printable bytes as themselves and the others, in order, from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}


class Ids:
    """Ids of texts as little-endian bytes, four an id, as tokenizers gives them without special tokens."""

    #: How the byte-level pre-tokenizer splits a text (a fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ranks = _token_bytes({t: i for t, i in self.tokenizer.get_vocab().items() if t not in added})
        self.fast = Encoding(os.path.basename(path), pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def _window(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:  # its patterns can't take a run of very much white space
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str, window: int = WINDOW) -> Iterator[bytes]:
        """The ids of a text, window by window."""
        at = 0
        while len(text) - at > window:
            cut = _CUT.search(text, at + window)
            if not cut:
                break
            yield self._window(text[at : cut.start()])
            at = cut.start()
        yield self._window(text[at:] if at else text)


_loaded: dict[str, Ids] = {}


class _Worker:
    """The open bins of one task, and the rows of those that are full."""

    def __init__(self, first_id: int, capacity: int, slack: int):
        self.capacity, self.sizes = capacity, classes(capacity, slack)
        self.open, self.holds = {s: [] for s, _ in self.sizes}, dict(self.sizes)
        self.next_id, self.rows, self.bytes = first_id, [], 0

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1
        self.bytes += 4 * offset + 64 * len(pieces)

    def put(self, size: int, piece: tuple) -> None:
        held = self.open[size]
        held.append(piece)
        if len(held) == self.holds[size]:
            self.close(held)
            self.open[size] = []

    def cut(self, doc, start: int, ids: bytes, total: int, sizes: list[int]) -> None:
        """ids into pieces of the given lengths, the largest that fits first."""
        at = 0
        for size in sizes:
            while len(ids) - at >= 4 * size:
                self.put(size, (doc, start + at // 4, ids[at : at + 4 * size], total))
                at += 4 * size

    def finish(self) -> None:
        binary = [s for s, _ in self.sizes if not s & (s - 1)]
        for size in self.open:
            if size not in binary:
                left, self.open[size] = self.open[size], []
                for doc, start, ids, total in left:
                    self.cut(doc, start, ids, total, binary)
        for size in binary:
            left, self.open[size] = self.open[size], []
            while left:
                n = 1 << (len(left).bit_length() - 1)
                self.close(left[:n])
                left = left[n:]

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _ARROW)], schema=_ARROW)
        self.rows, self.bytes = [], 0
        return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """A row for each piece: doc_id, start (ids of the document before it), length, ids (32 bits each, little-endian),
    doc_tokens, sequence_id, offset (ids of the sequence before it).

    docs has doc_id and text; `tokenizer` is the path of a byte-level vocabulary, there on every host; capacity is a power of two.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError(f"capacity {capacity} is no power of two")
    whole, last = 4 * capacity, end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, Ids(tokenizer))
        worker = _Worker(TaskContext.get().partitionId() << 33, capacity, slack)
        sizes = [s for s, _ in worker.sizes]
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, full, tail, taken = doc.as_py(), [], b"", 0
                for ids in encode(text.as_py() or ""):
                    tail += ids
                    for at in range(0, len(tail) - whole + 1, whole):
                        full.append((taken, tail[at : at + whole]))
                        taken += capacity
                    tail = tail[len(tail) // whole * whole :]
                tail += last
                total = taken + len(tail) // 4
                for start, ids in full:
                    worker.put(capacity, (doc, start, ids, total))
                    if worker.bytes >= OUT_BYTES:
                        yield worker.batch()
                worker.cut(doc, taken, tail, total, sizes)
                if worker.bytes >= OUT_BYTES:
                    yield worker.batch()
        worker.finish()
        if worker.rows:
            yield worker.batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, n (ids before padding), ids: each sequence whole, padded to capacity unless n is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, 0).otherwise(capacity - F.col("n"))
    padding = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), pad.cast("int")))
    return joined.select("sequence_id", "n", F.concat(ids, padding).alias("ids"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
