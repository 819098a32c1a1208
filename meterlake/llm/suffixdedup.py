"""Suffix-array dedup: byte strings of LENGTH bytes that also start elsewhere go, all of them.

Method: a logarithmic family of suffix arrays. Documents come in batches. A batch's suffixes are sorted
into an array, a level of size one; while two levels have one size, they and the batch are merged into one array
of twice that size, so a suffix is rewritten a logarithmic number of times. The levels that are left
are merge-scanned together: in the order of all suffixes, what a suffix shares with any other it
shares with a neighbour.

The arrays are sparse. Of the suffixes of every LENGTH bytes, the one whose 16 bytes hash smallest (the
last of equals) among the first SHIFTS is an anchor; equal strings have the same anchor at the same
place, so any repeated string shows as two anchors that agree in their first CORE bytes. An entry is
an anchor with the first 16 bytes of its suffix, by which the array is ordered, then a fingerprint of
its first CORE bytes, then one of its context, i.e. of all that the strings with this anchor reach
before and after it. So a neighbour's common prefix is known to be CORE or not, and an equal
context to be one, from the entries alone. Full arrays over every byte would move each suffix's bytes through the shuffle.

An array is range-partitioned over all columns of an entry: a suffix that is everywhere is split
over as many partitions as its share needs, and only the first and last entry of each partition are compared across.

Long matches are then exact. Anchors whose neighbour has the same context are covered whole. Where
neighbours agree in their core but not in the context, both are refined: the bytes of their contexts are
stored once and compared by 128-bit fingerprints, first CELL shifts at a time: a cell whose whole reach
repeats is covered, one whose windows have nothing repeated in common is done. The others, one for each
distinct reach, are compared shift by shift. A context that repeats is covered anyway and only lends its shifts.

Scale: what is sorted are 56 bytes per anchor. Texts are read twice again, for the contexts to be
refined and for cutting, and shuffled only where the text may hold such a thing, by a bitmap of fixed size. Counting is by
fingerprint with partial aggregation; no group's members meet each other. Very long texts are taken
in pieces that overlap by LENGTH - 1 bytes.

Defined results: null texts are empty; strings never cross documents; occurrences may overlap, also
with themselves; texts shorter than LENGTH are kept whole; rows that repeat id and text are two
documents whose strings all repeat; rows with a null id are told apart by their texts; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, flat_bytes, held_rows, membership, only_held, slices, stored, table
from .hashing import RangeHash, mix

LENGTH = 400
CORE = 64
#: Shifts between a window and its anchor run from 0 to SHIFTS - 1.
SHIFTS = LENGTH - CORE + 1
CELL = 48
BATCHES = 4
#: Bytes of texts hashed at a time; longer texts are taken in pieces.
BATCH_BYTES = 1 << 19
#: Contexts of a text emitted at a time.
CONTEXTS = 2_048
_POSITION = np.uint64((1 << 26) - 1)
_SIGN = np.uint64(1 << 63)
#: An entry; `place` packs the anchor and how many bytes its context has before it and from it on:
#: anchor * 2**20 + before * 2**10 + from.
ENTRY = "b0 long, b1 long, core long, context long, reach int, d long, t long, place long"
ORDER = ["b0", "b1", "core", "context", "reach", "d", "t", "place"]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([values, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _words(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The 8 bytes from each place of data on as a number; data ends with 8 bytes more."""
    return np.ndarray((max(len(data) - 8, 0),), ">u8" if big else "<u8", data.tobytes(), strides=(1,)).astype(np.uint64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, ...]:
    """(row, place in data, first, last) of each row's anchors; rows shorter than `length` have none.

    first and last: the starts of the strings of `length` bytes whose anchor it is; they are a run.
    data holds no more than 2**26 bytes.
    """
    shifts, n = length - core + 1, len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    words = _words(np.concatenate([data, np.zeros(16, np.uint8)]))
    hashed = mix(words[: n + shifts - 1] * np.uint64(0x9E3779B97F4A7C15) + mix(words[8 : n + shifts + 7]))
    place = _POSITION - np.arange(len(hashed), dtype=np.uint64)  # of equal hashes the last one wins
    least = window_minima((hashed & ~_POSITION) | place, shifts)
    start = np.arange(n)
    whole = np.searchsorted(offsets, start, "right") == np.searchsorted(offsets, start + length - 1, "right")
    places, starts = (_POSITION - (least[whole] & _POSITION)).astype(np.int64), start[whole]
    if not len(places):
        return (np.zeros(0, np.int64),) * 4
    at = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    last = np.concatenate([at[1:] - 1, [len(places) - 1]])
    return np.searchsorted(offsets, places[at], "right") - 1, places[at], starts[at], starts[last]


def pieces(offsets: np.ndarray, most: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, begin, end): rows lo .. hi - 1 are the bytes begin .. end, or row lo has a piece there."""
    for lo, hi in slices(offsets, most):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or end - begin <= most:
            yield lo, hi, begin, end
        else:
            for at in range(begin, end - overlap, most):
                yield lo, hi, at, min(at + most + overlap, end)


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key (d, t) of the row that is the same whenever the row is read again.

    t is a 64-bit hash of the text; rows without an id, however many, have another one as d.
    """
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(17), "text")).alias("d"), F.xxhash64("text").alias("t"))


def entries(docs: DataFrame) -> DataFrame:
    """ENTRY columns: an entry of the sparse suffix array per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            for lo, hi, begin, end in pieces(offsets, BATCH_BYTES, LENGTH - 1):
                part, bounds = data[begin:end], np.clip(offsets[lo : hi + 1] - begin, 0, end - begin)
                row, at, first, last = anchors(part, bounds)
                stop = last + LENGTH
                hashed = RangeHash(part)
                core, context = hashed(at, at + CORE), hashed(first, stop)
                head = _words(np.concatenate([part, np.zeros(16, np.uint8)]), big=True)
                reach = ((at - first) << 10) + (stop - at)
                place = ((at + begin - offsets[lo:hi][row]) << 20) + reach
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (head[at] ^ _SIGN, head[at + 8] ^ _SIGN, core, context)), pa.array(reach.astype(np.int32)),
                        batch.column("d")[lo:hi].take(take), batch.column("t")[lo:hi].take(take), pa.array(place)],
                    names=ORDER,
                )

    return docs.select("d", "t", "text").mapInArrow(run, ENTRY)


def _array(*parts: DataFrame) -> DataFrame:
    """The entries of all parts in the order of their suffixes, each compared with its neighbours.

    `same`: a neighbour has the same context, too; `apart`: a neighbour has the core but another
    context; `edge`: the first or last entry of partition `part`, not compared to the outside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, began = TaskContext.get().partitionId(), None, True

        def compared(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            key = [rows.column(c).to_numpy() for c in ORDER[:5]]
            core = np.logical_and.reduce([k[1:] == k[:-1] for k in key[:3]])
            kind = core & (key[3][1:] == key[3][:-1]) & (key[4][1:] == key[4][:-1])
            same, apart = (np.concatenate([[False], x]) | np.concatenate([x, [False]]) for x in (kind, core & ~kind))
            if held is not None:  # the first row is the last of the batch before
                same[0] |= held.column("same")[0].as_py()
                apart[0] |= held.column("apart")[0].as_py()
            edge = np.zeros(rows.num_rows, bool)
            edge[0] |= began
            edge[-1] |= last
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ORDER), pa.array(same), pa.array(apart), pa.array(edge),
                pa.array(np.full(rows.num_rows, part, np.int32))], names=[*ORDER, "same", "apart", "edge", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = compared(batch if held is None else pa.concat_batches([held.select(ORDER), batch]), False)
            held = rows.slice(rows.num_rows - 1)
            if rows.num_rows > 1:
                yield rows.slice(0, rows.num_rows - 1)
                began = False
        if held is not None:
            yield compared(held.select(ORDER), True)

    whole = parts[0].select(ORDER)
    for part in parts[1:]:
        whole = whole.unionByName(part.select(ORDER))
    return whole.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, ENTRY + ", same boolean, apart boolean, edge boolean, part int")


def family(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """The levels of the index over docs, which come in `batches` batches."""
    batch = F.pmod(F.xxhash64("d", "t"), F.lit(batches)).cast("int")
    every = stored(entries(docs).withColumn("batch", batch), "suffix-entries", "batch")
    levels: list[tuple[int, DataFrame]] = []
    for b in range(batches):
        size, equal = 1, [every.where(F.col("batch") == b)]
        while levels and levels[-1][0] == size:  # the carry of a binary counter
            size *= 2
            equal.append(levels.pop()[1])
        levels.append((size, stored(_array(*equal), f"suffix-level-{size}")))
        discarded(*equal[1:])
    discarded(every)
    return [level for _, level in levels]


def matched(levels: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries whose context a neighbour shares, those of which a neighbour shares the core only, their table)."""
    whole = levels[0]
    if len(levels) > 1:
        whole = stored(_array(*levels), "suffix-levels")
        discarded(*levels)
    # Two entries a partition; a partition's last one is compared with the next one's first.
    edges: dict[int, list] = {}
    for r in sorted(whole.where("edge").select(*ORDER, "part").collect()):
        edges.setdefault(r["part"], []).append(r)
    across = {"same": [], "apart": []}
    ordered = [edges[p] for p in sorted(edges)]
    for one, two in zip(ordered, ordered[1:]):
        a, b = one[-1], two[0]
        if a[:3] == b[:3]:
            across["same" if a[:5] == b[:5] else "apart"] += [tuple(a[:8]), tuple(b[:8])]
    return tuple(whole.where(k).select(ORDER).unionByName(whole.sparkSession.createDataFrame(across[k], ENTRY)) for k in ("same", "apart")) + (whole,)


def contexts(texts: DataFrame, apart: DataFrame) -> DataFrame:
    """d, t, place, s: the bytes of the contexts of entries."""
    wanted = stored(apart.groupBy("d", "t").agg(F.array_sort(F.collect_set("place")).alias("at")), "suffix-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, text, at in zip(batch.column("d"), batch.column("t"), batch.column("text"), batch.column("at")):
                raw, at = text.as_buffer(), at.values.to_numpy()
                for k in range(0, len(at), CONTEXTS):
                    some = at[k : k + CONTEXTS]
                    begin, end = (some >> 20) - ((some >> 10) & 1023), (some >> 20) + (some & 1023)
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.repeat(d, n), pa.repeat(t, n), pa.array(some),
                        pa.array([raw[b:e].to_pybytes() for b, e in zip(begin.tolist(), end.tolist())], pa.binary())], names=["d", "t", "place", "s"])

    # Only texts that may have something wanted are shuffled; the hash table is of the wanted side.
    some = only_held(texts, membership(wanted, "d", "t"), "d", "t", once=True)
    out = stored(some.join(wanted.hint("shuffle_hash"), ["d", "t"]).select("d", "t", "text", "at").mapInArrow(run, "d long, t long, place long, s binary"), "suffix-contexts")
    discarded(wanted)
    return out


def cells_of(strings: DataFrame) -> DataFrame:
    """Cells of shifts x .. x + CELL - 1 of each context, of which low .. high count.

    h1, h2 are of what the whole cell's strings have in common, u1, u2 of all that low .. high reach.
    """
    first = np.arange(0, SHIFTS, CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column("s"))
            for lo, hi in slices(offsets, BATCH_BYTES):
                place = batch.column("place")[lo:hi].to_numpy()
                left, right = (place >> 10) & 1023, place & 1023
                low, high = np.maximum(first, (LENGTH - right)[:, None]), np.minimum(first + CELL - 1, left[:, None])
                row, c = np.nonzero(low <= high)
                low, high, x = low[row, c], high[row, c], first[c]
                p = (offsets[lo:hi] - offsets[lo] + left)[row]
                part = data[offsets[lo] : offsets[hi]]
                hashes = [RangeHash(part, 0), RangeHash(part, 1)]
                own = mix((low * 1024 + high).astype(np.uint64))
                # Where one string of a cell lies in the document, so does the common part.
                common = [h(p - x, p - np.minimum(x + CELL - 1, SHIFTS - 1) + LENGTH) for h in hashes]
                reach = [h(p - high, p - low + LENGTH) ^ own for h in hashes]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[lo:hi].take(take) for k in ("d", "t", "place")), *(pa.array(v.astype(np.int16)) for v in (x, low, high)),
                        *(pa.array(h.view(np.int64)) for h in (*common, *reach))],
                    names=["d", "t", "place", "x", "low", "high", "h1", "h2", "u1", "u2"],
                )

    return strings.mapInArrow(run, "d long, t long, place long, x short, low short, high short, h1 long, h2 long, u1 long, u2 long")


def shifts_of(strings: DataFrame) -> DataFrame:
    """A row for each shift y from low to high of the cells `at`, with h1, h2 of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column("s"))
            for lo, hi in slices(offsets, BATCH_BYTES // 4):
                at = batch.column("at")[lo:hi]
                row = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(at).to_numpy())
                x, low, high = (a.to_numpy().astype(np.int64) for a in at.flatten().flatten())
                each = high - low + 1
                y = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - low, each)
                row, x = np.repeat(row, each), np.repeat(x, each)
                p = (offsets[lo:hi] - offsets[lo] + ((batch.column("place")[lo:hi].to_numpy() >> 10) & 1023))[row]
                part = data[offsets[lo] : offsets[hi]]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[lo:hi].take(take) for k in ("d", "t", "place")), pa.array(x.astype(np.int16)), pa.array(y.astype(np.int16)),
                        *(pa.array(RangeHash(part, k)(p - y, p - y + LENGTH).view(np.int64)) for k in (0, 1))],
                    names=["d", "t", "place", "x", "y", "h1", "h2"],
                )

    return strings.mapInArrow(run, "d long, t long, place long, x short, y short, h1 long, h2 long")


def around(shifts: DataFrame) -> DataFrame:
    """d, t, s, e: the bytes that the strings of shifts_of() rows cover, a row for each anchor.

    Each of them holds its anchor, so those of one anchor leave no gap between the first and the last.
    """
    p = F.shiftright("place", 20).alias("p")
    return shifts.groupBy("d", "t", p).agg(F.min("y").alias("low"), F.max("y").alias("high")).select(
        "d", "t", (F.col("p") - F.col("high")).cast("int").alias("s"), (F.col("p") - F.col("low") + LENGTH).cast("int").alias("e"))


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """d, t, starts, ends: byte spans of repeated strings, merged, a row per document that has any; a stored table."""
    texts = docs.select("d", "t", "text")
    same, apart, found = matched(family(texts, batches))
    p, left, right = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(1023), F.col("place").bitwiseAND(1023)
    covered = same.select("d", "t", (p - left).cast("int").alias("s"), (p + right).cast("int").alias("e"))

    # Cells of shifts of contexts that share their core with another context.
    strings = contexts(texts, apart)
    cells = stored(cells_of(strings), "suffix-cells")
    # Reach: all that a cell's strings reach. An anchor is known by its place in its document.
    spot = F.struct("d", "t", "place")
    reaches = cells.groupBy("x", "low", "high", "h1", "h2", "u1", "u2").agg(F.min(spot).alias("a"), F.max(spot).alias("b"))
    other = (F.col("a.d") != F.col("b.d")) | (F.col("a.t") != F.col("b.t")) | (F.shiftright("a.place", 20) != F.shiftright("b.place", 20))
    reaches = stored(reaches.select("x", "low", "high", "h1", "h2", "u1", "u2", "a.*", other.alias("twice")), "suffix-reaches")
    full = stored(reaches.where("twice").select("x", "u1", "u2").distinct(), "suffix-full")
    filled = cells.join(full, ["x", "u1", "u2"], "left_semi").select("d", "t", (p - F.col("high")).cast("int").alias("s"), (p - F.col("low") + LENGTH).cast("int").alias("e"))

    # Shift by shift: one cell of each distinct reach, where what the strings share has several.
    mixed = stored(reaches.groupBy("x", "h1", "h2").agg(F.count("*").alias("k")).where("k > 1").select("x", "h1", "h2"), "suffix-mixed")
    single = reaches.join(mixed, ["x", "h1", "h2"], "left_semi").groupBy("d", "t", "place").agg(F.array_sort(F.collect_set(F.struct("x", "low", "high"))).alias("at"))
    single = stored(single, "suffix-single")
    held = only_held(strings, membership(single, "d", "t", "place"), "d", "t", "place")
    shifts = stored(shifts_of(held.join(single.hint("shuffle_hash"), ["d", "t", "place"]).select("d", "t", "place", "s", "at")), "suffix-shifts")
    anchor = F.xxhash64("d", "t", p)
    twice = shifts.groupBy("y", "h1", "h2").agg(F.min(anchor).alias("a"), F.max(anchor).alias("b")).where("a <> b").select("y", "h1", "h2")
    twice = stored(twice, "suffix-twice")
    hit = around(shifts.join(twice, ["y", "h1", "h2"], "left_semi"))
    spans = covered.unionByName(filled).unionByName(hit).groupBy("d", "t").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def expand(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            runs = []
            for one in part.column("spans"):
                starts, ends = (a.to_numpy() for a in one.values.flatten())
                order = np.argsort(starts, kind="stable")
                runs.append(merged(starts[order], ends[order]))
            yield pa.RecordBatch.from_arrays([part.column("d"), part.column("t"), pa.array([[s for s, _ in r] for r in runs], pa.list_(pa.int32())),
                pa.array([[e for _, e in r] for r in runs], pa.list_(pa.int32()))], names=["d", "t", "starts", "ends"])

    out = stored(spans.mapInArrow(expand, "d long, t long, starts array<int>, ends array<int>"), "suffix-spans")
    discarded(found, strings, cells, reaches, full, mixed, single, shifts, twice)
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans sorted by start; touching ones are one run."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return list(zip(starts[new].tolist(), reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])].tolist()))


def cut(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): a row per document."""
    keyed = _documents(docs)
    spans = repeated_spans(keyed, batches)
    held = membership(spans, "d", "t")
    # A text that the filter does not hold has no span and is done where it lies.
    some = only_held(keyed, held, "d", "t").join(spans.hint("shuffle_hash"), ["d", "t"], "left").select("doc_id", "text", "starts", "ends")
    plain = keyed.select("doc_id", "text", F.xxhash64("d", "t").alias("__key"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            if "__key" in part.schema.names:
                part = part.filter(pa.array(~held_rows(held, part.column("__key"))))
                spans = [(None, None)] * part.num_rows
            else:
                spans = zip(part.column("starts").to_pylist(), part.column("ends").to_pylist())
            for text, (starts, ends) in zip(part.column("text"), spans):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                out, at = [], 0
                for s, e in zip(starts or (), ends or ()):
                    out.append(raw[at:s])
                    at = e
                out.append(raw[at:])
                kept.append(b"".join(out))
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(kept[-1]))
                n_spans.append(len(starts or ()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    return plain.mapInArrow(run, schema).unionByName(some.mapInArrow(run, schema))


def op8_suffixdedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cut(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
with raw as (select doc_id, encode(coalesce(text, '')) as b from documents),
spot as (select doc_id, i, hash(b[i + 1:i + 400]) as h from raw, unnest(range(0, octet_length(b) - 399)) t(i)),
twice as (select h from spot group by h having count(*) > 1),
hit as (select doc_id, i from spot semi join twice using (h)),
edge as (
  select doc_id, i, case when i > lag(i + 400) over (partition by doc_id order by i) then 1 else 0 end as jump from hit),
grp as (select doc_id, i, sum(jump) over (partition by doc_id order by i) as g from edge),
span as (select doc_id, g, min(i) as s, max(i) + 400 as e from grp group by doc_id, g),
gap as (
  select doc_id, coalesce(lag(e) over (partition by doc_id order by s), 0) as a, s as z from span
  union all select doc_id, max(e), 1000000000 from span group by doc_id),
kept as (select doc_id, string_agg(hex(b[a + 1:least(z, octet_length(b))]), '' order by a) as k from gap join raw using (doc_id) group by doc_id),
num as (select doc_id, sum(e - s) as n, count(*) as c from span group by doc_id)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(c, 0) as n_spans, sha256(coalesce(unhex(k), b)) as kept_sha256
from raw left join num using (doc_id) left join kept using (doc_id)
"""
