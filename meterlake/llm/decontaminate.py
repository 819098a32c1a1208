"""Benchmark decontamination with a generalised suffix automaton over item words.

The benchmark items become one automaton whose alphabet is words. Every document streams its words
through it, tracking the longest suffix that occurs in some item. A position whose longest match
reaches `window` words ends an occurrence of a window; an item shorter than a window is a window of
its own and is found through the suffix links.

Scale: documents are never shuffled. Items are cut into blocks of at most `block_words` words; the
automaton of a block is what a task holds, so its size is bounded by a parameter however large the
benchmark is. The driver holds one block at a time; further blocks are further passes, each a stored
table whose broadcast is released, and their hits are merged.

Defined results: null and empty texts have no words and are not hit; an item without words, null or
not, is never matched; repeated items all count; items without an id hit like any other: together
they are one item of n_items, which the digest of the ids leaves out; an empty benchmark leaves every document clean;
rows with a null doc_id are kept and judged on their own; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, plain, stored, table

WINDOW = 13
#: Words of benchmark items in one block, hence in one automaton in a task's memory.
BLOCK_WORDS = 400_000
#: A document is contaminated when COVERAGE times its hit words reach its words.
COVERAGE = 20

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: A-Z lowered, anything ASCII but digits and letters separates."""
    return text.translate(_WORD_BYTES).split()


class WordAutomaton:
    """Generalised suffix automaton; `item_sets[s]` are the items in which state s's window occurs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        # Windows are anchored at the one state of their length class, per item.
        self.item_sets: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}  # state -> length -> whole short items
        for item_id, words in items:
            if not words:
                continue
            state, matched = 0, 0
            for word in words:
                state, matched = self.next[state][word], matched + 1
                if matched > window:
                    matched = window
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                if matched >= window:
                    self.item_sets.setdefault(state, set()).add(item_id)
            if len(words) < window:
                self.short.setdefault(state, {}).setdefault(len(words), set()).add(item_id)
        # Longest whole short item that is a suffix of a state's shortest string or of the state itself.
        self.short_link = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            self.short_link[state] = up if up in self.short else self.short_link[up]

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = twin
            p = link[p]
        link[q] = twin
        return twin

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged word spans inside occurring windows, ids of the items with occurring windows)."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = matched = 0
        for i, word in enumerate(words):
            to = nxt[state].get(word)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(word)
                matched = length[state] if to is not None else 0
            if to is None:
                state = 0
                continue
            state, matched = to, matched + 1
            reach = 0
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                items |= self.item_sets.get(state, ())
                reach = window
            if self.short:
                at = state
                while at > 0:
                    for size, whole in self.short.get(at, {}).items():
                        if size <= matched:
                            reach = max(reach, size)
                            items |= whole
                    at = self.short_link[at]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


_cache: dict[tuple, WordAutomaton] = {}


def _automaton(block, window: int) -> WordAutomaton:
    """One automaton is kept per Python worker; tasks of a pass share it."""
    key, items = block.value
    if (key, window) not in _cache:
        _cache.clear()
        _cache[key, window] = WordAutomaton(items, window)
    return _cache[key, window]


def _passes(benchmark: DataFrame, block_words: int) -> Iterator[tuple]:
    """(broadcast block, whether it is the last) for each block of items; one block at least."""
    sc = benchmark.sparkSession.sparkContext
    blocks = item_blocks(benchmark, block_words)
    now = next(blocks, [])
    while now is not None:
        after = next(blocks, None)
        yield sc.broadcast((uuid.uuid4().hex, now)), after is None
        now = after


def _hits(docs: DataFrame, block, window: int) -> DataFrame:
    """Rows of docs (row, text) with n_words, spans and items found for one block of items."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block, window)
        for batch in batches:
            n_words, starts, ends, items = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                spans, found = automaton.scan(words)
                n_words.append(len(words))
                starts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=[*(c for c in batch.schema.names if c != "text"), "n_words", "starts", "ends", "items"],
            )

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(scan, f"{rest}, n_words long, starts array<int>, ends array<int>, items array<string>")


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, streamed to the driver in blocks of at most `block_words` words (one item at least).

    An item is named "i" and its id; all that have no id are named "".
    """
    block, held = [], 0
    for row in benchmark.select(F.coalesce(F.concat(F.lit("i"), F.col("item_id").cast("string")), F.lit("")).alias("i"), F.col("text").alias("t")).where("t is not null").toLocalIterator():
        words = words_of(row["t"].encode())
        if not words:
            continue
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((row["i"], words))
        held += len(words)
    if block:
        yield block


def merge_spans(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, starts, ends (merged hit word spans), items (sorted ids, null first for those without): a row per document."""
    ids = F.transform("items", lambda x: F.when(x != "", F.substring(x, 2, 2**31 - 1))).alias("items")
    texts, parts = docs.select("doc_id", "text"), []
    for block, last in _passes(benchmark, block_words):
        if last and not parts:
            return _hits(texts, block, window).withColumn("items", ids)
        if not parts:
            texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
        parts.append(stored(_hits(texts, block, window), "decontaminate-hits"))
        block.destroy()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    merged = whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join_spans(batches):
        for batch in batches:
            spans = [merge_spans(s, e) for s, e in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"),
                pa.array([[s for s, _ in x] for x in spans], pa.list_(pa.int32())), pa.array([[e for _, e in x] for x in spans], pa.list_(pa.int32())),
                batch.column("items")], names=["doc_id", "n_words", "starts", "ends", "items"])

    return merged.select("doc_id", "n_words", "starts", "ends", ids).mapInArrow(join_spans,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, starts array<int>, ends array<int>, items array<string>")


def digest(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words")))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    raw, at, word, out, begin = text.encode(), 0, -1, [], 0
    plain = raw.translate(_WORD_BYTES)
    bounds = []
    n = len(plain)
    while at < n:
        if plain[at] == 32:
            at += 1
            continue
        end = plain.find(b" ", at)
        end = n if end < 0 else end
        bounds.append((at, end))
        at = end
    for s, e in spans:
        out.append(raw[begin : bounds[s][0]])
        begin = bounds[e - 1][1]
    return b"".join([*out, raw[begin:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without contamination: those whose hits reach 1/coverage of their words go, in others the hit spans are cut.

    Keeps the columns of docs, whatever their names. Items come in blocks; each block is one map over
    the documents, all but the last a stored table.
    """
    carried, rows = "spans", plain(docs)
    columns, out = rows.columns, rows
    # A word is judged by all blocks together, so spans are carried along until the last block.
    for block, last in _passes(benchmark, block_words):
        before, out = out, out.mapInArrow(_cleaner(block, window, coverage, columns, carried, last), _ddl(rows) + ("" if last else f", `{carried}` array<int>"))
        if not last:
            out = stored(out, "decontaminate-pass")
            block.destroy()
            if before is not rows:
                discarded(before)
    return out.toDF(*docs.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _cleaner(block, window: int, coverage: int, columns: list[str], held: str, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block, window)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            before = batch.column(held).to_pylist() if held in batch.schema.names else [[]] * len(texts)
            keep, new, carried = [], [], []
            for text, old in zip(texts, before):
                words = words_of(text.encode()) if text else []
                found, _ = automaton.scan(words)
                spans = merge_spans([*old[::2], *(s for s, _ in found)], [*old[1::2], *(e for _, e in found)])
                hit = sum(e - s for s, e in spans)
                keep.append(not last or not (hit and coverage * hit >= len(words)))
                new.append(cut_spans(text, spans) if last and spans and keep[-1] else text)
                carried.append([x for s in spans for x in s])
            arrays = [pa.array(new, batch.schema.field(c).type) if c == "text" else batch.column(c) for c in columns]
            if last:
                yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(carried, pa.list_(pa.int32()))], names=[*columns, held])

    return run


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return digest(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP2_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w, row_number() over () as r
  from documents),
items as (
  select coalesce('i' || cast(item_id as varchar), '') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
windows as (
  select distinct item, least(len(w), 13) as k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as s
  from items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) where len(w) > 0),
sizes as (select distinct k from windows),
spots as (
  select r, i, k, array_to_string(w[i:i + k - 1], ' ') as s
  from words, sizes, unnest(range(1, len(w) - k + 2)) t(i)),
found as (select r, i, spots.k, item from spots join windows using (k, s)),
hit as (
  select r, count(distinct p) as n from (select distinct r, i, k from found), unnest(range(i, i + k)) u(p) group by r),
named as (
  select r, count(distinct item) as n, array_to_string(list_sort(list(distinct item[2:]) filter (item <> '')), ',') as ids from found group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items,
  sha256(coalesce(named.ids, '')) as items_sha256,
  coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) as contaminated
from words left join hit using (r) left join named using (r)
"""
