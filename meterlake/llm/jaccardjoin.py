"""N-gram Jaccard join: T-occurrence search with DivideSkip, linked documents as components.

Two documents link when their sets of word shingles overlap by Jaccard >= NUM/100. With sizes m and n
that means an overlap of at least T = ceil(NUM * (m + n) / (100 + NUM)).

1. A document's set becomes 64-bit hashes, a parity bitmap of them, and its prefix: any two sets
   that link share one of their first n - ceil(NUM * n / 100) + 1 hashes, in any order common to all
   (prefix filter). The order is by hash, except that hashes found in very many prefixes of a first
   pass come last, so that a shingle that is everywhere brings no documents together.
2. Documents with equal sets are one class; the smallest id stands for it from here on.
3. Candidates: first each class meets the smallest class of its groups by the ANCHORS smallest
   hashes; the links found join classes to components. Then prefix hashes that still lie in several
   components are opened. In a group of more than LARGE classes each class meets the nearest one of another
   component, by bitmap, again and again while classes have more than FEW open partners on average, so that a large
   group of near copies becomes one component by a few pairs per class. Whatever is open then is opened in full: a group of them is dealt into blocks, every pair of blocks is a task, and a
   task passes on the pairs of different components whose sizes and bitmaps allow the overlap. The
   symmetric difference of two sets is at least the Hamming distance of their bitmaps, so no pair
   that links is lost.
4. Verification is the T-occurrence search, the judge of every link, on what the filters have left: for each class its candidates' inverted lists, the long
   ones set aside, the short ones merged by a heap; who occurs often enough is probed in the long
   ones by binary search (DivideSkip).
5. Links of both rounds form the components.

Scale: shingles are never shuffled as a whole, only the prefixes (a tenth) with their bitmaps where a
hash occurs twice. A group that holds very many classes, say a third of all, is mostly one component
after the first round and closes; where it stays open it is split into blocks of BLOCK classes. No
group's pairs are all written: pairs of one component are skipped, the rest must pass the filters.

Defined results: null and empty texts, or texts without words, have no shingles and link with nothing;
with fewer words than a shingle the whole sequence is one; rows that repeat an id are one document,
which links where any of its texts does, and one row each in the result, with the set size of the row's own text (if texts
of an id differ, rows are numbered in a written table, joined by number, and components that share an id become one); a
row with a null id is its own component, null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discarded, empty, fetched, flat_bytes, held_rows, membership, only_held, slices, stored, table
from .components import connected
from .hashing import mix, word_hashes

WORDS = 3
NUM = 90
#: Smallest hashes by which classes meet in the first round.
ANCHORS = 4
#: Classes in a block of an open group.
BLOCK = 512
#: Hashes in more prefixes than this are common. At most MOST_COMMON hashes are: with more rows the
#: bound rises, and any bound gives the same result.
COMMON = 64
MOST_COMMON = 1_000_000
#: Classes from which on an open group is first tried by nearest pairs, and rounds of that at most.
LARGE = 64
ROUNDS = 8
#: Open partners of a class, on average, up to which large groups are opened in full at once: no more pairs than a few rounds have.
FEW = 4
#: Inverted lists longer than this share of the candidates are set aside, if there are so many.
LONG_SHARE = 0.5
#: Candidates of a query that are judged in one place.
CANDIDATES = 256
BATCH_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, is_word: np.ndarray = _IS_WORD) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each row."""
    hashed, bounds = word_hashes(data, offsets, is_word, _LOWER)
    n = len(hashed)
    full = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        full = mix(full * np.uint64(0x9E3779B97F4A7C15) + hashed[k : n - words + 1 + k]) if len(full) else full
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in hashed[a:b]:
                h = mix(h * np.uint64(0xD1B54A32D192ED03) + x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int, num: int = NUM) -> int:
    return n - -(-num * n // 100) + 1 if n else 0


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity bitmap, a power of two of bits, at least one for each hash."""
    bits = max(64, 1 << int(len(hashes) - 1).bit_length()) if len(hashes) else 64
    place = (hashes >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def needed(m, n, num: int = NUM):
    """Overlap from which two sets of sizes m and n link."""
    return -(-num * (m + n) // (100 + num))


def with_room(n: np.ndarray, maps: list[bytes], num: int = NUM) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, room): sets i and those no smaller that may link with it by size and bitmap; each pair once.

    room: how far their bitmaps are from ruling the link out.
    """
    width = np.array([len(x) for x in maps])
    order = np.lexsort((width, n))
    size, wide = n[order], width[order]
    matrices = {}
    for w in np.unique(wide):
        m = np.zeros((len(order), w), np.uint8)
        for v in np.unique(wide[wide >= w]):
            at = np.flatnonzero(wide == v)
            x = np.stack([np.frombuffer(maps[k], np.uint8) for k in order[at]])
            m[at] = np.bitwise_xor.reduce(x.reshape(len(at), v // w, w), axis=1)
        matrices[w] = m
    ends = np.searchsorted(size, 100 * size // num, "right")
    for at, end in enumerate(ends.tolist()):
        if end > at + 1:
            m = matrices[wide[at]]
            apart = np.bitwise_count(m[at + 1 : end] ^ m[at]).sum(axis=1, dtype=np.int64)
            room = size[at + 1 : end] + size[at] - 2 * needed(size[at], size[at + 1 : end], num) - apart
            ok = room >= 0
            if ok.any():
                yield int(order[at]), order[at + 1 : end][ok], room[ok]


def may_link(n: np.ndarray, maps: list[bytes], num: int = NUM) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js) of with_room."""
    return ((i, js) for i, js, _ in with_room(n, maps, num))


def t_occurrence(query: np.ndarray, sets: list[np.ndarray], num: int = NUM) -> list[int]:
    """Which of the sets overlap the query in as many shingles as they need to link (DivideSkip)."""
    lists: dict[int, list[int]] = {}
    members = query.tolist()
    wanted = set(members)
    for k, s in enumerate(sets):
        for h in s.tolist():
            if h in wanted:
                lists.setdefault(h, []).append(k)
    need = [needed(len(query), len(s), num) for s in sets]
    least = min(need)
    by_length = sorted((lists[h] for h in members if h in lists), key=len, reverse=True)
    # The longest lists are set aside, fewer than the smallest threshold.
    aside = 0
    while aside < min(len(by_length), least - 1) and len(by_length[aside]) > LONG_SHARE * len(sets):
        aside += 1
    long, short = by_length[:aside], by_length[aside:]
    counts: dict[int, int] = {}
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        k, i, at = heapq.heappop(heap)
        counts[k] = counts.get(k, 0) + 1
        if at + 1 < len(short[i]):
            heapq.heappush(heap, (short[i][at + 1], i, at + 1))
    if aside >= least:
        counts = {k: counts.get(k, 0) for k in range(len(sets))}
    out = []
    for k, have in counts.items():
        if have + aside < need[k]:
            continue
        for j, ids in enumerate(long):
            if have + aside - j < need[k]:
                break
            at = bisect_left(ids, k)
            have += at < len(ids) and ids[at] == k
        if have >= need[k]:
            out.append(k)
    return sorted(out)


def prefix_of(x: np.ndarray, common: np.ndarray, num: int = NUM) -> np.ndarray:
    """The first hashes of a sorted set in the common order: those of `common` (sorted) come last."""
    size = prefix_size(len(x), num)
    if not len(common) or not size:
        return x[:size]
    for reach in (2 * size, len(x)):
        part = x[:reach]
        rare = part[common[np.minimum(np.searchsorted(common, part), len(common) - 1)] != part]
        if len(rare) >= size:
            return rare[:size]
    return np.concatenate([rare, x[common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x]])[:size]


def common_hashes(docs: DataFrame, words: int = WORDS, num: int = NUM, is_word: np.ndarray = _IS_WORD) -> np.ndarray:
    """Sorted hashes found in very many prefixes in plain order of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            for lo, hi in slices(offsets, BATCH_BYTES):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words, is_word)
                keys, counts = np.unique(np.concatenate([x[: prefix_size(len(x), num)] for x in sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "c"])

    counted = docs.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    counted = stored(counted.where(F.col("c") > COMMON), "jaccard-common")
    total = fetched(counted.agg(F.sum("c")))[0][0] or 0
    rows = counted.where(F.col("c") > max(COMMON, total // MOST_COMMON)).select("key").toPandas()
    return np.sort(rows["key"].to_numpy(np.int64).view(np.uint64))


def profiles(docs: DataFrame, common: np.ndarray, words: int = WORDS, num: int = NUM, is_word: np.ndarray = _IS_WORD) -> DataFrame:
    """id, n, s1, s2 (a 128-bit fingerprint of the set), bits, prefix: a row per document."""
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            for lo, hi in slices(offsets, BATCH_BYTES):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words, is_word)
                with np.errstate(over="ignore"):
                    s1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                    s2 = np.array([mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                prefix = pa.array([prefix_of(x, held.value, num).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id")[lo:hi], pa.array([len(x) for x in sets], pa.int32()), pa.array(s1), pa.array(s2),
                    pa.array([bitmap(x) for x in sets], pa.binary()), prefix], names=["id", "n", "s1", "s2", "bits", "prefix"])

    return docs.select("id", "text").mapInArrow(run, "id long, n int, s1 long, s2 long, bits binary, prefix array<long>")


def verified(docs: DataFrame, pairs: DataFrame, words: int = WORDS, num: int = NUM, is_word: np.ndarray = _IS_WORD) -> DataFrame:
    """The candidate pairs (a, b) that link, a stored table. `docs` (id, text) has one row for each id that occurs."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    held = membership(ids, "id")

    # Texts become sets where they lie; only sets that may be wanted are shuffled. The filter is a part
    # of the same map, as a chain of maps would hold twice as many Python workers.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(held_rows(held, batch.column("key"))))
            data, offsets = flat_bytes(batch.column("text"))
            for lo, hi in slices(offsets, BATCH_BYTES):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words, is_word)
                yield pa.RecordBatch.from_arrays([batch.column("id")[lo:hi], pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "s"])

    made = docs.select("id", "text", F.xxhash64("id").alias("key")).mapInArrow(run, "id long, s binary")
    sets = stored(made.join(ids, "id", "left_semi"), "jaccard-sets")
    held.destroy()

    # A query is a row with a null b and a's set, followed by its candidates. A class with very many
    # candidates is several queries, which meet in different places.
    many = stored(pairs.groupBy("a").agg(F.count("*").alias("c")), "jaccard-many")
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / float(CANDIDATES))).alias("salt"))
    right = salted.join(sets.select(F.col("id").alias("b"), F.col("s")), "b").select("a", "salt", "b", "s")
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), F.col("s")), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "s")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, name = None, None
        for batch in batches:
            found_a, found_b = [], []
            a, salt, b = (batch.column(k).to_pylist() for k in ("a", "salt", "b"))
            sets = batch.column("s")
            raw = lambda i: np.frombuffer(sets[i].as_buffer(), np.uint64)
            at = 0
            while at < len(a):
                if b[at] is None:
                    query, name, at = raw(at), (a[at], salt[at]), at + 1
                    continue
                end = at
                while end < len(a) and (a[end], salt[end]) == name and b[end] is not None:
                    end += 1
                for k in t_occurrence(query, [raw(i) for i in range(at, end)], num):
                    found_a.append(a[at + k])
                    found_b.append(b[at + k])
                at = end
            query = None if query is None else query.copy()
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    queries = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    links = stored(queries.mapInArrow(search, "a long, b long"), "jaccard-links")
    discarded(sets, many)
    return links


def _open_pairs(opened: DataFrame, num: int, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of different components that the filters let through, from blocks of open groups.

    nearest: of each class only the pair with the most room, so no more pairs than classes; `met` says in how many blocks
    the pair was chosen, `partners` how many pairs were let through there.
    """
    split = F.ceil(F.col("size") / float(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("split")).cast("int")
    dealt = opened.withColumn("split", split).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "bits")
    groups = dealt.groupBy("key", "i", "j").agg(F.collect_list(F.struct("id", "component", "n", "own", "bits")).alias("g"), F.min("component").alias("c0"),
        F.max("component").alias("c1")).where("c0 <> c1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b, partners = [], [], []
            for i, j, g in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("g")):
                v = g.values
                ids, comp, n, own = (v.field(k).to_numpy() for k in range(4))
                for k, js, room in with_room(n.astype(np.int64), v.field(4).to_pylist(), num):
                    ok = (comp[js] != comp[k]) & ((own[js] != own[k]) | (i == j))
                    js = js[ok]
                    partners += [len(js)] * (len(js) > 0)
                    js = js[np.argmax(room[ok])][None] if nearest and len(js) else js
                    out_a += np.maximum(ids[js], ids[k]).tolist()
                    out_b += np.minimum(ids[js], ids[k]).tolist()
            found = [pa.array(x, pa.int64()) for x in (out_a, out_b, *[partners] * nearest)]
            yield pa.RecordBatch.from_arrays(found, names=["a", "b", "partners"][: len(found)])

    if nearest:
        found = groups.select("i", "j", "g").mapInArrow(run, "a long, b long, partners long")
        return found.groupBy("a", "b").agg(F.count("*").alias("met"), F.sum("partners").alias("partners"))
    return groups.select("i", "j", "g").mapInArrow(run, "a long, b long").distinct()


def torn(docs: DataFrame) -> bool:
    """Whether an id (not null) stands at different texts."""
    twice = stored(docs.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "jaccard-repeated")
    h = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))), F.crc32(F.coalesce("text", F.lit(""))))
    found = not empty(twice) and not empty(docs.join(twice, "id", "left_semi").groupBy("id").agg(F.min(h).alias("x"), F.max(h).alias("y")).where("x <> y"))
    discarded(twice)
    return found


def join(docs: DataFrame, words: int = WORDS, num: int = NUM, is_word: np.ndarray = _IS_WORD) -> DataFrame:
    """id, n_shingles, component_id for docs (id long, text): a row per row of docs."""
    lost = profiles(docs.where("id is null"), np.zeros(0, np.uint64), words, num, is_word)
    lost = lost.select("id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    named = docs.where("id is not null").select("id", "text")
    if not torn(named):
        return join_once(named, words, num, is_word).unionByName(lost)
    rows = numbered(named)
    found = join_once(rows.select(F.col("row").alias("id"), "text"), words, num, is_word).toDF("row", "n_shingles", "c")
    found = stored(rows.select("row", "id").join(found, "row"), "jaccard-placed")
    # Components of rows that share an id are one.
    least = stored(found.groupBy("id").agg(F.min("c").alias("b"), F.max("c").alias("most")).where("b <> most").select("id", "b"), "jaccard-shared")
    merged = connected(found.join(least, "id").select(F.col("c").alias("a"), "b").where("a <> b").distinct())
    whole = stored(found.join(merged, F.col("c") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("component", "c").alias("c")), "jaccard-merged")
    names = stored(whole.groupBy("c").agg(F.min("id").alias("component_id")), "jaccard-names")
    out = stored(whole.join(names, "c").select("id", "n_shingles", "component_id"), "jaccard-found")
    discarded(rows, found, least, whole, names)
    return out.unionByName(lost)


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """docs with a number of each row in a column `name`; a stored table, so that it stays a row's own."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "jaccard-numbered")


def join_once(docs: DataFrame, words: int = WORDS, num: int = NUM, is_word: np.ndarray = _IS_WORD) -> DataFrame:
    """join() of docs without null ids where an id has one text; a stored table."""
    texts = docs.select("id", "text")
    common = common_hashes(texts, words, num, is_word)
    known = stored(profiles(texts, common, words, num, is_word), "jaccard-profiles")
    some = known.where("n > 0")
    classes = some.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last")
    classes = stored(classes.select("n", "s1", "s2", "rep"), "jaccard-classes")
    copies = stored(some.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).where("id <> rep").select("id", "n", "s1", "s2", "rep"), "jaccard-copies")
    reps = stored(some.join(copies, ["id", "n", "s1", "s2"], "left_anti").select("id", "n", "bits", "prefix"), "jaccard-reps")

    # Round 1: by the first hashes, each class with the smallest of its group.
    anchors = stored(reps.select("id", F.explode(F.slice("prefix", 1, ANCHORS)).alias("key")), "jaccard-anchors")
    least = stored(anchors.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b <> most").select("key", "b"), "jaccard-least")
    stars = anchors.join(least, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    stars = _filtered(stored(stars, "jaccard-stars"), reps, num)
    links = verified(texts, stars, words, num, is_word)
    comp = connected(links)
    placed = reps.join(comp, reps["id"] == comp["node"], "left").select("id", "n", "prefix", F.coalesce("component", "id").alias("component"))

    # Round 2: prefix hashes that lie in several components.
    keys = placed.select("id", "component", "n", F.posexplode("prefix").alias("at", "key"))
    keys = keys.select("id", "component", "n", (F.col("at") < _early(num)).alias("early"), "key")
    groups = keys.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("size"), F.max("early").alias("any"))
    groups = stored(groups.where("c0 <> c1 and any").select("key", "size"), "jaccard-groups")
    held = membership(groups, "key")
    wide = stored(only_held(keys, held, "key").join(groups, "key").select("key", "id", "component", "n", "early", "size"), "jaccard-keys")
    rows = stored(_partnered(wide.where(F.col("size") <= LARGE), num).unionByName(wide.where(F.col("size") > LARGE).select("key", "id", "component", "size")), "jaccard-rows")
    held.destroy()
    discarded(wide, groups)
    maps = reps.select("id", "n", "bits")
    # Large groups first: each class with the nearest of another component, round by round, until few pairs are open or that links nothing.
    large = stored(rows.where(F.col("size") > LARGE), "jaccard-large")
    first = links
    for _ in range(ROUNDS if not empty(large) else 0):
        near = stored(_open_pairs(large.join(maps, "id"), num, nearest=True), "jaccard-near")
        if fetched(near.agg(F.coalesce(F.sum("partners") <= FEW * F.sum("met"), F.lit(True))))[0][0]:
            discarded(near)
            break
        new = verified(texts, near.select("a", "b"), words, num, is_word)
        discarded(near)
        if empty(new):
            break
        links = stored(links.unionByName(new), "jaccard-links")
        comp = connected(links)
        before, large = large, stored(_placed(large, comp), "jaccard-large")
        discarded(before)
    rows = rows if links is first else _placed(rows, comp)
    second = stored(_open_pairs(rows.join(maps, "id"), num), "jaccard-pairs")
    more = verified(texts, second, words, num, is_word)
    # A class is named by its smallest id, so the smallest id of a component is a class's name too.
    whole = links.unionByName(more).unionByName(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    final = connected(whole)
    out = known.select("id", F.col("n").cast("long").alias("n_shingles")).join(final, F.col("id") == F.col("node"), "left")
    out = stored(out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")), "jaccard-found")
    discarded(known, classes, copies, reps, anchors, least, stars, links, second, more)
    return out


def _early(num: int):
    """So many first hashes of a set of n: where it links with one no smaller, their first common hash is one of these."""
    both = 2 * F.col("n").cast("long")
    return F.col("n") - F.ceil(F.lit(num) * both / F.lit(100.0 + num)) + 1


def _partnered(rows: DataFrame, num: int) -> DataFrame:
    """The rows of groups of several components that have a partner by size in their group, one of the two, the smaller, with its key `early`.

    A pair that links is left with both ends at its first common hash. What goes here takes no bitmap along.
    """
    w = W.partitionBy("key").orderBy("n", F.desc("early"), "id")
    below = F.max(F.when(F.col("early"), F.col("n"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    above = F.when(F.col("early"), F.lead("n").over(w))
    near = lambda m, n: F.coalesce(F.lit(100) * m.cast("long") >= F.lit(num) * n.cast("long"), F.lit(False))
    some = rows.select("*", below.alias("below"), above.alias("above")).where(near(F.col("below"), F.col("n")) | near(F.col("n"), F.col("above")))
    whole = W.partitionBy("key")
    some = some.select("key", "id", "component", "size", F.min("component").over(whole).alias("c0"), F.max("component").over(whole).alias("c1"))
    return some.where("c0 <> c1").drop("c0", "c1")


def _placed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with the component that holds now."""
    return rows.drop("component").join(comp, rows["id"] == comp["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"), "size")


def _filtered(pairs: DataFrame, reps: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow a link."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    both = pairs.join(left, "a").join(right, "b").where(F.lit(100) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("ba").to_pylist(), batch.column("bb").to_pylist()):
                keep.append(any(True for _ in may_link(np.array([m, n]), [x, y], num)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long"), "jaccard-filtered")


def op9_jaccardjoin(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    return join(docs).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g
  from w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) t(i)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (g)
  where a.doc_id < b.doc_id group by 1, 2),
link as (
  select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
both_ as (select a, b from link union all select b, a from link),
reach(a, b) as (select distinct a, a from both_ union select reach.a, both_.b from reach join both_ on reach.b = both_.a),
least_ as (select a, min(b) as m from reach group by a)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(m, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join least_ on least_.a = w.doc_id
"""
