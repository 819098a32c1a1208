"""Line dedup: winnowing over line hashes finds repeated runs of lines; later repeats go.

Every WINDOW consecutive lines of a document select the smallest of their line hashes (the last of
equal ones) as fingerprint. Two equal runs of WINDOW lines select the same line, so a run that
repeats shares a fingerprint for certain. Each selected position is emitted once, with the hashes of
the lines that its windows reach to both sides. Positions whose fingerprint stands at one place only are
done. From every other one the match is extended to both sides, line by line: each run of WINDOW
lines that holds the fingerprint is joined to the first place of the same run, and where that is an
earlier one the run is a repeat. Repeats that overlap or touch are one maximal run, which is deleted. With
`words`, shorter runs (one line up to WINDOW - 1) of at least that many words are positions of their
own, found and joined alike; the registered query is what its SQL says, runs of WINDOW lines, and the
pipeline asks for LONG_WORDS.

Scale: only DataFrame functions. Texts are read twice and not shuffled as long as the table of
deleted spans is measured small, else joined by document. Fingerprints and runs are counted before they are
joined; positions are joined to the first place of their run, never to each other, and these
joins have a plain exchange on both sides, so that Spark splits a run that is everywhere.

Defined results: lines are what newlines separate, compared without spaces around them; null text
has no lines and stays null; documents of fewer than WINDOW lines are left alone, unless they hold a run of `words`; earlier means
smaller doc_id (null last, as in the SQL), then position; rows that repeat id and text are one document and
get one decision; an empty table gives no rows; other columns are carried along unread, whatever their
names, but a column with the name of a count that is asked for gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discarded, fetched, small, stored, table

WINDOW = 3
#: Words from which on a single line or two lines are a run as well, where asked for.
LONG_WORDS = 50
_LAST = 2**63 - 1


def _key() -> tuple[Column, Column]:
    """A row's key: d (its id, null the last) and t (its text's hash)."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t")


def positions(docs: DataFrame, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """d, t, w, fp, i, k, h, g: a row per selected position.

    Its windows of w lines start at lines i .. i + k - 1; h and g are two hashes of each line they reach.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.trim(x))  # F.trim itself would take the place as what to trim
    hashed = docs.select(*_key(), lines.alias("l")).where(F.size("l") >= (1 if words else window))
    n_words = [F.transform("l", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"\s+")))).alias("c")] if words else []
    hashed = hashed.select("d", "t", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", lambda x: F.xxhash64(F.lit(17), x)).alias("g"), *n_words)

    def position(w, fp, i, k):
        return F.struct(F.lit(w).alias("w"), fp.alias("fp"), i.cast("int").alias("i"), k.cast("int").alias("k"), F.slice("h", i + 1, k + w - 1).alias("h"),
            F.slice("g", i + 1, k + w - 1).alias("g"))

    def selected(i):
        part = F.slice("h", i + 1, window)
        # Counted from the end: the last of equal minima.
        return (i + window - F.array_position(F.reverse(part), F.array_min(part))).cast("int")

    chosen = hashed.select("*", F.when(F.size("h") >= window, F.transform(F.sequence(F.lit(0), F.size("h") - window), selected)).alias("m"))
    # The windows that select one line are neighbours; the first one stands for them.
    first = F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda i: (i == 0) | (F.get("m", i) != F.get("m", i - 1)))
    chosen = chosen.select("*", F.when(F.col("m").isNotNull(), first).alias("s"))
    every = F.transform("s", lambda i, at: position(window, F.get("h", F.get("m", i)), i, F.coalesce(F.get("s", at + 1), F.size("m")) - i))
    if words:

        def short(w):
            # A fingerprint is of runs of one length.
            long = lambda i: F.aggregate(F.slice("c", i + 1, w), F.lit(0), lambda a, x: a + x) >= words
            starts = F.filter(F.sequence(F.lit(0), F.size("h") - w), long)
            return F.when(F.size("h") >= w, F.transform(starts, lambda i: position(w, F.xxhash64(F.lit(w), F.array_min(F.slice("h", i + 1, w))), i, F.lit(1))))

        every = F.flatten(F.filter(F.array(every, *(short(w) for w in range(1, window))), lambda x: x.isNotNull()))
    return chosen.select("d", "t", F.explode(every).alias("p")).select("d", "t", "p.*")


def deleted_spans(docs: DataFrame, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """d, t, starts, ends: the maximal runs of lines to delete, a row per document that has any; a stored table."""
    every = stored(positions(docs, window, words), "linededup-positions")
    # fp selected at two different places at least; places are told apart by min and max
    place = F.struct("d", "t", "i")
    again = stored(every.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp"), "linededup-again")
    extended = every.join(small(again, 48), "fp", "left_semi").select("d", "t", "w", "i", "h", "g", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    part = lambda c: F.xxhash64(F.slice(c, F.col("o") + 1, F.col("w")))
    runs = stored(extended.select("d", "t", (F.col("i") + F.col("o")).alias("i"), "w", part("h").alias("k1"), part("g").alias("k2")), "linededup-runs")
    first = stored(runs.groupBy("k1", "k2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("k1", "k2", "a"), "linededup-first")
    later = runs.join(small(first, 128), ["k1", "k2"]).where(place > F.col("a"))
    reach = F.array_sort(F.collect_set(F.struct("i", (F.col("i") + F.col("w")).alias("e"))))
    found = later.groupBy("d", "t").agg(reach.alias("s"))
    if words:  # runs of several lengths: line by line
        each = F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["i"], x["e"] - 1)))))
        found = found.select("d", "t", F.transform(each, lambda i: F.struct(i.alias("i"), (i + 1).alias("e"))).alias("s"))
    starts = F.filter("s", lambda x, k: (k == 0) | (x["i"] > F.get("s", k - 1)["e"]))
    ends = F.filter("s", lambda x, k: (k == F.size("s") - 1) | (F.get("s", k + 1)["i"] > x["e"]))
    out = stored(found.select("d", "t", F.transform(starts, lambda x: x["i"]).alias("starts"), F.transform(ends, lambda x: x["e"]).alias("ends")), "linededup-spans")
    discarded(every, again, runs, first)
    return out


def dedup_lines(docs: DataFrame, window: int = WINDOW, words: int | None = None, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """docs, all columns, with the later repeated runs cut from text; adds the counts n_lines and n_removed."""
    spans = deleted_spans(docs, window, words)
    size = fetched(spans.agg((F.count("*") * 96 + F.coalesce(F.sum(F.size("starts")), F.lit(0)) * 16).alias("n")))[0]["n"]
    spans = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    own = {n_lines.lower(), n_removed.lower()}
    columns = [c for c in docs.columns if c.lower() not in own]
    d, t = _key()
    rows = docs.select(d, t, "text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    both = rows.join(spans, ["d", "t"], "left")
    lines = F.split("text", "\n", -1)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    begin = lambda k: F.when(k == 0, 0).otherwise(F.get("ends", k - 1))
    end = lambda k: F.coalesce(F.get("starts", k), F.size(lines))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("starts")), lambda k: F.slice(lines, begin(k) + 1, end(k) - begin(k))))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    cut = F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return both.select(
        *((cut if c == "text" else F.col("row").getField(c)).alias(c) for c in columns),
        n.cast("long").alias(n_lines), F.coalesce(removed, F.lit(0).cast("long")).alias(n_removed),
    )


def op5_linededup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = """
with l as (select doc_id, string_split(text, chr(10)) as x from documents),
w as (select doc_id, i, list_transform(x[i:i + 2], lambda s: trim(s)) as k from l, unnest(range(1, len(x) - 1)) t(i)),
late as (select doc_id, i from w qualify row_number() over (partition by k order by doc_id, i) > 1),
gone as (select distinct doc_id, j from late, unnest(range(i, i + 3)) t(j)),
each as (select doc_id, j, x[j] as line from l, unnest(range(1, len(x) + 1)) t(j)),
kept as (
  select doc_id, string_agg(line, chr(10) order by j) as text, count(*) as n
  from each anti join gone using (doc_id, j) group by doc_id)
select doc_id, coalesce(len(x), 0) as n_lines, coalesce(len(x), 0) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from l left join kept using (doc_id)
"""
