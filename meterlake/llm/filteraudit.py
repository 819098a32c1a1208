"""Filter interaction audit: what each filter removes in every order of applying them.

The orders form a trie: an edge applies one filter to what its prefix has left. Which documents
survive depends on the set of filters in the prefix only, so a prefix is a state that is computed once and
shared by all its orders (memoised): with five filters 32 states and 80 edges stand for 120 orders and 600 steps.
States are visited depth first; a state's survivors are a DataFrame, made by applying the edge's
filter to the survivors of the state before and persisted while edges below it are open, so no more than one per
filter is held at a time. Each visit counts the survivors and what every filter removes of them, by part.

Scale: texts are read once, for one row a document (part, a flag for each filter, two labels);
that table is written to the shared folder, so a lost executor's survivors are filtered from it again. Each count
is combined before its shuffle, so a hot part costs nothing; results are 80 rows a part. Repeats
are found by aggregating texts' SHA-256 to the least id; only texts that repeat are joined back, from stored
tables, so Spark can broadcast or split a hot text.

Defined results: a null text is empty, a null part is the empty string; a repeat is a text that a
smaller doc_id has too, so of equal ids neither repeats the other, and a null id neither repeats nor is repeated; an
empty text has no words and fails the count of words only (and the repeat, if it is one); several labels of an id count once each way if any has the
value; labels without an id fit nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discarded, stored, table

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
SYMBOLS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions of failure that a text decides alone, by filter."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * distinct.cast("long") < MIN_DISTINCT * n.cast("long"),
        "C": 100 * capitals.cast("long") > MAX_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike("[" + SYMBOLS + "]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, a flag of failure for each of FILTERS, good and toxic: one row a document; a stored table."""
    text = F.coalesce("text", F.lit(""))
    seen = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    seen = stored(seen.select("id", "part", *(c.alias(f) for f, c in text_filters(F.col("text")).items()), F.unhex(F.sha2("text", 256)).alias("t")), "audit-texts")
    firsts = stored(seen.where("id is not null").groupBy("t").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"), "audit-repeats")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    out = seen.join(firsts, "t", "left").join(stored(marks, "audit-labels"), "id", "left")
    false = F.lit(False)
    repeat = F.coalesce(F.col("first") < F.col("id"), false).alias("E")
    return stored(out.select("part", *"ABCD", repeat, F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic")), "audit-flags")


def _counts(survivors: DataFrame, state: frozenset, filters: str) -> DataFrame:
    """part, state, kept, and for each filter not in the state what it removes of the survivors."""
    n = lambda c: F.count_if(c)  # noqa: E731
    rest = [f for f in filters if f not in state]
    removed = [F.struct(F.lit(f).alias("filter"), n(F.col(f)).alias("removed"), n(F.col(f) & F.col("good")).alias("good_lost"), n(F.col(f) & F.col("toxic")).alias("toxic_lost")) for f in rest]
    edges = F.array(*removed) if removed else F.expr("cast(array() as array<struct<filter: string, removed: bigint, good_lost: bigint, toxic_lost: bigint>>)")
    name = "".join(sorted(state))
    return survivors.groupBy("part").agg(F.count("*").alias("kept"), edges.alias("edges")).select("part", F.lit(name).alias("state"), "kept", "edges")


def trie(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, state (its filters in order), kept, edges array<struct<filter, removed, good_lost, toxic_lost>>; a stored table.

    A part that has no survivors in a state has no row there.
    """
    counted, done = [], set()

    def visit(survivors: DataFrame, state: frozenset) -> None:
        done.add(state)
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counted.append(stored(_counts(survivors, state, filters), "audit-state"))
            for f in filters:
                if f not in state and state | {f} not in done:
                    visit(survivors.where(~F.col(f)), state | {f})
        finally:
            survivors.unpersist()

    visit(flags, frozenset())
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    out = stored(out.coalesce(max(1, out.sparkSession.sparkContext.defaultParallelism)), "audit-trie")
    discarded(*counted)
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs has doc_id, source (the part) and text; labels doc_id, quality and toxic.
    """
    flags = flagged(docs, labels)
    states = trie(flags, filters)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))  # noqa: E731
    only = lambda f: F.count_if(F.col(f) & ~F.greatest(F.lit(False), *(F.col(g) for g in filters if g != f), F.lit(False)))  # noqa: E731
    fails = F.create_map(*(x for f in filters for x in (F.lit(f), F.struct(F.count_if(f).alias("all"), only(f).alias("unique")))))
    # Orders meet at edges: (state, filter) with the number of orders through it.
    n, name = len(filters), lambda fs: "".join(sorted(fs))
    steps = [("".join(p), k + 1, name(p[:k]), p[k]) for p in permutations(filters) for k in range(n)]
    through = lambda state: factorial(len(state)) * factorial(n - 1 - len(state))  # noqa: E731
    known = sorted({(state, f, name(state + f), through(state)) for _, _, state, f in steps})
    edge = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(e, ("state", "filter", "after", "orders")))) for e in known))
    parts = stored(flags.groupBy("part").agg(fails.alias("fails")), "audit-parts")
    edges = parts.select("part", "fails", F.explode(edge).alias("e")).select("part", "e.*", F.col("fails")[F.col("e.filter")].alias("fails"))
    gone = states.select("part", "state", F.inline("edges"))
    left = states.select("part", F.col("state").alias("after"), "kept")
    edges = edges.join(gone, ["part", "state", "filter"], "left").join(left, ["part", "after"], "left")
    edges = edges.withColumns({c: zero(F.col(c)) for c in ("removed", "good_lost", "toxic_lost", "kept")})
    shapley = F.sum(F.col("removed") * F.col("orders")).over(W.partitionBy("part", "filter"))
    edges = edges.withColumn("shapley", shapley).withColumn("redundant", F.col("fails.all") - F.col("removed"))
    # n * n! rows, fixed by the filters.
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, state string, filter string")
    out = edges.join(F.broadcast(orders), ["state", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", F.col("fails.unique").alias("unique_fails"), "good_lost", "toxic_lost", "shapley")


def op12_filteraudit(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
words AS (
  SELECT part, doc_id, t, len(w) AS n, len(list_distinct(w)) AS u
  FROM (SELECT *, regexp_extract_all(t, '[^ 	-]+') AS w FROM d)),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (n < 50)::INT + 2 * (100 * u < 65 * n)::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS mask
  FROM words JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31),
steps AS (
  SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before
  FROM orders, range(1, 6) AS x(k)),
found AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM found
"""
