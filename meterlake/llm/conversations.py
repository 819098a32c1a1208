"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by A*.

A repaired conversation is an optional system turn and then pairs of user and assistant, or
nothing. Edits: K keeps a turn, R gives it the role user or assistant, D deletes it, I inserts an
empty turn of user or assistant anywhere. Blank turns and repeats of role and text must be deleted;
a turn that ends without . ! or ? costs TRUNCATED more if it stays. The lattice has a node for each number
of turns dealt with and each of four states (nothing yet, system, user, assistant last). A* expands nodes by (cost plus
heuristic, audit), the audit being the edits so far. The heuristic is a suffix sum: of each turn to come that must go, its
deletion; of each truncated one, the least of deleting it and of the charge for keeping it. Each is a
lower bound of what any path pays for that turn, and no turn pays less than it takes off the sum,
so the first time a node is expanded is the cheapest way there, and of equally cheap ones the one whose audit is least in ASCII.
Given the turns, an audit tells every role: states follow from it.

Turns stand in order of `turn` (nulls first), then role, then the text's SHA-256.

Scale: a conversation of up to LONG turns and LONG_BYTES is dealt with in one task, one at a time, after one shuffle by
conversation. A longer one, even a third of the table, is split: rows equal in all four columns are counted, range
partitioning puts the turns in order, without texts, and CHUNK of them make a chunk. A chunk's table has for each state before
and after it the cheapest edits (the same A*); the tables are put together in order, and each chunk then knows the
state it begins in and its edits. Repeats are found by an aggregation. Texts join at the end, turn by turn; an audit
is one byte a turn, and only it and what is known of the chunks come together for one conversation.

Defined results: null texts and roles are one space here (so a null text is blank), a null turn stands first, a null
conv_id is a conversation of its own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discarded, stored, table

RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns and bytes of a conversation up to which it is dealt with as a whole; turns of a chunk of a longer one.
LONG, LONG_BYTES, CHUNK = 512, 16 << 20, 512
SPACE = " \t\n\x0b\f\r"
#: States: nothing yet, a system turn, user last, assistant last; what may follow each, and where a conversation may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (NOTHING, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
#: Kinds of turns.
SOUND, MUST_GO, CUT_OFF = range(3)


def search(initials: list[str], kinds: list[int], copies: list[int] | None = None, begin: int = NOTHING, ends: tuple = ENDS, every: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) by the state at the end, of the first of `ends` that is reached or, with `every`, of all that can be.

    copies: how often a turn stands there; the turns behind the first of them must go.
    """
    n = len(kinds)
    least = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        must = DELETE * (copies[k] - 1) if copies else 0
        least[k] = least[k + 1] + must + (0, DELETE, min(DELETE, TRUNCATED))[kinds[k]]
    queue, done, found = [(least[0], "", 0, begin)], set(), {}
    while queue:
        f, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        cost = f - least[at]
        if at == n and state in ends:
            found[state] = cost, audit
            if not every or len(found) == len(ends):
                break
        for role, after in NEXT[state].items():
            if role in ROLES and (at, after) not in done:
                heapq.heappush(queue, (cost + INSERT + least[at], audit + "I", at, after))
        if at == n:
            continue
        more = copies[at] - 1 if copies else 0
        behind, rest = "D" * more, DELETE * more + least[at + 1]
        if (at + 1, state) not in done:
            heapq.heappush(queue, (cost + DELETE + rest, audit + "D" + behind, at + 1, state))
        if kinds[at] != MUST_GO:
            stay = cost + (TRUNCATED if kinds[at] == CUT_OFF else 0)
            for role, after in NEXT[state].items():
                if (at + 1, after) in done:
                    continue
                if role == initials[at]:
                    heapq.heappush(queue, (stay + rest, audit + "K" + behind, at + 1, after))
                elif role in ROLES:
                    heapq.heappush(queue, (stay + RETAG + rest, audit + "R" + behind, at + 1, after))
    return found


def applied(audit: str, roles: list[str], state: int = NOTHING) -> Iterator[tuple[int, str | None]]:
    """(turn, role) in order: the turn's number or -1 for an inserted one, its role or None where it is deleted."""
    at = 0
    for edit in audit:
        if edit == "D":
            yield at, None
        else:
            role = "u" if "u" in NEXT[state] else "a"
            if edit == "K":
                role, shown = roles[at][:1], roles[at]
            else:
                shown = ROLES[role]
            state = NEXT[state][role]
            yield (-1 if edit == "I" else at), shown
        at += edit != "I"


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def _turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, first (1 where turn is a number), t (SHA-256 of the text), kind before repeats, size."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    kind = F.when(_bare(text) == "", MUST_GO).when(F.right(_bare(text), F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("t"), kind.alias("kind"), (_bare(text) == "").alias("blank"))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: A piece: a whole conversation, or one turn of a long one; counts stand with the first piece of a conversation.
PIECE = "place long, whole boolean, audit string, turns array<struct<role: string, text: string>>, " + ", ".join(f"{c} long" for c in _COUNTS)


def _illegal(initials: list[str]) -> int:
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))


def _gaps(turns: list) -> int:
    known = {x for x in turns if x is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, its rows) of batches sorted by conv_id, the first column."""
    key, rows = None, []
    for batch in batches:
        for conv, *row in zip(batch.column("conv_id").to_pylist(), *(batch.column(c).to_pylist() for c in names)):
            if rows and conv != key:
                yield key, rows
                rows = []
            key = conv
            rows.append(tuple(row))
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def repair_one(turns: list, roles: list[str], texts: list[str], kinds: list[int], blanks: list[bool]) -> tuple:
    """audit, repaired turns and counts (as _COUNTS) of one conversation in order; kinds before repeats."""
    seen, kinds, duplicate = set(), list(kinds), 0
    for k, turn in enumerate(zip(roles, texts)):
        if turn in seen and not blanks[k]:
            kinds[k] = MUST_GO
            duplicate += 1
        seen.add(turn)
    initials = [r[:1] for r in roles]
    ((cost, audit),) = search(initials, kinds).values()
    repaired = [(role, "" if k < 0 else texts[k]) for k, role in applied(audit, roles) if role is not None]
    return audit, repaired, _gaps(turns), sum(blanks), duplicate, kinds.count(CUT_OFF), _illegal(initials), cost


def _whole(turns: DataFrame, schema: StructType) -> DataFrame:
    """Conversations that a task takes one by one."""
    made = StructType([f for f in schema if f.name != "whole"])
    arrow = _arrow(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((conv, rows, repair_one(*zip(*rows))) for conv, rows in _grouped(batches, ["turn", "role", "text", "kind", "blank"]))
        yield from _batches(((conv, 0, *repaired) for conv, _, repaired in found), arrow)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "t"]
    rows = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "kind", "blank")
    # `whole` is a constant that Spark knows, so who asks for pieces of long conversations doesn't run this.
    return rows.mapInArrow(run, made).withColumn("whole", F.lit(True)).select(*schema.names)


_TABLE = "chunk long, ways array<struct<before: int, after: int, cost: long, audit: string>>, initials array<string>, turns array<long>, counts array<long>"


def _chunk_tables(marks: DataFrame, conv_type: str) -> DataFrame:
    """A row a chunk: the cheapest edits by state before and after, its first and last initial and turn, its counts."""
    schema = StructType.fromDDL(f"conv_id {conv_type}, {_TABLE}")
    arrow = _arrow(schema)

    def run(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["id"])
        initials, copies = [r["role"][:1] for r in rows], [r["n"] for r in rows]
        kinds = [r["kind"] for r in rows]
        ways = [(p, q, cost, audit) for p in NEXT for q, (cost, audit) in search(initials, kinds, copies, p, tuple(NEXT), True).items()]
        known = [r["turn"] for r in rows if r["turn"] is not None]
        counts = [
            len(set(known)), sum(r["n"] for r in rows if r["blank"]), sum(r["n"] - (not r["again"]) for r in rows if not r["blank"]),
            kinds.count(CUT_OFF), _illegal(initials) + sum(copies) - len(rows),
        ]
        one = (rows[0]["conv_id"], rows[0]["chunk"], ways, [initials[0], initials[-1]], [known[0], known[-1]] if known else [], counts)
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(one, arrow)], schema=arrow)

    return marks.groupBy("conv_id", "chunk").applyInArrow(run, schema)


def joined(chunks: list[tuple]) -> tuple[list[tuple[int, str]], list[int]]:
    """(state before and edits of each chunk, counts as _COUNTS) from the chunks' tables in order."""
    best, back = {NOTHING: (0, "")}, []
    for _, ways, *_ in chunks:
        now, from_ = {}, {}
        for w in ways:
            if w["before"] in best:
                cost, tail = best[w["before"]]
                way = cost + w["cost"], tail + w["audit"]
                if w["after"] not in now or way < now[w["after"]]:
                    now[w["after"]], from_[w["after"]] = way, (w["before"], w["audit"])
        # What all have in common decides nothing any more.
        same = len(commonprefix([tail for _, tail in now.values()]))
        best = {q: (cost, tail[same:]) for q, (cost, tail) in now.items()}
        back.append(from_)
    state = min((q for q in ENDS if q in best), key=lambda q: best[q])
    cost, edits = best[state][0], []
    for from_ in reversed(back):
        state, audit = from_[state]
        edits.append((state, audit))
    distinct, blank, duplicate, truncated, illegal = (sum(c[-1][k] for c in chunks) for k in range(5))
    illegal += _illegal([x for c in chunks for x in c[2]]) - sum(_illegal(c[2]) for c in chunks)
    spans = [c[3] for c in chunks if c[3]]
    distinct -= sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    gaps = spans[-1][1] - spans[0][0] + 1 - distinct if spans else 0
    return edits[::-1], [gaps, blank, duplicate, truncated, illegal, cost]


def _edits(tables: DataFrame, conv_type: str) -> DataFrame:
    """Each chunk's state before and edits; the conversation's counts with its first chunk."""
    schema = StructType.fromDDL(f"conv_id {conv_type}, chunk long, state int, audit string, counts array<long>")
    arrow = _arrow(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, chunks in _grouped(batches, ["chunk", "ways", "initials", "turns", "counts"]):
            edits, counts = joined(chunks)
            for k, (chunk, (state, audit)) in enumerate(zip((c[0] for c in chunks), edits)):
                yield conv, chunk, state, audit, None if k else counts

    return tables.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(lambda batches: _batches(rows(batches), arrow), schema)


def _turn_edits(marks: DataFrame, edits: DataFrame) -> DataFrame:
    """Each turn's own part of its chunk's edits: key, place, audit, shown (role, whether the turn's own text), counts."""
    schema = StructType.fromDDL("key long, place long, audit string, shown array<struct<role: string, own: boolean>>, counts array<long>")
    arrow = _arrow(schema)

    def run(part: pa.Table, edit: pa.Table) -> pa.Table:
        turns, (chunk,) = sorted(part.to_pylist(), key=lambda r: r["id"]), edit.to_pylist()
        roles = [r["role"] for r in turns for _ in range(r["n"])]
        owner = [k for k, r in enumerate(turns) for _ in range(r["n"])]
        audits, shown, at = [[] for _ in turns], [[] for _ in turns], 0
        for mark, (turn, role) in zip(chunk["audit"], applied(chunk["audit"], roles, chunk["state"])):
            k = owner[min(at, len(owner) - 1)]
            audits[k].append(mark)
            if role is not None:
                shown[k].append((role, turn >= 0))
            at += mark != "I"
        counts = [chunk["counts"]] + [None] * (len(turns) - 1)
        out = ([r["key"] for r in turns], [r["id"] for r in turns], ["".join(a) for a in audits], shown, counts)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    by = ["conv_id", "chunk"]
    return marks.groupBy(*by).cogroup(edits.groupBy(*by)).applyInArrow(run, schema)


def _split(turns: DataFrame, schema: StructType) -> DataFrame:
    """Long conversations, in chunks of their turns."""
    conv_type = schema["conv_id"].dataType.simpleString()
    same = ["conv_id", "turn", "role", "t"]
    keyed = turns.groupBy(*same).agg(F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("text", "kind", "blank")))
    keyed = stored(keyed.withColumn("key", F.monotonically_increasing_id()), "conversation-turns")
    place = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = stored(keyed.groupBy("conv_id", "role", "t").agg(F.min(place).alias("first")).toDF("c", "r", "h", "first"), "conversation-firsts")
    slim = keyed.drop("text").join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("t") == F.col("h")))
    again = place > F.col("first")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "t"]
    marks = slim.withColumn("again", again).withColumn("kind", F.when(F.col("again"), MUST_GO).otherwise(F.col("kind"))).repartitionByRange(*order).sortWithinPartitions(*order)
    marks = marks.select("conv_id", "turn", "role", "n", "kind", "blank", "again", "key", F.monotonically_increasing_id().alias("id"))
    marks = stored(marks.withColumn("chunk", F.expr(f"id div {CHUNK}")), "conversation-marks")
    edits = stored(_edits(_chunk_tables(marks, conv_type), conv_type), "conversation-edits")
    found = _turn_edits(marks, edits).join(keyed.select("key", "conv_id", "text"), "key")
    shown = F.transform("shown", lambda x: F.struct(x["role"].alias("role"), F.when(x["own"], F.col("text")).otherwise("").alias("text")))
    counts = [F.coalesce(F.col("counts")[k], F.lit(0)).alias(c) for k, c in enumerate(_COUNTS)]
    out = stored(found.select("conv_id", "place", F.lit(False).alias("whole"), "audit", shown.alias("turns"), *counts), "conversation-repaired")
    discarded(keyed, firsts, marks, edits)
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """Pieces of repaired conversations: conv_id, place, whole, audit, turns (role, text), gaps, blank, duplicate, truncated, illegal, cost.

    A conversation is one whole piece, or, if it is long, a piece for each of its distinct turns, in order of place;
    its counts are the sums over its pieces. conversations has conv_id, turn, role, text.
    """
    turns = _turns(conversations)
    schema = StructType.fromDDL(f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, {PIECE}")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("b"))
    split = stored(sizes.where((F.col("n") > LONG) | (F.col("b") > LONG_BYTES)).select(F.col("conv_id").alias("c")), "conversation-long")
    if split.isEmpty():
        discarded(split)
        return _whole(turns, schema)
    fits = F.col("conv_id").eqNullSafe(F.col("c"))
    return _whole(turns.join(split, fits, "left_anti"), schema).unionByName(_split(turns.join(split, fits, "left_semi"), schema))


def report(pieces: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, counts, audit, repaired_sha256 (of `role:text`, newline-joined)."""
    line = lambda x: F.concat(x["role"], F.lit(":"), x["text"])
    short = pieces.where("whole").select("conv_id", *_COUNTS, "audit", F.sha2(F.array_join(F.transform("turns", line), "\n"), 256).alias("repaired_sha256"))
    arrow = _arrow(short.schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, audit, counts, sha, begun = None, [], None, None, False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                conv, edits, turns, *own = row
                if counts is None or conv != key:
                    if counts is not None:
                        yield key, *counts, "".join(audit), sha.hexdigest()
                    key, audit, counts, sha, begun = conv, [], [0] * len(_COUNTS), hashlib.sha256(), False
                audit.append(edits)
                counts = [x + y for x, y in zip(counts, own)]
                for t in turns:
                    sha.update(("\n" if begun else "").encode() + f"{t['role']}:{t['text']}".encode())
                    begun = True
        if counts is not None:
            yield key, *counts, "".join(audit), sha.hexdigest()

    long = pieces.where("not whole").select("conv_id", "audit", "turns", *_COUNTS, "place").repartition("conv_id").sortWithinPartitions("conv_id", "place").drop("place")
    return short.unionByName(long.mapInArrow(lambda batches: _batches(digests(batches), arrow), short.schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32 of `conv_id:turn` mod 20: 0 dropped, 1 emptied, 2 without . ! ?, 3 twice, 4 role user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = conversations.select("conv_id", "turn", "role", "text", fault.alias("fault")).where("fault <> 0")
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return out.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(role).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = report(repair(damaged(rows))).withColumnRenamed("conv_id", "c")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
