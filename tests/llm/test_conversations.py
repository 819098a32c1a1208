"""op11: damage, faults and edits by a plain dynamic programme, and every edit string tried for small cases."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from meterlake.llm import conversations as C

GOOD = re.compile(r"(s?(ua)+)?")


def result_of(audit, turns):
    """(cost, repaired) of an edit string over (role, text, kind), or None where it doesn't fit."""
    cost, at, shown = 0, 0, []
    for k, e in enumerate(audit):
        if e != "I" and at == len(turns):
            return None
        role, text, kind = turns[at] if e != "I" else ("", "", 0)
        due = "a" if shown and shown[-1][0][:1] == "u" else "u"
        named = {"u": "user", "a": "assistant"}[due]
        if e == "D":
            cost += 2
        elif e == "I":
            cost, shown = cost + 5, [*shown, (named, "")]
        else:
            if kind == C.MUST_GO:
                return None
            shown = [*shown, (role if e == "K" else named, text)]
            cost += (e == "R") + 5 * (kind == C.CUT_OFF)
        at += e != "I"
    if at < len(turns) or not GOOD.fullmatch("".join(r[:1] or "-" for r, _ in shown)):
        return None
    return cost, shown


def cheapest(turns):
    """Least (cost, audit) by relaxing every edge until nothing changes."""
    best = {(0, "", ""): (0, "")}
    layer = {"": (0, "")}  # by the last initial; s only as the first
    def spread(layer):
        changed = True
        while changed:
            changed = False
            for last, (cost, audit) in list(layer.items()):
                to = "a" if last == "u" else "u"
                way = (cost + 5, audit + "I")
                if to not in layer or way < layer[to]:
                    layer[to], changed = way, True
        return layer
    layer = spread(layer)
    for role, _, kind in turns:
        now = {}
        def offer(to, way):
            if to not in now or way < now[to]:
                now[to] = way
        for last, (cost, audit) in layer.items():
            offer(last, (cost + 2, audit + "D"))
            if kind == C.MUST_GO:
                continue
            stay = cost + (5 if kind == C.CUT_OFF else 0)
            fits = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
            if role[:1] and role[:1] in fits:
                offer(role[:1], (stay, audit + "K"))
            to = "a" if last == "u" else "u"
            offer(to, (stay + 1, audit + "R"))
        layer = spread(now)
    return min(layer[x] for x in ("", "a") if x in layer), best


def expected(rows):
    """The contract's row for one conversation, from damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        turns.append((role, text, {None: C.SOUND, "truncated": C.CUT_OFF}.get(fault, C.MUST_GO)))
    (cost, audit), _ = cheapest(turns)
    again, shown = result_of(audit, turns)
    assert again == cost
    known = {t for t, *_ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in shown).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out.setdefault(conv, []).extend([] if k == 0 else [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1))
    return out


def made(n, seed, longest=7):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            turn = rng.choice([turn, turn, turn, turn + 2, 1, None])
            text = rng.choice(["a.", "b!", "c?", "cut", "", " \t", None, "é.", "a. ", "b", f"{rng.random()}.", f"{rng.random()}.", f"{rng.random()}."])
            rows.append((conv if conv else None, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua"]), text))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", place string, cost int").write.parquet(f"{tmp_path}/conversations.parquet")
    found = C.op11_conversations(spark, str(tmp_path)).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(found) == len(got)
    assert got == {conv: expected(mine) for conv, mine in damaged(rows).items()}
    return got


def test_search_tries_what_every_edit_string_gives():
    rng = random.Random(1)
    for _ in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "tool"]), f"{k}", rng.choice([0, 0, 1, 2])) for k in range(rng.randint(0, 3))]
        tried = [(r[0], "".join(a)) for n in range(len(turns) + 3) for a in product("DIKR", repeat=n) if (r := result_of(a, turns))]
        ((found),) = C.search([r[:1] for r, *_ in turns], [k for *_, k in turns]).values()
        assert found == min(tried) == cheapest(turns)[0]


def test_search_equals_a_plain_programme():
    rng = random.Random(2)
    for _ in range(400):
        turns = [(rng.choice("uuaasx"), "", rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 25))]
        ((found),) = C.search([r for r, *_ in turns], [k for *_, k in turns]).values()
        assert found == cheapest(turns)[0]


def test_conversations_as_a_whole(spark, tmp_path):
    check(spark, made(250, 3), tmp_path)


def test_long_conversations_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "LONG", 3)
    monkeypatch.setattr(C, "CHUNK", 2)
    rows = made(40, 4, 12) + [(77, t, r, "same.") for t in range(9) for r in ("user", "user", "assistant")]
    check(spark, rows, tmp_path)


def test_long_texts_split_a_conversation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "LONG_BYTES", 1000)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "word " * 200 + ".") for t in range(20)] + made(10, 5)
    check(spark, rows, tmp_path)


def test_one_conversation_of_many_chunks(spark, tmp_path):
    rng = random.Random(6)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", f"{t}.", f"{t}", ""])) for t in range(1500)]
    check(spark, rows + made(5, 7), tmp_path)


def test_pieces_hold_the_repaired_turns(spark, monkeypatch):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "u."), (2, 0, "assistant", "x."), (2, 1, "assistant", "y.")]
    want = {1: [("user", "s."), ("assistant", "u.")], 2: [("user", "x."), ("assistant", "y.")]}
    for most in (512, 1):
        monkeypatch.setattr(C, "LONG", most)
        got = {}
        for r in sorted(C.repair(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.place):
            assert r.whole == (most == 512)
            got.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
        assert got == want


@pytest.mark.parametrize("name", ["empty", "dropped"])
def test_nothing_left(spark, tmp_path, name):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [] if name == "empty" else [(gone, 0, "user", "a.")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in C.op11_conversations(spark, str(tmp_path)).collect()]
    assert got == ([] if name == "empty" else [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())])
