"""op13: ids of whole texts, every id in one piece, sequences without gaps, little padding."""

import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlake.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def checked(rows, docs, ids_of, capacity):
    """What the contract says of pieces, against ids of whole texts; returns ids of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        want, mine, at = [*ids_of(text or ""), 0], sorted(by_doc[i], key=lambda r: r.start), 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(want) and r.length > 0
            assert bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in want[at : at + r.length])
            at += r.length
        assert at == len(want)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if not at & (at - 1) else capacity - at
    return padding


def texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "Bcd", "don't", "'s", "12", "3", ",", ".", "é", "ßtraße", "²", "x\u0301", "_", "Ж", "'", "語彙", "😀", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x1c", " ", "​", "\x85", "<|endoftext|>", "!!", "᠎", "﻿", "\0"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_of_parts_are_ids_of_the_text(whole):
    encode = P.Ids(PATH)
    for text in texts(3000):
        want = b"".join(i.to_bytes(4, "little") for i in whole(text))
        assert b"".join(encode(text)) == want and b"".join(encode(text, 7)) == want


def test_every_kind_of_character(whole):
    encode, rng = P.Ids(PATH), random.Random(9)
    for code in [*range(0x3100), *(rng.randrange(0x3100, 0xD800) for _ in range(2000)), *(rng.randrange(0xE000, 0x110000) for _ in range(3000))]:
        c = chr(code)
        text = f"a{c}b1{c}2!{c}? {c}  {c}"
        assert b"".join(encode(text)) == b"".join(i.to_bytes(4, "little") for i in whole(text)), hex(code)


def test_very_much_white_space(whole):
    for text in (" " * 1_200_000 + "a", "a" + "\n" * 1_200_000):
        assert b"".join(P.Ids(PATH)(text)) == b"".join(i.to_bytes(4, "little") for i in whole(text))


def test_classes():
    found = P.classes()
    assert all(s * k <= 1024 and 1024 - s * k <= P.SLACK for s, k in found)
    assert {1 << b for b in range(11)} <= {s for s, _ in found} and (341, 3) in found
    assert [s for s, _ in P.classes(1024, 0)] == [1 << b for b in range(10, -1, -1)]


def test_pieces(spark, whole):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["word", "längere", "42", "so"]) for _ in range(rng.choice([0, 1, 5, 300, 3000])))) for i in range(120)]
    docs += [(200 + i, t) for i, t in enumerate(texts(50, 6))] + [(300, None), (301, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = P.pack(df, PATH).collect()
    used = sum(r.length for r in rows)
    assert checked(rows, docs, whole, 1024) <= used * P.SLACK / 1000
    for capacity, slack in ((64, 0), (64, 1), (1, 0)):
        small = [d for d in docs if len(d[1] or "") < 2000]
        got = P.pack(df.where(F.length(F.coalesce("text", F.lit(""))) < 2000), PATH, capacity, slack=slack).collect()
        assert slack or not checked(got, small, whole, capacity)
        checked(got, small, whole, capacity)


def test_sequences(spark, whole):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string").coalesce(1)
    rows = P.sequences(P.pack(docs, PATH, 8), 8, pad_id=7).collect()
    assert sorted(r.n for r in rows) in ([7], [1, 2, 4])
    flat = [int.from_bytes(bytes(r.ids)[k : k + 4], "little") for r in rows for k in range(0, len(r.ids), 4)]
    assert sorted(flat) == sorted(whole("a b c") + [0] + whole("d e") + [0] + [7] * (len(flat) - 7))


def test_long_text_without_spaces_and_over_windows(spark, whole, monkeypatch):
    docs = [(1, "x" * 5000), (2, "lorem ipsum, " * 60_000)]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    checked(rows, docs, whole, 1024)


def test_repeated_and_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string, length string, ids int, sequence_id int"
    df = spark.createDataFrame([(None, "a", "x", 1, 2), (None, "a", "x", 1, 2), (4, "b", "y", 1, 2), (4, "c", "y", 1, 2)], schema)
    rows = P.pack(df, PATH).collect()
    assert sum(r.length for r in rows) == 8 and {r.doc_tokens for r in rows} == {2}
    assert P.pack(df.where("false"), PATH).collect() == []
    with pytest.raises(ValueError):
        P.pack(df, PATH, 1000)


def test_query(spark, whole, tmp_path):
    docs = [(i, f"text {i} " * (i % 40)) for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {i: [*whole(t), 0] for i, t in docs}
    for r in P.op13_packing(spark, str(tmp_path)).collect():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)) and r.doc_tokens == len(ids[r.doc_id])
