"""Streams: the tailing source over restarts, ingest, and rules that keep state."""

import json
import os
import random

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from meterlake.engine import Engine
from meterlake.operators import ingest
from meterlake.sources import logs, tail
from meterlake.sources.store import Store
from meterlake.streaming import pipeline, state


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def usage_line(i):
    return json.dumps({"timestamp": "2026-02-03T04:05:06Z", "sessionId": "s", "requestId": f"r{i}",
        "message": {"id": f"m{i}", "model": "claude-opus-5", "usage": {"input_tokens": 3, "output_tokens": i}}}) + "\n"


class Stream:
    """The calls Spark makes: offsets survive a restart, the reader doesn't."""

    def __init__(self, root, **options):
        self.options = {"root": str(root), "globs": "*.jsonl"} | options
        self.reader = tail.TailReader(self.options)
        self.at = self.reader.initialOffset()

    def restart(self):
        self.reader = tail.TailReader(self.options)

    def batch(self):
        end = self.reader.latestOffset()
        rows = [r for p in self.reader.partitions(self.at, end) for b in self.reader.read(p) for r in b.to_pylist()]
        self.at = end
        self.events = [(r["problem"], os.path.basename(r["path"]), r["offset"]) for r in rows if r["problem"] in tail.EVENTS]
        return [r["line"] or r["problem"] for r in sorted(rows, key=lambda r: r["place"]) if r["problem"] not in tail.EVENTS]


def test_a_restart_reads_nothing_twice(tmp_path):
    for i in range(5):
        put(f"{tmp_path}/{i}.jsonl", f"line{i}\n")
    s = Stream(tmp_path, maxFilesPerBatch="2")
    seen = s.batch()
    assert len(seen) == 2
    s.restart()
    seen += s.batch() + s.batch()
    assert sorted(seen) == [f"line{i}" for i in range(5)]
    put(f"{tmp_path}/3.jsonl", "more\n")
    s.restart()
    assert s.batch() == ["more"] and s.batch() == []
    os.truncate(f"{tmp_path}/3.jsonl", 0)
    put(f"{tmp_path}/3.jsonl", "new\n")
    s.restart()
    assert s.batch() == ["new"]


def test_a_line_that_is_given_up_is_skipped_to_its_end(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "LONGEST_LINE", 50)
    path = f"{tmp_path}/a.jsonl"
    s = Stream(tmp_path)
    put(path, "one\n" + "x" * 80)
    assert s.batch() == ["one"]
    put(path, "x" * 20)
    assert s.batch() == ["oversize line"]
    put(path, "rest of it\ntwo\n")
    assert s.batch() == ["two"]
    put(path, b"\xff\xfe\nthree\n")
    assert s.batch() == ["invalid UTF-8", "three"]


def test_ingest_lands_every_line_once(spark, tmp_path):
    root, out = f"{tmp_path}/c", f"{tmp_path}/out"
    for i in range(60):
        put(f"{root}/proj{i}/a.jsonl", usage_line(2 * i) + usage_line(2 * i + 1))
    put(f"{root}/proj0/a.jsonl", b"\xff\n")
    for _ in range(2):
        pipeline.ingest(spark, root, "claude-code", out, f"{tmp_path}/cp", {"once": True}).awaitTermination(240)
        put(f"{root}/proj1/a.jsonl", usage_line(500) + usage_line(7))
    store = Store(spark, out)
    usage = store.usage(0)
    assert usage.count() == 121 == usage.select("seq").distinct().count() == usage.select("message").distinct().count()
    assert [r.message.split(" in ")[0] for r in store.errors().collect()] == ["invalid UTF-8"]
    told = store.counters().first()
    assert (told.lines, told.accepted, told.duplicates_skipped, told.invalid, told.refused) == (122, 121, 1, 1, 1)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_errors_live_until_their_file_is_replaced_or_removed(spark, tmp_path):
    root, out = f"{tmp_path}/c", f"{tmp_path}/out"

    def run():
        pipeline.ingest(spark, root, "claude-code", out, f"{tmp_path}/cp").awaitTermination(240)
        return sorted(os.path.basename(r.path) for r in Store(spark, out).errors().collect())

    for name in "abc":
        put(f"{root}/p/{name}.jsonl", '{"usage": no}\n' + usage_line(1))
    assert run() == ["a.jsonl", "b.jsonl", "c.jsonl"]
    put(f"{root}/p/a.jsonl", usage_line(2))
    os.remove(f"{root}/p/b.jsonl")
    os.rename(f"{root}/p/c.jsonl", f"{tmp_path}/old")
    put(f"{root}/p/c.jsonl", usage_line(3))
    assert run() == ["a.jsonl"]
    os.truncate(f"{root}/p/a.jsonl", 0)
    put(f"{root}/p/a.jsonl", '{"usage": worse}\n')
    assert run() == ["a.jsonl"] and Store(spark, out).counters().first().rotations == 2


def test_the_first_pass_comes_in_batches_after_a_restart_too(tmp_path, spark):
    root = tmp_path / "c"
    for i in range(80):
        put(f"{root}/{i:03}.jsonl", f"line{i}\n")
        os.utime(f"{root}/{i:03}.jsonl", (1000 + i, 1000 + i))
    s = Stream(root, maxFilesPerBatch="10", firstFiles="50")
    first = s.batch()
    assert sorted(first) == sorted(f"line{i}" for i in range(30, 80)) and s.events == [("backlog", "", 30)]
    # A new reader knows from the query's checkpoint how far it was.
    os.makedirs(f"{tmp_path}/cp/offsets")
    with open(f"{tmp_path}/cp/offsets/0", "w") as f:
        f.write("v1\n{}\n" + json.dumps(s.at))
    s.options["checkpoint"] = f"{tmp_path}/cp"
    s.restart()
    assert sorted(s.batch()) == [f"line{i:02}" for i in range(20, 30)] and s.events == [("backlog", "", 20)]
    assert len(s.batch()) == 10 and len(s.batch()) == 10 and s.events == [("backlog", "", 0)] and s.batch() == []
    out = f"{tmp_path}/out"
    for i in range(60):
        put(f"{tmp_path}/l/p/{i}.jsonl", usage_line(i))
    for waiting in (20, 10, 0):
        query = pipeline.ingest(spark, f"{tmp_path}/l", "claude-code", out, f"{tmp_path}/cp2", {"once": True}, maxFilesPerBatch=10, firstFiles=40)
        query.awaitTermination(240)
        assert [r.waiting for r in Store(spark, out).backlog().collect()] == [waiting]
        assert Engine.from_store(spark, out, 1_770_000_000).scanning() == (waiting > 0)
    assert Store(spark, out).usage(0).count() == 60


def batch_rows(root, **options):
    reader = tail.LogReader({"root": str(root), "globs": "*.jsonl"} | options)
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_batch_and_stream_read_the_same_lines(tmp_path, monkeypatch):
    rng = random.Random(3)
    for i in range(6):
        parts = [rng.choice([b"", b"x", "é€".encode(), b"y" * rng.randint(0, 40), b"\xff", b"z\r", b"\r"]) + b"\n" for _ in range(200)]
        put(f"{tmp_path}/{i}.jsonl", b"".join(parts) + rng.choice([b"", b"unfinished"]))
    s = Stream(tmp_path)
    want = s.batch()
    for split, chunk in ((64 << 20, 4 << 20), (7, 4 << 20), (50, 3), (1, 1), (1000, 11)):
        monkeypatch.setattr(tail, "SPLIT", split)
        monkeypatch.setattr(tail, "CHUNK", chunk)
        assert split > 1000 or len(tail.LogReader({"root": str(tmp_path)}).partitions()) > 6
        rows = sorted(batch_rows(tmp_path), key=lambda r: r["place"])
        assert [r["line"] or r["problem"] for r in rows] == want and len({r["place"] for r in rows}) == len(rows)
    raw = {r["path"]: open(r["path"], "rb").read() for r in rows}
    assert all(r["line"] is None or raw[r["path"]][r["offset"] :].startswith(r["line"].encode()) for r in rows)


def test_oversize_lines_in_a_batch(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "LONGEST_LINE", 50)
    monkeypatch.setattr(tail, "CHUNK", 16)
    put(f"{tmp_path}/a.jsonl", "one\n" + "x" * 200 + "\ntwo\n" + "y" * 40)
    for split in (1 << 20, 30, 8):
        monkeypatch.setattr(tail, "SPLIT", split)
        assert [r["line"] or r["problem"] for r in batch_rows(tmp_path)] == ["one", "oversize line", "two"]


def test_conditions_leave_out_files_unopened(spark, tmp_path, monkeypatch):
    for i in range(3):
        put(f"{tmp_path}/p/{i}.jsonl", usage_line(i))
        os.utime(f"{tmp_path}/p/{i}.jsonl", (1000 + i, 1000 + i))
    assert logs.lines(spark, "claude-code", str(tmp_path), least_modified=1002).count() == 1
    reader = tail.LogReader({"root": f"{tmp_path}/p", "globs": "*.jsonl"})
    assert list(reader.pushFilters([GreaterThan(("modified",), 1001), EqualTo(("line",), "x"), EqualTo(("path",), f"{tmp_path}/p/2.jsonl")])) == [EqualTo(("line",), "x")]
    assert [s.path for p in reader.partitions() for s in p.spans] == [f"{tmp_path}/p/2.jsonl"]


def test_reverse_tail_reads_no_more_than_asked(tmp_path, monkeypatch):
    path = f"{tmp_path}/a.jsonl"
    put(path, "".join(f"line {i}\n" for i in range(1000)) + "unfini")
    size, read = os.path.getsize(path), []
    monkeypatch.setattr(tail, "CHUNK", 64)

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    store = type("Fs", (), {"open_input_file": lambda self, p: Counted(open(p, "rb"))})()
    monkeypatch.setattr(tail, "opened", lambda root: (store, root))
    span = tail.Span(str(tmp_path), path, 0, size, size, 0, 0)
    lines = tail.last_lines(span, 500)
    assert [next(lines)[1] for _ in range(3)] == ["line 999", "line 998", "line 997"] and sum(read) == 64
    rest = list(lines)
    assert sum(read) == 500 and [x for _, x in rest] == [f"line {i}" for i in range(996, 996 - len(rest), -1)] and len(rest) == 51
    with open(path, "rb") as f:
        data = f.read()
    assert all(data[at:].startswith(x.encode()) for at, x in rest)
    assert [x for _, x in tail.last_lines(span, 1 << 20)] == [f"line {i}" for i in range(999, -1, -1)]
    assert list(tail.last_lines(span, 3)) == []


def test_a_folder_that_is_closed_hides_only_itself(tmp_path, monkeypatch):
    put(f"{tmp_path}/open/a.jsonl", "x\n")
    os.makedirs(f"{tmp_path}/closed")
    real = tail.fs.LocalFileSystem

    class Closed:
        def get_file_info(self, what):
            if isinstance(what, tail.fs.FileSelector) and what.base_dir.endswith("/closed"):
                raise PermissionError("no")
            return real().get_file_info(what)

    monkeypatch.setattr(tail, "opened", lambda root: (Closed(), root))
    files, closed = tail.found(str(tmp_path), ["*/*.jsonl", "*/*/*.jsonl"])
    assert list(files) == [f"{tmp_path}/open/a.jsonl"] and closed == [f"{tmp_path}/closed"]
    assert tail.access(f"{tmp_path}/closed") == "denied" and tail.access(f"{tmp_path}/none") == "missing"


def replayed(spark, tmp_path, name, make, batches):
    """Rows of make(stream) over files that come one a batch, with a restart between all of them."""
    rows = []
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/{name}")
        query = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation",
            f"{tmp_path}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
    return spark.read.parquet(f"{tmp_path}/{name}-out").orderBy("seq").collect() + rows


def test_running_totals_go_on_after_a_restart(spark, tmp_path):
    def totals(*rows):
        df = spark.createDataFrame(list(rows), "seq long, session string, at_s long, input long")
        return df.select(F.lit("p").alias("provider"), "session", "seq", "at_s", "input", *(F.lit(0).cast("long").alias(c) for c in ingest.COUNTERS[1:]))

    parts = [totals((1, "a", 5, 100), (2, "b", 5, 7)), totals((3, "a", 9, 250), (4, "a", 8, 900), (5, "b", 6, 3))]
    got = replayed(spark, tmp_path, "totals", state.deltas, parts)
    whole = ingest.cumulative_deltas(parts[0].unionByName(parts[1])).orderBy("seq").collect()
    assert [(r.seq, r.input) for r in got] == [(r.seq, r.input) for r in whole] == [(1, 100), (2, 7), (3, 150), (5, 3)]


def test_state_of_sessions_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SHARDS", 1)

    def totals(*rows):
        df = spark.createDataFrame(list(rows), "seq long, session string, at_s long, input long")
        return df.select(F.lit("p").alias("provider"), "session", "seq", "at_s", "input", *(F.lit(0).cast("long").alias(c) for c in ingest.COUNTERS[1:]))

    # Ten sessions, the oldest two by time are s0 and s9; an eleventh sends both away, then s0 and s1 come back.
    first = totals(*((i, f"s{i}", 100 + i if i < 9 else 50, 10) for i in range(10)))
    parts = [first, totals((10, "t", 300, 10)), totals((11, "s0", 400, 15), (12, "s1", 400, 15))]
    got = replayed(spark, tmp_path, "bounded", lambda df: state.deltas(df, cap=10), parts)
    assert [(r.session, r.input) for r in got[10:]] == [("t", 10), ("s0", 15), ("s1", 5)] and len(got) == 13
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/bounded-cp")
    assert held.count() == 10 and "s9" not in {r.key.session for r in held.selectExpr("user_map_key as key").collect()}


def test_alerts_and_episodes_are_announced_once(spark, tmp_path):
    def readings(*rows):
        return spark.createDataFrame([("p", "l", 300, seq, seq, float(p), r) for seq, p, r in rows],
            "provider string, limit_id string, window_minutes long, seq long, at_s long, used_percent double, resets_at long")

    got = replayed(spark, tmp_path, "readings", state.alerts, [readings((1, 71, None), (2, 80, None)), readings((3, 72, None), (4, 86, None)), readings((5, 60, None), (6, 70, 9))])
    assert [(r.seq, r.threshold) for r in got] == [(1, 70.0), (4, 85.0), (6, 70.0)]
    checks = [spark.createDataFrame([("p", k, b, 5.0)], "provider string, seq long, in_burst boolean, factor double") for k, b in enumerate([True, True, False, True])]
    assert [r.seq for r in replayed(spark, tmp_path, "checks", state.episodes, checks)] == [0, 3]


def test_a_session_keeps_its_project(spark, tmp_path):
    schema = "provider string, session string, seq long, at_s long, project string, seen boolean"
    parts = [[("p", "s", 1, 10, "/one", True), ("p", "s", 2, 5, None, False)],
        [("p", "s", 3, 8, "/old", True), ("p", "s", 4, 9, None, False), ("p", "s", 5, 9, "/own", False), ("p", "t", 6, 9, None, False)]]
    make = lambda df: state.projects(df.where("not seen"), df.where("seen"))
    got = replayed(spark, tmp_path, "sessions", make, [spark.createDataFrame(p, schema) for p in parts])
    assert [(r.seq, r.project) for r in got] == [(2, "/one"), (4, "/one"), (5, "/own"), (6, None)]


def test_five_minute_sums_of_a_stream(spark, tmp_path):
    rows = [(0, "m", "r", 1), (10, "m", "r", 1), (400, None, None, 2), (401, None, None, 2)]
    df = spark.createDataFrame(rows, "at_s long, message string, request string, input long").select(F.timestamp_seconds("at_s").alias("at"),
        F.lit("p").alias("provider"), "message", "request", "input", *(F.lit(0).cast("long").alias(c) for c in ("output", "cache_read", "cache_creation")))
    df.write.parquet(f"{tmp_path}/u")
    stream = pipeline.bucket_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/u"))
    query = stream.writeStream.format("memory").queryName("five").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert sorted((r.start, r.input) for r in spark.table("five").collect()) == [(0, 1), (300, 4)]
