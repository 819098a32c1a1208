"""The usage engine: rules by hand, every registered query against its SQL, logs and streams."""

import json
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from meterlake.functions import scalars as S
from meterlake.operators import alerts, fold, ingest, pricing, report
from meterlake.plans import catalog
from meterlake.sources import logs, tail

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 6) if hasattr(v, "__float__") else v


def rows_of(pdf):
    return sorted(str([cell(v) for v in r]) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in "events lineitem".split():
        c.sql(f"create view {name} as from read_parquet('{SF}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_scalar_rules(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    kinds = [one(S.window_kind(F.lit(m)))[0] for m in (299, 300, 10079, 10080, 43200, 2880, 0)]
    assert kinds == ["session", "session", "weekly", "weekly", "monthly", "other", "other"]
    assert [one(S.pace_risk(F.lit(p)))[0] for p in (89.9, 90.0, 100.0, 100.1)] == ["healthy", "at-risk", "at-risk", "over"]
    assert [one(S.confidence(F.lit(0), n))[0] for n in (29 * 60, 31 * 60)] == ["measured", "stale"]
    assert one(S.normalise_model(F.lit(" us.anthropic.Claude-Haiku-4-5-20251001-v1:0")))[0] == "anthropic.claude-haiku-4-5"
    assert one(S.csv_cell(F.lit('a,"b')))[0] == '"a,""b"' and one(S.dollars(F.lit(0), F.lit(3)))[0] == "" and one(S.dollars(F.lit(0), F.lit(0)))[0] == "0.000000"
    assert one(S.instant(F.lit(1785000000)))[0] == "2026-07-25T17:20:00Z" and one(S.week_slot(F.lit(1785715200)))[0] == 0
    assert one(S.percent_of(F.lit(0.0), F.lit(1.0)))[0] is None and one(S.percent_of(F.lit(1.0), F.lit(50.0)))[0] == 999.0
    u = spark.createDataFrame([("claude-opus-4-8", 1000, 200, 4000, 800, 300), ("who", 1, 1, 1, 1, 1), (None, 1, 1, 1, 1, 1)],
        "model string, input long, output long, cache_read long, cache_5m long, cache_1h long")
    assert [None if r.usd is None else float(r.usd) for r in pricing.with_cost(u).collect()] == [0.02, None, None]  # (5000 + 5000 + 2000 + 5000 + 3000) / 10**6


def totals(spark, rows):
    df = spark.createDataFrame([(i, at, n) for i, (n, at) in enumerate(rows)], "seq long, at_s long, input long")
    df = df.select(F.lit("p").alias("provider"), F.lit("s").alias("session"), "seq", "at_s", "input", *(F.lit(0).cast("long").alias(c) for c in ingest.COUNTERS[1:]))
    return [r.input for r in ingest.cumulative_deltas(df).orderBy("seq").collect()]


def test_cumulative_totals(spark):
    assert totals(spark, [(100, 0), (250, 10), (400, 20)]) == [100, 150, 150]
    assert totals(spark, [(500, 0), (30, 10)]) == [500, 30]
    assert totals(spark, [(300, 100), (100, 0), (350, 200)]) == [300, 50]
    assert totals(spark, [(100, 5), (100, 5), (150, 5), (30, 9)]) == [100, 50, 30]


@pytest.mark.parametrize("bits", [1, 3, 24])
def test_totals_and_projects_by_chunks_equal_row_by_row(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randint(0, 12), *(rng.randint(0, 3) for _ in ingest.COUNTERS)) for k in range(300)]
    df = spark.createDataFrame(rows, "session string, seq long, at_s long, " + ", ".join(f"{c} long" for c in ingest.COUNTERS)).withColumn("provider", F.lit("p"))
    want, state = [], {}
    for r in rows:
        row = dict(zip(["session", "seq", "at_s", *ingest.COUNTERS], r))
        state[r[0]], out = ingest.next_delta(state.get(r[0]), row)
        want += [(r[0], *out)] if out else []
    assert sorted(map(str, want)) == sorted(str(tuple(r)[1:]) for r in ingest.cumulative_deltas(df, bits).collect())
    known = df.where("seq % 7 = 3").selectExpr("provider", "session", "seq", "at_s", "if(seq % 2 = 0, null, concat('/w/', seq)) as project")
    use = df.where("seq % 7 <> 3").selectExpr("provider", "session", "seq", "if(seq % 5 = 0, '/own', null) as project")
    seen, shown = {}, {}
    for r in rows:
        if r[1] % 7 != 3:
            shown[r[1]] = "/own" if r[1] % 5 == 0 else seen.get(r[0], (0, 0, None))[2]
        elif r[1] % 2:
            seen[r[0]] = max(seen.get(r[0], (-1, -1, "")), (r[2], r[1], f"/w/{r[1]}"))
    assert {r.seq: r.project for r in ingest.attribute_sessions(use, known, bits).collect()} == shown


def test_one_session_is_many_groups(spark):
    df = spark.range(100).selectExpr("concat('p', id % 1) as provider", "concat('s', id % 1) as session", "id << 20 as seq", "id as at_s", *(f"id as {c}" for c in ingest.COUNTERS))
    chunks = ingest.max_before(df, ["provider", "session"], F.col("at_s"), "x")
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert any("__c" in x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])
    assert {(r.at_s, r.x) for r in chunks.collect()} == {(k, k - 1 if k else None) for k in range(100)}


def test_alert_state(spark):
    def fired(rows):
        df = spark.createDataFrame([("p", "l", 300, i, i, float(p), r) for i, (p, r) in enumerate(rows)],
            "provider string, limit_id string, window_minutes long, seq long, at_s long, used_percent double, resets_at long")
        return [(r.seq, r.threshold) for r in alerts.replay(df).orderBy("seq").collect()]

    assert fired([(50, 1), (71, 1), (72, 1), (86, 1), (84, 1), (86, 1), (96, 1)]) == [(1, 70.0), (3, 85.0), (6, 95.0)]
    assert fired([(71, 1), (66, 1), (71, 1)]) == [(0, 70.0), (2, 70.0)] and fired([(71, 1), (71, 2)]) == [(0, 70.0), (1, 70.0)]


def test_label_cap_and_range_edges(spark):
    u = spark.createDataFrame([("p", i, i * 100, f"m{i % 4}" if i != 9 else None, 1) for i in range(12)], "provider string, seq long, at_s long, model string, input long")
    kept, dropped = fold.capped_labels(u, "model", 2)
    assert kept.count() == 6 and dropped.first().labels_dropped == 6  # m2 and m3, three records each
    s = spark.createDataFrame([("p", t, 1) for t in (0, 300, 600)], "provider string, start long, input long")
    assert fold.in_range(s, 0, 600).count() == 2


def test_paths(spark):
    got = report.shortened_paths(spark.createDataFrame([("/a/x/p",), ("/b/x/p",), (r"c:\w\q",)], "path string"))
    assert {r.path: r.short for r in got.collect()} == {"/a/x/p": "a/x/p", "/b/x/p": "b/x/p", r"c:\w\q": "q"}


def write(path, *records, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + end)


def claude_row(i, out=10, **more):
    return {"timestamp": "2026-07-28T15:00:00Z", "sessionId": "s1", "requestId": f"r{i}", "cwd": "/srv/tools/alpha",
        "message": {"id": f"m{i}", "model": "claude-opus-5", "usage": {"input_tokens": 2, "output_tokens": out, "cache_creation_input_tokens": 5}}} | more


def test_log_formats(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/c/proj/a.jsonl", claude_row(1), claude_row(1), claude_row(2, 0, requestId=None), '{"usage": broken', {"type": "user"})
    write(f"{root}/c/proj/s/subagents/b.jsonl", claude_row(3))
    write(f"{root}/c/statusline/d.jsonl", {"type": "x", "at": "2026-07-28T15:05:00Z", "rate_limits": {"seven_day": {"used_percentage": 95.0, "resets_at": 1785007800}}})
    r = logs.read_provider(spark, f"{root}/c", "claude-code")
    rows = r.usage.where("origin = 'main'").orderBy("seq").collect() + r.usage.where("origin <> 'main'").collect()
    assert len(rows) == 4 and {x.origin for x in rows} == {"main", "subagent"} and r.errors.count() == 1
    assert float(rows[0].usd) == pytest.approx(2 * 5e-6 + 10 * 2.5e-5 + 5 * 6.25e-6)
    assert ingest.dedup_first_wins(r.usage).count() == 3
    assert [(x.window_minutes, x.used_percent) for x in r.limits.collect()] == [(10080, 95.0)]
    count = {"total_tokens": 120, "input_tokens": 100, "cached_input_tokens": 40, "output_tokens": 20, "reasoning_output_tokens": 5}
    write(f"{root}/x/2026/07/28/rollout-1.jsonl", {"timestamp": "2026-07-28T15:00:00Z", "type": "session_meta", "payload": {"cwd": "/srv/tools/alpha"}},
        {"timestamp": "2026-07-28T15:01:00Z", "type": "event_msg", "payload": {"type": "token_count",
        "info": {"total_token_usage": count, "last_token_usage": count}, "rate_limits": {"primary": {"used_percent": 12.5, "window_minutes": 299}, "secondary": None}}})
    r = logs.read_provider(spark, f"{root}/x", "codex")
    u = ingest.attribute_sessions(r.usage, r.sessions).first()
    assert (u.input, u.cache_read, u.output, u.reasoning, u.project, u.usd) == (60, 40, 20, 5, "/srv/tools/alpha", None)
    assert [(x.limit_id, x.window_minutes) for x in r.limits.collect()] == [("codex", 299)]
    metric = {"totalNanoAiu": 250000000, "requests": {"cost": 2.0}, "usage": {"inputTokens": 900, "outputTokens": 40, "cacheReadTokens": 300, "cacheWriteTokens": 500}}
    write(f"{root}/p/u1/events.jsonl", {"type": "session.shutdown", "id": "e", "timestamp": "2026-07-28T15:00:00Z",
        "data": {"modelMetrics": {"claude-haiku-4-5": metric}}}, {"type": "session.error", "timestamp": "2026-07-28T15:00:00Z", "data": {"errorCode": "quota_exceeded"}})
    r = logs.read_provider(spark, f"{root}/p", "copilot-cli")
    u, x = r.usage.first(), r.limits.first()
    assert (u.session, u.input, u.cache_creation, float(u.usd), u.requests) == ("u1", 100, 500, 0.0025, 2.0) and x.resets_at == 1785542400


def test_tail_reads_appended_bytes_once(tmp_path):
    path = f"{tmp_path}/a.jsonl"
    reader = tail.TailReader({"root": str(tmp_path), "globs": "*.jsonl"})
    start = reader.initialOffset()

    def step():
        nonlocal start
        end = reader.latestOffset()
        out = [x for p in reader.partitions(start, end) for b in reader.read(p) for x in b.column("line").to_pylist() if x]
        start = end
        return out

    write(path, "one", "tw", end="")
    assert step() == ["one"] and step() == []
    write(path, "o", "", "three\r")
    assert step() == ["two", "three"]
    os.remove(path)
    write(path, "new")
    assert step() == ["new"]


