"""The facade, the command line, settings, formats and counters over small log folders."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from meterlake import __main__ as cli
from meterlake import settings
from meterlake.engine import Engine, month_bounds
from meterlake.functions import formats
from meterlake.functions import scalars as S
from meterlake.operators import fold, ingest, report, snapshot
from meterlake.sources import logs, tail
from meterlake.sources.store import Store
from meterlake.streaming import pipeline

NOW = 1_770_000_000  # 2026-02-02T02:40:00Z


def put(path, *records, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + end)


def at(seconds):
    import datetime

    return datetime.datetime.fromtimestamp(NOW - seconds, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def spent(i, ago, model="claude-opus-5", **usage):
    return {"timestamp": at(ago), "sessionId": "s", "requestId": f"r{i}", "cwd": "/w/x",
        "message": {"id": f"m{i}", "model": model, "usage": {"input_tokens": 100_000, "output_tokens": 2_000} | usage}}


@pytest.fixture
def home(tmp_path):
    h = str(tmp_path)
    put(f"{h}/.claude/projects/-w-x/a.jsonl", *(spent(i, 600 * (i + 1)) for i in range(3)), spent(1, 50))
    put(f"{h}/.meterlake/claude-code/b.jsonl", {"type": "status", "at": at(300), "rate_limits": {"five_hour": {"used_percentage": 91.5, "resets_at": NOW + 3600}}})
    return h


def test_state_and_exports(spark, home):
    e = Engine.open(spark, logs.discovered(home), NOW).set_plan("claude-code", "max-5x").set_plan("codex", "no-such-plan")
    assert e.installed == ("claude-code",)
    rows = {(r.kind, r.confidence): r for r in e.windows().collect()}
    assert set(rows) == {("session", "measured"), ("weekly", "derived")} and rows["session", "measured"].used_percent == 91.5
    state = {r.provider: r for r in e.providers().collect()}
    assert state["claude-code"].unavailable is None and state["claude-code"].input == 300_000 and state["codex"].unavailable == "not-installed"
    told = json.loads(e.json())
    assert told["updatedAt"] == "2026-02-02T02:40:00Z" and not told["scanning"] and [p["id"] for p in told["providers"]] == ["claude-code", "codex", "copilot-cli"]
    assert [w["windowMinutes"] for w in told["providers"][0]["windows"]] == [300, 10080] and told["providers"][1]["windows"] == []
    assert told["history"][0]["model"]["hours"][0]["label"] == "claude-opus-5" and told["history"][0]["total"]["dropped"] == 0
    first, absent = told["providers"][:2]
    assert list(first) == ["id", "installed", "windows", "today", "todayCost", "series", "pace", "lastActivity", "unavailable", "readError", "burst"] == list(absent)
    assert sum(b["tokens"]["input"] for b in first["series"]) == 300_000 and first["series"] == sorted(first["series"], key=lambda b: b["start"])
    assert [p["windowMinutes"] for p in first["pace"]] == [300] and first["lastActivity"] == at(600) and first["burst"] is None and first["readError"] is None
    assert absent["series"] == absent["pace"] == [] and absent["readError"] is None
    shown = [(r.dimension, r.label, r.share) for r in e.shares(7).collect()]
    assert shown == [("agent", "main", 1.0), ("model", "claude-opus-5", 1.0), ("project", "/w/x", 1.0)]
    assert e.exit_code() == 10 and e.exit_code(scanning=True) == 20
    assert [r.threshold for r in e.alerts("claude-code").collect()] == [85.0] and e.set_mute(NOW).alerts("claude-code").count() == 0
    assert e.provider_plans("copilot-cli") == ["pro", "pro-plus", "max"]


def test_command_line(spark, home):
    def run(*words):
        out = io.StringIO()
        return cli.run(spark, cli.parser().parse_args(["--home", home, "--now", str(NOW), *words]), out), out.getvalue()

    code, text = run("list")
    assert code == 0 and [x.split("\t")[:2] for x in text.splitlines()] == [["claude-code", "readable"], ["codex", "missing"], ["copilot-cli", "missing"]]
    code, text = run("export", "--csv")
    assert code == 10 and text.splitlines()[0].startswith("provider,dimension,start") and any(x.startswith("claude-code,project") for x in text.splitlines())
    assert run("export", "--json", "--provider", "codex")[0] == 20
    code, text = run("debug", "claude-code", "pro")
    assert code == 0 and text.splitlines()[0].startswith("claude\t300\t91.5\tmeasured")


def test_settings(tmp_path, spark):
    path = f"{tmp_path}/s.json"
    assert settings.load(path) == settings.Settings()
    Engine(spark, None, NOW).set_thresholds("codex", [50]).set_mute(9).save_settings(path)
    s = settings.load(path)
    assert s.thresholds("codex") == [50] and s.thresholds("claude-code") == [70, 85, 95] and s.muted(8) and not s.muted(9)
    put(path, "{", end="")
    with pytest.raises(settings.SettingsError, match="s.json"):
        settings.load(path)
    known = spark.createDataFrame([("a",), ("b",)], "provider string")
    chosen = spark.createDataFrame([("a", [5])], "provider string, thresholds array<int>")
    assert {r.provider: r.thresholds for r in settings.thresholds(known, chosen).collect()} == {"a": [5], "b": [70, 85, 95]}
    assert month_bounds(NOW) == (1_769_904_000, 1_772_323_200) and month_bounds(1_767_200_000) == (1_764_547_200, 1_767_225_600)


def test_records_that_are_refused(spark, tmp_path):
    good = json.dumps(spent(1, 60))
    bad = [good.replace("100000", "null"), good.replace("100000", "-1"), good.replace("100000", "1.5"), good.replace(at(60), "yesterday"),
        good.replace('"input_tokens"', '"output_tokens": 1, "input_tokens"')]
    put(f"{tmp_path}/p/a.jsonl", *bad, good, good.replace("m1", "m2")[:-9], end="")
    found = logs.read_provider(spark, str(tmp_path), "claude-code")
    assert found.usage.count() == 1 and found.errors.count() == len(bad)  # the last line is unfinished
    more = spark.createDataFrame([("claude-code", f"/{i}", 9 + i, f"other{i}") for i in range(5)], "provider string, path string, seq long, message string")
    first = found.errors.selectExpr("'claude-code' as provider", "path", "seq", "message")
    told = report.provider_errors(first.unionByName(more), 3).first().read_error
    assert told.startswith("other0 | other1 | malformed record in ") and told.endswith(" | 3 more log files with errors")
    store = Store(spark, f"{tmp_path}/store")
    read = store.add("claude-code", logs.lines(spark, "claude-code", f"{tmp_path}"), files=1)
    assert (read["files"], read["lines"], read["records"], read["accepted"], read["duplicates_skipped"], read["refused"]) == (1, 6, 1, 1, 0, 5)
    grown = report.since(spark.createDataFrame([("p", 3)], "k string, n long"), spark.createDataFrame([("p", 5), ("q", 2)], "k string, n long"), "n", "k")
    assert {r.k: r.n for r in grown.collect()} == {"p": 2, "q": 2}
    assert [json.loads(r.line)["message"]["id"] for r in logs.last_lines(spark, "claude-code", str(tmp_path), 2 * len(good)).collect()] == ["m1"]


def test_what_else_is_refused_and_found(spark, tmp_path):
    for folder in ("with space", "per%20cent", "ümläut"):
        put(f"{tmp_path}/{folder}/a b.jsonl", spent(folder, 60))
    put(f"{tmp_path}/p/s.jsonl", {"at": at(5), "rate_limits": {"five_hour": {"resets_at": NOW}}}, {"at": at(5), "rate_limits": {"five_hour": {"used_percentage": 4.0}}})
    with open(f"{tmp_path}/p/s.jsonl", "ab") as f:
        f.write(b'{"usage": "\xff"}\n')
    found = logs.read_provider(spark, str(tmp_path), "claude-code")
    assert found.usage.count() == 3 and [r.used_percent for r in found.limits.collect()] == [4.0]
    assert sorted(r.message.split(" in ")[0] for r in found.errors.collect()) == ["invalid UTF-8", "malformed record"]


def test_why_a_provider_is_unavailable(spark, tmp_path, monkeypatch):
    os.makedirs(f"{tmp_path}/a")
    put(f"{tmp_path}/b/2026/01/01/rollout-1.jsonl", '{"token_count"')
    os.makedirs(f"{tmp_path}/c")
    real = tail.access
    monkeypatch.setattr(tail, "access", lambda root: "denied" if root.endswith("/c") else real(root))
    e = Engine.open(spark, {"claude-code": f"{tmp_path}/a", "codex": f"{tmp_path}/b", "copilot-cli": f"{tmp_path}/c"}, NOW)
    state = {r.provider: (r.unavailable, r.read_error) for r in e.providers().collect()}
    assert state["claude-code"] == ("no-logs-found", None) and state["copilot-cli"] == ("permission-denied", None)
    assert state["codex"][0] == "read-error" and state["codex"][1].startswith("malformed record in ")
    assert Engine.open(spark, {"codex": f"{tmp_path}/none"}, NOW).providers().where("unavailable = 'not-installed'").count() == 3


def test_label_cap_frees_places(spark):
    rows = [("p", i, h * 3600, f"m{i}", 1) for i, h in enumerate([0, 1, 9, 9])] + [("p", 9, 9 * 3600, None, 1)]
    u = spark.createDataFrame(rows, "provider string, seq long, at_s long, model string, input long")
    u = u.selectExpr("*", "null as project", "'main' as origin", "0L as output", "0L as cache_read", "0L as cache_creation", "0L as reasoning", "cast(0 as decimal(38,11)) as usd")
    for after, labels, lost in ((0, {"m0", "m1", None}, 2), (9 * 3600, {"m2", "m3", None}, 0)):
        kept, dropped = fold.capped(fold.prune(fold.breakdown(u, "model"), after, 0, 3600, "hour"), 2)
        assert {r.label for r in kept.collect()} == labels and dropped.first().labels_dropped == lost
    assert [r.label for r in fold.points(fold.breakdown(u, "model"), 9 * 3600, 10 * 3600).collect()] == [None, "m2", "m3"]
    win = snapshot.ranked(spark.createDataFrame([("p", "l", 300), ("p", "l", 60)], "provider string, limit_id string, window_minutes long"))
    assert [r.window_minutes for r in win.orderBy("place").collect()] == [60, 300]


def test_formats(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(formats.duration(F.lit(s))) for s in (-5, 59, 3_900, 90_000)] == ["0m", "0m", "1h 05m", "1d 1h"]
    assert [one(formats.span(F.lit(s))) for s in (604_800, 18_000, 5_400)] == ["7d", "5h", "1h 30m"]
    assert [one(formats.tokens(F.lit(n))) for n in (999, 1_250, 3_400_000, 2_000_000_000)] == ["999", "1.2K", "3.4M", "2.0B"]
    assert [one(formats.cost(F.lit(x))) for x in (1234.4, 9.5, 0.004, 0.0)] == ["$1,234", "$9.50", "<$0.01", "$0"]
    assert [one(formats.factor(F.lit(x))) for x in (12.4, 4.0, 4.25)] == ["12", "4", "4.2"] and one(formats.percent(F.lit(84.5))) == "85%"
    assert one(formats.relative(F.lit(100), 130)) == "just now" and one(formats.relative(F.lit(None).cast("long"), 5)) is None
    assert one(formats.clock(F.lit(NOW), "Asia/Tokyo")) == "11:40" and one(formats.date(F.lit(NOW), "America/New_York")) == "1 Feb"
    assert one(formats.alert_text(F.lit("codex"), F.lit("weekly"), F.lit(85.0), F.lit(7_200))) == "codex: weekly window at 85%, resets in 2h 00m"


def test_state_is_bounded_by_the_newest(spark):
    state = spark.createDataFrame([("p", f"s{i}", i) for i in range(5)] + [("q", "s0", 0)], "provider string, session string, at_s long")
    assert {(r.provider, r.session) for r in ingest.evict_oldest(state, 2, ["session"]).collect()} == {("p", "s4"), ("p", "s3"), ("q", "s0")}
    assert [spark.range(1).select(S.level(F.lit(x))).first()[0] for x in (59.9, 60.0, 85.0, 85.1)] == ["ample", "tight", "tight", "critical"]
    rows = spark.createDataFrame([("p", 0, 0, 0.0), ("p", 1, 0, 0.0), ("p", 0, 0, 2.0)], "provider string, input long, output long, requests double")
    rows = rows.selectExpr("*", "0L as cache_read", "0L as cache_creation", "0L as reasoning")
    assert ingest.counted(rows).count() == 2


def test_what_a_stream_has_stored_is_read_back(spark, home, tmp_path):
    out, roots = f"{tmp_path}/store", logs.discovered(home)
    pipeline.ingest(spark, roots["claude-code"], "claude-code", out, f"{tmp_path}/cp", {"once": True}).awaitTermination(240)
    stored, read = Engine.from_store(spark, out, NOW), Engine.open(spark, roots, NOW)
    assert not stored.scanning()
    for ask in (lambda e: e.series().drop("batch"), lambda e: e.windows(), lambda e: e.csv(), lambda e: e.labels().drop("first_seq")):
        rows = [sorted(map(str, ask(e).collect())) for e in (stored, read)]
        assert rows[0] == rows[1] and rows[0]
    assert json.loads(stored.json())["providers"][0] == json.loads(read.json())["providers"][0]
    path = read.store.path
    read.close()
    assert not os.path.exists(path)
