"""The stored series: batches that come late, twice or broken, days that are read and days that go."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from meterlake.engine import Engine
from meterlake.operators import fold, ingest
from meterlake.sources import logs
from meterlake.sources.store import DAY, Store

DAY0 = 20_000 * DAY
USAGE = "path string, seq long, at_s long, session string, message string, request string, model string, project string, origin string, requests double, " + ", ".join(
    f"{c} long" for c in fold.TOKENS) + ", usd string"


def records(spark, *rows, sessions=(), errors=()):
    """rows: (seq, at_s, session, message, model, input)."""
    usage = [("/f", seq, at, session, message, "r" if message else None, model, None, "main", 0.0, n, 0, 0, 0, 0, "0.5") for seq, at, session, message, model, n in rows]
    usage = spark.createDataFrame(usage, USAGE).withColumn("usd", F.col("usd").cast("decimal(38,11)")).withColumn("provider", F.lit("codex"))
    known = spark.createDataFrame(list(sessions), "seq long, at_s long, session string, project string").selectExpr("'codex' as provider", "'/f' as path", "*")
    bad = spark.createDataFrame(list(errors), "path string, seq long, message string")
    limits = spark.createDataFrame([], "provider string, path string, seq long, limit_id string, observed_at long, window_minutes long, used_percent float, resets_at long")
    return logs.Records(usage, limits, known, bad)


FIRST = [(1, DAY0 + 10, "s", "m1", "x", 5), (2, DAY0 + 20, "s", None, "x", 7), (3, DAY0 + DAY + 5, "t", "m2", "y", 11), (4, DAY0 + 15, "s", "m1", "x", 99)]
SECOND = [(11, DAY0 + 30, "s", "m3", "y", 13), (12, DAY0 + 2 * DAY, "s", "m1", "x", 99), (13, DAY0 + 2 * DAY, "t", "m4", "z", 17)]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


SERIES = [(DAY0, 5 + 7 + 13), (DAY0 + DAY, 11), (DAY0 + 2 * DAY, 17)]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_late_and_repeated_usage_lands_once(spark, store):
    told = store.merge("codex", records(spark, *FIRST, sessions=[(0, 1, "s", "/one")]), 0)
    assert told == {"records": 4, "accepted": 3, "duplicates_skipped": 1, "refused": 0}
    kept = {f: os.path.getmtime(f) for f in glob.glob(f"{store.path}/series/day=*/provider=codex/*.parquet")}
    told = store.merge("codex", records(spark, *SECOND, sessions=[(10, 2, "s", "/two")], errors=[("/f", 14, "bad")]), 1)
    assert told == {"records": 3, "accepted": 2, "duplicates_skipped": 1, "refused": 1}
    for _ in range(2):
        assert rows(store.series(0), "start", "input") == SERIES
        whole = ingest.dedup_first_wins(records(spark, *FIRST, *SECOND).usage)
        want = rows(fold.breakdown(whole, "model", "agent"), "dimension", "hour", "label", "input", "records", "first_seq")
        assert rows(store.labels(0).where("dimension <> 'project'"), "dimension", "hour", "label", "input", "records", "first_seq") == want
        assert rows(store.usage(0), "seq", "project") == [(1, "/one"), (2, "/one"), (3, None), (11, "/two"), (13, None)]
        # The day that nothing touched was not written again.
        now = set(glob.glob(f"{store.path}/series/day=*/provider=codex/*.parquet"))
        assert [f for f in kept if f in now] == [f for f in kept if "day=2024-10-05" in f] and len(now) == 3
        store.merge("codex", records(spark, *SECOND, sessions=[(10, 2, "s", "/two")], errors=[("/f", 14, "bad")]), 1)  # the batch runs again
    assert not glob.glob(f"{store.path}/stage/*")


def test_a_merge_that_breaks_is_mended_by_the_next(spark, store, monkeypatch):
    store.merge("codex", records(spark, *FIRST), 0)
    real = Store._write

    def breaking(name):
        def write(self, table, df):
            if table == name:
                self.delete("series/day=*/provider=codex")  # as if between a day's deletion and its rename
                raise OSError("lost")
            real(self, table, df)

        return write

    for name in ("usage", "sums", "label_sums", "series", "labels"):
        monkeypatch.setattr(Store, "_write", breaking(name))
        with pytest.raises(OSError):
            store.merge("codex", records(spark, *SECOND), 1)
    monkeypatch.setattr(Store, "_write", real)
    store.refold("codex", ["2024-10-05"])  # the batch doesn't touch this one, which the test has deleted
    store.merge("codex", records(spark, *SECOND), 1)
    assert rows(store.series(0), "start", "input") == SERIES


def test_a_batch_that_shrinks_takes_its_days_along(spark, store):
    store.merge("codex", records(spark, *SECOND), 0)
    store.merge("codex", records(spark, *SECOND[:1]), 0)
    assert rows(store.series(0), "start", "input") == [(DAY0, 13)]
    assert rows(store.labels(0).where("dimension = 'model'"), "label", "input") == [("y", 13)]


def test_only_the_days_asked_for_are_read(spark, store):
    store.merge("codex", records(spark, *FIRST, *SECOND), 0)
    asked = store.series(DAY0 + DAY, DAY0 + 2 * DAY, "codex")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "provider" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r.f.split("/day=")[1][:10] for r in asked.select(F.input_file_name().alias("f")).collect()} == {"2024-10-05"}
    assert rows(asked, "start", "input") == [(DAY0 + DAY, 11)]
    assert rows(store.series(DAY0 + 1), "start") == [(DAY0 + DAY,), (DAY0 + 2 * DAY,)]


def test_prune_drops_whole_days(spark, store):
    store.merge("codex", records(spark, *FIRST, *SECOND), 0)
    assert store.prune(DAY0 + 2 * DAY + 5, DAY) == ["2024-10-04"]
    assert rows(store.series(0), "start") == [(DAY0 + DAY,), (DAY0 + 2 * DAY,)] and store.usage(0).count() == 2
    assert store.prune(DAY0 + 2 * DAY + 5, DAY) == []


def test_providers_share_a_store(spark, store):
    store.merge("codex", records(spark, *FIRST), 0)
    other = records(spark, *FIRST)
    store.merge("claude-code", other, 0)
    store.merge("claude-code", records(spark), 1)
    assert rows(store.series(0), "provider", "start", "input") == sorted([(p, at, n) for p in ("codex", "claude-code") for at, n in [(DAY0, 12), (DAY0 + DAY, 11)]])


def test_questions_read_no_log(spark, store):
    store.merge("codex", records(spark, *FIRST), 0)
    e = Engine(spark, store, DAY0 + DAY + 100)
    for df in (e.windows(), e.providers(), e.csv()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "log_lines" not in plan and "FileScan text" not in plan and "PythonDataSource" not in plan and "/usage" not in plan
    assert Engine(spark, Store(spark, store.path + "-none"), DAY0).series().count() == 0
