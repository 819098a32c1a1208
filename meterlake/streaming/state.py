"""Streams that remember: running totals, a session's project, announced alerts and bursts.

Each rule is that of the batch operator, kept as state, so a restart goes on where the
checkpoint stands. Rows of a micro-batch are taken in order of seq; later batches arrive later. State has
no timeout: a session's baseline and project outlive the retention of the series.

What is kept per session is bounded: a provider's sessions are dealt into SHARDS by hash, each a map of its own
in RocksDB, where a session is read and written alone. When a map grows beyond its share of the cap, the tenth of it
that is oldest goes, but nothing that the batch itself has touched; so all shards work side by side, none needs
the others, and looking for the oldest is paid once for many sessions. A session that comes back after that begins anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import alerts as rules
from ..operators.ingest import COUNTERS, DELTAS, next_delta


def _remembering(stream: DataFrame, keys: list[str], step: Callable, result: str, state: str, pack: Callable, unpack: Callable) -> DataFrame:
    """keys and results of step over each key's rows; pack and unpack turn its state into a row of `state` and back."""
    typed = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    schema = StructType.fromDDL(f"{typed}, {result}")
    ordered = stream.select(*keys, *(c for c in stream.columns if c not in keys))

    def run(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("seq").astype(object)
        now = unpack(held.get) if held.exists else None
        found = []
        for row in rows.where(rows.notna(), None).to_dict("records"):
            now, out = step(now, row)
            if out is not None:
                found.append((*key, *out))
        if now is not None:
            held.update(pack(now))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(found, columns=schema.names)

    return ordered.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", "NoTimeout")


#: Sessions of a provider whose running totals, and whose projects, are kept (fixed values); maps they are dealt into.
TOTALS_CAP, PROJECTS_CAP = 100_000, 20_000
SHARDS = 64


class BoundedSessions(StatefulProcessor):
    """step over the rows of each session of a shard; of its states (`value`, whose first column says how old one is) the newest stay."""

    def __init__(self, step: Callable, result: StructType, value: str, pack: Callable, unpack: Callable, cap: int):
        self.step, self.row, self.pack, self.unpack, self.cap = step, Row(*result.names), pack, unpack, cap
        # Parsed here, as init() runs where there is no session.
        self.schemas = [StructType.fromDDL(x) for x in ("session string", value, "n int")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        session, value, n = self.schemas
        self.held, self.size = handle.getMapState("held", session, value), handle.getValueState("size", n)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        states, known, found = {}, set(), []
        for row in sorted((r.asDict() for r in rows), key=lambda r: r["seq"]):
            session = row["session"]
            if session not in states:
                value = self.held.getValue((session,)) if self.held.containsKey((session,)) else None
                states[session] = None if value is None else self.unpack(value)
                if value is not None:
                    known.add(session)
            states[session], out = self.step(states[session], row)
            if out is not None:
                found.append((key[0], session, *out))
        states = {session: now for session, now in states.items() if now is not None}
        for session, now in states.items():
            self.held.updateValue((session,), self.pack(now))
        n = (self.size.get()[0] if self.size.exists() else 0) + len(states.keys() - known)
        if n > self.cap:
            old = sorted((value[0], session) for (session,), value in self.held.iterator() if session not in states)
            gone = old[: n - self.cap + self.cap // 10]
            for _, session in gone:
                self.held.removeKey((session,))
            n -= len(gone)
        self.size.update((n,))
        yield from (self.row(*x) for x in found)

    def close(self) -> None:
        pass


def _per_session(stream: DataFrame, step: Callable, result: str, value: str, pack: Callable, unpack: Callable, cap: int) -> DataFrame:
    """provider, session and results of step over each session's rows, with no more than about `cap` sessions of a provider held."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    sharded = stream.withColumn("shard", F.pmod(F.xxhash64("session"), F.lit(SHARDS)).cast("int"))
    out = StructType.fromDDL(f"provider string, session string, {result}")
    bounded = BoundedSessions(step, out, value, pack, unpack, max(1, cap // SHARDS))
    return sharded.groupBy("provider", "shard").transformWithState(bounded, out, "Append", "None")


def deltas(totals: DataFrame, cap: int = TOTALS_CAP) -> DataFrame:
    """Accepted increments of running totals (provider, session, seq, at_s, counters)."""
    names = ["at_s", *COUNTERS]
    rows = totals.where("session is not null").select("provider", "session", "seq", "at_s", *COUNTERS)
    return _per_session(rows, next_delta, DELTAS, ", ".join(f"{c} bigint" for c in names), lambda row: tuple(int(row[c]) for c in names), lambda held: dict(zip(names, held)), cap)


def alerts(readings: DataFrame, thresholds=rules.DEFAULT_THRESHOLDS) -> DataFrame:
    """Announced crossings of fresh readings (provider, limit_id, window_minutes, seq, at_s, used_percent, resets_at)."""
    fresh = readings.where(F.col("used_percent").isNotNull() & ~F.isnan("used_percent"))
    fresh = fresh.select(*rules.KEYS, "seq", "at_s", F.col("used_percent").cast("double").alias("used_percent"), F.col("resets_at").cast("bigint").alias("resets_at"))
    return _remembering(fresh, rules.KEYS, rules.next_alert(thresholds), rules.ALERTS, "threshold double, resets_at bigint",
        lambda s: (float(s[0]), None if s[1] is None else int(s[1])), tuple)


def next_project(state: tuple | None, row: dict) -> tuple[tuple | None, tuple | None]:
    """State: (at, project) of the newest session record so far, of equally new ones the last to arrive."""
    if row["seen_at"] is not None:
        return ((row["seen_at"], row["project"]) if state is None or row["seen_at"] >= state[0] else state), None
    project = row["project"] if row["project"] is not None else (state[1] if state else None)
    return state, (row["seq"], project)


def projects(usage: DataFrame, sessions: DataFrame, cap: int = PROJECTS_CAP) -> DataFrame:
    """provider, session, seq, project of each usage row: its own, else its session's newest that arrived before."""
    own = usage.select("provider", "session", "seq", "project", F.lit(None).cast("bigint").alias("seen_at"))
    seen = sessions.where("project is not null").select("provider", "session", "seq", "project", F.col("at_s").cast("bigint").alias("seen_at"))
    return _per_session(own.unionByName(seen), next_project, "seq bigint, project string", "at bigint, project string", tuple, lambda s: (int(s[0]), s[1]), cap)


def next_episode(state: tuple | None, row: dict) -> tuple[tuple | None, tuple | None]:
    """A burst is announced when it begins and again only after it has cleared."""
    if not row["in_burst"]:
        return None, None
    return (True,), (None if state else (row["seq"], row["factor"]))


def episodes(checks: DataFrame) -> DataFrame:
    """provider, seq, factor of the checks (provider, seq, in_burst, factor) at which a burst begins."""
    rows = checks.select("provider", "seq", "in_burst", F.col("factor").cast("double").alias("factor"))
    return _remembering(rows, ["provider"], next_episode, "seq bigint, factor double", "open boolean", lambda s: (True,), tuple)
