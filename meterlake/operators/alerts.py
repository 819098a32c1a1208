"""Threshold alerts: each crossing is announced once, until the window resets or falls back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequence import folded

HYSTERESIS = 3.0
DEFAULT_THRESHOLDS = (70, 85, 95)
KEYS = ["provider", "limit_id", "window_minutes"]
ALERTS = "seq bigint, at_s bigint, percent double, threshold double"
#: Readings of a window among which those without effect are dropped together.
CHUNK = 1_000_000


def next_alert(thresholds) -> Callable:
    """step(state, reading) -> (state, alert or None); the state is the announced threshold and its reset."""
    rising = sorted(float(t) for t in thresholds)

    def step(state: tuple | None, row: dict) -> tuple[tuple | None, tuple | None]:
        percent, reset = row["used_percent"], row["resets_at"]
        if state is not None and (state[1] != reset or percent < state[0] - HYSTERESIS):
            state = None
        crossed = max((t for t in rising if percent >= t), default=None)
        if crossed is None or (state is not None and state[0] >= crossed):
            return state, None
        return (crossed, reset), (row["seq"], row["at_s"], percent, crossed)

    return step


def telling(readings: DataFrame, thresholds=DEFAULT_THRESHOLDS) -> DataFrame:
    """The readings that can change a window's state.

    One that stands between the same thresholds, and as far above what forgets them, as the one before, with the same
    reset, can't. A window's readings are compared chunk by chunk, so that none is a task by itself.
    """
    edges = sorted({float(t) for t in thresholds} | {t - HYSTERESIS for t in thresholds})
    band = sum((F.when(F.col("used_percent") >= t, 1).otherwise(0) for t in edges), F.lit(0))
    w = W.partitionBy(*KEYS, F.floor(F.col("seq") / CHUNK)).orderBy("seq")
    now = F.struct(band.alias("b"), F.col("resets_at").alias("r"))
    return readings.withColumn("__now", now).withColumn("__before", F.lag("__now").over(w)).where(~F.col("__now").eqNullSafe(F.col("__before"))).drop("__now", "__before")


def replay(readings: DataFrame, thresholds=DEFAULT_THRESHOLDS, muted_until: int | None = None, primed_from: int | None = None) -> DataFrame:
    """provider, limit_id, window_minutes, seq, at_s, percent, threshold for each announced crossing.

    `readings` are fresh ones (provider, limit_id, window_minutes, seq, at_s, used_percent, resets_at)
    in order of seq. Muted and unprimed readings update the state silently.
    """
    fresh = readings.where(F.col("used_percent").isNotNull() & ~F.isnan("used_percent"))
    fresh = fresh.select(*KEYS, "seq", "at_s", F.col("used_percent").cast("double").alias("used_percent"), "resets_at")
    out = folded(telling(fresh, thresholds), KEYS, ["seq"], next_alert(thresholds), ALERTS)
    for since in (muted_until, primed_from):
        if since is not None:
            out = out.where(F.col("at_s") >= since)
    return out
