"""What a provider stands at: windows measured and estimated, today's spend, pace and bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import total, window_kind
from . import fold, pace, windows

DAY = 86_400
#: How a provider's missing windows are filled: from rolling spend, from the month's spend, or not at all.
ESTIMATES = {"claude-code": "rolling", "codex": "none", "copilot-cli": "month"}
WINDOW = ["provider", "limit_id", "kind", "window_minutes", "used_percent", "resets_at", "confidence", "reported_at", "basis"]


def of(estimate: str) -> Column:
    return F.col("provider").isin([p for p, how in ESTIMATES.items() if how == estimate])


def all_windows(series: DataFrame, latest: DataFrame, ceilings: DataFrame, now: int, month_start: int, next_month: int) -> DataFrame:
    """Every provider's windows: what was measured, and estimates against the chosen plans' ceilings.

    A month's allowance counts readings of this month only, and is estimated only where there is none.
    """
    read = windows.measured(latest, now)
    current = read.where(~of("month") | (F.col("reported_at") >= month_start))
    rolling = windows.derived(read.where(of("rolling")), series, ceilings.where(of("rolling")), now)
    month = windows.month_to_date(series, read, ceilings.where(of("month")), month_start, next_month, now)
    limit = F.coalesce(*(F.when(F.col("provider") == p, x) for p, x in windows.DEFAULT_LIMIT.items()))
    month = month.select(
        "provider", limit.alias("limit_id"), window_kind(F.col("window_minutes")).alias("kind"), "window_minutes", "used_percent", "resets_at",
        F.lit("derived").alias("confidence"), F.lit(None).cast("bigint").alias("reported_at"), "basis",
    ).where("used_percent is not null")
    return current.select(WINDOW).unionByName(rolling.select(WINDOW)).unionByName(month.select(WINDOW))


def with_pace(windows_: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Windows with their forecast, where there is one."""
    return windows_.join(forecasts.select(*pace.KEY, "projected_percent", "risk", "exhausted_at"), pace.KEY, "left")


def trimmed(series: DataFrame, windows_: DataFrame, now: int) -> DataFrame:
    """The buckets of each provider's longest window, a day at least."""
    span = windows_.groupBy("provider").agg((F.max("window_minutes") * 60).alias("span"))
    both = series.join(F.broadcast(span), "provider", "left")
    return both.where(F.col("start") >= F.lit(now) - F.greatest(F.coalesce("span", F.lit(DAY)), F.lit(DAY))).drop("span")


def providers(series: DataFrame, windows_: DataFrame, known: DataFrame, now: int, errors: DataFrame | None = None) -> DataFrame:
    """A row per provider of `known` (provider, installed, maybe closed): today's spend, last activity, and why there is no reading, if so.

    series has last_at, a bucket's newest record. closed: why the logs can't be read. errors: provider, read_error.
    awaiting_setup: installed, spending today, but never told a limit.
    """
    known = known if "closed" in known.columns else known.withColumn("closed", F.lit(None).cast("string"))
    today = fold.in_range(series, now - DAY, now).groupBy("provider").agg(*(F.sum(c).alias(c) for c in (*fold.TOKENS, "usd", "unpriced")))
    last = series.groupBy("provider").agg(F.max("last_at").alias("last_activity"))
    count = windows_.groupBy("provider").agg(F.count("*").alias("windows"))
    both = known.join(today, "provider", "left").join(last, "provider", "left").join(count, "provider", "left")
    both = both.join(errors, "provider", "left") if errors is not None else both.withColumn("read_error", F.lit(None).cast("string"))
    both = both.select("provider", "installed", "closed", *(F.coalesce(c, F.lit(0)).alias(c) for c in (*fold.TOKENS, "usd", "unpriced", "windows")), "last_activity", "read_error")
    nothing = (F.col("windows") == 0) & F.col("last_activity").isNull()
    why = F.when(~F.col("installed"), "not-installed").when(nothing & F.col("closed").isNotNull(), F.col("closed"))
    why = why.when(nothing & F.col("read_error").isNotNull(), "read-error").when(F.col("windows") == 0, "never-reported")
    both = both.withColumn("unavailable", why).withColumn("reporting", F.col("installed")).drop("closed")
    return both.withColumn("awaiting_setup", F.coalesce(F.col("unavailable") == "never-reported", F.lit(False)) & (total() > 0))


def ranked(windows_: DataFrame) -> DataFrame:
    """Windows of each provider in order of their length."""
    return windows_.withColumn("place", F.row_number().over(W.partitionBy("provider").orderBy("window_minutes", "limit_id")))
