"""Quota windows: measured readings, plan ceilings, calibrated and derived estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import confidence, correction, implied_ceiling, percent_of, window_kind

#: Provider, plan, window minutes, USD of the window.
PLANS = (
    ("claude-code", "pro", 300, 5.0), ("claude-code", "pro", 10080, 35.0),
    ("claude-code", "max-5x", 300, 25.0), ("claude-code", "max-5x", 10080, 175.0),
    ("claude-code", "max-20x", 300, 100.0), ("claude-code", "max-20x", 10080, 700.0),
    ("copilot-cli", "pro", 43200, 15.0), ("copilot-cli", "pro-plus", 43200, 70.0), ("copilot-cli", "max", 43200, 200.0),
)
DEFAULT_LIMIT = {"claude-code": "claude", "codex": "codex", "copilot-cli": "copilot"}


def plan_ceilings(spark) -> DataFrame:
    return spark.createDataFrame(PLANS, "provider string, plan string, window_minutes bigint, ceiling_usd double")


def measured(latest: DataFrame, now: int) -> DataFrame:
    return latest.select(
        "provider", "limit_id", window_kind(F.col("window_minutes")).alias("kind"), "window_minutes", "used_percent", "resets_at",
        confidence(F.col("observed_at"), now).alias("confidence"), F.col("observed_at").alias("reported_at"), F.lit(None).cast("string").alias("basis"),
    )


def rolling_spend(series: DataFrame, windows: DataFrame, now: int, *keys: str) -> DataFrame:
    """windows (provider, window_minutes, keys) with usd and unpriced of [now - window, now)."""
    span = F.col("window_minutes") * 60
    hit = (F.col("start") >= F.lit(now) - span) & (F.col("start") < now)
    both = F.broadcast(windows).join(series.select("provider", "start", F.col("usd"), "unpriced"), "provider", "left")
    return both.groupBy("provider", "window_minutes", *keys).agg(F.coalesce(F.sum(F.when(hit, F.col("usd"))), F.lit(0)).cast("double").alias("spent"),
        F.coalesce(F.sum(F.when(hit, F.col("unpriced"))), F.lit(0)).alias("spent_unpriced"))


def calibration(measured_: DataFrame, series: DataFrame, ceilings: DataFrame, now: int) -> DataFrame:
    """provider, factor: of the first usable fresh reading in order of limit and window."""
    fresh = measured_.where("confidence = 'measured' and used_percent is not null").join(F.broadcast(ceilings), ["provider", "window_minutes"])
    spent = rolling_spend(series, fresh.select("provider", "limit_id", "window_minutes", "used_percent", "ceiling_usd"), now, "limit_id", "used_percent", "ceiling_usd")
    used = F.col("used_percent").cast("double")
    factor = correction(F.col("ceiling_usd"), implied_ceiling(used, F.col("spent"), F.col("spent_unpriced")))
    return spent.withColumn("factor", factor).where("factor is not null").groupBy("provider").agg(F.min_by("factor", F.struct("limit_id", "window_minutes")).alias("factor"))


def derived(measured_: DataFrame, series: DataFrame, ceilings: DataFrame, now: int, calibrated: bool = True) -> DataFrame:
    """Estimates for a plan's windows that nothing measured, stale readings included.

    calibrated: a fresh reading of another window corrects the plan's ceiling, else it stands as it is.
    """
    open_ = F.broadcast(ceilings).join(measured_.select("provider", "window_minutes").distinct(), ["provider", "window_minutes"], "left_anti")
    spent = rolling_spend(series, open_.select("provider", "window_minutes", "ceiling_usd"), now, "ceiling_usd")
    both = spent.where("spent_unpriced = 0")
    both = both.join(F.broadcast(calibration(measured_, series, ceilings, now)), "provider", "left") if calibrated else both.withColumn("factor", F.lit(1.0))
    used = percent_of(F.col("ceiling_usd") * F.coalesce("factor", F.lit(1.0)), F.col("spent"))
    limit = F.coalesce(*(F.when(F.col("provider") == p, x) for p, x in DEFAULT_LIMIT.items()))
    return both.select(
        "provider", limit.alias("limit_id"), window_kind(F.col("window_minutes")).alias("kind"), "window_minutes", used.alias("used_percent"), F.lit(None).cast("bigint").alias("resets_at"),
        F.lit("derived").alias("confidence"), F.lit(None).cast("bigint").alias("reported_at"), F.lit("token-window").alias("basis"),
    ).where("used_percent is not null")


def month_to_date(series: DataFrame, measured_: DataFrame, ceilings: DataFrame, month_start: int, next_month: int, now: int) -> DataFrame:
    """Month's spend against an allowance, only where no reading of this month was measured."""
    current = measured_.where(F.col("reported_at") >= month_start)
    open_ = ceilings.join(current.select("provider").distinct(), "provider", "left_anti")
    hit = (F.col("start") >= month_start) & (F.col("start") < now)
    spent = F.broadcast(open_).join(series, "provider", "left").groupBy("provider", "plan", "window_minutes",
        "ceiling_usd").agg(F.coalesce(F.sum(F.when(hit, F.col("usd"))), F.lit(0)).cast("double").alias("spent"),
        F.coalesce(F.sum(F.when(hit, F.col("unpriced"))), F.lit(0)).alias("open_tokens"))
    return spent.where("open_tokens = 0").select("provider", "plan", "window_minutes", percent_of(F.col("ceiling_usd"), F.col("spent")).alias("used_percent"),
        F.lit(next_month).cast("long").alias("resets_at"), F.lit("request-count").alias("basis"))
