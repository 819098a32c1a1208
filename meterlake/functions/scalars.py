"""Scalar rules as column expressions. Instants are whole epoch seconds (bigint)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_SECONDS, HOUR_SECONDS, STALE_SECONDS = 300, 3600, 1800


def epoch_seconds(ntz: Column) -> Column:
    """Whole seconds of a TIMESTAMP_NTZ read as UTC, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)


def floor_to(at: Column, seconds: int) -> Column:
    return (F.floor(at / F.lit(seconds)) * seconds).cast("long")


def window_kind(minutes: Column) -> Column:
    return F.when(minutes.between(1, 360), "session").when(minutes.between(9000, 11520), "weekly").when(minutes.between(40000, 46080), "monthly").otherwise("other")


def age_seconds(reported: Column, now: int) -> Column:
    return F.greatest(F.lit(now) - reported, F.lit(0)).cast("long")


def confidence(reported: Column, now: int) -> Column:
    return F.when(age_seconds(reported, now) > STALE_SECONDS, "stale").otherwise("measured")


def resets_in(resets_at: Column, now: int) -> Column:
    return F.when(resets_at > now, resets_at - now)


def pace_risk(percent: Column) -> Column:
    return F.when(percent < 90, "healthy").when(percent <= 100, "at-risk").otherwise("over")


def level(percent: Column) -> Column:
    return F.when(percent > 85, "critical").when(percent >= 60, "tight").otherwise("ample")


def total(c=F.col) -> Column:
    """Tokens of a row; reasoning is a part of output and not added."""
    return c("input") + c("output") + c("cache_read") + c("cache_creation")


def is_zero(c=F.col) -> Column:
    return (total(c) == 0) & (c("reasoning") == 0)


def normalise_model(model: Column) -> Column:
    m = F.lower(F.trim(model))
    for prefix in (r"anthropic\.", "anthropic/", r"us\.", r"eu\.", r"apac\."):
        m = F.regexp_replace(m, "^" + prefix, "")
    return F.regexp_replace(F.regexp_replace(m, r"-v1:0$", ""), r"-[0-9]{8}$", "")


def implied_ceiling(percent: Column, usd: Column, unpriced: Column) -> Column:
    """What the whole window holds, from a reading that is neither too small nor full."""
    return F.when((percent >= 15) & (percent < 99) & (unpriced == 0) & (usd > 0), usd / (percent / 100))


def correction(seed: Column, implied: Column) -> Column:
    f = F.try_divide(implied, seed)
    return F.when((seed > 0) & f.between(0.1, 10), f)


def percent_of(ceiling: Column, spent: Column) -> Column:
    ok = (ceiling > 0) & ~F.isnan(ceiling) & (ceiling != float("inf"))
    return F.when(ok, F.least(F.greatest(F.try_divide(spent, ceiling) * 100, F.lit(0.0)), F.lit(999.0)).cast("float"))


def week_slot(at: Column) -> Column:
    """Hour of the week in UTC, Monday 00:00 being 0 (the epoch was a Thursday)."""
    return F.pmod(F.floor(at / F.lit(3600)) + 72, F.lit(168)).cast("int")


def instant(at: Column) -> Column:
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / F.lit(86400)).cast("int")).cast("string")
    second = F.pmod(at, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(days, F.lit("T"), two(second / 3600), F.lit(":"), two(F.pmod(second, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(second, F.lit(60))), F.lit("Z"))


def dollars(usd: Column, unpriced: Column) -> Column:
    return F.when((usd == 0) & (unpriced > 0), "").otherwise(F.round(usd, 6).cast("decimal(38,6)").cast("string"))


def csv_cell(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def highest_crossed(thresholds: Column, percent: Column) -> Column:
    return F.array_max(F.filter(thresholds, lambda t: percent >= t))
