"""How numbers and instants are shown: durations, tokens, percents, factors, costs, clocks and dates. Pure functions of a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def duration(seconds: Column) -> Column:
    """2d 3h, 4h 05m or 6m."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    days, hours, minutes = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    long = F.concat(_text(days), F.lit("d "), _text(hours), F.lit("h"))
    middle = F.concat(_text(hours), F.lit("h "), F.lpad(_text(minutes), 2, "0"), F.lit("m"))
    return F.when(days > 0, long).when(hours > 0, middle).otherwise(F.concat(_text(minutes), F.lit("m")))


def span(seconds: Column) -> Column:
    """Whole days or hours as such, anything else as a duration."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    whole = lambda unit: (s >= unit) & (F.pmod(s, F.lit(unit)) == 0)
    return F.when(whole(86400), F.concat(_text(s / 86400), F.lit("d"))).when(whole(3600), F.concat(_text(s / 3600), F.lit("h"))).otherwise(duration(s))


def tokens(count: Column) -> Column:
    """1.2K, 3.4M, 5.6B, or the number itself below a thousand."""
    out = F.format_number(count, 0)
    for unit, letter in ((1_000, "K"), (1_000_000, "M"), (1_000_000_000, "B")):
        out = F.when(count >= unit, F.concat(F.format_number(count / unit, 1), F.lit(letter))).otherwise(out)
    return out


def percent(value: Column) -> Column:
    return F.concat(F.format_number(F.floor(value + 0.5), 0), F.lit("%"))


def factor(value: Column) -> Column:
    return F.when(value >= 10, F.format_number(value, 0)).otherwise(F.regexp_replace(F.format_number(value, 1), r"\.0$", ""))


def cost(usd: Column) -> Column:
    """$12, $1.23, <$0.01 or $0."""
    dollar = lambda digits: F.concat(F.lit("$"), F.format_number(usd, digits))
    return F.when(usd >= 10, dollar(0)).when(usd >= 0.01, dollar(2)).when(usd > 0, "<$0.01").otherwise("$0")


def relative(at: Column, now: int) -> Column:
    """How long ago; null stays null."""
    gone = F.greatest(F.lit(now) - at, F.lit(0))
    return F.when(at.isNull(), F.lit(None).cast("string")).when(gone < 60, "just now").otherwise(duration(gone))


def _local(at: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(at).cast("timestamp_ntz").cast("string"), zone)


def clock(at: Column, zone: str = "UTC") -> Column:
    """14:05, in a zone."""
    return F.date_format(_local(at, zone), "HH:mm")


def date(at: Column, zone: str = "UTC") -> Column:
    """3 Feb, in a zone."""
    return F.date_format(_local(at, zone), "d MMM")


def alert_text(provider: Column, kind: Column, used: Column, left: Column) -> Column:
    """The sentence of an alert; `left` is the seconds to the reset, or null."""
    head = F.concat(provider, F.lit(": "), kind, F.lit(" window at "), percent(used))
    return F.when(left.isNull(), head).otherwise(F.concat(head, F.lit(", resets in "), duration(left)))
