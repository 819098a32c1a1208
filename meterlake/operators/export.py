"""The published state as JSON: one object a provider, with its windows and its history by hour."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age_seconds, instant
from .fold import TOKENS

#: Nulls are written, as a reader expects every key.
_NULLS = {"ignoreNullFields": "false"}
_CAMEL = {"cache_read": "cacheRead", "cache_creation": "cacheCreation"}


def _tokens() -> Column:
    return F.struct(*(F.col(c).alias(_CAMEL.get(c, c)) for c in TOKENS))


def _cost() -> Column:
    return F.struct(F.col("usd").cast("decimal(38,6)").alias("usd"), F.col("unpriced").alias("unpricedTokens"))


def _instant(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), instant(F.col(c)))


def window_objects(windows_: DataFrame, now: int) -> DataFrame:
    """provider, windows: an array of objects in order of length and limit, a row a provider."""
    level = F.struct(
        F.col("confidence").alias("level"), _instant("reported_at").alias("reportedAt"), F.col("basis").alias("basis"),
        F.when(F.col("confidence") == "stale", age_seconds(F.col("reported_at"), now)).alias("ageSeconds"),
    )
    one = F.struct(
        F.col("window_minutes").alias("windowMinutes"), F.col("limit_id").alias("limitId"), F.col("kind").alias("kind"), F.col("used_percent").cast("decimal(9,3)").alias("usedPercent"),
        _instant("resets_at").alias("resetsAt"), level.alias("confidence"),
    )
    return windows_.groupBy("provider").agg(F.array_sort(F.collect_list(one)).alias("windows"))


def series_objects(series: DataFrame) -> DataFrame:
    """provider, series: an array of buckets in order of their start; a snapshot's series is trimmed, which bounds it."""
    one = F.struct(
        F.col("start").alias("start"), _tokens().alias("tokens"), F.col("requests").cast("decimal(18,6)").alias("requests"),
        F.col("usd").cast("decimal(38,6)").alias("costUsd"), F.col("unpriced").alias("unpricedTokens"),
    )
    return series.groupBy("provider").agg(F.array_sort(F.collect_list(one)).alias("series"))


def pace_objects(windows_: DataFrame) -> DataFrame:
    """provider, pace: the forecasts of its windows that have one, in order of limit and length."""
    one = F.struct(
        F.col("limit_id").alias("limitId"), F.col("window_minutes").alias("windowMinutes"), F.col("projected_percent").cast("decimal(9,3)").alias("projectedPercent"), "risk",
        _instant("exhausted_at").alias("exhaustedAt"),
    )
    return windows_.where("projected_percent is not null").groupBy("provider").agg(F.array_sort(F.collect_list(one)).alias("pace"))


def _burst() -> Column:
    b = F.col("burst")
    cost = F.struct(b["usd"].cast("decimal(38,6)").alias("usd"), b["unpriced"].alias("unpricedTokens"))
    return F.when(b.isNotNull(), F.struct(instant(b["since"]).alias("since"), b["tokens"].alias("tokens"), cost.alias("cost"), b["factor"].cast("decimal(9,3)").alias("factor")))


def provider_objects(providers: DataFrame, windows_: DataFrame, series: DataFrame, now: int) -> DataFrame:
    """provider, json: the snapshot of a provider.

    providers has a column burst; windows_ their forecasts (with_pace); series is trimmed to what is shown.
    """
    both = providers.drop("windows")
    for name, part in (("windows", window_objects(windows_, now)), ("series", series_objects(series)), ("pace", pace_objects(windows_))):
        both = both.join(part, "provider", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    whole = F.struct(
        F.col("provider").alias("id"), "installed", "windows", _tokens().alias("today"), _cost().alias("todayCost"), "series", "pace",
        _instant("last_activity").alias("lastActivity"), "unavailable", F.col("read_error").alias("readError"), _burst().alias("burst"),
    )
    return both.select("provider", F.to_json(whole, _NULLS).alias("json"))


def history_objects(hours: DataFrame, breakdown_: DataFrame, dropped: DataFrame) -> DataFrame:
    """provider, dimension, json: the hours of a provider's totals and of each dimension; retention and label cap bound a row."""
    whole = hours.select("provider", F.lit("total").alias("dimension"), "hour", F.lit(None).cast("string").alias("label"), *TOKENS, "usd", "unpriced")
    rows = whole.unionByName(breakdown_.select(whole.columns))
    point = F.struct(F.col("hour").alias("start"), "label", _tokens().alias("tokens"), _cost().alias("cost"))
    lists = rows.groupBy("provider", "dimension").agg(F.array_sort(F.collect_list(point)).alias("hours"))
    both = lists.join(F.broadcast(dropped), ["provider", "dimension"], "left")
    return both.select("provider", "dimension", F.to_json(F.struct(F.coalesce("labels_dropped", F.lit(0)).alias("dropped"), "hours"), _NULLS).alias("json"))


def document(providers: DataFrame, history: DataFrame, now_text: str, scanning: bool = False) -> str:
    """The whole export as text, from a row a provider and a row a dimension."""
    past: dict[str, dict] = {}
    for r in history.collect():
        past.setdefault(r["provider"], {"id": r["provider"]})[r["dimension"]] = json.loads(r["json"])
    shown = [json.loads(r["json"]) for r in providers.orderBy("provider").collect()]
    return json.dumps({"updatedAt": now_text, "scanning": scanning, "providers": shown, "history": [past[p] for p in sorted(past)]}, indent=2)
